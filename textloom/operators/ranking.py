"""Fusion, reranking and comparison of ranked lists. A run has query_id, chunk_id, rank and score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["query_id", "chunk_id"]
# Bonuses by category.
DIALECT_BONUS = {"compatible": 0.004, "related": 0.003, "unknown": 0.002, "incompatible": 0.0}
VERSION_BONUS = {"compatible": 0.002, "general": 0.0006, "unknown": 0.0004, "not_applicable": 0.0004, "incompatible": 0.0}
COMBINED_VERSION_BONUS = {"compatible": 0.005, "general": 0.0015, "unknown": 0.001, "not_applicable": 0.001, "incompatible": 0.0}
PROBLEM, SQL, ERROR, EXACT, GAMMA = 0.8, 0.8, 1.5, 2.0, 0.001


def rrf(lexical: DataFrame, dense: DataFrame, k: int = 60, depth: int = 30, out: int | None = 30) -> DataFrame:
    """Reciprocal rank fusion: (query_id, chunk_id, score, lexical_rank, dense_rank, rank). Each list is cut at depth
    first; order: score, best component rank, id. out None keeps every candidate."""
    a = lexical.filter(F.col("rank") <= depth).select(*KEYS, F.col("rank").alias("lexical_rank"))
    b = dense.filter(F.col("rank") <= depth).select(*KEYS, F.col("rank").alias("dense_rank"))
    part = lambda c: F.coalesce(F.lit(1.0) / (k + F.col(c)), F.lit(0.0))
    both = a.join(b, KEYS, "full_outer").withColumn("score", F.round(part("lexical_rank") + part("dense_rank"), 12))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.least("lexical_rank", "dense_rank"), "chunk_id")
    fused = both.withColumn("rank", F.row_number().over(order))
    return fused if out is None else fused.filter(F.col("rank") <= out)


def bonus(category: Column, values: dict[str, float]) -> Column:
    found = F.lit(0.0)
    for name, value in values.items():
        found = F.when(category == name, value).otherwise(found)
    return found


def metadata_rerank(candidates: DataFrame, *bonuses: Column) -> DataFrame:
    """Adds bonuses to the score; order: adjusted score, former rank, id. Nothing is filtered. The new rank is
    metadata_rank."""
    total = F.col("score")
    for b in bonuses:
        total = total + b
    order = Window.partitionBy("query_id").orderBy(F.desc("adjusted"), "rank", "chunk_id")
    return candidates.withColumn("adjusted", F.round(total, 12)).withColumn("metadata_rank", F.row_number().over(order))


def min_max(column: str, by: str = "query_id") -> Column:
    """Scaled to [0, 1] within each query; 0 where all values are equal."""
    w = Window.partitionBy(by)
    low, high = F.min(column).over(w), F.max(column).over(w)
    return F.when(high == low, 0.0).otherwise((F.col(column) - low) / (high - low))


def field_rerank(candidates: DataFrame, depth: int = 30) -> DataFrame:
    """candidates: metadata_rerank's rows with problem, sql, error (field scores) and exact (error identifiers found). Each
    field score is scaled within the query's candidates; their weighted sum is added to the adjusted score."""
    fields = PROBLEM * min_max("problem") + SQL * min_max("sql") + ERROR * min_max("error") + EXACT * F.col("exact")
    scored = candidates.withColumn("lexical", F.round(fields, 9)).withColumn("final", F.round(F.col("adjusted") + GAMMA * F.col("lexical"), 12))
    order = Window.partitionBy("query_id").orderBy(F.desc("final"), "metadata_rank", "rank", "chunk_id")
    return scored.withColumn("field_rank", F.row_number().over(order)).filter(F.col("field_rank") <= depth)


def exact_errors(text: Column, *values: Column) -> Column:
    """How many of the identifiers the passage holds; one that stands in two fields counts twice."""
    folded = F.lower(text)
    return F.size(F.filter(F.array(*values), lambda v: F.coalesce((v != "") & F.contains(folded, F.lower(v)), F.lit(False)))).cast("long")


def lists(run: DataFrame, k: int) -> DataFrame:
    """(query_id, ids): the k first of each query, in order."""
    return run.filter(F.col("rank") <= k).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("ids"))


def paired(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    none = F.array().cast("array<long>")
    return lists(a, k).withColumnRenamed("ids", "a").join(lists(b, k).withColumnRenamed("ids", "b"), "query_id", "full_outer").select("query_id", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))


def rbo(a: Column, b: Column, p: float = 0.9) -> Column:
    """Rank-biased overlap of two lists to their common depth, with the last agreement carried on."""
    depth = F.least(F.size(a), F.size(b))
    agree = lambda d: F.size(F.array_intersect(F.slice(a, 1, d), F.slice(b, 1, d))) / d
    body = F.aggregate(F.sequence(F.lit(1), depth), F.lit(0.0), lambda s, d: s + agree(d) * F.pow(F.lit(p), d - 1))
    return F.when(depth > 0, (1 - p) * body + F.pow(F.lit(p), depth) * agree(depth)).otherwise(0.0)


def kendall_tau(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(query_id, common, tau) over the ids that both lists have; null for fewer than two. Lists have k ids at most."""
    both = a.filter(F.col("rank") <= k).select(*KEYS, F.col("rank").alias("ra")).join(b.filter(F.col("rank") <= k).select(*KEYS, F.col("rank").alias("rb")), KEYS)
    pairs = both.groupBy("query_id").agg(F.collect_list(F.struct("ra", "rb")).alias("x"))
    signs = lambda x: F.aggregate(x, F.lit(0), lambda s, i: s + F.aggregate(x, F.lit(0), lambda t, j: t + F.when(i["ra"] < j["ra"], F.signum(j["rb"] - i["rb"]).cast("int")).otherwise(0)))
    n = F.size("x")
    return pairs.select("query_id", n.cast("long").alias("common"), F.when(n > 1, signs(F.col("x")) / (n * (n - 1) / 2)).alias("tau"))


def run_faults(run: DataFrame) -> DataFrame:
    """One row per query: whether pairs are unique, ranks run from 1 without a gap, and scores are finite and descend."""
    w = Window.partitionBy("query_id").orderBy("rank")
    bad = F.isnan("score") | (F.abs("score") == float("inf")) | F.col("score").isNull()
    marked = run.withColumn("rises", F.coalesce(F.col("score") > F.lag("score").over(w), F.lit(False))).withColumn("bad", bad)
    return marked.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), (F.countDistinct("chunk_id") == F.count(F.lit(1))).alias("unique_pairs"),
        ((F.max("rank") == F.count(F.lit(1))) & (F.countDistinct("rank") == F.count(F.lit(1))) & (F.min("rank") == 1)).alias("contiguous"),
        (~F.bool_or("bad")).alias("finite"), (~F.bool_or("rises")).alias("descending"),
    )
