"""Retrieval metrics over runs and qrels, slices, pooling audits, resampling and agreement.

An unjudged pair is a null after the left join and never a 0; denominators stay k for short lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.numbering import numbered
from textloom.operators.ranking import KEYS


def _dcg(grade: Column, rank: Column, k: int) -> Column:
    return F.sum(F.when(rank <= k, (F.pow(F.lit(2.0), F.coalesce(grade, F.lit(0))) - 1) / F.log2(rank + 1.0)).otherwise(0.0))


def grades(qrels: DataFrame) -> DataFrame:
    """(query_id, relevance, n): how often a query has each grade."""
    return qrels.groupBy("query_id", "relevance").agg(F.count(F.lit(1)).alias("n"))


def per_query(run: DataFrame, qrels: DataFrame, universe: DataFrame) -> DataFrame:
    """One row per query of universe, zeros where the run has none of it: ndcg_10, mrr_10, recall_5/10/20, p_5,
    hit_5/10 (relevance 2), recall_any_10 (1 or 2), judged_5/10/20/30."""
    return per_query_of(run.select(*KEYS, "rank").join(qrels, KEYS, "left"), grades(qrels), universe)


def per_query_of(joined: DataFrame, grades: DataFrame, universe: DataFrame) -> DataFrame:
    """per_query of a run whose rows have their relevance (null: not judged) and of what grades() gives: the judgments of
    other pairs only count. The best possible list takes ten of a grade at most."""
    w = Window.partitionBy("query_id").orderBy(F.desc("relevance"))
    tops = grades.select("query_id", "relevance", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(10)).cast("int")))).withColumn("i", F.row_number().over(w))
    totals = grades.groupBy("query_id").agg(*[F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)).alias(name) for name, which in (("n2", F.col("relevance") == 2), ("n1", F.col("relevance") >= 1))])
    ideal = tops.groupBy("query_id").agg(_dcg(F.col("relevance"), F.col("i"), 10).alias("ideal")).join(totals, "query_id")
    rel, rank = F.col("relevance"), F.col("rank")
    count = lambda what, k: F.count(F.when(what & (rank <= k), 1))
    got = joined.groupBy("query_id").agg(
        _dcg(rel, rank, 10).alias("dcg"), F.min(F.when((rel == 2) & (rank <= 10), rank)).alias("first"),
        *[count(rel == 2, k).alias(f"r{k}") for k in (5, 10, 20)], count(rel >= 1, 10).alias("any10"), *[count(rel.isNotNull(), k).alias(f"j{k}") for k in (5, 10, 20, 30)],
    )
    share = lambda a, b: F.coalesce(F.when(F.col(b) > 0, F.col(a) / F.col(b)), F.lit(0.0))
    rounded = lambda c, name: F.round(c, 6).alias(name)
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return universe.select("query_id").distinct().join(got, "query_id", "left").join(ideal, "query_id", "left").select(
        "query_id", rounded(share("dcg", "ideal"), "ndcg_10"), rounded(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), "mrr_10"),
        *[rounded(share(f"r{k}", "n2"), f"recall_{k}") for k in (5, 10, 20)], rounded(n("r5") / 5, "p_5"),
        *[(n(f"r{k}") > 0).cast("double").alias(f"hit_{k}") for k in (5, 10)], rounded(share("any10", "n1"), "recall_any_10"),
        *[rounded(n(f"j{k}") / k, f"judged_{k}") for k in (5, 10, 20, 30)],
    )


def any_relevance(run: DataFrame, qrels: DataFrame, universe: DataFrame) -> DataFrame:
    """One row per query of universe, relevance 1 or 2 counting alike: mrr_10_any, recall_5/10/20_any, p_5_any, hit_5_any."""
    return any_relevance_of(run.select(*KEYS, "rank").join(qrels, KEYS, "left"), grades(qrels), universe)


def any_relevance_of(joined: DataFrame, grades: DataFrame, universe: DataFrame) -> DataFrame:
    """any_relevance of a run whose rows have their relevance (null: not judged) and of what grades() gives."""
    good = grades.filter("relevance >= 1").groupBy("query_id").agg(F.sum("n").alias("n"))
    hits = joined.filter("relevance >= 1")
    count = lambda k: F.count(F.when(F.col("rank") <= k, 1))
    got = hits.groupBy("query_id").agg(F.min(F.when(F.col("rank") <= 10, F.col("rank"))).alias("first"), *[count(k).alias(f"r{k}") for k in (5, 10, 20)])
    joined = universe.select("query_id").distinct().join(got, "query_id", "left").join(good, "query_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    recall = lambda k: F.round(F.when(n("n") > 0, n(f"r{k}") / n("n")).otherwise(0.0), 6).alias(f"recall_{k}_any")
    return joined.select("query_id", F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr_10_any"), *map(recall, (5, 10, 20)), F.round(n("r5") / 5, 6).alias("p_5_any"), (n("r5") > 0).cast("double").alias("hit_5_any"))


def macro(metrics: DataFrame, names: list[str]) -> DataFrame:
    return metrics.agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in names])


def sliced(metrics: DataFrame, slices: DataFrame, names: list[str], least: int = 30) -> DataFrame:
    """slices: (slice_name, slice_value, query_id). A slice without queries has null means; small marks under least."""
    joined = slices.join(metrics, "query_id", "left")
    seen = F.count(F.col(names[0]))
    return joined.groupBy("slice_name", "slice_value").agg(seen.alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in names]).withColumn("small", F.col("queries") < least)


def unjudged(runs: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Pairs of a top k that no one has judged, with each system's rank: runs has a column system."""
    return unjudged_of(runs.join(qrels.select(*KEYS, "relevance"), KEYS, "left"), k)


def unjudged_of(runs: DataFrame, k: int) -> DataFrame:
    """unjudged of runs whose rows have their relevance, null where no one has judged."""
    missing = runs.filter((F.col("rank") <= k) & F.col("relevance").isNull())
    return missing.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("systems"), F.min("rank").alias("best_rank"), F.array_join(F.array_sort(F.collect_list("system")), ",").alias("retrieved_by"))


def judged_share(runs: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    return judged_share_of(runs.join(qrels.select(*KEYS, "relevance"), KEYS, "left"), k)


def judged_share_of(runs: DataFrame, k: int) -> DataFrame:
    """judged_share of runs whose rows have their relevance, null where no one has judged."""
    marked = runs.filter(F.col("rank") <= k).withColumn("judged", F.col("relevance").isNotNull().cast("int"))
    return marked.groupBy("system").agg(F.countDistinct("query_id").alias("queries"), F.sum(F.coalesce("judged", F.lit(0))).alias("judged")).withColumn("share", F.round(F.col("judged") / (F.col("queries") * k), 6))


def complementarity(a: DataFrame, b: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """One row: mean Jaccard of the two top k, and how many queries either, both or none finds a relevance 2 for."""
    hit = lambda run, name: run.filter(F.col("rank") <= k).join(qrels.filter("relevance = 2"), KEYS, "left_semi").select("query_id").distinct().withColumn(name, F.lit(1))
    from textloom.operators.ranking import paired

    both = paired(a, b, k).withColumn("j", F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")))
    marked = both.join(hit(a, "ha"), "query_id", "left").join(hit(b, "hb"), "query_id", "left").na.fill(0, ["ha", "hb"])
    n = lambda x, y: F.count(F.when((F.col("ha") == x) & (F.col("hb") == y), 1))
    return marked.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("j"), 6).alias("mean_jaccard"), n(1, 1).alias("both"), n(1, 0).alias("only_a"), n(0, 1).alias("only_b"), n(0, 0).alias("neither"), F.round(F.avg(F.greatest("ha", "hb")), 6).alias("union_hit_rate"))


def drawn(seed: int, draw: Column, n: Column) -> Column:
    """A number from 0 to n - 1 for a draw, named by a string: the first 15 hexadecimal digits of an MD5, mod n. Every
    engine and cluster draws alike."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), draw)), 1, 15), 16, 10).cast("long"), n)


def bootstrap(values: DataFrame, column: str, rounds: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """One row: mean, low and high of the percentile interval of the mean. Each round draws as many values as there are,
    with replacement; draw d of round b takes the value at place drawn(seed, "b:d", n) in the order of query_id. values has
    one row a query; the rounds * n draws are spread over all tasks. No values give nulls."""
    spark = values.sparkSession
    places = numbered(values.select("query_id", F.col(column).alias("x")), ["query_id"], "i").select("i", "x")
    n = places.count()
    draws = spark.range(rounds * n).select(F.floor(F.col("id") / max(1, n)).alias("b"), (F.col("id") % max(1, n)).alias("d"))
    draws = draws.select("b", drawn(seed, F.concat_ws(":", "b", "d"), F.lit(max(1, n)).cast("long")).alias("i"))
    means = draws.join(places, "i").groupBy("b").agg(F.avg("x").alias("m"))
    low, high = (1 - level) / 2, 1 - (1 - level) / 2
    return means.agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.percentile("m", F.lit(low)), 6).alias("low"), F.round(F.percentile("m", F.lit(high)), 6).alias("high"))


def wins(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: queries in which a, or b, does better, ties, and the mean difference. Both must have the same queries."""
    both = a.select("query_id", F.col(column).alias("a")).join(b.select("query_id", F.col(column).alias("b")), "query_id", "full_outer")
    checked = both.withColumn("ok", F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("the systems have different queries"))).otherwise(F.lit(True)))
    return checked.filter("ok is null or ok").agg(F.count(F.when(F.col("a") > F.col("b"), 1)).alias("wins_a"), F.count(F.when(F.col("b") > F.col("a"), 1)).alias("wins_b"), F.count(F.when(F.col("a") == F.col("b"), 1)).alias("ties"), F.round(F.avg(F.col("a") - F.col("b")), 6).alias("mean_difference"))


def kappa(pairs: DataFrame, a: str, b: str, quadratic: bool = False) -> DataFrame:
    """One row: n, agreement and Cohen's kappa of two columns of grades; quadratic weighs by squared distance. What chance
    would give follows from sums over the grades, so no pair of grades is made that does not occur."""
    cells = pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    n, apart = F.col("n"), F.col("a") - F.col("b")
    w = apart * apart if quadratic else F.when(F.col("a") == F.col("b"), 0).otherwise(1)
    one = cells.agg(F.sum(n).alias("t"), F.sum(F.when(F.col("a") == F.col("b"), n).otherwise(0)).alias("same"), F.sum(w * n).alias("seen"), *[F.sum(x * n).cast("double").alias(name) for name, x in (("sa", F.col("a")), ("sb", F.col("b")), ("qa", F.col("a") * F.col("a")), ("qb", F.col("b") * F.col("b")))])
    t = F.col("t")
    if quadratic:
        expected = ((F.col("qa") + F.col("qb")) * t - 2 * F.col("sa") * F.col("sb")) / (t * t)
    else:
        rows, cols = cells.groupBy("a").agg(F.sum("n").alias("ra")), cells.groupBy("b").agg(F.sum("n").alias("cb"))
        met = rows.join(cols, rows["a"] == cols["b"]).agg(F.sum(F.col("ra") * F.col("cb")).alias("met"))
        one = one.crossJoin(met)  # one row each
        expected = 1 - F.coalesce("met", F.lit(0)) / (t * t)
    return one.select(t.alias("n"), F.round(F.col("same") / t, 6).alias("agreement"), F.round(1 - F.col("seen") / t / expected, 6).alias("kappa"))
