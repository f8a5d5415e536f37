"""Comparisons of systems: judged answers, score differences, rankings, cases, failures, gates, sensitivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import ranking


def rate(c: Column) -> Column:
    """The share of rows where c is true; a null is a failure and stays in the count."""
    return F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)


def bounded_mean(c: Column) -> Column:
    """The mean of scores from 0 to 1; a missing one counts as 0, one out of range is an error."""
    score = F.coalesce(c, F.lit(0.0))
    return F.round(F.avg(F.when(score.between(0, 1), score).otherwise(F.raise_error(F.lit("a score lies outside of 0 to 1")).cast("double"))), 6)


def judged(rows: DataFrame, by: list[str], flags: list[str], scores: list[str], status: str, retries: str) -> DataFrame:
    """Per group: results, successes, failures, retries, such as came right after one, the rate of each flag and the mean of
    each score. Failures stay in every denominator."""
    good = F.coalesce(F.col(status) == "success", F.lit(False))
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("results"), n(good, "successes"), n(~good, "failures"), F.sum(F.coalesce(retries, F.lit(0))).alias("retries"), n(good & (F.coalesce(retries, F.lit(0)) > 0), "recovered"),
        *[rate(F.col(c)).alias(c) for c in flags], *[bounded_mean(F.col(c)).alias(c) for c in scores],
    )


def score_differences(a: DataFrame, b: DataFrame, digits: int = 8) -> DataFrame:
    """One row over the pairs that both runs have: compared, equal after rounding (and their share), mean and greatest
    absolute difference; nulls where nothing is compared."""
    both = a.select(*ranking.KEYS, F.round("score", digits).alias("x")).join(b.select(*ranking.KEYS, F.round("score", digits).alias("y")), ranking.KEYS)
    gap = F.round(F.abs(F.col("x") - F.col("y")), digits)
    return both.agg(F.count(F.lit(1)).alias("compared"), F.count(F.when(gap == 0, 1)).alias("equal"), F.round(F.avg((gap == 0).cast("int")), 6).alias("equal_share"), F.round(F.avg(gap), 9).alias("mean_difference"), F.round(F.max(gap), 9).alias("greatest_difference"))


def compared(a: DataFrame, b: DataFrame, k: int, tau_k: int) -> DataFrame:
    """One row over the queries of either run: equal sequences and sets (and their shares), mean overlap, Jaccard, rank-biased
    overlap, and mean Kendall correlation of those with two common ids or more."""
    both = ranking.paired(a, b, k)
    shared, union = F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))
    same_set = (F.size(F.array_except("a", "b")) == 0) & (F.size(F.array_except("b", "a")) == 0)
    per = both.select("query_id", (F.col("a") == F.col("b")).alias("sequence"), same_set.alias("set"), (shared / F.greatest(F.lit(1), F.size("b"))).alias("overlap"), (shared / F.greatest(F.lit(1), union)).alias("jaccard"), ranking.rbo(F.col("a"), F.col("b")).alias("rbo"))
    joined = per.join(ranking.kendall_tau(a, b, tau_k).select("query_id", "tau"), "query_id", "left")
    mean = lambda c: F.round(F.avg(c), 6).alias(f"mean_{c}")
    return joined.agg(
        F.count(F.lit(1)).alias("queries"), F.count(F.when(F.col("sequence"), 1)).alias("equal_sequences"), F.count(F.when(F.col("set"), 1)).alias("equal_sets"),
        rate(F.col("sequence")).alias("sequence_share"), rate(F.col("set")).alias("set_share"), *map(mean, ("overlap", "jaccard", "rbo", "tau")),
    )


def cases(a: DataFrame, b: DataFrame, column: str, n: int) -> DataFrame:
    """The n queries that gain most from a to b, and the n that lose most, by id where equal: kind, place, query_id, delta."""
    deltas = a.select("query_id", F.col(column).alias("x")).join(b.select("query_id", F.col(column).alias("y")), "query_id").select("query_id", F.round(F.col("y") - F.col("x"), 9).alias("delta")).filter("delta != 0")
    marked = deltas.withColumn("kind", F.when(F.col("delta") > 0, "gain").otherwise("loss"))
    order = Window.partitionBy("kind").orderBy(F.desc(F.abs("delta")), "query_id")
    return marked.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).select("kind", "place", "query_id", "delta")


def first_relevant(run: DataFrame, qrels: DataFrame, name: str) -> DataFrame:
    """(query_id, name): the first rank of relevance 2."""
    return run.join(qrels.filter("relevance = 2"), ranking.KEYS).groupBy("query_id").agg(F.min("rank").alias(name))


def failures(universe: DataFrame, a: DataFrame, b: DataFrame, qrels: DataFrame, k: int, n: int) -> DataFrame:
    """What became of each query in two systems, by the first relevant rank of either: the n first of each category, and how
    many it has. Categories: both_miss, only_a, only_b, both_late (none in the first 5), regressed, improved."""
    ranks = universe.select("query_id").distinct().join(first_relevant(a, qrels, "ra"), "query_id", "left").join(first_relevant(b, qrels, "rb"), "query_id", "left")
    in_a, in_b = F.coalesce(F.col("ra") <= k, F.lit(False)), F.coalesce(F.col("rb") <= k, F.lit(False))
    rules = (("both_miss", ~in_a & ~in_b), ("only_a", in_a & ~in_b), ("only_b", ~in_a & in_b), ("both_late", in_a & in_b & (F.col("ra") > 5) & (F.col("rb") > 5)), ("regressed", in_a & in_b & (F.col("rb") > F.col("ra"))), ("improved", in_a & in_b & (F.col("rb") < F.col("ra"))))
    found = ranks.select("query_id", "ra", "rb", F.explode(F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules]))).alias("category"))
    w = Window.partitionBy("category")
    return found.withColumn("place", F.row_number().over(w.orderBy("query_id"))).withColumn("queries", F.count(F.lit(1)).over(w)).filter(F.col("place") <= n)


def gates(metrics: DataFrame, rules: dict[str, tuple[str, float]]) -> DataFrame:
    """metrics: rows with metric, control and candidate, and any other columns. rules: metric to (kind, limit): "at_least" and "at_most" bound the
    candidate, "falls_by" asks for a relative reduction, "drops_by" bounds an absolute loss. A missing value fails."""
    x, c = F.col("candidate"), F.col("control")
    held = {"at_least": lambda v: x + 1e-15 >= v, "at_most": lambda v: x - 1e-15 <= v, "falls_by": lambda v: (c > 0) & ((c - x) / c + 1e-15 >= v), "drops_by": lambda v: x + 1e-15 >= c - v}
    rows = [F.when(F.col("metric") == name, F.struct(F.lit(kind).alias("kind"), F.lit(float(limit)).alias("limit"), F.coalesce(held[kind](limit), F.lit(False)).alias("passed"))) for name, (kind, limit) in rules.items()]
    return metrics.withColumn("r", F.coalesce(*rows)).filter("r is not null").select(*metrics.columns, "r.kind", "r.limit", "r.passed")


def sensitivity(metrics: DataFrame, passes: Column, names: list[str]) -> DataFrame:
    """(metric, passes, spread): the greatest less the least mean of each metric over the passes."""
    means = metrics.groupBy(passes.alias("_pass")).agg(*[F.avg(c).alias(c) for c in names])
    long = means.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in names])).alias("x")).select("x.*")
    return long.groupBy("metric").agg(F.count("v").alias("passes"), F.round(F.max("v") - F.min("v"), 6).alias("spread"))


def evidence(items: DataFrame, known: DataFrame) -> DataFrame:
    """items: query_id, dialect, ids (array). known: id, dialect. Per query: ids named, such as nothing is known of, and such
    as are of another dialect. Repeats count."""
    named = items.select("query_id", "dialect", F.explode_outer("ids").alias("id"))
    joined = named.join(known.select("id", F.col("dialect").alias("own"), F.lit(True).alias("there")), "id", "left")
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return joined.groupBy("query_id").agg(n(F.col("id").isNotNull(), "named"), n(F.col("id").isNotNull() & F.col("there").isNull(), "missing"), n(F.coalesce(F.col("own") != F.col("dialect"), F.lit(False)), "other_dialect"))


def totals(parts: DataFrame, columns: list[str]) -> DataFrame:
    """One row: sums over components, as estimates of what a whole takes."""
    return parts.agg(F.count(F.lit(1)).alias("components"), *[F.round(F.sum(c), 6).alias(c) for c in columns])


def containment(a: Column, b: Column) -> Column:
    """The share of a's distinct tokens that b has; 0 for no tokens."""
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_distinct(a)))


def sentence_copied(query: Column, text: Column, least: int = 6) -> Column:
    """Whether a sentence of the query of so many words or more stands in the text, blanks run together and case folded."""
    flat = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    sentences = F.filter(F.transform(F.split(query, T.SENTENCE_END), flat), lambda s: F.size(F.split(s, " ")) >= least)
    # the text is flattened once, not for every sentence
    return F.element_at(F.transform(F.array(flat(text)), lambda whole: F.exists(sentences, lambda s: F.contains(whole, s))), 1)
