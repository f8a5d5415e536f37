"""Exact percentiles of groups of any size, without a buffer of their values.

A percentile lies between two values of known rank. An interval that holds the value of a rank is cut into bins, the bins
are counted, and the bin that the rank falls into, from its least to its greatest value, is the next interval, until one
value is left. Counts are added up before they are shuffled, so a task never holds more than BINS counts for each rank.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.storage import written

BINS = 1024


def ranked_values(rows: DataFrame, groups: list[str], value: str, ranks: DataFrame) -> DataFrame:
    """ranks (groups and rank, from 0) with the value of that rank in its group. Nulls have no rank; ranks must exist."""
    named = rows.filter(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("_v"))
    same = lambda a, b: reduce(and_, [a[c].eqNullSafe(b[f"_{c}"]) for c in groups], F.lit(True))
    renamed = lambda df: df.select(*[F.col(c).alias(f"_{c}") for c in groups], *[c for c in df.columns if c not in groups])
    ends = renamed(named.groupBy(*groups).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi")))
    open_ = written(ranks.join(ends, same(ranks, ends)).select(*groups, "rank", F.col("rank").alias("left"), "lo", "hi"), "ranks")
    found = open_.limit(0).select(*groups, "rank", F.col("lo").alias("value"))
    while True:
        found = written(found.unionAll(open_.filter("lo = hi").select(*groups, "rank", "lo")), "found")
        open_ = open_.filter("lo < hi")
        if open_.isEmpty():
            return found
        asked = renamed(open_)
        inside = named.join(asked, same(named, asked) & F.col("_v").between(F.col("lo"), F.col("hi")))
        # the greatest value has a bin of its own, so that every round parts an interval
        bin_ = F.when(F.col("_v") == F.col("hi"), BINS).otherwise(F.least(F.lit(BINS - 1), F.floor((F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS)))
        bins = inside.groupBy(*groups, "rank", "left", bin_.alias("_b")).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*groups, "rank").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        hit = bins.withColumn("_before", before).filter((F.col("_before") <= F.col("left")) & (F.col("left") < F.col("_before") + F.col("n")))
        open_ = written(hit.select(*groups, "rank", (F.col("left") - F.col("_before")).alias("left"), "lo", "hi"), "ranks")


def percentiles(rows: DataFrame, groups: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """groups and one column for each of shares: the linearly interpolated percentile of the group's values (null if it has
    none). Null groups are a group."""
    counts = rows.groupBy(*groups).agg(F.count(value).alias("_n"))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q")) for name, q in shares.items()])).alias("x")
    place = counts.filter("_n > 0").select(*groups, "_n", each).select(*groups, "x.name", (F.col("x.q") * (F.col("_n") - 1)).alias("at"))
    place = place.withColumn("low", F.floor("at")).withColumn("high", F.ceil("at"))
    ranks = place.select(*groups, F.explode(F.array("low", "high")).alias("rank")).distinct()
    values = ranked_values(rows, groups, value, ranks)
    end = lambda df, c: df.join(values.select(*[F.col(g).alias(f"_{g}") for g in groups], F.col("rank").alias("_rank"), F.col("value").alias(f"v_{c}")), reduce(and_, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups], F.col(c) == F.col("_rank"))).drop("_rank", *[f"_{g}" for g in groups])
    both = end(end(place, "low"), "high").withColumn("p", F.col("v_low") + (F.col("at") - F.col("low")) * (F.col("v_high") - F.col("v_low")))
    wide = both.groupBy(*groups).agg(*[F.max(F.when(F.col("name") == name, F.col("p"))).alias(name) for name in shares])
    if not groups:
        return counts.crossJoin(wide).drop("_n")  # one row each
    named = wide.select(*[F.col(g).alias(f"_{g}") for g in groups], *shares)
    return counts.join(named, reduce(and_, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups]), "left").select(*groups, *shares)
