"""Constraint checks as rows: check, status, observed, required."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def suite(rows: DataFrame, checks: dict[str, tuple[Column, float, float]]) -> DataFrame:
    """checks: name to (aggregate, least, most). All aggregates are computed in one pass."""
    one = rows.agg(*[agg.cast("double").alias(name) for name, (agg, _, _) in checks.items()])
    made = [F.struct(F.lit(n).alias("check"), F.round(F.col(n), 6).alias("observed"), F.lit(float(lo)).alias("least"), F.lit(float(hi)).alias("most")) for n, (_, lo, hi) in checks.items()]
    out = one.select(F.explode(F.array(*made)).alias("x")).select("x.*")
    return out.withColumn("status", F.when((F.col("observed") >= F.col("least") - 1e-15) & (F.col("observed") <= F.col("most") + 1e-15), "PASS").otherwise("FAIL"))


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """One row: rows of child whose key no row of parent has (null keys count)."""
    keys = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.join(keys, child_key, "left_anti").agg(F.count(F.lit(1)).alias("orphans"))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def set_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids that only one side has, with the side."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("a")).unionByName(y.join(x, key, "left_anti").withColumn("side", F.lit("b")))


def close(expected: DataFrame, actual: DataFrame, keys: list[str], column: str, tolerance: float = 1e-12) -> DataFrame:
    """Rows that differ by more than the tolerance, or that one side lacks."""
    both = expected.select(*keys, F.col(column).alias("expected")).join(actual.select(*keys, F.col(column).alias("actual")), keys, "full_outer")
    return both.filter(F.coalesce(F.abs(F.col("expected") - F.col("actual")) > tolerance, ~F.col("expected").eqNullSafe(F.col("actual"))))


def order_digest(rows: DataFrame, key: str, width: int = 1024) -> DataFrame:
    """One row: how many values key has, and a digest of them in ascending order. Values are digested in ranges of width
    numbers, ranges' digests in groups of width ranges, and so on to the root, so that no task holds more than width of
    them. key: unique, non-negative, whole."""
    joined = lambda c: F.sha2(F.array_join(c, "\n"), 256)
    level = rows.select(F.col(key).alias("k")).groupBy(F.floor(F.col("k") / width).alias("g")).agg(F.count("k").alias("n"), joined(F.transform(F.array_sort(F.collect_list("k")), lambda x: x.cast("string"))).alias("d"))
    groups = -(-(int(rows.agg(F.max(key)).first()[0] or 0) + 1) // width)
    while True:
        groups = -(-groups // width)
        level = level.groupBy(F.floor(F.col("g") / width).alias("g")).agg(F.sum("n").alias("n"), joined(F.transform(F.array_sort(F.collect_list(F.struct("g", "d"))), lambda x: x["d"])).alias("d"))
        if groups <= 1:
            return level.select("n", F.col("d").alias("digest"))
