"""Positions in a global order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.storage import written


def numbered(rows: DataFrame, by: list[str], name: str = "n") -> DataFrame:
    """rows with their places, from 0, in ascending order of by (nulls first). Rows are dealt out in ranges of that order;
    what is summed in one task, and broadcast, has a row per range. Rows that are equal in by get places in any order."""
    parts = written(rows.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows")).select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*by)) - 1
    return parts.withColumn("_in", inside).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_in")).drop("_part", "_in", "_start")
