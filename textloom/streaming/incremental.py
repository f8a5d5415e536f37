"""Incremental forms of collection and journals: new files only, duplicates dropped across batches, append with resume."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_rows(spark: SparkSession, path: str, schema, time_col: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Rows of Parquet files as they arrive, the first of each key; keys older than late are forgotten."""
    return spark.readStream.schema(schema).parquet(path).withWatermark(time_col, late).dropDuplicatesWithinWatermark(keys)


def windowed(events: DataFrame, time_col: str, value_col: str, by: str, size: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Count, sum and greatest value per window and key."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, size).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value_col).alias("total"), F.max(value_col).alias("most")).select(F.col("w.start").alias("start"), by, "n", "total", "most")


def append_journal(rows: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Appends each batch's rows that the journal at path has not: a batch that runs twice is written once."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            done = spark.read.schema(batch.schema).parquet(path).select(*keys)
        except AnalysisException as fault:  # any other fault would have rows written twice
            if fault.getCondition() != "PATH_NOT_FOUND":
                raise
            done = spark.createDataFrame([], batch.select(*keys).schema)
        batch.dropDuplicates(keys).join(done, keys, "left_anti").write.mode("append").parquet(path)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
