"""Readers and writers of run files, judgments and line-wise JSON, strict where a bad line would change results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _checked(rows: DataFrame, good, what: str) -> DataFrame:
    return rows.filter(F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"not a {what} line: "), F.col("value"))).cast("boolean")))


def read_jsonl(spark: SparkSession, path: str, schema: StructType, strict: bool = False) -> DataFrame:
    """Blank lines are skipped, or, if strict, an error, as is a line that is no object; a bad value is an error."""
    if not strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    rows = _checked(spark.read.text(path), F.trim("value").startswith("{") & F.trim("value").endswith("}"), "JSON")
    return rows.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("error").json(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """query_id, chunk_id, rank, score, tag of lines "query Q0 chunk rank score tag"."""
    shape = r"^\S+ Q0 \S+ [1-9][0-9]* -?[0-9]+\.[0-9]{12} \S+$"
    p = F.split("value", " ")
    return _checked(spark.read.text(path), F.col("value").rlike(shape), "run").select(p[0].alias("query_id"), p[2].alias("chunk_id"), p[3].cast("int").alias("rank"), p[4].cast("double").alias("score"), p[5].alias("tag"))


def write_run(run: DataFrame, path: str) -> None:
    """Sorted by query, rank and id; scores with 12 digits, never a negative zero."""
    score = F.when(F.col("score") == 0, F.lit(0.0)).otherwise(F.col("score"))
    run.orderBy("query_id", "rank", "chunk_id").select(F.format_string("%s Q0 %s %d %.12f %s", F.col("query_id").cast("string"), F.col("chunk_id").cast("string"), "rank", score, "tag").alias("value")).write.text(path)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """query_id, chunk_id, relevance of lines "query 0 chunk grade" with grades 0, 1 and 2."""
    p = F.split("value", " ")
    return _checked(spark.read.text(path), F.col("value").rlike(r"^\S+ 0 \S+ [012]$"), "judgment").select(p[0].alias("query_id"), p[2].alias("chunk_id"), p[3].cast("int").alias("relevance"))


def write_qrels(qrels: DataFrame, path: str) -> None:
    qrels.orderBy("query_id", "chunk_id").select(F.format_string("%s 0 %s %d", F.col("query_id").cast("string"), F.col("chunk_id").cast("string"), "relevance").alias("value")).write.text(path)


def merge_qrels(base: DataFrame, more: DataFrame, pool: DataFrame) -> DataFrame:
    """base and more together. A pair that both judge, or that is not in the pool, is an error."""
    keys = ["query_id", "chunk_id"]
    if not more.join(base, keys, "left_semi").isEmpty():
        raise ValueError("a pair is judged twice")
    if not more.join(pool, keys, "left_anti").isEmpty():
        raise ValueError("a pair lies outside of the pool")
    return base.unionByName(more)
