"""Single documents: JSON read by a schema and replaced as a whole, tables as CSV."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


_CELLS = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON documents, one a file, as rows. A document that is no JSON, or that the schema does not fit, is an error."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def write_json(row: DataFrame, path: str, keep_nulls: bool = True) -> None:
    """The one row as a JSON document at path. It is written beside it first and then takes its place in one step, so that a
    reader finds the old document or the new one, and a failed writer leaves the old."""
    if row.limit(2).count() != 1:
        raise ValueError("one row makes a document")
    text = row.select(F.to_json(F.struct("*"), {"ignoreNullFields": str(not keep_nulls).lower()}).alias("value"))
    _replace(text.coalesce(1).write.text, row.sparkSession, path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A table with a header line, whose names must be the schema's; a line that does not fit is an error."""
    # an empty cell is null, a quoted one an empty text: what nulls are read as must be no text
    return spark.read.schema(schema).options(**_CELLS, enforceSchema="false", mode="FAILFAST", multiLine="true", nullValue="\0").csv(path)


def write_csv(rows: DataFrame, path: str, order: list[str], single: bool = False) -> None:
    """rows as CSV with a header line, in order: a folder of files that are sorted one after the other, or, where the table is
    known to be small (a report), one file that takes its place in one step. Quotes are doubled; a null is an empty cell, an
    empty text is quoted."""
    options = _CELLS | {"emptyValue": '""', "nullValue": ""}
    if single:
        _replace(rows.coalesce(1).sortWithinPartitions(*order).write.options(**options).csv, rows.sparkSession, path)
    else:
        rows.orderBy(*order).write.mode("overwrite").options(**options).csv(path)


def _replace(write, spark: SparkSession, path: str) -> None:
    """Has write fill a folder beside path with one file, and moves that to path, over what is there."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    made = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    store = made.getFileSystem(conf)
    write(made.toString())
    try:
        part = next(f.getPath() for f in store.listStatus(made) if f.getPath().getName().startswith("part-"))
        replacing = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri(), conf)
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = replacing
        context.rename(part, jvm.org.apache.hadoop.fs.Path(path), options)
    finally:
        store.delete(made, True)
