"""Where intermediate and kept tables go: the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import hashlib
import inspect
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyspark
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, where that is unset and all run on this machine (tests), a folder made here. Unset on a
    cluster is an error: a folder of the driver's would not be seen elsewhere."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="textloom-work-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read back: its lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Has Spark hand rows with texts to Python in batches of so many at most: what a task holds follows its batches. The
    session keeps the setting, as tasks run after the caller has returned."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def give_back() -> None:
    """Returns what this Python process has freed to the system: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores where it is read in fewer parts than there are, as one small file is; anything larger is
    left alone, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def matching(rows: DataFrame, keys: list[str], ids: DataFrame, bits: int = 1 << 24) -> DataFrame:
    """The rows whose keys are in ids (those columns, distinct). A bitmap of the ids' hashes, of so many bits however many
    ids there are, spares most other rows the shuffle; the join decides. It is an inner one, as a semi-join would be moved
    below the bitmap's."""
    slot = F.pmod(F.xxhash64(*keys), F.lit(bits))
    bitmap = ids.select(slot.alias("_s")).groupBy(F.shiftright("_s", 6).alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_s & 63 as int))")).alias("_bits"))
    told = rows.withColumn("_s", slot).withColumn("_w", F.shiftright("_s", 6)).join(F.broadcast(bitmap), "_w")
    likely = told.filter("shiftrightunsigned(_bits, cast(_s & 63 as int)) & 1 = 1").select(*rows.columns)
    return likely.join(ids.select(*keys), keys).select(*rows.columns)


def state(spark: SparkSession, paths: list[str]) -> str:
    """Names the files at the paths and below them as they are now: where they lie, their bytes, when each was changed.
    The listing is a table of Spark's, so that many files are looked at by many tasks; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length", F.unix_micros("modificationTime").alias("changed"))
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(seed), "path", "length", "changed").cast("decimal(38,0)")), F.lit(0)) for seed in (1, 2)]
    return _digest(*files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0)), *sums).first())


def _digest(*parts: object) -> str:
    return hashlib.sha256("\n".join(map(str, parts)).encode()).hexdigest()[:32]


def described(part: object) -> str:
    """What a kept table is made by, as text: a module by its source, an expression by what it says (lambda variables
    under one name), anything else as it prints."""
    if inspect.ismodule(part):
        return inspect.getsource(part)
    return re.sub(r"\b([a-z]+)_\d+\b", r"\1", str(part)) if isinstance(part, Column) else repr(part)


def kept(spark: SparkSession, name: str, sources: list[str], made_by: list[object], build: Callable[[], DataFrame]) -> DataFrame:
    """The table that build makes of the files at sources, from the shared folder if it has been made of them as they are
    now, and in this way. made_by is all that its content depends on besides: modules whose code makes it, expressions,
    parameters. A table of other files, of the same before a change, by other code or parameters is not taken for it. One
    that was left unfinished is made anew."""
    path = f"{shared_dir(spark)}/kept/{name}-{_digest(state(spark, sources), pyspark.__version__, *map(described, made_by))}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
