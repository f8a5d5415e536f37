"""Token counts through a digest cache.

Counts are kept by (digest of the normalised content, digest of the tokenizer's version). A run joins its texts to
the stored counts, encodes each distinct missing content once, appends those counts to the cache and joins again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from textloom.llm.common import arrow_chunks, materialize, scratch, text_or_empty
from textloom.llm.tokenization import encoder, version_digest

CACHE_SCHEMA = "tokenizer_version string, digest binary, n_tokens long"
#: Text bytes that are taken apart at a time.
CHUNK_BYTES = 1 << 20


def stored_counts(spark: SparkSession, cache_path: str) -> DataFrame:
    """The cache's rows; a cache that is not there yet has none, and any other fault in reading it is an error. A content
    that two runs appended may be there twice."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_bytes (UTF-8), n_tokens.

    A null text counts as empty. The vocabulary keeps case and white space, so the normalised content is the UTF-8
    text itself; its SHA-256 is the digest. Texts are encoded whole, with no special tokens added; strings of special
    tokens inside a text are found as the library does by default. Null and repeated ids are rows like any other.
    Appends to the cache at cache_path before it returns.
    """
    spark, version = docs.sparkSession, version_digest(tokenizer_path)
    text = text_or_empty(text_col)
    keyed = materialize(docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("digest")), "digests")

    def first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Drops what this task has seen, before the shuffle: a content with many copies becomes one row a task."""
        seen: set[bytes] = set()
        for batch in arrow_chunks(batches, "text", CHUNK_BYTES):
            keep, digests = [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                d = hashlib.sha256(t.encode()).digest()
                if d not in seen:
                    seen.add(d)
                    keep.append(i)
                    digests.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), batch.column("text").take(pa.array(keep, pa.int32()))], names=["digest", "text"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = encoder(tokenizer_path), set()
        for batch in arrow_chunks(batches, "text", CHUNK_BYTES):
            digests = batch.column("digest").to_pylist()
            new = pa.array([i for i, d in enumerate(digests) if d not in seen and not seen.add(d)], pa.int32())
            counts = own.counts(batch.column("text").take(new))
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(new), pa.string()), batch.column("digest").take(new), pa.array(counts, pa.int64())], names=["tokenizer_version", "digest", "n_tokens"])

    known = stored_counts(spark, cache_path).filter(F.col("tokenizer_version") == version)
    misses = (
        docs.select(text.alias("text")).mapInArrow(first_seen, "digest binary, text string")
        .repartition("digest")  # the one shuffle of texts: the join keeps to it, and so does the encoding after it
        .join(known.select("digest"), "digest", "left_anti")
    )
    misses.mapInArrow(encoded, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    counts = stored_counts(spark, cache_path).filter(F.col("tokenizer_version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return _with_counts(keyed, counts).select(F.col("id").alias(id_col), "n_bytes", "n_tokens")


def _with_counts(keyed: DataFrame, counts: DataFrame) -> DataFrame:
    """keyed with each digest's count; a digest without one is an error. Digests that would fill a good part of a task are
    joined by broadcast, where their rows stay where they are: there are 4 at most for each shuffle partition."""
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = max(64, keyed.count() // (4 * parts))
    often = keyed.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > hot).select("digest")
    often = F.broadcast(materialize(often.join(counts, "digest"), "hot-counts"))
    rest = keyed.join(often.select("digest"), "digest", "left_anti").join(counts, "digest", "left")
    found = keyed.join(often, "digest").select("id", "n_bytes", "n_tokens").unionAll(rest.select("id", "n_bytes", "n_tokens"))
    return found.withColumn("n_tokens", F.coalesce("n_tokens", F.raise_error(F.lit("a text was not counted")).cast("long")))


def fresh_cache(spark: SparkSession) -> str:
    return scratch(spark, "token-counts")
