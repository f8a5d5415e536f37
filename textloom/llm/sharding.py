"""Sharding by a keyed Feistel permutation of global row numbers.

Every row gets a global number that depends on its content alone, the permutation moves that number, and shard and
slot follow by arithmetic: shard = position mod shards, slot = position div shards. Shard sizes differ by one row at most.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import text_or_empty

ROUNDS = 6
#: Rows are numbered bucket by bucket: so many buckets at least, and one for so many rows. The table of their starts is
#: broadcast (16 bytes a bucket: 2 MB for 10^11 rows).
BUCKETS, BUCKET_ROWS = 4096, 1_000_000
#: Repeated rows are expanded in steps of so many.
STEP = 4096


def _round(half: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = half + np.uint64(key)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def round_keys(seed: int) -> list[int]:
    rng = np.random.Generator(np.random.PCG64(seed))
    return [int(x) for x in rng.integers(0, 2**64, ROUNDS, dtype=np.uint64)]


def permute(numbers: np.ndarray, total: int, seed: int) -> np.ndarray:
    """The image of each of the numbers (0 <= x < total) under the permutation of range(total) that seed selects.

    A balanced Feistel network permutes the smallest range of an even number of bits that holds total; images outside
    of range(total) are fed back in until they fall inside (cycle walking), under four passes a number on average.
    """
    x = np.asarray(numbers, dtype=np.uint64).copy()
    if total <= 1:
        return x.astype(np.int64)
    half = np.uint64(max(1, (int(total - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = round_keys(seed)
    left_to_do = np.arange(len(x))
    while len(left_to_do):
        y = x[left_to_do]
        left, right = y >> half, y & mask
        for key in keys:
            left, right = right, left ^ (_round(right, key) & mask)
        y = (left << half) | right
        x[left_to_do] = y
        left_to_do = left_to_do[y >= np.uint64(total)]
    return x.astype(np.int64)


def shard(docs: DataFrame, shards: int, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, size, text_crc32, row_number, position, shard, slot.

    size: UTF-8 bytes of the text plus 1, a null text has none. text_crc32: of the UTF-8 bytes, a null text counts as
    empty. Row numbers follow (content bucket, id, crc, size), so neither the order of the input, its files nor the
    cluster change them. Null ids are a value like any other; repeated rows are counted first, then each gets a number
    of its own; no rows give no rows; other columns of docs are not read.
    """
    buckets = max(BUCKETS, -(-docs.count() // BUCKET_ROWS))
    narrow = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text_or_empty(text_col).cast("binary")).alias("crc"),
    )
    counted = (
        narrow.groupBy("id", "size", "crc").agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("bucket", F.pmod(F.xxhash64("id", "crc", "size"), F.lit(buckets)).cast("int"))
    )
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One row a bucket: one task sums them, and they are broadcast.
    starts = (
        counted.groupBy("bucket").agg(F.sum("copies").alias("rows"))
        .select("bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"), F.sum("rows").over(Window.partitionBy()).alias("total"))
    )
    inside = Window.partitionBy("bucket").orderBy("id", "crc", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = (
        counted.withColumn("first", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
        .join(F.broadcast(starts), "bucket")
        .withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / STEP))))
        .withColumn("nth", F.explode(F.sequence(F.col("step") * STEP, F.least(F.col("copies"), (F.col("step") + 1) * STEP) - 1)))
        .select("id", "size", "crc", "total", (F.col("start") + F.col("first") + F.col("nth")).alias("row_number"))
    )

    @F.pandas_udf("long")
    def moved(numbers: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), int(total.iloc[0]), seed) if len(numbers) else np.empty(0, np.int64))

    return numbered.withColumn("position", moved("row_number", "total")).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "row_number", "position",
        (F.col("position") % shards).cast("int").alias("shard"), F.floor(F.col("position") / shards).cast("long").alias("slot"),
    )
