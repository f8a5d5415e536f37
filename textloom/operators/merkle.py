"""Digest trees over tables: whether two tables hold the same rows, and where they differ.

Rows are dealt into leaves by the first hexadecimal digits of their key's SHA-256, so that both tables have the same leaves
whatever else they hold. A leaf's digest depends on the rows in it, not on their order or how they are split over tasks: the
rows' digests are cut into four numbers, each is summed, so leaves are sums that Spark adds up before it shuffles them, and
no list of rows is made. Each node above digests its children, FANOUT at most, up to the root.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.storage import written

FANOUT = 16
#: Rows to a leaf, on average, where the depth is chosen here.
LEAF_ROWS = 64


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of the columns' values as text, each with its length; a null is told from an empty text."""
    framed = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws(",", *framed), 256)


def _rows(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return rows.select(F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")), 256).alias("place"), F.col(key).alias("key"), row_digest([key, *columns]).alias("d"))


def tree(rows: DataFrame, key: str, columns: list[str], depth: int | None = None) -> DataFrame:
    """(level, path, n, digest): the root has level 0 and path '', the leaves have level depth and so many digits. The
    depth follows the number of rows unless it is given; trees are compared at one depth. Rows may repeat."""
    if depth is None:
        depth = max(1, math.ceil(math.log(max(1, rows.count() / LEAF_ROWS), FANOUT)))
    placed = _rows(rows, key, columns).select(F.substring("place", 1, depth).alias("path"), "d")
    pieces = [F.sum(F.conv(F.substring("d", 1 + 16 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]
    leaves = placed.groupBy("path").agg(F.count(F.lit(1)).alias("n"), *pieces)
    level = written(leaves.select(F.lit(depth).alias("level"), "path", "n", F.sha2(F.concat_ws(",", "n", *[F.col(f"s{i}").cast("string") for i in range(4)]), 256).alias("digest")), "leaves")
    out = level
    for d in range(depth - 1, -1, -1):
        kids = F.array_sort(F.collect_list(F.struct("path", "digest")))
        up = level.withColumn("up", F.substring("path", 1, d)).groupBy("up").agg(F.sum("n").alias("n"), kids.alias("kids"))
        level = up.select(F.lit(d).alias("level"), F.col("up").alias("path"), "n", F.sha2(F.concat_ws(",", F.transform("kids", lambda x: F.concat(x["path"], F.lit("="), x["digest"]))), 256).alias("digest"))
        out = out.unionAll(level)
    return out


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(path, n_a, n_b) of the leaves that differ between two trees of one depth, found from the root down: only children of
    nodes that differ are looked at."""
    depth = a.agg(F.max("level")).first()[0]
    if depth != b.agg(F.max("level")).first()[0]:
        raise ValueError("trees of different depths")
    side = lambda t, d, s: t.filter(F.col("level") == d).select("path", F.col("n").alias(f"n_{s}"), F.col("digest").alias(f"d_{s}"))
    found: DataFrame | None = None
    for d in range((depth or 0) + 1):
        x, y = side(a, d, "a"), side(b, d, "b")
        if found is not None:
            up = found.select(F.col("path").alias("up"))
            x, y = (t.withColumn("up", F.substring("path", 1, d - 1)).join(up, "up", "left_semi").drop("up") for t in (x, y))
        found = written(x.join(y, "path", "full_outer").filter(~F.col("d_a").eqNullSafe(F.col("d_b"))).select("path", "n_a", "n_b"), "differing")
    return found


def changes(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change): keys whose rows differ between two tables: changed, gone (not in b) or new (not in a). Keys are
    unique. Both tables are digested once; rows are only compared in leaves whose digests differ."""
    depth = max(1, math.ceil(math.log(max(1, a.count() / LEAF_ROWS), FANOUT)))
    leaves = differing(tree(a, key, columns, depth), tree(b, key, columns, depth)).select("path")
    at = lambda t, s: _rows(t, key, columns).withColumn("path", F.substring("place", 1, depth)).join(leaves, "path", "left_semi").select("place", F.col("key").alias(f"key_{s}"), F.col("d").alias(f"d_{s}"))
    both = at(a, "a").join(at(b, "b"), "place", "full_outer").filter(~F.col("d_a").eqNullSafe(F.col("d_b")))
    change = F.when(F.col("d_b").isNull(), "gone").when(F.col("d_a").isNull(), "new").otherwise("changed")
    return both.select(F.coalesce("key_a", "key_b").alias(key), change.alias("change"))
