"""Vectors kept in files that can be read in parts, bound to what they were made of, and searched exactly.

Vectors lie in the files by cell, the nearest of a few centres, so that a reader skips row groups of other cells by their
bounds. Of each cell its centre and radius are kept: no vector of it scores more than query * centre + |query| * radius.
A search looks into each query's most promising cells first and then into those only that may still hold a better one.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators import dense
from textloom.operators.storage import kept

#: Centres, cells that each query looks into first.
CELLS, FIRST = 64, 2


@dataclass(frozen=True)
class Store:
    """vectors: (cell, id, v). cells: (cell, centre, radius, n, digest)."""

    vectors: DataFrame
    cells: DataFrame


def _digests(vectors: DataFrame) -> DataFrame:
    """(cell, n, digest): two sums of hashes of a cell's ids and components, whatever the order of its rows."""
    sums = [F.sum(F.xxhash64(F.lit(seed), "id", "v").cast("decimal(38,0)")).cast("string") for seed in (1, 2)]
    return vectors.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.concat_ws(":", *sums).alias("digest"))


def _celled(rows: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """rows (id, v) with the nearest of CELLS of them, chosen by a hash of their ids."""
    chosen = rows.groupBy("id").agg(F.any_value("v").alias("v")).orderBy(F.xxhash64("id"), "id").limit(CELLS).select("v").collect()
    width = max((len(r[0]) for r in chosen), default=0)
    centres = np.array([[*r[0], *[0.0] * (width - len(r[0]))] for r in chosen]).reshape(len(chosen), width)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms = (centres**2).sum(axis=1)
        for batch in batches:
            v = dense._matrix(batch.column("v"), width)
            cell = np.argmin(norms - 2 * v @ centres.T, axis=1) if len(v) else np.empty(0)
            # the distance counts components beyond the centres' width too
            whole = np.array([float(np.square(x.values.to_numpy()).sum()) for x in batch.column("v")])
            far = np.sqrt(np.maximum(whole - (v**2).sum(axis=1) + ((v - centres[cell.astype(int)]) ** 2).sum(axis=1), 0)) if len(v) else np.empty(0)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column("id"), batch.column("v"), pa.array(far, pa.float64())], names=["cell", "id", "v", "far"])

    return rows.mapInArrow(placed, "cell int, id long, v array<double>, far double"), centres


def kept_store(spark: SparkSession, name: str, sources: list[str], rows: DataFrame, id_col: str = "id", vector_col: str = "vector") -> Store:
    """The store of the files at sources, made once for them as they are now. Vectors that are null, empty or not finite
    are left out. A store whose vectors are not those that it was made with, by its digests, is an error."""
    by = [sys.modules[__name__], dense, id_col, vector_col, CELLS]

    def made() -> DataFrame:
        return _celled(dense.usable(rows, id_col, vector_col))[0].repartitionByRange("cell", "id").sortWithinPartitions("cell", "id")

    def described() -> DataFrame:
        centres = _celled(dense.usable(rows, id_col, vector_col))[1]
        listed = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
        return listed.join(vectors.groupBy("cell").agg(F.max("far").alias("radius")), "cell").join(_digests(vectors), "cell")

    vectors = kept(spark, f"vectors-{name}", sources, by, made)
    store = Store(vectors, kept(spark, f"cells-{name}", sources, by, described))
    check(store)
    return store


def check(store: Store) -> None:
    """An error if a cell's vectors have changed, or are there without a digest, or the other way round."""
    now = _digests(store.vectors).select("cell", F.col("n").alias("n_now"), F.col("digest").alias("now"))
    bad = store.cells.join(now, "cell", "full_outer").filter(~(F.col("digest").eqNullSafe(F.col("now")) & F.col("n").eqNullSafe(F.col("n_now")))).select("cell").limit(5).collect()
    if bad:
        raise ValueError(f"the vectors of cells {sorted(r[0] for r in bad)} are not those that were stored")


def top_k(store: Store, queries: DataFrame, k: int, id_col: str = "id", vector_col: str = "vector", digits: int = 9) -> DataFrame:
    """(query_id, chunk_id, score, rank) as dense.top_k has them. Queries are taken in blocks of bounded size."""
    spark = queries.sparkSession
    cells = store.cells.orderBy("cell").select("cell", "centre", "radius").collect()  # CELLS at most
    found: list[DataFrame] = []
    block: list = []

    def scanned(ids: np.ndarray, matrix: np.ndarray, wanted: list[int]) -> DataFrame:
        shared = spark.sparkContext.broadcast((ids, matrix))
        rows = store.vectors.filter(F.col("cell").isin(wanted)).select("id", "v")
        return rows.mapInArrow(dense._scan(shared, k, digits), "query_id long, chunk_id long, score double")

    def flush() -> None:
        width = max([len(r[1]) for r in block] + [len(c["centre"]) for c in cells])
        fill = lambda x: [*x, *[0.0] * (width - len(x))]
        ids, matrix = np.array([r[0] for r in block]), np.array([fill(r[1]) for r in block])
        names = np.array([c["cell"] for c in cells])
        most = matrix @ np.array([fill(c["centre"]) for c in cells]).T + np.linalg.norm(matrix, axis=1)[:, None] * np.array([c["radius"] for c in cells])
        first = np.unique(names[np.argsort(-most, axis=1)[:, :FIRST]])
        begun = scanned(ids, matrix, first.tolist())
        kth = {r[0]: r[1] for r in begun.groupBy("query_id").agg(F.try_element_at(F.sort_array(F.collect_list("score"), False), F.lit(k)).alias("s")).collect()}
        least = np.array([x if (x := kth.get(i)) is not None else -np.inf for i in ids.tolist()])
        # rounding moves a score by half a unit of the last digit
        rest = names[((most + 10.0**-digits) * (1 + 1e-12) + 1e-12 >= least[:, None]).any(axis=0) & ~np.isin(names, first)]
        found.append(begun)
        if len(rest):
            found.append(scanned(ids, matrix, rest.tolist()))
        block.clear()

    for row in dense.usable(queries, id_col, vector_col).toLocalIterator() if cells else ():
        block.append(row)
        if len(block) == dense.QUERY_BLOCK:
            flush()
    if block:
        flush()
    if not found:
        return spark.createDataFrame([], "query_id long, chunk_id long, score double, rank int")
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
