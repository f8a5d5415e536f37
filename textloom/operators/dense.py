"""Exact dense retrieval: blocks of query vectors against all rows, top k kept per task, then per query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that are sent to all tasks at a time.
QUERY_BLOCK = 4096
#: Rows that are scored at a time: a task holds this many scores for each query of a block, and its best ones.
ROW_BLOCK = 1024


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows whose vector is not null or empty and has no null or non-finite component; ids as they are."""
    vector = F.col("v")
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(vector.isNotNull() & (F.size(vector) > 0) & fine)


def top_k(queries: DataFrame, corpus: DataFrame, k: int, id_col: str = "id", vector_col: str = "vector", digits: int = 9) -> DataFrame:
    """(query_id, chunk_id, score, rank): for each query the k rows of corpus with the greatest inner product, rounded;
    ties go to the smaller id. Queries are taken in blocks of bounded size, the corpus is read once for each. Vectors that
    are null or empty, or have a null or non-finite component, take no part; a shorter one counts as padded with zeros."""
    spark = corpus.sparkSession
    held: list[DataFrame] = []
    rows, candidates = usable(queries, id_col, vector_col), usable(corpus, id_col, vector_col)
    block: list = []

    def flush() -> None:
        if block:
            ids, width = np.array([r[0] for r in block]), max(len(r[1]) for r in block)
            matrix = np.array([[*r[1], *[0.0] * (width - len(r[1]))] for r in block])
            shared = spark.sparkContext.broadcast((ids, matrix))
            held.append(candidates.mapInArrow(_scan(shared, k, digits), "query_id long, chunk_id long, score double"))
            block.clear()

    for row in rows.toLocalIterator():
        block.append(row)
        if len(block) == QUERY_BLOCK:
            flush()
    flush()
    if not held:
        return spark.createDataFrame([], "query_id long, chunk_id long, score double, rank int")
    found = held[0]
    for more in held[1:]:
        found = found.unionAll(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, cut or padded with zeros to so many."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if (sizes == width).all():
        return flat.reshape(len(column), width)
    out, nth = np.zeros((len(column), width)), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row[nth < width], nth[nth < width]] = flat[nth < width]
    return out


def _scan(shared, k: int, digits: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = shared.value
        best, who = np.full((len(q), 0), 0.0), np.full((len(q), 0), 0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROW_BLOCK):
                part = batch.slice(at, ROW_BLOCK)
                ids = part.column("id").to_numpy()
                by_id = np.argsort(ids, kind="stable")
                scores = np.round(q @ _matrix(part.column("v"), q.shape[1])[by_id].T, digits)
                order = np.argsort(-scores, axis=1, kind="stable")[:, :k]  # stable: the smaller id comes first
                best = np.concatenate([best, np.take_along_axis(scores, order, 1)], axis=1)
                who = np.concatenate([who, ids[by_id][order]], axis=1)
                order = np.lexsort((who, -best), axis=1)[:, :k]
                best, who = np.take_along_axis(best, order, 1), np.take_along_axis(who, order, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, who.shape[1])), pa.array(who.ravel()), pa.array(best.ravel())], names=["query_id", "chunk_id", "score"])

    return scan
