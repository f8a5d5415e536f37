"""Exact top-k inner-product search as a Voronoi kNN join.

Component vectors are lifted so that a greater inner product is a smaller distance: a candidate v becomes
(v, sqrt(M - |v|^2)) with M the greatest |v|^2, a query q becomes (q, 0), and |q - v|^2 = |q|^2 + M - 2 q.v. Queries and
candidates are grouped by their nearest pivot. Per group, the summary (how far queries lie from their pivot, and the
least distances of candidates from theirs) bounds how far the k-th neighbour of any query of the group can be; a
candidate is sent to a group only if it can be nearer than that. Groups are solved on exact integers.

More groups are smaller, and may need fewer candidates each, but a candidate is sent to each that needs it. A bounded
sample shows what share of the candidates the groups would need, for several numbers of groups, and the cheapest is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import materialize

#: Pivots: one for so many candidates, within these bounds. Everything that is broadcast has a row or a pair per pivot.
PER_PIVOT, LEAST_PIVOTS, MOST_PIVOTS = 2000, 4, 256
#: Rows of the sample that the number of groups is chosen by: queries, and candidates.
SAMPLE = 1000, 5000
#: What it takes to send a candidate to a group, in comparisons of a candidate with a query.
SENT = 250.0
#: Distinct vectors that a task remembers.
REMEMBERED = 100_000
#: Scores are exact as float64 up to here, and as 64-bit integers up to there.
FLOAT_EXACT, INT_EXACT = 2.0**53, 2.0**62
#: Rows of a group that are solved against each other at a time.
QUERY_BLOCK, CANDIDATE_BLOCK = 4096, 8192


@dataclass(frozen=True)
class Summary:
    pivots: np.ndarray  # (g, d + 1), lifted: those that queries are grouped by
    top: float  # M
    limits: np.ndarray  # (g,): no k-th neighbour of a query of the group is further than this; -1: no queries
    reach: np.ndarray  # (g,): the greatest distance of a query of the group from its pivot
    query_blocks: np.ndarray  # (g,)
    candidate_blocks: np.ndarray  # (g,)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), dtype=np.int64)
    if len(flat):
        out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _lifted(rows: np.ndarray, top: float | None) -> np.ndarray:
    rows = rows.astype(np.float64)
    last = np.zeros(len(rows)) if top is None else np.sqrt(np.maximum(0, top - (rows * rows).sum(axis=1)))
    return np.column_stack([rows, last])


def _nearest(points: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    square = (points * points).sum(axis=1)[:, None] - 2 * points @ pivots.T + (pivots * pivots).sum(axis=1)[None]
    cell = square.argmin(axis=1)
    return cell, np.sqrt(np.maximum(0, square[np.arange(len(points)), cell]))


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (points * points).sum(axis=1)[:, None] - 2 * points @ pivots.T + (pivots * pivots).sum(axis=1)[None]))


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of each component. Vectors that are null, or have a null or non-finite component, and
    rows with a null id, are left out; so are empty vectors. What is beyond 64 bits counts as the end of their range."""
    parts = F.col("x")
    usable = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x")).filter(
        F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)
        & F.forall(parts, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) != float("inf")), F.lit(False)))
    )
    return usable.select("id", F.transform(parts, lambda e: F.floor(e * scale).cast("long")).alias("v"))


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which is_query(id column) holds, the k other rows with the
    greatest integer inner product, all of them if there are fewer; ties go to the smaller id.

    A shorter vector counts as padded with zeros. A row is not a candidate of queries with its own id; equal rows count
    once. Rows of one id with different vectors are candidates each, and queries whose k best are taken together.
    Vectors with a null or non-finite component, and null ones, take no part. No vectors, or no queries, give no rows.
    Scores beyond 64 bits are given as the end of their range, but ranked by what they are.
    """
    spark = vectors.sparkSession
    rows = quantized(vectors, id_col, vector_col, scale).dropDuplicates().withColumn("q", is_query(F.col("id")))
    stored = materialize(rows, "quantized")
    facts = stored.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("q"), 1)).alias("asked"), F.max(F.size("v")).alias("width"), F.max(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))).alias("top")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, top = facts["width"], facts["top"] * (1 + 1e-12)
    m = int(min(MOST_PIVOTS, max(LEAST_PIVOTS, facts["n"] // PER_PIVOT)))
    picked = stored.select("v", F.xxhash64("v").alias("h")).distinct().orderBy("h").limit(m)  # m rows at most
    pivots = _lifted(_matrix(pa.array([r["v"] for r in picked.collect()], pa.list_(pa.int64())), width), top)
    m = len(pivots)
    groups = _choose(group_costs(stored, pivots, width, top, k, facts["n"], facts["asked"]))
    held = spark.sparkContext.broadcast(pivots)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ints, p = _matrix(batch.column("v"), width), held.value
            cell, far = _nearest(_lifted(ints, top), p)
            q_cell, q_far = _nearest(_lifted(ints, None), p[:groups])
            made = [pa.array(cell, pa.int32()), pa.array(far), pa.array(q_cell, pa.int32()), pa.array(q_far)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "cell", "far", "q_cell", "q_far"])

    cells = materialize(stored.mapInArrow(placed, "id long, v array<long>, q boolean, cell int, far double, q_cell int, q_far double"), "cells")
    own = cells.groupBy("id").count().agg(F.max("count")).first()[0]
    summary = _summary(cells, pivots, groups, top, k, own)
    candidates = _distinct_vectors(cells.select("id", "v"), k)
    for r in candidates.mapInArrow(_counter(spark.sparkContext.broadcast(summary), width), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # m rows at most
        summary.candidate_blocks[r["cell"]] = max(1, -(-r["n"] // CANDIDATE_BLOCK))
    shared = spark.sparkContext.broadcast(summary)
    sent = candidates.mapInArrow(_sender(shared, width), "unit long, id long, v array<long>")
    asked = cells.filter("q").select("id", "v", F.col("q_cell").alias("cell")).mapInArrow(_asker(shared), "unit long, id long, v array<long>")

    def solved(left: pa.Table, right: pa.Table) -> pa.Table:
        none = -(1 << 62)  # below any score, and its negative is a number too
        q_ids, ids = left.column("id").to_numpy(), right.column("id").to_numpy()
        found: list[list[np.ndarray]] = [[], [], []]
        if len(q_ids) and len(ids):
            # a sum of products is bounded, at every step, by the product of the two vectors' lengths: by top
            q, v = (_matrix(t.column("v").combine_chunks(), width) for t in (left, right))
            kind = np.float64 if top < FLOAT_EXACT else np.int64 if top < INT_EXACT else object
            q, v = q.astype(kind), v.astype(kind)
            by_id = np.argsort(ids, kind="stable")
            ids, v = ids[by_id], v[by_id]
            for at in range(0, len(q), 128):
                scores = q[at : at + 128] @ v.T
                own = ids[None] == q_ids[at : at + 128, None]
                if kind is object:
                    rows = [(y, *x) for y, line in enumerate(scores) for x in sorted((-s, i) for i, (s, mine) in enumerate(zip(line, own[y])) if not mine)[:k]]
                    for out, x in zip(found, ([q_ids[at + y] for y, _, _ in rows], [ids[i] for _, _, i in rows], [-s for _, s, _ in rows])):
                        out.append(x)
                    continue
                scores = np.rint(scores).astype(np.int64) if kind is np.float64 else scores
                scores[own] = none
                row, column, score = _greatest(scores, k)
                real = score != none
                for out, x in zip(found, (q_ids[at : at + 128][row[real]], ids[column[real]], score[real])):
                    out.append(x)
        q_id, v_id, score = ([y for x in xs for y in np.asarray(x, dtype=object).tolist()] for xs in found) if top >= INT_EXACT else (np.concatenate(x) if x else np.empty(0, np.int64) for x in found)
        if top >= INT_EXACT:
            score = [max(-Decimal(10) ** 38 + 1, min(Decimal(10) ** 38 - 1, Decimal(int(s)))) for s in score]
        return pa.Table.from_arrays([pa.array(q_id, pa.int64()), pa.array(v_id, pa.int64()), pa.array(score, pa.int64() if top < INT_EXACT else pa.decimal128(38, 0))], names=["query_id", "vec_id", "score"])

    local = asked.groupBy("unit").cogroup(sent.groupBy("unit")).applyInArrow(solved, f"query_id long, vec_id long, score {'long' if top < INT_EXACT else 'decimal(38,0)'}")
    ranked = local.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    score = F.col("score") if top < INT_EXACT else F.greatest(F.lit(-(2**63)), F.least(F.lit(2**63 - 1), F.col("score"))).cast("long")
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))


def _greatest(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the k greatest of each row; of equal ones the first columns."""
    n = scores.shape[1]
    least = np.partition(scores, max(0, n - k), axis=1)[:, max(0, n - k)]
    row, column = np.nonzero(scores >= least[:, None])
    score = scores[row, column]
    order = np.lexsort((column, -score, row))
    row, column, score = row[order], column[order], score[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], column[first], score[first]


def group_costs(stored: DataFrame, pivots: np.ndarray, width: int, top: float, k: int, n: int, asked: int, sample: tuple[int, int] = SAMPLE) -> list[tuple[int, float, float]]:
    """(groups, share, cost) for 1, 2, 4, ... groups: the share of all pairs of a candidate and a group that would be sent,
    and the work it means, in comparisons; estimated on the rows that hash lowest, so many queries and candidates."""
    low = lambda rows, limit: rows.select("v", F.xxhash64("id", "v").alias("h")).orderBy("h").limit(limit).select("v").toArrow().column("v").combine_chunks()
    q, c = (_matrix(low(rows, limit), width) for rows, limit in ((stored.filter("q"), sample[0]), (stored, sample[1])))
    if not len(q) or not len(c):
        return [(1, 1.0, 0.0)]
    queries, candidates = _lifted(q, None), _lifted(c, top)
    far, between = _distances(candidates, pivots).min(axis=1), _distances(pivots, pivots)
    cell = _distances(candidates, pivots).argmin(axis=1)
    nth = min(len(c), max(1, -(-(k + 1) * len(c) // n)))  # of the sample, for the k + 1 nearest of all
    out, g = [], 1
    while g <= len(pivots):
        own, reach_of = _nearest(queries, pivots[:g])
        needed = sent = compared = 0.0
        for i in np.unique(own):
            reach, size = reach_of[own == i].max(), (own == i).sum() * asked / len(q)
            limit = np.partition(reach + between[i, cell] + far, nth - 1)[nth - 1]
            share = float((_distances(candidates, pivots[i : i + 1])[:, 0] - reach <= limit + _slack(top, limit)).mean())
            needed += share
            sent += share * max(1.0, size / QUERY_BLOCK)
            compared += share * size
        out.append((g, needed / g, n * (compared + SENT * sent)))
        g *= 2
    return out


def _choose(costs: list[tuple[int, float, float]]) -> int:
    """The cheapest number of groups; of equal ones, the least."""
    return min(costs, key=lambda x: (x[2], x[0]))[0]


def _slack(top: float, limit) -> float:
    """More than what rounding may do to a distance."""
    return 1e-9 * limit + 1e-7 * np.sqrt(top) + 1e-6


def _distinct_vectors(candidates: DataFrame, k: int) -> DataFrame:
    """Of equal vectors only the k + 1 least ids can be among the k nearest of anything; a task drops the others of its
    rows before they are sent anywhere, as far as it remembers them."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import heapq

        ids_of: dict[bytes, list[int]] = {}
        for batch in batches:
            keep: list[int] = []
            ids = batch.column("id").to_pylist()
            column = batch.column("v")
            flat, at = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(np.diff(column.offsets.to_numpy()))])
            if len(ids_of) > REMEMBERED:
                ids_of.clear()
            for i, x in enumerate(ids):
                heap = ids_of.setdefault(flat[at[i] : at[i + 1]].tobytes(), [])
                if len(heap) <= k:
                    heapq.heappush(heap, -x)
                elif x < -heap[0]:
                    heapq.heapreplace(heap, -x)
                else:
                    continue
                keep.append(i)  # a row of the same id again is one of this vector's rows only once: rows are distinct
            yield batch.take(pa.array(keep, pa.int32()))

    return candidates.mapInArrow(least, candidates.schema)


#: An id with more rows than this is not bounded by the summary: its groups get every candidate.
MOST_OWN = 64


def _summary(cells: DataFrame, pivots: np.ndarray, groups: int, top: int, k: int, own: int) -> Summary:
    """From one row per cell, with its k + own least distances; own: the most rows that one id has."""
    near = k + min(own, MOST_OWN)
    ranked = cells.select("id", "cell", "far", F.row_number().over(Window.partitionBy("cell", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("far", "id")).alias("r")).filter(F.col("r") <= near)
    least = {r["cell"]: sorted(r["far"])[:near] for r in ranked.groupBy("cell").agg(F.collect_list("far").alias("far")).collect()}  # m rows of 64 (k + MOST_OWN) at most
    asked = {r["q_cell"]: r for r in cells.filter("q").groupBy("q_cell").agg(F.count(F.lit(1)).alias("n"), F.max("q_far").alias("far")).collect()}
    between = _distances(pivots, pivots)
    limits, reach = np.full(groups, -1.0), np.zeros(groups)
    queries, candidates = np.ones(groups, np.int64), np.ones(groups, np.int64)
    for i, r in asked.items():
        reach[i] = r["far"]
        # any candidate at distance x of pivot j is within reach + |p_i p_j| + x of every query of group i
        bounds = np.sort(np.concatenate([reach[i] + between[i, j] + np.array(d) for j, d in least.items()]))
        # a query's own rows may be among them
        limits[i] = bounds[near - 1] if len(bounds) >= near and own <= MOST_OWN else np.inf
        queries[i] = -(-r["n"] // QUERY_BLOCK)
    return Summary(pivots[:groups], top, limits, reach, queries, candidates)


def _unit(summary: Summary, group: np.ndarray, query_block: np.ndarray, candidate_block: np.ndarray) -> np.ndarray:
    return (group.astype(np.int64) << 48) | (query_block.astype(np.int64) << 24) | candidate_block.astype(np.int64)


def _salt(ids: np.ndarray, blocks: np.ndarray, seed: int) -> np.ndarray:
    from textloom.llm.shingles import mix

    with np.errstate(over="ignore"):
        return (mix(ids.astype(np.uint64) + np.uint64(seed)) % blocks.astype(np.uint64)).astype(np.int64)


def _needed(s: Summary, lifted: np.ndarray) -> np.ndarray:
    """Which groups each candidate may be a neighbour in: its distance from their pivot, less their reach, is a lower bound."""
    return (_distances(lifted, s.pivots) - s.reach[None] <= s.limits[None] + _slack(s.top, s.limits)[None]) & (s.limits >= 0)[None]


def _counter(shared, width: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Summary = shared.value
        n = np.zeros(len(s.pivots), dtype=np.int64)
        for batch in batches:
            n += _needed(s, _lifted(_matrix(batch.column("v"), width), s.top)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n)), pa.int32()), pa.array(n)], names=["cell", "n"])

    return count


def _sender(shared, width: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Summary = shared.value
        for batch in batches:
            lifted = _lifted(_matrix(batch.column("v"), width), s.top)
            ids = batch.column("id").to_numpy()
            row, group = np.nonzero(_needed(s, lifted))
            block = _salt(ids[row], s.candidate_blocks[group], 1)
            times = s.query_blocks[group]  # once for each block of the group's queries
            again = np.repeat(np.arange(len(row)), times)
            nth = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
            unit = _unit(s, group[again], nth, block[again])
            for at in range(0, len(unit), 20000):
                part = pa.array(row[again[at : at + 20000]])
                yield pa.RecordBatch.from_arrays([pa.array(unit[at : at + 20000]), batch.column("id").take(part), batch.column("v").take(part)], names=["unit", "id", "v"])

    return send


def _asker(shared):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Summary = shared.value
        for batch in batches:
            ids, group = batch.column("id").to_numpy(), batch.column("cell").to_numpy()
            block = _salt(ids, s.query_blocks[group], 2)
            times = s.candidate_blocks[group]  # once for each block of the group's candidates
            again = np.repeat(np.arange(len(ids)), times)
            nth = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
            part = pa.array(again)
            yield pa.RecordBatch.from_arrays([pa.array(_unit(s, group[again], block[again], nth)), batch.column("id").take(part), batch.column("v").take(part)], names=["unit", "id", "v"])

    return ask
