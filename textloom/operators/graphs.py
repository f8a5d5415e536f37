"""Graphs as tables of edges: connected components, and a pass over nodes in their order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.storage import written

#: Nodes of a component whose pass is made in one task, which holds the dropped ones' ids; larger ones go by rounds.
LOCAL_NODES = 1_000_000


def _jumped(parents: DataFrame) -> DataFrame:
    """(node, root) of a forest (node, root: the node above): every round doubles the steps taken."""
    while True:
        above = parents.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        # written, so that the join can be split at a root of very many nodes
        further = written(parents.join(above, "root", "left").select("node", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("_moved")), "forest")
        parents = further.select("node", "root")
        if further.filter("_moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge; root is the least node that it reaches. edges: (a, b), loops and repeats are fine.

    Every node takes its least smaller neighbour for its parent; trees shrink to their roots by jumping, and the edges
    between roots are the next round's. What is left are nodes without a smaller neighbour, so each round at least halves them.
    """
    ends = edges.toDF("a", "b").filter("a is not null and b is not null")
    nodes = ends.select(F.col("a").alias("node")).unionAll(ends.select(F.col("b").alias("node"))).distinct()
    known = written(nodes.select("node", F.col("node").alias("root")), "components")
    now = written(ends.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not now.isEmpty():
        roots = _jumped(written(now.groupBy("b").agg(F.min("a").alias("root")).withColumnRenamed("b", "node"), "forest"))
        side = lambda df, c: df.join(roots.select(F.col("node").alias(c), F.col("root").alias("_r")), c, "left").withColumn(c, F.coalesce("_r", c)).drop("_r")  # noqa: E731, B023
        known = written(side(known, "root"), "components")
        now = written(side(side(now, "a"), "b").filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return known


def _rounds(edges: DataFrame) -> DataFrame:
    """(node) that are dropped, by rounds that decide all nodes whose smaller neighbours are decided."""
    open_edges, found = edges, edges.select(F.col("b").alias("node")).limit(0)
    while not open_edges.isEmpty():
        blocked = open_edges.select(F.col("b").alias("a")).distinct()
        now = written(open_edges.join(blocked, "a", "left_anti").select(F.col("b").alias("node")).distinct(), "dropped")  # a is kept: nothing smaller is open
        found = written(found.unionAll(now), "dropped")
        gone = open_edges.join(now.withColumnRenamed("node", "b"), "b", "left_anti")
        open_edges = written(gone.join(now.withColumnRenamed("node", "a"), "a", "left_anti"), "edges")
    return found


def dropped_in_order(edges: DataFrame) -> DataFrame:
    """(node) of all that a pass in ascending order drops, if each is dropped that has an edge to a kept smaller one.

    edges: (a, b), a < b, longs. Components are found in rounds that grow with the logarithm of a chain; within one the
    pass is a stream over its sorted edges, many components a task. Only components of over LOCAL_NODES nodes go by rounds
    of their own.
    """
    edges = written(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).distinct(), "edges")
    if edges.isEmpty():
        return edges.select(F.col("b").alias("node"))
    roots = components(edges)
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    placed = written(edges.join(roots.withColumnRenamed("node", "b"), "b").join(sizes, "root"), "edges")

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, gone = None, set()
        for batch in batches:
            out = []
            for r, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if r != root:
                    root, gone = r, set()
                if a not in gone and b not in gone:
                    gone.add(b)
                    out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["node"])

    local = placed.filter(F.col("n") <= LOCAL_NODES).select("root", "a", "b").repartition("root").sortWithinPartitions("root", "b", "a")
    large = written(placed.filter(F.col("n") > LOCAL_NODES).select("a", "b"), "edges")
    return local.mapInArrow(passed, "node long").unionAll(_rounds(large))
