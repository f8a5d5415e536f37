"""MinHash near-duplicates: SuperMinHash signatures, banding, exact verification, union-find grouping.

Texts with equal shingle sets become one node first, however many copies there are. Nodes that share a band key meet in
a bucket. No bucket is turned into all its pairs: every bucket names one centre, its member that meets most others over
all its keys (in a group of edited copies, the text that they were made from), and the members are compared with it, on
their full shingle sets. Verified links are joined into components, and buckets whose members are all in one component
are done, as are those of two members. Elsewhere, once for each distinct set of members, those outside of the bucket's
largest component are compared with the rest of it, in blocks of bounded size that keep their pairs to themselves and
give links only (see _apart).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import arrow_chunks, materialize
from textloom.llm.components import components
from textloom.llm.shingles import common, digest, shingle_sets
from textloom.llm.superminhash import band_keys, signatures

CHUNK_BYTES = 2 << 20
#: Two sets of similarity 0.85 share no key with a chance of (1 - 0.85^6)^32, about 3 in 10 million.
BANDS, ROWS = 32, 6
#: Shingles, and members, to a block that is compared with another block.
BLOCK_SHINGLES, BLOCK_ROWS = 64_000, 256
#: Bits of the map of nodes whose texts are needed (4 MB as it is broadcast).
BITS = 1 << 24

SKETCH = "doc_id long, n_shingles long, digest binary, keys array<long>"


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id, n_shingles, digest of the shingle set (null if empty), and the band keys, once per digest and task."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in arrow_chunks(batches, "text", CHUNK_BYTES):
            sets = shingle_sets([t or b"" for t in batch.column("text").to_pylist()], words)
            names = [digest(s) if len(s) else None for s in sets]
            new = []
            for i, d in enumerate(names):
                if d is not None and d not in seen:
                    seen.add(d)
                    new.append(i)
            keys: list = [None] * len(sets)
            for i, row in zip(new, band_keys(signatures([sets[i] for i in new], BANDS * ROWS), BANDS)):
                keys[i] = row
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "keys"])

    return rows.mapInArrow(made, SKETCH)


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    of_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = of_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[bytes, np.ndarray] = {}
        for batch in arrow_chunks(batches, "text_b", CHUNK_BYTES):
            text_a = batch.column("text_a").to_pylist()
            needed = [t for t in dict.fromkeys(text_a) if t not in last]
            # rows come ordered by a: its set is kept for the rows that follow
            last = {t: last[t] for t in set(text_a) & set(last)}
            for at in range(0, len(needed), 64):
                last.update(zip(needed[at : at + 64], shingle_sets(needed[at : at + 64], words)))
            keep = []
            for i, (t, s) in enumerate(zip(text_a, shingle_sets(batch.column("text_b").to_pylist(), words))):
                r = last[t]
                shared = common(r, s)
                if len(s) and len(r) and 100 * shared >= percent * (len(r) + len(s) - shared):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int32()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(checked, "a long, b long")


def link(docs: DataFrame, percent: int = 85, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id, kept.

    A text's set: its distinct runs of so many words (ASCII white space splits, A-Z count as a-z), or all its words as
    one run where it has fewer. Two texts are linked if 100 * intersection >= percent * union. component_id is the least
    id that is reached over links, kept is whether that is the row's own. A null text, or one without words, has an
    empty set and is linked with nothing. Rows with equal ids are one document: what links one of them links all. A row
    with a null id takes no part: its component_id is null, and it is kept. Sets are compared as 64-bit hashes.
    """
    sketch = materialize(sketches(docs, id_col, text_col, words), "sketches")
    named = sketch.filter("doc_id is not null and digest is not null")
    nodes = materialize(named.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("keys", ignorenulls=True).alias("keys")), "nodes")
    # Rows of one id with several texts are one node: their links unite.
    aliases = named.join(nodes.select("digest", "node"), "digest").filter("doc_id != node").select("doc_id", "node")
    members = nodes.select("node", "n", F.explode("keys").alias("key"))
    busy = members.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("size")).filter("low != high").select("key", "size")
    members = materialize(members.join(busy, "key"), "members")
    texts = _texts(docs, members, id_col, text_col)
    centres = materialize(_centres(members), "centres")  # written, so that joins with it can be split where a key is hot
    pairs = members.join(centres, "key").filter("a != node").filter(100 * F.least("n_a", "n") >= percent * F.greatest("n_a", "n")).select("a", F.col("node").alias("b")).distinct()
    links = materialize(_verified(pairs, texts, words, percent), "links")
    known = components(links)
    placed = members.filter("size > 2").join(known.withColumnRenamed("component", "found"), "node", "left").select("key", "node", "n", F.coalesce("found", "node").alias("class"))
    apart = materialize(_undecided(placed, centres), "apart")
    more = materialize(_apart(apart, texts, words, percent), "links")
    if not more.isEmpty():
        links = links.unionAll(more)
        known = components(links)
    every = aliases.select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    shared_ids = every.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high")).filter("low != high")
    # An id whose texts lie in several nodes, or that is itself a node, ties them together.
    owners = nodes.groupBy("node").count().select(F.col("node").alias("u"), F.col("node").alias("low"))
    ties = every.join(shared_ids.select("u"), "u").unionAll(every.join(owners.select("u"), "u"))
    if not ties.isEmpty():
        known = components(links.unionAll(ties))
    placed = sketch.join(nodes.select("digest", "node"), "digest", "left").join(known, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return placed.select(F.col("doc_id").alias(id_col), "n_shingles", component.alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def _texts(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text) of the nodes that share a bucket with another. Most texts share none: a bitmap of the nodes' hashes,
    of BITS bits whatever their number, spares them the shuffle; the join decides."""
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    bitmap = members.select(spot("node").alias("h")).groupBy(F.shiftright("h", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
    rows = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").cast("binary").alias("text")).filter("node is not null and text is not null")
    likely = rows.withColumn("h", spot("node")).withColumn("word", F.shiftright("h", 6)).join(F.broadcast(bitmap), "word").filter("shiftrightunsigned(bits, cast(h & 63 as int)) & 1 = 1").select("node", "text")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Drops repeats within a task before they are shuffled."""
        seen: set[int] = set()
        for batch in batches:
            keep = []
            for i, (d, t) in enumerate(zip(batch.column("node").to_pylist(), batch.column("text").to_pylist())):
                k = hash((d, t))
                if k not in seen:
                    seen.add(k)
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int32()))

    return materialize(likely.mapInArrow(once, rows.schema).join(members.select("node").distinct(), "node"), "texts")


def _centres(members: DataFrame) -> DataFrame:
    """(key, a, n_a): each bucket's centre, who meets most others over all its keys, then the least node."""
    met = members.groupBy("node").agg(F.sum("size").alias("met"))
    ranked = members.join(met, "node").select("key", "node", "n", "met")
    return ranked.groupBy("key").agg(F.max(F.struct("met", (-F.col("node")).alias("a"), F.col("n").alias("n_a"))).alias("c")).select("key", (-F.col("c.a")).alias("a"), "c.n_a")


def _undecided(placed: DataFrame, centres: DataFrame) -> DataFrame:
    """Members of buckets that hold several classes, of buckets with the same members those of one only, and without the
    centre, which all have been compared with. Buckets count as having the same members if their number and two sums of
    hashes of them agree."""
    sums = [F.sum(F.xxhash64("node", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in (0, 1)]
    sets = placed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count(F.lit(1)).alias("size"), *sums).filter("low != high")
    one = materialize(sets.groupBy("size", "s0", "s1").agg(F.min("key").alias("key")).select("key").join(centres.select("key", "a"), "key"), "open")
    return placed.join(one, "key").filter("node != a").drop("a")


def _apart(placed: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) from members of a bucket outside of its largest component to members of other components there: for
    each such member and component one, if there is any. Both sides are dealt out in blocks of bounded size."""
    weight = placed.groupBy("key", "class").agg(F.sum("n").alias("w"), F.count(F.lit(1)).alias("c"))
    sides = weight.groupBy("key").agg(F.max(F.struct("w", "class", "c")).alias("l"), F.sum("w").alias("all"), F.sum("c").alias("rows"))
    sides = sides.select("key", F.col("l.class").alias("largest"), "all", (F.col("all") - F.col("l.w")).alias("out"), "rows", (F.col("rows") - F.col("l.c")).alias("out_rows")).filter("out_rows > 0")
    sides = materialize(sides, "sides")
    blocks = lambda w, c: F.greatest(F.lit(1), F.ceil(F.col(w) / BLOCK_SHINGLES), F.ceil(F.col(c) / BLOCK_ROWS)).cast("int")
    rows = placed.join(sides, "key").join(texts, "node").withColumn("lefts", blocks("out", "out_rows")).withColumn("rights", blocks("all", "rows"))
    deal = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    unit = ["key", "i", "j"]
    left = rows.filter("class != largest").select("key", deal("lefts").alias("i"), every("rights").alias("j"), "node", "class", "text")
    right = rows.select("key", every("lefts").alias("i"), deal("rights").alias("j"), "node", "class", "text")

    def compared(a: pa.Table, b: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        if a.num_rows and b.num_rows:
            own, others = (shingle_sets(t.column("text").to_pylist(), words) for t in (a, b))
            nodes, classes = b.column("node").to_numpy(), b.column("class").to_numpy()
            sizes = np.array([len(x) for x in others])
            known, codes = np.unique(np.concatenate(others), return_inverse=True)
            starts = np.cumsum(sizes) - sizes
            here = np.zeros(len(known), dtype=np.int32)
            for node, kind, items in zip(a.column("node").to_pylist(), a.column("class").to_pylist(), own):
                near = (100 * np.minimum(sizes, len(items)) >= percent * np.maximum(sizes, len(items))) & (classes != kind)
                if not near.any():
                    continue
                at = np.searchsorted(known, items)
                at[at == len(known)] = 0
                at = at[known[at] == items]
                here[at] = 1
                shared = np.add.reduceat(here[codes], starts)
                here[at] = 0
                hit = np.flatnonzero((100 * shared >= percent * (len(items) + sizes - shared)) & near)
                _, one = np.unique(classes[hit], return_index=True)
                found += [(node, int(nodes[i])) for i in hit[one]]
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # columns of their own: both come of one table
    return left.groupBy(*unit).cogroup(right.groupBy(*unit)).applyInArrow(compared, "a long, b long")
