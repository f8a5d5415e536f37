"""The prefix trie of conversations: every prefix by its chained digest, nodes by (depth, digest), sums over subtrees.

A prefix's digest is SHA-256 of the digest before it and the next turn's, so equal sequences of turns, and only those,
have equal digests, and none is stored or shuffled as text. Prefixes are rows; nodes are their groups by (depth, digest).
A node is named by its least member. If that is the least member of a node, it is that of all nodes below it on its own
path; a conversation so names the nodes from some depth to its end. For the sums over subtrees these nodes are summed up
from below first, and each conversation then sends its sum, once, to every ancestor above them: as many rows as there are
prefixes at most, where sending every node to all its ancestors by itself would take the square of a conversation's length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import materialize

ROOT = hashlib.sha256(b"").digest()
#: Ids whose digits are put together before they meet the other members' of their node.
IDS = 200
WORD = r"[^\x20\x09-\x0D]+"


def turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, place (from 0, by turn, nulls first; of equal turns by role and text), turn (the digest of role and text)
    and words of the text. A null role or text is an empty one. A row without a conversation takes no part."""
    named = rows.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("_t"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))]).filter("conv_id is not null")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("_t"), "role", "text")) - 1
    framed = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")
    said = F.unhex(F.sha2(framed, 256))
    return named.withColumn("place", place).select("conv_id", F.col("place").cast("long").alias("place"), said.alias("said"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))


def rebuilt(own: DataFrame, base: Callable[[Column], Column], shared: Callable[[Column], Column], most: int) -> DataFrame:
    """own: as of turns. Each conversation, with the first shared(conv_id) turns (most at most) of conversation
    base(conv_id) in place of its own first ones; all that there are if there are fewer, none if there is no such
    conversation. Rows: conv_id, part (0 the other's turns, 1 its own), place, said, words; a conversation that is left
    without turns has one row whose place is null."""
    every = own.select("conv_id").distinct().withColumn("base", base(F.col("conv_id"))).withColumn("h", shared(F.col("conv_id")))
    heads = own.filter(F.col("place") < most).select(F.col("conv_id").alias("base"), "place", "said", "words")
    lent = every.join(heads, "base").filter(F.col("place") < F.col("h")).select("conv_id", F.lit(0).alias("part"), "place", "said", "words")
    kept = own.filter(F.col("place") >= shared(F.col("conv_id"))).select("conv_id", F.lit(1).alias("part"), "place", "said", "words")
    # every conversation has a row before its turns: the root, of which all are members
    return every.select("conv_id", F.lit(-1).alias("part"), F.lit(None).cast("long").alias("place"), F.lit(None).cast("binary").alias("said"), F.lit(0).cast("long").alias("words")).unionAll(lent).unionAll(kept)


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, depth, digest, parent (the digest of the prefix before), words of the last turn, ends (the conversation has
    no longer prefix). Digests are chained along sorted rows: of a conversation, however long, a task holds one turn."""

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row that waits for the next one to tell whether it ends its conversation
        for batch in batches:
            out = []
            for conv, said, words in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "said", "words"))):
                if last is not None:
                    out.append((*last, last[0] != conv))
                if last is None or last[0] != conv:
                    last = (conv, 0, ROOT, None, 0)
                else:
                    last = (conv, last[1] + 1, hashlib.sha256(last[2] + said).digest(), last[2], words)
            yield _batch(out)
        if last is not None:
            yield _batch([(*last, True)])

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 6
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["conv_id", "depth", "digest", "parent", "words", "ends"])

    sorted_rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place").select("conv_id", "said", "words")
    return sorted_rows.mapInArrow(chained, "conv_id long, depth long, digest binary, parent binary, words long, ends boolean")


def id_digests(ends: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """keys and ids_sha256: SHA-256 of the ascending ids of each key as decimals, joined by commas. Ids are dealt out in
    ranges of (key, id), so that the members of one key are joined by many tasks; what meets in one task is a row for
    every IDS ids, and no task holds more than a batch of them."""
    strings = "string"

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            out = []
            for *k, i in zip(*(batch.column(c).to_pylist() for c in (*keys, id_col))):
                if held and (k != key or len(held) >= IDS):
                    out.append((*key, held[0], ",".join(map(str, held))))
                    held = []
                key = k
                held.append(i)
            yield _named(out)
        if held:
            yield _named([(*key, held[0], ",".join(map(str, held)))])

    kinds = {f.name: f.dataType for f in ends.schema.fields}
    ddl = lambda more: ", ".join(f"{k} {kinds[k].simpleString()}" for k in keys) + more
    arrow = [pa.binary() if kinds[k].simpleString() == "binary" else pa.int64() for k in keys]

    def _named(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * (len(keys) + 2)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [*arrow, pa.int64(), pa.string()])], names=[*keys, "low", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for *k, ids in zip(*(batch.column(c).to_pylist() for c in (*keys, "ids"))):
                if k != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _said(out)
        if key is not None:
            yield _said([(*key, state.hexdigest())])

    def _said(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * (len(keys) + 1)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [*arrow, pa.string()])], names=[*keys, "ids_sha256"])

    pieces = ends.select(*keys, id_col).repartitionByRange(*keys, id_col).sortWithinPartitions(*keys, id_col).mapInArrow(joined, ddl(f", low long, ids {strings}"))
    return pieces.repartition(*keys).sortWithinPartitions(*keys, "low").select(*keys, "ids").mapInArrow(hashed, ddl(f", ids_sha256 {strings}"))


def nodes(paths: DataFrame) -> DataFrame:
    """paths: as of prefixes. One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. No paths give no nodes."""
    at = ["depth", "digest"]
    paths = materialize(paths, "prefixes")
    grouped = paths.groupBy(*at).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("parent").alias("parent"), F.first("words").alias("words"), F.sum(F.col("ends").cast("long")).alias("n_ends"))
    found = materialize(grouped.select(*at, "parent", "conv_id", "n_convs", (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved")), "nodes")
    chains = materialize(found.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")), "chains")
    # what the nodes that another conversation names get of those below: a row for each ancestor of a chain
    above = paths.select("conv_id", *at).join(chains, "conv_id").filter("depth < top").select(*at, "leaf", "saved", F.lit(0).cast("long").alias("child"))
    children = found.filter("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest"), *[F.lit(v).cast("long").alias(c) for c, v in (("leaf", 0), ("saved", 0), ("child", 1))])
    below = above.unionAll(children).groupBy(*at).agg(*[F.sum(c).alias(f"_{c}") for c in ("leaf", "saved", "child")])
    from_end = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    own = found.withColumn("_own_leaf", F.sum("leaf").over(from_end)).withColumn("_own_saved", F.sum("saved").over(from_end))
    # the parent of a chain's top is another conversation's node; all others have their own
    tops = found.join(chains.select("conv_id", F.col("top").alias("depth")), ["conv_id", "depth"]).filter("depth > 0").select("conv_id", "depth", (F.col("depth") - 1).alias("_d"), F.col("parent").alias("_p"))
    parents = materialize(tops, "tops").join(found.select(F.col("depth").alias("_d"), F.col("digest").alias("_p"), F.col("conv_id").alias("_parent")), ["_d", "_p"]).select("conv_id", "depth", "_parent")
    ends = id_digests(paths.filter("ends"), at, "conv_id")
    out = own.join(below, at, "left").join(ends, at, "left").join(parents, ["conv_id", "depth"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("_parent", "conv_id")).alias("parent_conv_id"), "n_convs", zero("_child").alias("n_children"),
        (F.col("_own_leaf") + zero("_leaf")).alias("n_leaves"), (F.col("_own_saved") + zero("_saved")).alias("saved_tokens"), F.coalesce("ids_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def trie(rows: DataFrame, base: Callable[[Column], Column] | None = None, shared: Callable[[Column], Column] | None = None, most: int = 0) -> DataFrame:
    """The prefix trie of the conversations in rows (conv_id, turn, role, text), one row a node as of nodes().

    A conversation's turns are ordered by turn, nulls first, of equal turns by role and text; repeated rows are turns of
    their own. base, shared and most put other conversations' first turns in place of their own, see rebuilt(); without
    them conversations are taken as they are. A null role or text is an empty one; rows without a conversation take no
    part; further columns are not looked at. An empty table has no nodes, not even a root.
    """
    own = materialize(turns(rows), "turns")
    if base is None or shared is None:
        base, shared = (lambda c: c), (lambda c: F.lit(0))
    return nodes(prefixes(rebuilt(own, base, shared, most)))
