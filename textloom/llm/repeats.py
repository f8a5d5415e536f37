"""Removal of repeated byte strings: suffixes in content-defined buckets, sorted blockwise with a difference cover.

A suffix of at least `length` bytes lies in the bucket of its anchor: of all runs of ANCHOR bytes within its first
`length` bytes that with the least hash. Suffixes that agree in `length` bytes have the same anchor at the same distance,
so they meet in a bucket. Neighbouring suffixes mostly share their anchor and travel together, as one stretch of text.

1. Anchors are counted; those that occur once can't be part of a repeat. A bitmap of fixed size spares their stretches
   the shuffle; what passes it wrongly is only compared in vain.
2. Equal stretches within a task are one; of the later ones it is known that they are repeats.
3. Buckets are dealt over tasks, and sorted in blocks of bounded size: see suffix_sort. Of suffixes that agree in
   `length` bytes all but the first are repeats.
4. A bucket of very many stretches would be too much for a task. Its suffixes are rows of their own instead, summed up by
   128-bit hashes of their first bytes, so that such a bucket is dealt over all tasks.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import arrow_chunks, give_back, materialize, small_batches
from textloom.llm.shingles import mix, stream
from textloom.llm.suffix_sort import equal_prefixes, groups, several

ANCHOR = 40
CHUNK_BYTES = 1 << 20
#: Stretches whose suffixes are sorted together, in bytes; a bucket is never cut.
BLOCK_BYTES = 3 << 20
#: A bucket of so many stretches is dealt out as single suffixes.
HOT = 4096
#: Bits of the maps of anchors (8 MB each as they are broadcast).
BITS = 1 << 26
#: Bits of the map of texts that have a mark (4 MB as it is broadcast).
TEXT_BITS = 1 << 24

_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 24) - 1)
_LAST = (1 << 63) - 1
_BYTES = (stream(0x61, 256), stream(0x62, 256))

FOUND = "h long, h2 long, doc long, tag long, lo int, hi int, left int, text binary"


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse modulo 2^64."""
    with np.errstate(over="ignore"):
        return tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


class _Hashes:
    """Hashes of stretches of some bytes in constant time each, two independent ones."""

    def __init__(self, data: np.ndarray):
        self.power, self.inverse = _powers(1 << len(data).bit_length())
        self.data, self.sums = data, [None, None]

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice, which: int = 0) -> np.ndarray:
        with np.errstate(over="ignore"):
            if self.sums[which] is None:
                sums = np.zeros(len(self.data) + 1, np.uint64)
                np.cumsum(_BYTES[which][self.data] * self.power[: len(self.data)], out=sums[1:])
                self.sums[which] = sums
            sums = self.sums[which]
            return mix((sums[end] - sums[start]) * self.inverse[: len(sums)][start])


def _stretches(texts: list[bytes], length: int, part: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, _Hashes, np.ndarray]]:
    """For parts of the joined texts (of part suffixes): anchor hash, anchor place, first and last suffix of each stretch, the text that it
    lies in, that text's start in the part, the part's hashes and bytes. Suffixes of a stretch share their anchor."""
    whole = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    span = length - ANCHOR + 1  # so many anchors to choose from
    for base in range(0, len(whole) - length + 1, part):
        data = whole[base : base + part + length - 1]
        n = len(data) - length + 1
        hashes = _Hashes(data)
        own = hashes.of(slice(0, len(data) - ANCHOR + 1), slice(ANCHOR, len(data) + 1))
        least = (own & ~_LOW) | np.arange(len(own), dtype=np.uint64)  # the first of equal ones
        width = 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[:n], least[span - width : span - width + n])
        anchor = (least & _LOW).astype(np.int64)
        text = np.repeat(np.arange(len(texts)), np.diff(np.clip(ends, base, base + n), prepend=base))
        fits = np.arange(base, base + n) + length <= ends[text]
        change = np.ones(n, dtype=bool)
        change[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(change & fits)
        # a stretch ends where the next begins, or where the text has no further suffix
        stop = np.flatnonzero((np.append(change[1:], True) | ~np.append(fits[1:], False)) & fits)
        yield own[anchor[first]], anchor[first], first, stop, text[first], (ends - [len(t) for t in texts])[text[first]] - base, hashes, data


def _has(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _bitmap(anchors: DataFrame) -> np.ndarray:
    """Of the anchors' hashes. BITS bits reach the driver, however many anchors there are."""
    slot = anchors.select(F.col("h").bitwiseAND(BITS - 1).alias("slot"))
    found = slot.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(BITS >> 6, np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc and tag, by which texts come first, and the text. A null id comes last."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(text).alias("tag"), text.cast("binary").alias("text"))


def _batch(columns: dict[str, np.ndarray | list], n: int) -> pa.RecordBatch:
    kinds = {"h": pa.int64(), "h2": pa.int64(), "doc": pa.int64(), "tag": pa.int64(), "lo": pa.int32(), "hi": pa.int32(), "left": pa.int32(), "text": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in kinds.items()], names=list(kinds))


def _found(docs: DataFrame, repeated, hot, length: int) -> DataFrame:
    """Rows of three kinds: stretches with their text (left is set), single suffixes of hot buckets (h2 is set), and, with
    neither, bytes lo to hi that are known to be repeats. lo and hi: of the bytes of the stretch in its text."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_chunks(batches, "text", CHUNK_BYTES):
            docs_, tags = batch.column("doc").to_numpy(), batch.column("tag").to_numpy()
            order = np.lexsort((tags, docs_))
            again = np.zeros(len(order), dtype=bool)
            again[1:] = (docs_[order][1:] == docs_[order][:-1]) & (tags[order][1:] == tags[order][:-1])
            if again.any():  # a row that is there twice is one document
                batch = batch.take(pa.array(np.sort(order[~again])))
                docs_, tags = batch.column("doc").to_numpy(), batch.column("tag").to_numpy()
                order = np.lexsort((tags, docs_))
            place = np.empty(len(docs_), np.int64)  # of the batch's texts in their order
            place[order] = np.arange(len(docs_))
            for h, anchor, first, last, text, start, hashes, data in _stretches(batch.column("text").to_pylist(), length, CHUNK_BYTES):
                some = _has(repeated.value, h)
                h, anchor, first, last, text, start = (x[some] for x in (h, anchor, first, last, text, start))
                warm = ~_has(hot.value, h)
                known_doc, known_lo, known_hi = [], [], []
                # stretches: the first of equal ones in order
                at = np.flatnonzero(warm)
                at = at[np.lexsort((first[at], place[text[at]]))]
                seen, keep, content = set(), [], []
                raw = data.tobytes()
                for i, a, b in zip(at.tolist(), first[at].tolist(), (last[at] + length).tolist()):
                    piece = raw[a:b]
                    if piece in seen:
                        known_doc.append(text[i])
                        known_lo.append(a - start[i])
                        known_hi.append(b - start[i])
                    else:
                        seen.add(piece)
                        keep.append(i)
                        content.append(piece)
                if keep:
                    k = np.array(keep)
                    lo = first[k] - start[k]
                    yield _batch({"h": h[k].view(np.int64), "doc": docs_[text[k]], "tag": tags[text[k]], "lo": lo, "hi": last[k] + length - start[k], "left": anchor[k] - first[k], "text": content}, len(k))
                # single suffixes of hot buckets, likewise
                at = np.flatnonzero(~warm)
                if len(at):
                    sizes = last[at] - first[at] + 1
                    own = np.repeat(at, sizes)
                    p = np.repeat(first[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(own))
                    one, two = (hashes.of(p, p + length, which) for which in (0, 1))
                    order = np.lexsort((p, place[text[own]], two, one))
                    own, p, one, two = own[order], p[order], one[order], two[order]
                    again = np.zeros(len(p), dtype=bool)
                    again[1:] = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
                    k, q = own[~again], p[~again]
                    yield _batch({"h": one[~again].view(np.int64), "h2": two[~again].view(np.int64), "doc": docs_[text[k]], "tag": tags[text[k]], "lo": q - start[k], "hi": q - start[k] + length}, len(k))
                    k, q = own[again], p[again]
                    back = np.lexsort((q, k))
                    k, q = k[back], q[back]
                    a, b = _runs(k, q)
                    known_doc += text[k[a]].tolist()
                    known_lo += (q[a] - start[k[a]]).tolist()
                    known_hi += (q[b] - start[k[a]] + length).tolist()
                if known_doc:
                    yield _batch({"doc": docs_[known_doc], "tag": tags[known_doc], "lo": np.array(known_lo), "hi": np.array(known_hi)}, len(known_doc))
        give_back()

    return _rows(docs, "doc_id", "text").mapInArrow(made, FOUND)


def _runs(owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of runs of consecutive places of one owner."""
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(at)) - 1


def _block(rows: pa.Table, length: int) -> pa.RecordBatch:
    """What of these stretches, some whole buckets in order, repeats an earlier suffix."""
    h, doc, tag, lo, left = (rows.column(c).to_numpy() for c in ("h", "doc", "tag", "lo", "left"))
    contents = rows.column("text").to_pylist()
    hi = lo + np.array([len(c) for c in contents])
    # equal stretches of several tasks: the first stays, and a row that is there twice is one document
    order = np.lexsort((lo, tag, doc))
    before: dict[bytes, int] = {}
    first, again = np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=bool)
    for i in order.tolist():
        j = before.setdefault(contents[i], i)
        if j == i:
            first[i] = True
        else:
            again[i] = (doc[i], tag[i], lo[i]) != (doc[j], tag[j], lo[j])
    whose = np.empty(len(h), np.int64)  # numbers documents in their order
    whose[order] = np.cumsum(np.concatenate([[0], (doc[order][1:] != doc[order][:-1]) | (tag[order][1:] != tag[order][:-1])]))
    # a stretch that is alone in its bucket has nothing to be compared with: no two of its own suffixes are equal
    stay = np.flatnonzero(first)
    stay = stay[several(groups(h[stay]))]
    known = [doc[again], tag[again], lo[again], hi[again]]
    if not len(stay):
        return _marks(*known)
    text = np.frombuffer(b"".join([contents[i] for i in stay.tolist()]), np.uint8)
    h, doc, tag, lo, left, whose, sizes = (x[stay] for x in (h, doc, tag, lo, left, whose, hi - lo))
    begin = np.cumsum(sizes) - sizes
    number = sizes - length + 1
    owner = np.repeat(np.arange(len(sizes)), number)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
    # suffixes of one bucket whose anchor lies as far on: no others can be equal
    bucket = groups(h)[owner] * length + left[owner] - inside
    order = np.argsort(bucket, kind="stable")
    at, kind = equal_prefixes(text, begin[owner[order]] + inside[order], bucket[order], length)
    if len(at):
        own = np.searchsorted(begin, at, side="right") - 1
        place, who = lo[own] + at - begin[own], whose[own]
        by = np.lexsort((place, who, kind))
        kind, place, who = kind[by], place[by], who[by]
        head = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))[groups(kind)]
        p = np.sort(at[by[(who != who[head]) | (place != place[head])]])
        own = np.searchsorted(begin, p, side="right") - 1
        a, b = _runs(own, p)
        k = own[a]
        more = (doc[k], tag[k], lo[k] + p[a] - begin[k], lo[k] + p[b] - begin[k] + length)
        known = [np.concatenate([x, y]) for x, y in zip(known, more)]
    return _marks(*known)


def _marks(doc, tag, lo, hi) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(tag, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["doc", "tag", "lo", "hi"])


def marks(docs: DataFrame, length: int) -> DataFrame:
    """doc, tag, lo, hi: bytes of texts that are covered by strings of length bytes which also start earlier. docs: doc_id, text."""
    spark = docs.sparkSession

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_chunks(batches, "text", CHUNK_BYTES):
            for h, *_ in _stretches(batch.column("text").to_pylist(), length, CHUNK_BYTES):
                one, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(n, pa.int64())], names=["h", "n"])

    anchors = _rows(docs, "doc_id", "text").select("text").mapInArrow(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    repeated = materialize(anchors.filter("n > 1"), "anchors")
    maps = [spark.sparkContext.broadcast(_bitmap(x)) for x in (repeated, repeated.filter(F.col("n") >= HOT))]
    found = materialize(_found(docs, *maps, length), "stretches")

    def sorted_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column("text").nbytes
            if size < BLOCK_BYTES:
                continue
            rows = pa.Table.from_batches(held)
            h = rows.column("h").to_numpy()
            cut = len(h) - int(np.argmax(h[::-1] != h[-1])) if h[0] != h[-1] else 0
            if cut:  # the last bucket may go on
                yield _block(rows.slice(0, cut), length)
                held = rows.slice(cut).combine_chunks().to_batches()
                size = sum(b.column("text").nbytes for b in held)
        if held:
            yield _block(pa.Table.from_batches(held), length)
        give_back()

    buckets = found.filter("left is not null").select("h", "doc", "tag", "lo", "left", "text").repartition("h").sortWithinPartitions("h")
    sorted_ = buckets.mapInArrow(sorted_blocks, "doc long, tag long, lo int, hi int")
    single = found.filter("h2 is not null").select("h", "h2", F.struct("doc", "tag", "lo").alias("at"), "hi")
    least = materialize(single.groupBy("h", "h2").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "first")
    later = single.join(least, ["h", "h2"]).filter("at > first").select("at.doc", "at.tag", "at.lo", "hi")
    known = found.filter("h is null").select("doc", "tag", "lo", "hi")
    return known.unionAll(sorted_).unionAll(later)


def without_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_bytes, n_removed, n_spans, kept_sha256, kept (what is left, as bytes), spans (of
    removed bytes, as pairs of first and end).

    Texts are UTF-8 bytes. A byte is removed if it is covered by a string of length bytes that also starts earlier: in a
    row of smaller id, or earlier in the same text; strings overlap freely, never cross texts, and are judged on the input.
    A null text is an empty one; a text shorter than length has nothing to remove. Rows of equal ids and different texts
    come in the order of a hash of these; rows equal in both are one document, and get its result. A null id comes after
    all others. Further columns are not looked at.
    """
    small_batches(docs.sparkSession)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = materialize(marks(named, length), "marks")
    spans = found.groupBy("doc", "tag").agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))
    # Texts without a mark need not meet any: a bitmap of hashes of those that have some, of TEXT_BITS bits whatever their
    # number, keeps most of the others out of the shuffle; the join decides.
    slot = F.pmod(F.xxhash64("doc", "tag"), F.lit(TEXT_BITS))
    bitmap = found.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    rows = named.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = rows.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64("_text").alias("tag"), F.col("_text").cast("binary").alias("text"))
    told = rows.withColumn("slot", slot).withColumn("word", F.shiftright("slot", 6)).join(F.broadcast(bitmap), "word", "left")
    told = told.withColumn("may", F.coalesce(F.expr("shiftrightunsigned(bits, cast(slot & 63 as int)) & 1 = 1"), F.lit(False)))
    joined = told.filter("may").select("doc_id", "doc", "tag", "text").join(spans, ["doc", "tag"], "left").select("doc_id", "text", F.col("marks.lo").alias("lo"), F.col("marks.hi").alias("hi"))
    joined = joined.unionAll(told.filter("not may").select("doc_id", "text", F.lit(None).cast("array<int>"), F.lit(None).cast("array<int>")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_chunks(batches, "text", 8 * CHUNK_BYTES):
            out: list[tuple] = []
            for text, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("text", "lo", "hi"))):
                gone: list[list[int]] = []
                for a, b in sorted(zip(lo, hi)) if lo else ():
                    if gone and a <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], b)
                    else:
                        gone.append([a, b])
                left = b"".join(text[a:b] for a, b in zip([0, *(g[1] for g in gone)], [*(g[0] for g in gone), len(text)])) if gone else text
                out.append((len(text), len(text) - len(left), len(gone), hashlib.sha256(left).hexdigest(), left, gone))
            columns = list(zip(*out))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), t) for c, t in zip(columns, types))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<array<int>>").withColumnRenamed("doc_id", id_col)

