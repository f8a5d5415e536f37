"""Phrase collocations: n-grams as rows, counted by language, scored exactly against their parts.

n-grams of one length after the other are exploded into rows, summed up within pieces of a task first, and counted by
hash aggregation. No phrase is more frequent than its parts, so an n-gram is exploded only if both of its (n-1)-grams
may have reached the least count. Whether they may, a bitmap of a fixed size tells, which is made of the exact counts of
the length before: it lets some through that needn't be counted, and never holds one back. Counts, scores and the
comparison with longer phrases are exact, on the phrases themselves; nothing is decided by a hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import arrow_chunks, materialize, small_batches
from textloom.llm.shingles import mix, span_hashes

#: Bytes of text whose n-grams are summed up before they become rows.
CHUNK_BYTES = 8 << 20
#: Bits of the map of what has reached the least count (8 MB as it is broadcast).
BITS = 1 << 26
SPACE, BREAK = 32, 10
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes(BREAK if b in _BREAKS else SPACE if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Words:
    """The words of some texts in order: ids, the distinct words as strings and their hashes, and each word's piece and text."""

    def __init__(self, texts: list[bytes]):
        part = np.frombuffer(b"\n".join(texts).translate(_FOLD), np.uint8)
        ends = part == BREAK
        inside = np.zeros(len(part) + 2, dtype=bool)
        inside[1:-1] = (part != SPACE) & ~ends
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        first, last = edges[0::2], edges[1::2]
        offsets = np.zeros(len(first) + 1, np.int32)
        np.cumsum(last - first, out=offsets[1:])
        strings = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(part[inside[1:-1]])]).dictionary_encode()
        self.ids = strings.indices.to_numpy().astype(np.int64)
        self.known = strings.dictionary
        self.piece = np.cumsum(ends, dtype=np.int64)[first] if len(first) else first
        self.text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), first, side="right")
        self.hashes = _hashes(self.known)


def _hashes(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of strings, by their bytes."""
    if not len(strings):
        return np.empty(0, np.uint64)
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)
    return span_hashes(data, offsets[:-1], offsets[1:])


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of all but its last word and that of its last word."""
    with np.errstate(over="ignore"):
        return mix(left * _STEP + right)


class _Seen:
    """Bitmaps by length: which phrases of a language may have reached the least count."""

    def __init__(self, maps: list[np.ndarray]):
        self.maps = maps

    def has(self, n: int, hashes: np.ndarray) -> np.ndarray:
        bitmap = self.maps[n - 1]
        slot = hashes % np.uint64(64 * len(bitmap))
        return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _counted(texts: list[bytes], langs: list[str], n: int, seen: _Seen) -> pa.RecordBatch:
    """(lang, phrase, c): how often each n-gram occurs in these texts, without those that have a part that is too rare."""
    words = _Words(texts)
    kinds, known = pd.factorize(np.array(langs, dtype=object))
    base, top = np.array([_hashes(pa.array([k], pa.string()))[0] for k in known], np.uint64), max(1, len(words.known))
    # one code for each word of each language, then for each phrase of two words, and so on
    unit, pairs = pd.factorize(kinds.astype(np.int64)[words.text] * top + words.ids)
    code, hashes = unit, _join(base[pairs // top], words.hashes[pairs % top])
    own = words.hashes[pairs % top]
    at = np.arange(len(unit))
    for m in range(1, n):
        may = np.zeros(len(unit) + 1, dtype=bool)
        may[at] = seen.has(m, hashes)[code]
        here = np.full(len(unit), -1, np.int64)
        here[at] = code
        at = at[may[at] & may[at + 1]]
        at = at[at + m < len(unit)]
        at = at[words.piece[at] == words.piece[at + m]]
        code, pairs = pd.factorize(here[at] * max(1, len(own)) + unit[at + m])
        hashes = _join(hashes[pairs // max(1, len(own))], own[pairs % max(1, len(own))])
    counts = np.bincount(code, minlength=len(pairs))
    example = np.zeros(len(pairs), np.int64)
    example[code[::-1]] = at[::-1]
    phrase = [words.known.take(pa.array(words.ids[example + k])) for k in range(n)]
    said = pc.binary_join_element_wise(*phrase, " ") if n > 1 else phrase[0]
    kind = pa.array(known, pa.string()).take(pa.array(kinds[words.text[example]] if len(example) else [], pa.int64()))
    return pa.RecordBatch.from_arrays([kind, said.cast(pa.string()), pa.array(counts, pa.int64())], names=["lang", "phrase", "c"])


def _gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Batches put together until their texts have about limit bytes."""
    held, size = [], 0
    for batch in arrow_chunks(batches, "text", limit):
        n = pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
        if held and size + n > limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        held.append(batch)
        size += n
    if held:
        yield pa.Table.from_batches(held)


def _bitmap(frequent: DataFrame) -> np.ndarray:
    """Of the phrases' hashes. What reaches the driver is BITS bits at most, however many phrases there are."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(BITS >> 6, np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 16):
                piece = batch.slice(at, 1 << 16)
                hashes = _hashes(pa.concat_arrays([piece.column("lang")]))
                parts = pc.split_pattern(piece.column("phrase"), " ")
                lengths = np.diff(parts.offsets.to_numpy())
                own, first = _hashes(pa.concat_arrays([parts.flatten()])), np.cumsum(lengths) - lengths
                for k in range(int(lengths.max(initial=0))):
                    more = lengths > k
                    hashes[more] = _join(hashes[more], own[first[more] + k])
                slot = hashes % np.uint64(BITS)
                np.bitwise_or.at(words, (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
        full = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(words[full].view(np.int64), pa.int64())], names=["word", "bits"])

    found = frequent.select("lang", "phrase").mapInArrow(slots, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITS >> 6, np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def counts(docs: DataFrame, max_n: int, least: int, text_col: str, lang_col: str) -> tuple[DataFrame, DataFrame]:
    """(lang, n_words, phrase, f) of all phrases of 1 to max_n words that occur least times, and (lang, n): the words of a language."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    found: list[DataFrame] = []
    maps: list[np.ndarray] = []
    totals = None
    for n in range(1, max_n + 1):
        seen = spark.sparkContext.broadcast(_Seen(list(maps)))

        def exploded(batches: Iterator[pa.RecordBatch], n: int = n, seen=seen) -> Iterator[pa.RecordBatch]:
            for some in _gathered(batches, CHUNK_BYTES):
                yield _counted(some.column("text").to_pylist(), some.column("lang").to_pylist(), n, seen.value)

        summed = rows.mapInArrow(exploded, "lang string, phrase string, c long").groupBy("lang", "phrase").agg(F.sum("c").alias("f"))
        if n == 1:
            every = materialize(summed, "words")
            totals = materialize(every.groupBy("lang").agg(F.sum("f").alias("n")), "languages")  # written, so that Spark knows its size before it plans the join
            summed = every
        frequent = materialize(summed.filter(F.col("f") >= least).select("lang", F.lit(n).alias("n_words"), "phrase", "f"), "phrases")
        found.append(frequent)
        if n < max_n:
            maps.append(_bitmap(frequent))
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out, totals


def collocations(docs: DataFrame, max_n: int = 5, least: int = 100, percent: int = 100, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's first top phrases: lang, rank, phrase, a, l, r, n, score.

    A-Z count as a-z. Texts are cut into pieces at . , ; : ! ? and line breaks (0A to 0D), and pieces into words at spaces
    and tabs; nothing else separates. f counts all occurrences of a phrase within pieces, n all words of the language.
    A phrase of 2 to max_n words with a = f >= least is a candidate. Cutting it in two gives l and r, the counts of its
    parts, and the score floor(1000 * a * n / (l * r)); the lowest-scoring cut counts, of equal ones that with the
    shortest first part. A candidate is dropped if a longer one contains it that has 100 * f >= percent * a; one of one
    more word then does too, so that those are compared. Order: score and a descending, phrase ascending by UTF-8 bytes.

    A null language is `und`, a null or empty text has no words, rows with equal ids or texts all count. No text of any
    length is cut. An empty table gives no rows.
    """
    table, totals = counts(docs, max_n, least, text_col, lang_col)
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    phrases = table.filter("n_words > 1").select("lang", "n_words", "phrase", F.col("f").alias("a"), F.split("phrase", " ", -1).alias("words"))
    part = lambda start, length: F.array_join(F.slice("words", start, length), " ")
    k = F.col("k")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), k).alias("head"), part(k + 1, F.col("n_words") - k).alias("tail"))
    side = lambda name, f: table.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    both = cuts.join(side("head", "l"), ["lang", "head"]).join(side("tail", "r"), ["lang", "tail"]).join(totals, "lang")
    scored = both.withColumn("score", F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = phrases.filter("n_words > 2").select("lang", "a", F.explode(F.array(part(F.lit(1), F.col("n_words") - 1), part(F.lit(2), F.col("n_words") - 1))).alias("phrase"))
    longest = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    covered = longest.join(phrases.select("lang", "phrase", "a"), ["lang", "phrase"]).filter(whole("most") * 100 >= whole("a") * percent).select("lang", "phrase")
    kept = lowest.join(covered, ["lang", "phrase"], "left_anti").select("lang", "phrase", "a", "n", "cut.score", "cut.l", "cut.r")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return kept.withColumn("rank", place.cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
