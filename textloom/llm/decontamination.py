"""Benchmark decontamination with one Aho-Corasick automaton over words.

Benchmark words become letters of a private alphabet, windows of consecutive item words become patterns, and each text
is turned into that alphabet and scanned once. Matches are word ranges; they are mapped back to characters of the
original text.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import arrow_chunks

#: Bytes of benchmark text that go into one automaton (about 110 bytes of memory each); beyond, texts pass through several.
PART_BYTES = 2 << 20
CHUNK_BYTES = 8 << 20
#: A-Z to a-z, word bytes to themselves, all else to a space. UTF-8 keeps its length, so offsets hold.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
HITS = "array<struct<start_word:int,end_word:int,start_char:int,end_char:int>>"
_LETTERS = [*range(1, 0xD800), *range(0xE000, 0x110000)]
#: First and second letters, for more words than there are letters.
_HIGH, _LOW = _LETTERS[:1 << 19], _LETTERS[1 << 19 : 1 << 20]


def words_of(text: str) -> list[bytes]:
    """The text's words in lower case (A-Z), as UTF-8."""
    return text.encode().translate(FOLD).split()


def windows_of(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    """Runs of so many consecutive words; a shorter item, but not an empty one, is one window."""
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


class Matcher:
    """The automaton over items: (name or None, text). Items without words have no window."""

    def __init__(self, items: list[tuple[str | None, str]], size: int, letters: int = len(_LETTERS)):
        import ahocorasick

        numbers: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        owners: dict[str, list[int]] = {}
        for _, text in items:
            for w in words_of(text):
                numbers.setdefault(w, len(numbers))
        # a word is one letter, or two of alphabets that share none, so that no match starts within a word
        self.width = 1 if len(numbers) <= letters else 2
        self.letters = {w: chr(_LETTERS[n]) if self.width == 1 else chr(_HIGH[n // len(_LOW)]) + chr(_LOW[n % len(_LOW)]) for w, n in numbers.items()}
        for i, (_, text) in enumerate(items):
            words = words_of(text)
            for window in windows_of(words, size):
                owners.setdefault("".join(map(self.letters.__getitem__, window)), []).append(i)
        self.automaton = ahocorasick.Automaton()
        for pattern, who in owners.items():
            self.automaton.add_word(pattern, (len(pattern) // self.width, who))
        self.any = bool(owners)
        if self.any:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint ranges of hit words, ascending, and the names of items with a window there."""
        if not self.any:
            return [], set()
        spans: list[list[int]] = []
        who: set[int] = set()
        for end, (n, owners) in self.automaton.iter("".join(map(self.letters.get, words, itertools.repeat("\0" * self.width)))):
            end = end // self.width + 1
            start = end - n
            who.update(owners)
            while spans and spans[-1][0] >= start:
                spans.pop()
            if spans and spans[-1][1] >= start:
                spans[-1][1] = end
            else:
                spans.append([start, end])
        return [(a, b) for a, b in spans], {self.names[i] for i in who if self.names[i] is not None}


def word_bounds(text: str) -> tuple[np.ndarray, np.ndarray]:
    """First character of each word, and the one after its last."""
    raw = np.frombuffer(text.encode(), np.uint8)
    inside = np.concatenate([[False], np.frombuffer(raw.tobytes().translate(FOLD), np.uint8) != 32, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return chars[edges[0::2]], chars[edges[1::2]]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_MATCHERS: dict[str, Matcher] = {}


def _matcher(key: str, items, size: int) -> Matcher:
    """This process's automaton for a broadcast, which key names; one at a time is kept."""
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(items.value, size)
    return _MATCHERS[key]


def _parts(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str | None, str]]]:
    """The items in parts of PART_BYTES; a larger benchmark is never held whole."""
    rows = benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).filter(F.col(text_col).isNotNull())
    part, held = [], 0
    for name, text in rows.toLocalIterator():
        size = len(text.encode())
        if part and held + size > PART_BYTES:
            yield part
            part, held = [], 0
        part.append((name, text))
        held += size
    yield part


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id_col, n_words, hits, items, in the order and partitions of docs, without a shuffle.

    hits: disjoint ranges of words inside an occurrence of a window of the benchmark, with their characters in the
    original text. items: the ids, as strings, of items with an occurring window, sorted, each once. A null or empty
    text has no words and no hits. An item with a null id is searched for but not named; items with equal ids are one;
    an empty benchmark hits nothing. Texts are scanned whole. Extra columns of either table are not read, but those
    named in carry come along in a struct "carried", and the text with them in a column "text".
    """
    spark = docs.sparkSession
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.lit(None).cast(HITS).alias("hits"), F.lit(None).cast("array<string>").alias("items"), *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []))
    schema = out.schema
    hit_type = pa.list_(pa.struct([(k, pa.int32()) for k in ("start_word", "end_word", "start_char", "end_char")]))

    def scanner(items):
        key = uuid.uuid4().hex

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = _matcher(key, items, size)
            for batch in arrow_chunks(batches, "text", CHUNK_BYTES):
                n_words, hits, names = [], [], []
                texts = batch.column("text")
                for text, old, old_names in zip(texts.to_pylist(), batch.column("hits").to_pylist(), batch.column("items").to_pylist()):
                    words = words_of(text or "")
                    n_words.append(len(words))
                    spans, who = own.scan(words)
                    if old:
                        spans = merged(spans + [(x["start_word"], x["end_word"]) for x in old])
                    if spans:
                        first, last = word_bounds(text)
                        hits.append([(a, b, int(first[a]), int(last[b - 1])) for a, b in spans])
                    else:
                        hits.append([])
                    names.append(sorted(who.union(old_names or [])))
                rest = [batch.column("carried")] if carry else []
                made = [batch.column("id"), texts, pa.array(n_words, pa.int64()), pa.array([[dict(zip(("start_word", "end_word", "start_char", "end_char"), x)) for x in h] for h in hits], hit_type), pa.array(names, pa.list_(pa.string())), *rest]
                yield pa.RecordBatch.from_arrays(made, names=batch.schema.names)

        return scan

    for part in _parts(benchmark, item_col, item_text_col):
        out = out.mapInArrow(scanner(spark.sparkContext.broadcast(part)), schema)
    return out.select(F.col("id").alias(id_col), "n_words", "hits", "items", *(["text", "carried"] if carry else []))


def contaminated(docs: DataFrame, benchmark: DataFrame, share: int = 20, **names) -> DataFrame:
    """find_contamination with n_hit (hit words) and contaminated: hit at all, and one word in share or more is hit."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + (x["end_word"] - x["start_word"]))
    return find_contamination(docs, benchmark, **names).withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))
