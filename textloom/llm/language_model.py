"""Language-model scores from an Elias-Fano n-gram trie.

The trie has three levels. Words are sorted 64-bit hashes; a word's id is its place. A bigram's key is its first word's
id times the vocabulary size plus its second word's id; a trigram's key is the place of its first two words among the
bigrams times the vocabulary size plus its last word's id. So every level is one ascending sequence, its pointers are
the upper bits of an Elias-Fano code, and the children of a node are found by successor search relative to their
context. Beside each node lies its smoothed probability, quantised to 16 bits, and beside each bigram the weight that it
leaves to the shorter context.

Probabilities have Witten-Bell smoothing: with d distinct words seen after a context, and m = LEFT * d,
p(w | u v) = (c(u v w) + m p(w | v)) / (c(u v) + m), likewise one level below, and p(w) = (c + 0.5) / (N + 0.5 (V + 1));
they sum to 1 over V words and the unknown one. How many words follow a single word is summed over the shards and kept
with the vocabulary, so a bigram's numerator is what is stored beside it.

Bigrams are dealt over shards, each with its trigrams, by a hash of the pair; a shard is one file of bounded size in the
shared folder. Scoring tasks map the files they touch. All counts are taken from all training texts.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import arrow_chunks, materialize, scratch, text_or_empty
from textloom.llm.elias_fano import EliasFano
from textloom.llm.shingles import FOLD, mix, word_hashes
from textloom.llm.store import open_arrays, save_arrays

#: Text bytes that a task counts, or scores, at a time.
COUNT_BYTES, SCORE_BYTES = 6 << 20, 3 << 20
#: Training tokens to a shard, words to a vocabulary file.
SHARD_TOKENS, FILE_WORDS = 3_000_000, 4_000_000
END = np.uint64(0x9D39247E33776D41)
#: Weight of the shorter context, for each distinct word after the longer one.
LEFT = 3.0
_STEPS, _LEAST, _MOST = 65535, -12.0, 12.0


def quantise(log10: np.ndarray) -> np.ndarray:
    """Logarithms of probabilities, from -12 to 0, in steps of 0.0002."""
    return np.rint(np.clip(log10 / _LEAST, 0, 1) * _STEPS).astype(np.uint16)


def restored(q: np.ndarray) -> np.ndarray:
    """The value itself, not its logarithm."""
    return 10.0 ** (q.astype(np.float64) * (_LEAST / _STEPS))


def quantise_count(n: np.ndarray) -> np.ndarray:
    """Logarithms of counts, up to 10^12, in steps of 0.0002; 1 is exact."""
    return np.rint(np.clip(np.log10(n) / _MOST, 0, 1) * _STEPS).astype(np.uint16)


def restored_count(q: np.ndarray) -> np.ndarray:
    return 10.0 ** (q.astype(np.float64) * (_MOST / _STEPS))


@dataclass(frozen=True)
class Trained:
    """Where the model lies, and the little that every task needs to know of it."""

    vocabulary: tuple[str, ...]  # one file per range of hashes
    followers: tuple[str, ...]  # beside each, how many distinct words follow each of its words
    first_words: int  # distinct first words of texts
    starts: tuple[int, ...]  # id of each file's first word, and the number of words
    bits: int  # upper bits of a hash that select its file
    shards: tuple[str, ...]
    tokens: int  # N
    texts: int

    @property
    def words(self) -> int:
        return self.starts[-1]

    @property
    def unknown(self) -> int:
        return self.words

    @property
    def begin(self) -> int:
        return self.words + 1

    @property
    def none(self) -> int:
        return self.words + 2

    @property
    def size(self) -> int:
        return self.words + 3


@functools.lru_cache(maxsize=512)
def _open(uri: str):
    return open_arrays(uri)


@functools.lru_cache(maxsize=512)
def _sequence(uri: str, level: str) -> EliasFano:
    arrays, meta = _open(uri)
    return EliasFano(meta[level]["n"], meta[level]["bits"], *(arrays[f"{level}.{part}"] for part in ("low", "upper", "zeros")))


def _hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and the number of words of each."""
    hashes, starts = word_hashes(b" ".join(texts).translate(FOLD))
    cut = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
    return hashes, np.diff(cut)


def _look_up(model: Trained, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Id (the unknown word's if there is none), count and followers of each hash."""
    ids, counts, fans = np.full(len(hashes), model.unknown, dtype=np.int64), np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
    part = (hashes >> np.uint64(64 - model.bits)).astype(np.int64) if model.bits else np.zeros(len(hashes), np.int64)
    for p in np.unique(part):
        here = np.flatnonzero(part == p)
        arrays, _ = _open(model.vocabulary[p])
        known = arrays["hash"]
        if not len(known):
            continue
        at = np.minimum(np.searchsorted(known, hashes[here]), len(known) - 1)
        good = known[at] == hashes[here]
        ids[here[good]] = model.starts[p] + at[good]
        counts[here[good]] = arrays["count"][at[good]]
        if model.followers and model.followers[p]:
            fans[here[good]] = _open(model.followers[p])[0]["n"][at[good]]
    return ids, counts, fans


def _sequence_of(model: Trained, hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begin, words, end, none) of each text in a row; their counts and followers; where each text starts."""
    distinct, inverse = np.unique(np.append(hashes, END), return_inverse=True)
    ids, counts, fans = (x[inverse] for x in _look_up(model, distinct))
    starts = np.concatenate([[0], np.cumsum(sizes + 3)])
    row, seen, fan = np.full(starts[-1], model.none, dtype=np.int64), np.zeros(starts[-1], dtype=np.int64), np.zeros(starts[-1], dtype=np.int64)
    inside = np.ones(starts[-1], dtype=bool)
    ends = starts[1:] - 2
    inside[starts[:-1]] = inside[ends] = inside[ends + 1] = False
    row[inside], seen[inside], fan[inside] = ids[:-1], counts[:-1], fans[:-1]
    row[starts[:-1]], seen[starts[:-1]], fan[starts[:-1]] = model.begin, model.texts, model.first_words
    row[ends], seen[ends] = ids[-1], counts[-1]
    return row, seen, fan, starts


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix(keys + np.uint64(0x71)) % np.uint64(shards)).astype(np.int64)


def train(texts: DataFrame, text_col: str = "text") -> Trained:
    """Counts all words and n-grams of all rows (a null text has no words, but an end) and writes the trie. Without rows
    the model knows no word, and every token is the unknown one."""
    spark = texts.sparkSession
    rows = texts.select(text_or_empty(text_col).cast("binary").alias("text"))
    home = scratch(spark, "language-model")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_chunks(batches, "text", COUNT_BYTES):
            found, n = np.unique(_hashes(batch.column("text").to_pylist())[0], return_counts=True)
            found, n = np.append(found, END), np.append(n, batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], names=["hash", "n"])

    counted = rows.mapInArrow(words, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "word-counts")
    facts = counted.agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens"), F.sum(F.when(F.col("hash") == int(END.view(np.int64)), F.col("n"))).alias("texts")).first()
    n_words, tokens, n_texts = facts["words"], facts["tokens"] or 0, facts["texts"] or 0
    bits = max(0, -(-n_words // FILE_WORDS) - 1).bit_length()
    part = F.shiftrightunsigned("hash", 64 - bits).cast("int") if bits else F.lit(0)

    def vocabulary(key, table):
        found, n = table.column("hash").to_numpy().view(np.uint64), table.column("n").to_numpy()
        order = np.argsort(found)
        uri = f"{home}/words-{uuid.uuid4().hex}"
        save_arrays(uri, {"hash": found[order], "count": n[order]}, {})
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "uri": [uri], "n": pa.array([len(found)], pa.int64())})

    files = {r["part"]: r for r in counted.withColumn("part", part).groupBy("part").applyInArrow(vocabulary, "part int, uri string, n long").collect()}  # one row a file
    if len(files) < 1 << bits or not files:
        save_arrays(empty := f"{home}/words-none", {"hash": np.empty(0, np.uint64), "count": np.empty(0, np.int64)}, {})
    uris, starts = [], [0]
    for p in range(1 << bits):
        uris.append(files[p]["uri"] if p in files else empty)
        starts.append(starts[-1] + (files[p]["n"] if p in files else 0))
    shards = max(1, -(-tokens // SHARD_TOKENS))
    model = Trained(tuple(uris), (), 0, tuple(starts), bits, ("",) * shards, tokens, n_texts)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in arrow_chunks(batches, "text", COUNT_BYTES):
            row, _, _, starts_ = _sequence_of(model, *_hashes(batch.column("text").to_pylist()))
            first = np.ones(len(row), dtype=bool)  # of three in a row
            first[starts_[1:] - 1] = first[starts_[1:] - 2] = False
            at = np.flatnonzero(first)
            size = np.uint64(model.size)
            pairs = row[at].astype(np.uint64) * size + row[at + 1].astype(np.uint64)
            pair, which = np.unique(pairs, return_inverse=True)
            triples, n = np.unique(which.astype(np.uint64) * size + row[at + 2].astype(np.uint64), return_counts=True)
            pair_of, last = pair[(triples // size).astype(np.int64)], (triples % size).astype(np.uint32)
            shard = _shard_of(pair_of, shards)
            order = np.argsort(shard, kind="stable")
            bounds = np.searchsorted(shard[order], np.arange(shards + 1))
            blobs, to = [], []
            for s in range(shards):
                pick = order[bounds[s] : bounds[s + 1]]
                if len(pick):
                    gaps = np.diff(pair_of[pick], prepend=np.uint64(0))
                    blobs.append(pack.compress(len(pick).to_bytes(8, "little") + gaps.tobytes() + last[pick].tobytes() + n[pick].astype(np.uint32).tobytes()))
                    to.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "blob"])

    def trie(key, table):
        unpack = zstandard.ZstdDecompressor()
        pairs, lasts, ns = [], [], []
        for blob in table.column("blob"):
            data = unpack.decompress(blob.as_py())
            k = int.from_bytes(data[:8], "little")
            pairs.append(np.cumsum(np.frombuffer(data, np.uint64, k, 8), dtype=np.uint64))
            lasts.append(np.frombuffer(data, np.uint32, k, 8 + 8 * k))
            ns.append(np.frombuffer(data, np.uint32, k, 8 + 12 * k))
        del table
        pair, last, n = np.concatenate(pairs), np.concatenate(lasts), np.concatenate(ns).astype(np.int64)
        pairs = lasts = ns = None
        level2, which = np.unique(pair, return_inverse=True)
        size = np.uint64(model.size)
        key3 = which.astype(np.uint64) * size + last.astype(np.uint64)
        order = np.argsort(key3, kind="stable")
        key3, n = key3[order], n[order]
        new = np.flatnonzero(np.concatenate([[True], key3[1:] != key3[:-1]]))
        level3, n3 = key3[new], np.add.reduceat(n, new)
        parent = (level3 // size).astype(np.int64)
        n2 = np.bincount(parent, weights=n3, minlength=len(level2))
        real = level3 % size != np.uint64(model.none)
        level3, n3, parent = level3[real], n3[real], parent[real]
        distinct3 = np.bincount(parent, minlength=len(level2))
        contexts, distinct2 = np.unique((level2 // size).astype(np.int64), return_counts=True)
        a2, m2 = EliasFano.build(level2)
        a3, m3 = EliasFano.build(level3)
        left = LEFT * distinct3
        arrays = {f"level2.{k}": v for k, v in a2.items()} | {f"level3.{k}": v for k, v in a3.items()}
        # after a bigram that only ever ends a text nothing is known: all is left to the shorter context
        arrays |= {"n2": quantise_count(n2), "left2": quantise(np.log10(np.where(left > 0, left / (np.where(left > 0, n2, 0) + np.maximum(left, 1e-9)), 1.0))), "p3": quantise(np.log10(n3 / (n2 + left)[parent]))}
        uri = f"{home}/grams-{uuid.uuid4().hex}"
        save_arrays(uri, arrays, {"level2": m2, "level3": m3})
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "uri": [uri], "ids": pa.array([contexts], pa.list_(pa.int64())), "n": pa.array([distinct2], pa.list_(pa.int64()))})

    built = materialize(rows.mapInArrow(grams, "shard int, blob binary").groupBy("shard").applyInArrow(trie, "shard int, uri string, ids array<long>, n array<long>"), "shards")
    uri_of = {r["shard"]: r["uri"] for r in built.select("shard", "uri").collect()}  # one row a shard
    after = built.select(F.explode(F.arrays_zip("ids", "n")).alias("x")).groupBy(F.col("x.ids").alias("id")).agg(F.sum("x.n").alias("n"))
    after = materialize(after, "followers")
    first = after.filter(F.col("id") == model.begin).first()
    edges = F.array(*[F.lit(x).cast("long") for x in model.starts[1:]])  # one per vocabulary file
    placed = after.filter(F.col("id") < model.words).withColumn("part", F.size(F.filter(edges, lambda x: x <= F.col("id"))))

    def followers(key, table):
        p = key[0].as_py()
        n = np.zeros(model.starts[p + 1] - model.starts[p], dtype=np.int64)
        n[table.column("id").to_numpy() - model.starts[p]] = table.column("n").to_numpy()
        uri = f"{home}/followers-{uuid.uuid4().hex}"
        save_arrays(uri, {"n": n}, {})
        return pa.table({"part": pa.array([p], pa.int32()), "uri": [uri]})

    fans = {r["part"]: r["uri"] for r in placed.groupBy("part").applyInArrow(followers, "part int, uri string").collect()}  # one row a file
    return Trained(model.vocabulary, tuple(fans.get(p, "") for p in range(1 << bits)), first["n"] if first else 0, model.starts, bits, tuple(uri_of.get(s, "") for s in range(shards)), tokens, n_texts)


def _token_logs(model: Trained, row: np.ndarray, seen: np.ndarray, fan: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the tokens in row, and log10 of their base and model probabilities."""
    token = np.ones(len(row), dtype=bool)
    token[starts[:-1]] = token[starts[1:] - 1] = False
    at = np.flatnonzero(token)
    p1 = (seen[at] + 0.5) / (model.tokens + 0.5 * (model.words + 1))
    size = np.uint64(model.size)
    known = (row[at] != model.unknown) & (row[at - 1] != model.unknown)
    keys = row[at - 1].astype(np.uint64) * size + row[at].astype(np.uint64)
    shard = _shard_of(keys, len(model.shards))
    place = np.full(len(row), -1, dtype=np.int64)  # of the bigram that ends here
    n2, left2 = np.zeros(len(at)), np.ones(len(row))
    p3 = np.zeros(len(at))
    groups = _groups(np.where(known, shard, -1), len(model.shards))
    for s, here in groups:
        if not model.shards[s]:
            continue
        arrays, _ = _open(model.shards[s])
        found = _sequence(model.shards[s], "level2").find(keys[here])
        good = found >= 0
        here, found = here[good], found[good]
        n2[here] = restored_count(arrays["n2"][found])
        place[at[here]] = found
        left2[at[here]] = restored(arrays["left2"][found])
    whole = np.full(len(row), -1, dtype=np.int64)
    whole[at] = shard
    context = place[at - 1]
    after = (context >= 0) & (row[at] != model.unknown)
    keys3 = context.astype(np.uint64) * size + row[at].astype(np.uint64)
    for s, here in _groups(np.where(after, whole[at - 1], -1), len(model.shards)):
        arrays, _ = _open(model.shards[s])
        found = _sequence(model.shards[s], "level3").find(keys3[here])
        good = found >= 0
        p3[here[good]] = restored(arrays["p3"][found[good]])
    # a word that nothing was seen after leaves all to the next level down
    left1 = LEFT * fan[at - 1]
    lower = np.where(left1 > 0, (n2 + left1 * p1) / (seen[at - 1] + left1 + (left1 == 0)), p1)
    full = np.where(context >= 0, p3 + left2[at - 1] * lower, lower)
    return at, np.log10(p1), np.minimum(0.0, np.log10(full))


def _groups(group: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(group.astype(np.int32), kind="stable")
    bounds = np.searchsorted(group[order], np.arange(n + 1))
    for s in range(n):
        if bounds[s] < bounds[s + 1]:
            yield s, order[bounds[s] : bounds[s + 1]]


def score(docs: DataFrame, model: Trained, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_tokens (words and one end), n_known (tokens seen in training), base_score and
    score (log10 of the text's probability by words alone and by the trie). A null text counts as empty: its one token
    is the end. No shuffle; texts are scored whole."""
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    schema = StructType([rows.schema["id"], StructField("n_tokens", LongType()), StructField("n_known", LongType()), StructField("base_score", DoubleType()), StructField("score", DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_chunks(batches, "text", SCORE_BYTES):
            hashes, sizes = _hashes(batch.column("text").to_pylist())
            row, seen, fan, starts = _sequence_of(model, hashes, sizes)
            at, base, full = _token_logs(model, row, seen, fan, starts)
            first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
            made = [pa.array(sizes + 1, pa.int64()), pa.array(np.add.reduceat((seen[at] > 0).astype(np.int64), first)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(full, first))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *made], names=["id", "n_tokens", "n_known", "base_score", "score"])

    return rows.mapInArrow(scored, schema).withColumnRenamed("id", id_col)
