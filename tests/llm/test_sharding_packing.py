import numpy as np
import pytest

from textloom.llm.packing import Limits, pack_texts, place
from textloom.llm.sharding import permute, shard
from textloom.llm.tokenization import Encoder, vocabulary_path

DOCS = "doc_id long, text string, total int, bucket string"


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 64, 65, 1000])
def test_permutation(n):
    got = permute(np.arange(n), n, 42)
    assert sorted(got.tolist()) == list(range(n))
    assert n < 64 or (got != np.arange(n)).mean() > 0.8 and not np.array_equal(got, permute(np.arange(n), n, 43))


def rows():
    return [(i, f"text {i % 5}", 1, "x") for i in range(40)] + [(None, None, 1, "x"), (None, "", 1, "x")] + [(7, "same", 1, "x")] * 30


def test_shards(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    got = shard(docs, 8).collect()
    assert len(got) == 72
    sizes = [sorted(r["slot"] for r in got if r["shard"] == s) for s in range(8)]
    assert all(x == list(range(len(x))) for x in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1
    assert {r["size"] for r in got if r["doc_id"] is None} == {1}
    again = shard(docs.repartition(3, "text"), 8).collect()
    key = lambda r: (str(r["doc_id"]), r["text_crc32"], r["shard"], r["slot"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert shard(docs.limit(0), 8).count() == 0


def test_place_keeps_limits():
    rng = np.random.default_rng(1)
    for limits in (Limits(100, 5, 100), Limits(64, 3, 20), Limits(50, 50, 7)):
        tokens = rng.integers(0, 220, 120)
        prompt = np.minimum(tokens, rng.integers(0, 60, 120))
        pieces = place(tokens, prompt, limits)
        seen = {}
        for p in pieces:
            seen.setdefault(p.example, []).append((p.start, p.length))
        for i, n in enumerate(tokens.tolist()):
            at = 0
            for start, length in sorted(seen.get(i, [])):
                assert start == at and length > 0
                at += length
            assert at == n
        for s in {p.sequence for p in pieces}:
            own = sorted((p.offset, p.length, max(0, p.start + p.length - max(p.start, int(prompt[p.example])))) for p in pieces if p.sequence == s)
            assert [o for o, _, _ in own] == [sum(x[1] for x in own[:i]) for i in range(len(own))]
            assert sum(x[1] for x in own) <= limits.tokens and len(own) <= limits.segments and sum(x[2] for x in own) <= limits.loss_tokens


def test_little_padding():
    tokens = np.random.default_rng(2).integers(1, 3000, 2000)
    pieces = place(tokens, np.zeros(2000, int), Limits())
    assert tokens.sum() / (1024 * len({p.sequence for p in pieces})) > 0.995


def test_pack_texts(spark):
    docs = spark.createDataFrame([(1, "hello world " * 600, 1, "a"), (2, None, 1, "a"), (None, "", 1, "a"), (2, "x", 1, "a")], DOCS)
    path = vocabulary_path("byte_bpe_50k.json")
    got = pack_texts(docs, path, end_id=0).collect()
    n = len(Encoder(path).whole("hello world " * 600)) + 1
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == n == next(r["doc_tokens"] for r in got if r["doc_id"] == 1)
    assert sorted(r["length"] for r in got if r["doc_id"] != 1) == [1, 1, 2]
    assert pack_texts(docs.limit(0), path, end_id=0).count() == 0
