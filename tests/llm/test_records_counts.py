import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm.records import build_index, fetch, frame, frame_at, from_payload, read_index, read_records, scan_records, to_payload, write_records
from textloom.llm.token_counts import count_tokens, stored_counts
from textloom.llm.tokenization import Encoder, vocabulary_path

NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json")


@pytest.mark.parametrize("name", NAMES)
def test_encoder_is_the_library(name):
    e, rng = Encoder(vocabulary_path(name)), random.Random(1)
    signs = ["a", "B", " ", " ", "  ", "\n", "\t", "'s", "É", "<|endoftext|>", "<|startoftext|>", "́", "9", ".", "Σ", "\x1c", "　", "漢", "🙂", "<|", "İ", "ß", "hello", " world"]
    for _ in range(4000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 14)))
        ids, ends = e.encode(pa.array([text]))
        assert ids.tolist() == e.whole(text) and ends.tolist() == [0, len(ids)], repr(text)


def test_many_texts_at_once():
    """Tables that grow, texts that can't be cut, columns that are slices, lone pieces."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) + rng.choice(["", "", ",", "é", "9", "\n"]) for _ in range(3000)]
    texts = [rng.choice([" ", " ", " ", "  "]).join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for name in NAMES:
        e = Encoder(vocabulary_path(name))
        e.table.clear(4)
        want = [e.whole(t) for t in texts]
        for a, b in ((0, 1500), (700, 710), (3, 1400), (5, 5)):
            column = pa.array(texts).slice(a, b - a)
            ids, ends = e.encode(column)
            assert [ids[x:y].tolist() for x, y in zip(ends[:-1], ends[1:])] == want[a:b]
            assert e.counts(column).tolist() == [len(x) for x in want[a:b]]


def test_another_vocabulary_is_encoded_whole(tmp_path):
    """A file that is not one of the known ones byte for byte is not cut at spaces."""
    path = tmp_path / "other.json"
    with open(vocabulary_path(NAMES[0])) as f:
        path.write_text(f.read() + "\n")
    e = Encoder(str(path))
    assert not e.cuts and e.encode(pa.array(["a b", "", "c"]))[1].tolist() == [0, 2, 2, 3] and e.counts(pa.array(["a b"])).tolist() == [2]


def test_frames():
    data = b"".join(frame(to_payload(i, np.arange(i), 2 if i % 2 else 4)) for i in range(5)) + frame(to_payload(None, np.array([70000]), 4))
    at, got = 0, []
    while at < len(data):
        payload, at = frame_at(data, at)
        got.append(from_payload(payload))
    assert [r.doc_id for r in got] == [0, 1, 2, 3, 4, None] and [r.ids.tolist() for r in got] == [*[list(range(i)) for i in range(5)], [70000]]
    for i in (0, 9, 14, len(data) - 3):
        with pytest.raises(ValueError):
            bad = bytearray(data)
            bad[i] ^= 1
            at = 0
            while at < len(bad):
                _, at = frame_at(bytes(bad), at)
    with pytest.raises(ValueError, match="cut off"):
        frame_at(frame(b"abc")[:-2], 0)


def test_records_round_trip(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["line\nfeed", "\r\n", "x", "日本", "\x00y"]) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    rows += [(None, "n"), (None, None), (61, None), (62, "")] + [(7, "again")] * 50
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, start int")
    path = f"file://{tmp_path}/out"
    write_records(docs, path, vocabulary_path("word_bpe_49k.json"), end_id=2, file_bytes=300, slab_bytes=100)
    index = sorted(build_index(spark, path).collect(), key=lambda r: (r["part"], r["roll"], r["n"]))
    e = Encoder(vocabulary_path("word_bpe_49k.json"))
    want = [(i, np.array([*e.whole(t or ""), 2], "<u4").tobytes()) for i, t in rows]
    assert len({r["file"] for r in index}) > 3 and len(index) == len(rows)
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in index) == sorted((str(i), zlib.crc32(x)) for i, x in want)
    ids = [r["doc_id"] for r in index]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    before = 0
    for r in index:
        assert r["start"] == before
        before += r["n_tokens"]
    # files follow bytes, and equal rows are no exception
    largest = max(r["frame_length"] for r in index)
    for name in {r["file"] for r in index}:
        assert (tmp_path / "out" / "records" / name).stat().st_size <= 300 + 100 + largest


def test_a_shuffled_reader_needs_the_index_alone(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 7)) for i in range(80)], "doc_id long, text string")
    path = f"file://{tmp_path}/out"
    write_records(docs, path, vocabulary_path("byte_bpe_50k.json"), end_id=0, file_bytes=400, slab_bytes=50)
    build_index(spark, path)
    rows = read_index(spark, path).collect()
    random.Random(5).shuffle(rows)
    got = list(fetch(path, [(r["file"], r["file_offset"], r["frame_length"]) for r in rows]))
    assert [r.doc_id for r in got] == [r["doc_id"] for r in rows] and len({r["file"] for r in rows}) > 2
    assert all(zlib.crc32(g.ids.astype("<u4")) == r["ids_crc32"] for g, r in zip(got, rows))
    e = Encoder(vocabulary_path("byte_bpe_50k.json"))
    some = read_records(read_index(spark, path).filter("doc_id % 3 = 1"), path).collect()
    assert {r["doc_id"]: r["ids"] for r in some} == {i: [*e.whole(f"text {i} " * (i % 7)), 0] for i in range(1, 80, 3)}


def test_damaged_file_fails(spark, tmp_path):
    (tmp_path / "records").mkdir()
    (tmp_path / "records" / "part-00000").write_bytes(frame(to_payload(1, np.arange(3), 2))[:-6] + b"123456")
    with pytest.raises(Exception, match="bad payload"):
        scan_records(spark, f"file://{tmp_path}").collect()


def test_counts_and_cache(spark, tmp_path):
    path, cache = vocabulary_path("byte_bpe_50k.json"), f"file://{tmp_path}/cache"
    rows = [(1, "hello world"), (2, "hello world"), (3, None), (4, ""), (None, "ß <|endoftext|> x"), (4, "  two  "), (1, "hello world")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_tokens int")
    e = Encoder(path)
    want = sorted((str(i), len((t or "").encode()), len(e.whole(t or ""))) for i, t in rows)
    for _ in range(2):
        got = count_tokens(docs, path, cache).collect()
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
        assert stored_counts(spark, cache).count() == 4  # the second run finds all it needs
    count_tokens(spark.createDataFrame([(9, "new")], "doc_id long, text string"), path, cache).collect()
    assert stored_counts(spark, cache).count() == 5
    assert count_tokens(docs.limit(0), path, cache).count() == 0


def test_hot_contents_and_broken_caches(spark, tmp_path):
    path, cache = vocabulary_path("byte_bpe_50k.json"), f"file://{tmp_path}/cache"
    rows = [(i, "the same words") for i in range(900)] + [(1000 + i, f"number {i}") for i in range(60)]
    got = {r["doc_id"]: r["n_tokens"] for r in count_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), path, cache).collect()}
    e = Encoder(path)
    assert got == {i: len(e.whole(t)) for i, t in rows}
    (tmp_path / "cache" / "part-broken.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):
        count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, cache).collect()
