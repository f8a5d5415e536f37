"""Every registered query over the whole tables of a small scale, against SQL or a plain form of what it must return."""

import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from textloom.llm import quality, queries
from textloom.llm.html_text import main_text
from textloom.llm.sharding import permute
from textloom.llm.tokenization import vocabulary_path

QUERIES = queries.QUERIES


def table(sf, name, *columns):
    return pq.read_table(f"{sf}/{name}.parquet", columns=list(columns) or None).to_pylist()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, sf, name):
    con = duckdb.connect()
    for file in os.listdir(sf):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{file}')")
    got, want = QUERIES[name](spark, sf).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    rows = lambda f: sorted(map(tuple, f[sorted(f.columns)].astype(object).where(f[sorted(f.columns)].notna(), None).values.tolist()), key=repr)
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def held_out(doc_id, k):
    return zlib.crc32(str(doc_id).encode()) % k == 1


def test_sharding(spark, sf):
    """Sizes and checksums are recomputed; shard and slot come from a permutation of the row numbers that are implied."""
    got = QUERIES["op1_sharding"](spark, sf).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in table(sf, "documents", "doc_id", "text")}
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["law"]) for r in got} == {i: (len(t) + 1, zlib.crc32(t), "rows") for i, t in texts.items()}
    places = sorted(r["slot"] * 8 + r["shard"] for r in got)
    assert places == list(range(len(texts))) == sorted(permute(np.arange(len(texts)), len(texts), 42).tolist())
    from textloom.llm.sharding import shard

    numbered = shard(spark.read.parquet(f"{sf}/documents.parquet"), 8).collect()
    moved = permute(np.array([r["row_number"] for r in numbered]), len(numbered), 42)
    assert all(r["position"] == p and r["shard"] == p % 8 and r["slot"] == p // 8 for r, p in zip(numbered, moved.tolist()))
    assert sorted(r["row_number"] for r in numbered) == list(range(len(texts)))


def test_language_model_base(spark, sf):
    docs = {r["doc_id"]: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")), None] for r in table(sf, "documents", "doc_id", "text")}
    counts = Counter(w for i, ws in docs.items() if not held_out(i, 5) for w in ws)
    n, v = sum(counts.values()), len(counts)
    got = QUERIES["op5_language_model"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        own = docs[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(own), sum(w in counts for w in own), n, held_out(r["doc_id"], 5))
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel_tol=1e-9, abs_tol=1e-9)
        assert r["score"] <= 0
    new = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in new) > sum(r["base_score"] for r in new)


def test_records(spark, sf):
    t, start = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json")), 0
    got = sorted(QUERIES["op6_records"](spark, sf).collect(), key=lambda r: r["doc_id"])
    docs = sorted(table(sf, "documents", "doc_id", "text"), key=lambda r: r["doc_id"])
    assert len(got) == len(docs)
    for r, d in zip(got, docs):
        ids = np.array([*t.encode(d["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d["doc_id"], start, len(ids), zlib.crc32(ids))
        start += len(ids)


def test_html(spark, sf):
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in QUERIES["op7_html_extraction"](spark, sf).collect()}
    pages = table(sf, "pages")
    assert len(got) == len(pages)
    for p in pages:
        text = main_text(p["html"] or "")
        assert got[p["page_id"]] == (p["url"], text, len(text))
        # the made-up pages hold their text in one article, whose blocks are plain
        inside = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        import html

        words = html.unescape(re.sub(r"<[^>]*>", " ", inside)).split()
        assert text.split() == words


def test_quality(spark, sf):
    """One score recomputed without numpy's batches, and the labels that were held out."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = queries.quality_model(spark, docs, sf)
    got = {r["doc_id"]: r for r in QUERIES["op8_quality"](spark, sf).collect()}
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in table(sf, "documents", "doc_id", "text")}
    assert got.keys() == texts.keys() and all(r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == held_out(i, 3) for i, r in got.items())

    def plain(text):
        halves = []
        for at in range(0, max(1, len(text)), quality.HALF):
            row = [text[k] if k < len(text) else quality.PAD for k in range(at, at + quality.ROW)]
            spots = [np.concatenate([model.embed[b] for b in row[s : s + quality.WIDTH]]) for s in range(0, quality.ROW - quality.WIDTH + 1, quality.STRIDE)]
            halves.append(np.max([x @ model.filters for x in spots], axis=0))
        chunks = [np.maximum(a, b) for a, b in zip(halves, halves[1:])] or halves
        logit = float(np.mean([np.maximum(c + model.shift, 0) @ model.weights for c in chunks])) + model.bias + model.prior
        return 1 / (1 + math.exp(-max(-30, min(30, logit))))

    for i in sorted(texts, key=lambda i: len(texts[i]))[:60:6]:
        assert math.isclose(got[i]["score"], plain(texts[i]), abs_tol=1e-4)
    labels = [r for r in table(sf, "labels") if held_out(r["doc_id"], 3) and r["doc_id"] in got]
    assert sum(got[r["doc_id"]]["predicted"] == r["quality"] for r in labels) >= 0.9 * len(labels)


def test_packing(spark, sf):
    t = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    ids = {r["doc_id"]: np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4") for r in table(sf, "documents", "doc_id", "text")}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in QUERIES["op9_packing"](spark, sf).collect():
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, own in ids.items():
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at and length > 0
            at += length
        assert at == len(own)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(map(len, ids.values())) > 0.99 * 1024 * (len(sequences) - 4)


def test_token_counts(spark, sf):
    t = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    want = {r["doc_id"]: (len((r["text"] or "").encode()), len(t.encode(r["text"] or "", add_special_tokens=False).ids)) for r in table(sf, "documents", "doc_id", "text")}
    got = QUERIES["op10_token_counts"](spark, sf).collect()
    assert len(got) == len(want) and all((r["n_bytes"], r["n_tokens"]) == want[r["doc_id"]] and r["over_limit"] == (r["n_tokens"] > 512) for r in got)


def test_stages_with_odd_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, an id that is there twice, and columns of names that the operators use."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, text, None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (None, text + " more", "en", "s", 1), (None, None, None, None, None), (7, " ".join(f"v{i}" for i in range(40)), "en", "s", 2)]
    docs = spark.createDataFrame([(*r, "x", 1.0, "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, items string, score double, kept string")
    home = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (7, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    spark.createDataFrame([(5, " ".join(f"v{i}" for i in range(20))), (6, None)], "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    got = {name: sorted(map(str, (r["doc_id"] for r in stage(spark, docs, home).select("doc_id").collect()))) for name, stage in corpus_pipeline.STAGES}
    assert got["near_duplicates"] == ["1", "1", "3", "4", "7", "None", "None"]  # rows of one id are one document
    assert got["decontamination"] == ["1", "1", "2", "3", "4", "None", "None"]
    assert set(got["packing"]) == {"1", "2", "3", "4", "7", "None"} and len(got["quality"]) <= len(rows)
    assert all(stage(spark, docs, home).columns == ["doc_id", "text", "lang", "source", "n_chars"] for _, stage in corpus_pipeline.STAGES[:-1])
