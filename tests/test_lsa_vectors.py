"""TF-IDF and singular values against numpy, vector stores against plain products."""

import math
import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import dense, lsa, vectors
from textloom.operators.storage import written


def plain_matrix(texts, stop, least, most, size):
    held = []
    for t in texts:
        lowered = "".join(c for c in unicodedata.normalize("NFKD", (t or "").lower()) if not unicodedata.combining(c))
        words = [w for w in "".join(c if c.isalnum() or c == "_" else " " for c in lowered).split() if len(w) > 1 and w not in stop]
        held.append(Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])]))
    df, cf = Counter(t for c in held for t in c), sum(held, Counter())
    known = sorted(sorted((t for t in df if least <= df[t] <= most * len(texts)), key=lambda t: (-cf[t], t))[:size])
    a = np.zeros((len(texts), len(known)))
    for i, c in enumerate(held):
        for j, t in enumerate(known):
            if c[t]:
                a[i, j] = (1 + math.log(c[t])) * (math.log((1 + len(texts)) / (1 + df[t])) + 1)
    norm = np.linalg.norm(a, axis=1, keepdims=True)
    return known, a / np.where(norm == 0, 1, norm)


def fitted(spark, texts, stop, least, most, size):
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5).select("id", lsa.terms(F.col("text"), stop).alias("terms"))
    tf = written(lsa.frequencies(docs), "tf")
    return written(lsa.vocabulary(tf, len(texts), least, most, size), "vocabulary"), tf


def test_singular_values_and_vectors_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(lsa, "HEIGHT", 16)
    monkeypatch.setattr(lsa, "FAN", 2)
    monkeypatch.setattr(lsa, "TASK_ROWS", 5)
    rng = random.Random(4)
    words = ["the", "Éclair", "naïve", "a", "straße", *(f"w{i}" for i in range(40))]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))) for _ in range(70)] + [None, "", "the the"]
    vocab, tf = fitted(spark, texts, ["the"], 2, 0.9, 120)
    known, a = plain_matrix(texts, {"the"}, 2, 0.9, 120)
    assert [r["term"] for r in vocab.orderBy("place").collect()] == known and len(known) == 120
    rows = written(lsa.rows_of(tf, vocab), "rows")
    values, basis = lsa.decomposed(rows, len(known), 12, more=12, rounds=60)
    want = np.linalg.svd(a, compute_uv=False)[:12]
    assert np.allclose(values, want, rtol=0, atol=1e-6)
    got = np.zeros((len(texts), 12))
    for r in lsa.projected(rows, basis).collect():
        got[r["id"]] = r["vector"]
    exact = a @ np.linalg.svd(a)[2][:12].T
    exact /= np.where((n := np.linalg.norm(exact, axis=1, keepdims=True)) < 1e-12, 1, n)
    assert np.allclose(got @ got.T, exact @ exact.T, atol=1e-3)


def test_singular_values_of_the_documents(spark, sf):
    """96 dimensions over all documents of the small scale, within 1e-6 of numpy."""
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    vocab, tf = fitted(spark, texts, [], 2, 0.98, 30_000)
    rows, height = written(lsa.rows_of(tf, vocab), "rows"), vocab.count()
    values, _ = lsa.decomposed(rows, height, 96, more=96, rounds=40)
    a = np.zeros((len(texts), height))
    for i, r in enumerate(rows.collect()):
        a[i, r["places"]] = r["weights"]
    assert np.allclose(values, np.linalg.svd(a, compute_uv=False)[:96], rtol=0, atol=1e-6)


def test_nothing_to_decompose(spark, monkeypatch):
    vocab, tf = fitted(spark, [None, ""], [], 1, 1.0, 10)
    values, basis = lsa.decomposed(lsa.rows_of(tf, vocab), 0, 4)
    assert len(values) == 0 and basis.shape == (0, 0)
    vocab, tf = fitted(spark, ["one two", "two one"], [], 1, 1.0, 10)
    monkeypatch.setattr(lsa, "MOST_BYTES", 8)
    with pytest.raises(ValueError):
        lsa.decomposed(lsa.rows_of(tf, vocab), 4, 2)


def embedded(spark, path, n=700, width=6, clusters=12):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(clusters, width)) * 5
    rows = [(i, (base[i % clusters] + rng.normal(size=width) * 0.3).tolist()) for i in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [float("nan")] * width), (n + 3, [1.0, 2.0]), (n + 4, rows[3][1]), (n + 5, [9.0] * (width + 2))]
    spark.createDataFrame(rows, "id long, vector array<double>").repartition(4).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("cells", [1, 8, 64])
def test_vector_store_finds_the_same(spark, tmp_path, monkeypatch, cells):
    monkeypatch.setattr(vectors, "CELLS", cells)
    rows = embedded(spark, f"file://{tmp_path}/in")
    store = vectors.kept_store(spark, f"t{cells}", [f"file://{tmp_path}/in"], rows)
    assert store.vectors.count() == 703 and store.cells.count() <= cells
    asked = rows.filter("id % 50 = 0 or id > 700")
    as_rows = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in df.collect())
    assert as_rows(vectors.top_k(store, asked, 7)) == as_rows(dense.top_k(asked, rows, 7))
    assert vectors.top_k(store, rows.limit(0), 7).count() == 0


def test_a_changed_vector_file_is_an_error(spark, tmp_path):
    rows = embedded(spark, f"file://{tmp_path}/in", 60)
    store = vectors.kept_store(spark, "broken", [f"file://{tmp_path}/in"], rows)
    vectors.check(store)
    changed = store.vectors.withColumn("v", F.when(F.col("id") == 5, F.transform("v", lambda x: x + 1e-9)).otherwise(F.col("v")))
    for other in (changed, store.vectors.filter("id != 5"), store.vectors.unionAll(store.vectors.filter("id = 5"))):
        with pytest.raises(ValueError, match="not those that were stored"):
            vectors.check(vectors.Store(other, store.cells))
