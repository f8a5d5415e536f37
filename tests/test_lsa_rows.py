"""TF-IDF counted where texts lie, against the aggregates of (id, term, tf)."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import lsa
from textloom.operators.storage import written
from textloom.plans import semantic

STOP = ["the", "of"]


def made(spark, seed=3):
    rng = random.Random(seed)
    pool = ["the", "of", "Éclair", "naïve", "a", "日本", *(f"w{i}" for i in range(30))]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(0, 50))) for _ in range(40)] + [None, "", "the of the", "the"]
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3), len(texts)


@pytest.mark.parametrize("words", [7, 1 << 19])
def test_texts_are_counted_and_weighed_where_they_lie(spark, monkeypatch, words):
    monkeypatch.setattr(lsa, "WORDS", words)
    docs, n = made(spark)
    tf = written(lsa.frequencies(docs.select("id", lsa.terms(F.col("text"), STOP).alias("terms"))), "tf")
    texts = written(docs.select("id", lsa.words(F.col("text")).alias("words")), "texts")
    want = written(lsa.vocabulary(tf, n, 2, 0.9, 60), "vocabulary")
    got = written(lsa.chosen(lsa.totals(texts, STOP), n, 2, 0.9, 60), "vocabulary")
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect())) and want.count() == 60
    rows = lsa.weighed(texts, want, STOP)
    assert "Exchange" not in rows._jdf.queryExecution().toString()
    as_map = lambda df: {r["id"]: (r["places"], [round(w, 12) for w in r["weights"]]) for r in df.collect()}
    assert as_map(rows) == as_map(lsa.rows_of(tf, want)) and 40 < n


def test_an_id_that_is_there_twice_is_one_text(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (1, "aa cc"), (2, "aa bb"), (None, "bb cc"), (None, "bb")], "id long, text string").withColumn("words", lsa.words(F.col("text")))
    assert not lsa.one_a_text(docs) and lsa.one_a_text(docs.filter("id = 2 or text = 'aa cc'"))
    vocab = written(lsa.vocabulary(lsa.frequencies(docs.select("id", lsa.terms(F.col("text"), []).alias("terms"))), 3, 1, 1.0, 10), "vocabulary")
    assert semantic._weighed(docs, vocab).count() == 3
