"""The lexical index by rows: texts are counted and scored where they lie."""

import random

import pytest

from textloom.operators import lexical
from textloom.operators.numbering import numbered


def test_counting_shuffles_nothing(spark):
    docs = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["c"])], "id long, tokens array<string>")
    rows = lexical.counted(docs)
    assert sorted(map(tuple, rows.collect())) == [(1, 3, ["a", "b"], [1, 2]), (2, 0, [], []), (3, 0, [], []), (4, 1, ["c"], [1])]
    assert "Exchange" not in rows._jdf.queryExecution().toString()


@pytest.mark.parametrize("model", [lexical.Bm25(), lexical.Bm25(idf="okapi"), lexical.Bm25(k1=1.2, weight="log")])
def test_best_are_the_best_of_all_scores(spark, monkeypatch, model):
    monkeypatch.setattr(lexical, "QUERIES", 3)
    monkeypatch.setattr(lexical, "TEXTS", 4)
    rng = random.Random(4)
    docs = [(i * 3, [w for w in "abcd" for _ in range(rng.randint(1, 3)) if rng.random() < 0.8]) for i in range(30)]
    asked = [(q, [rng.choice("abcdz") for _ in range(rng.randint(1, 3))]) for q in range(4)] + [(50, ["z"]), (51, ["a"])]
    texts, queries = spark.createDataFrame(docs, "id long, tokens array<string>").repartition(3), spark.createDataFrame(asked, "id long, tokens array<string>")
    held = lexical.Index(lexical.postings(texts), numbered(lexical.doc_lengths(texts), ["id"], "place"))
    by_row = lexical.Index(held.postings, held.lengths, lexical.counted(texts))
    rows = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 8) + 0.0) for r in df.collect())
    scored = lexical.scores(held, queries, model)
    for index in (held, by_row):
        assert rows(lexical.best(index, queries, model, 7)) == rows(lexical.top_k(scored, 7))
    assert rows(lexical.best(by_row, queries, model, 7, padded=True)) == rows(lexical.padded_top_k(scored, held, queries, 7))
    among = scored.filter("chunk_id % 2 = 0").select("query_id", "chunk_id")
    few = {(r[0], r[1]): r[2] for r in lexical.scores(by_row, queries, model, among).collect()}
    assert few == {(r[0], r[1]): r[2] for r in scored.filter("chunk_id % 2 = 0").collect()}
