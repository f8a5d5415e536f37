"""Counts of an index by rows: nothing is taken apart to find out in how many texts a term is."""

import pyarrow as pa

from textloom.operators import lexical


def test_queries_terms_are_counted_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "TERMS", 2)
    texts = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b", "c"]), (3, [])], "id long, tokens array<string>").repartition(2)
    index = lexical.Index(lexical.postings(texts), lexical.doc_lengths(texts), lexical.counted(texts))
    asked = spark.createDataFrame([(t,) for t in "abcdz"], "term string")
    found = lexical._frequencies(index, asked)
    assert sorted(map(tuple, found.collect())) == [("a", 1), ("b", 2), ("c", 1)]
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()  # postings are not taken apart
    assert lexical._frequencies(index, asked.limit(0)).count() == 0


def test_counts_of_rows():
    lists = pa.array([["b", "é", "b"], [], ["z", "b"]])
    row, term, times = lexical.row_counts(lexical.rows_in(lists), lists.flatten())
    assert list(zip(row.tolist(), term.to_pylist(), times.tolist())) == [(0, "b", 2), (0, "é", 1), (2, "b", 1), (2, "z", 1)]
