"""Inputs beyond what the operators once were limited to, and empty tables."""

import pytest

from textloom.llm import quality, queries
from textloom.llm.packing import Limits, pack_texts
from textloom.llm.quality import Sample, fit
from textloom.llm.tokenization import vocabulary_path

EMPTY = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<double>, label int",
    "benchmark": "item_id long, text string",
    "conversations": "conv_id long, turn long, role string, text string",
}


@pytest.mark.parametrize("name", ["op2_top_k", "op4_near_duplicates", "op6_records", "op9_packing", "op10_token_counts", "op11_collocations", "op12_prefix_trie", "op13_repeats"])
def test_empty_tables(spark, tmp_path, name):
    for table, schema in EMPTY.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    assert queries.QUERIES[name](spark, f"file://{tmp_path}").count() == 0


def test_repeated_labels_and_rows_count_once(spark, monkeypatch):
    """5,000 rows of one id whose label is there three times: one row is collected of it, whichever order they come in."""
    seen = []
    monkeypatch.setattr(quality, "train", lambda texts, labels, *_: seen.append(sorted(zip(texts, labels))))
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)] + [(3, f"other {i}") for i in range(5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(3, 1), (3, 0), (3, 0), (None, 1), (4, None), (5, 7)], "doc_id long, quality int")
    for parts in (1, 5):
        fit(docs.repartition(parts), labels.repartition(parts), Sample(per_label=1000))
    assert seen[0] == seen[1] and len(seen[0]) == 20 and (b"other 0", 0) in seen[0]


def test_short_texts_fill_their_sequences(spark):
    """3,000 texts of two tokens: 1,024 segments are allowed, so no sequence but the last has room."""
    docs = spark.createDataFrame([(i, "a") for i in range(3000)], "doc_id long, text string").coalesce(1)
    pieces = pack_texts(docs, vocabulary_path("byte_bpe_50k.json"), end_id=0, limits=Limits(segments=1024)).groupBy("sequence_id").sum("length").collect()
    assert sorted(r[1] for r in pieces) == [880, *[1024] * 5]
