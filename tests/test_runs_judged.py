"""Queries on judged runs look up the runs' own pairs, whatever the labels are, and never list all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import analysis, evaluation, lexical
from textloom.plans import analysis as compared
from textloom.plans import retrieval

JUDGED = ("case_selection", "unjudged_pool", "acceptance_gates", "relative_gates", "paired_bootstrap", "complementarity", "failure_categories", "graded_metrics")
LEXICAL = ("leakage_status", "evidence_top5", "bm25_okapi_topk", "wrong_dialect_at5", "trec_render", "bm25_weighted_topk")
QUERIES = retrieval.QUERIES | compared.QUERIES


@pytest.fixture
def labelled(spark, tmp_path):
    """Labels beyond 0 to 9 too; all judgments as the SQL has them."""
    rng = random.Random(4)
    labels = {i: None if i % 41 == 0 else rng.choice([0, 1, 12, 13]) for i in range(600)}
    spark.createDataFrame(list(labels.items()), "vec_id long, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    gap = lambda q, c: None if labels[100 * q] is None or labels[c] is None else abs(labels[100 * q] - labels[c])
    every = [(q, c, {0: 2, 1: 1}.get(gap(q, c), 0)) for q in range(6) for c in labels if (31 * q + c) % 5]
    run = lambda: spark.createDataFrame([(q, c, n + 1) for q in range(6) for n, c in enumerate(rng.sample(range(600), 30))], "query_id long, chunk_id long, rank int")
    return str(tmp_path), spark.createDataFrame(every, "query_id long, chunk_id long, relevance int"), run(), run()


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_judgments_of_runs_serve_as_well_as_all(spark, labelled):
    sf, every, a, b = labelled
    some, asked = retrieval.judgments_of(spark, sf, a, b), retrieval.universe(spark, sf)
    assert rows(some) == rows(every.join(a.unionAll(b).select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"]))
    assert rows(evaluation.complementarity(a, b, some, 10)) == rows(evaluation.complementarity(a, b, every, 10))
    assert rows(analysis.failures(asked, a, b, some, 10, 5)) == rows(analysis.failures(asked, a, b, every, 10, 5))
    got = evaluation.any_relevance_of(retrieval.judged(spark, sf, a), retrieval.grades(spark, sf), asked)
    assert rows(got) == rows(evaluation.any_relevance(a, every, asked)) and got.filter("recall_20_any > 0").count() > 1


def joined(df):
    """The optimized plan: joins stand in it with their conditions."""
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", JUDGED)
def test_no_pair_is_made_but_of_runs(spark, sf, name):
    """No join on labels, but with their counts (rest): it would list every query's judgments."""
    plan = joined(QUERIES[name](spark, sf))
    assert not [line for line in plan.splitlines() if "Join" in line and "label" in line and "rest" not in line]


@pytest.mark.parametrize("name", LEXICAL)
def test_no_match_is_listed(spark, sf, name, monkeypatch):
    """Texts are scored where they lie: no query asks for the table of all matches, or for postings of all texts joined with it."""
    made = []
    monkeypatch.setattr(lexical, "scores", lambda *a, **k: made.append(a))
    monkeypatch.setattr(lexical, "padded_top_k", lambda *a, **k: made.append(a))
    plan = joined(QUERIES[name](spark, sf))
    assert not made and not [line for line in plan.splitlines() if "Join" in line and "term" in line]


def test_postings_need_no_shuffle(spark, sf):
    """term_stats sums up counts that are made where the texts lie: one shuffle, of a row a term and task."""
    index = retrieval.index(spark, sf)
    assert "Aggregate" not in joined(index.postings)
    plan = joined(lexical.term_stats(index))
    assert plan.count("Aggregate") == 1 and "Join" not in plan
    assert index.postings.agg(F.sum("tf")).first()[0] == index.lengths.agg(F.sum("dl")).first()[0]
