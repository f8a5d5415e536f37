"""The stages on a small corpus whose parts are known: junk goes, one of each group stays, a planted passage goes."""

import random

import pytest

import corpus_pipeline
from textloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    good = {i: text(rng.randint(20, 120)) + "." for i in range(150)}
    junk = {200 + i: " ".join(word().upper() + "!!" for _ in range(rng.randint(20, 120))) for i in range(90)}
    copies = {300: good[3], 301: good[3].upper().capitalize(), 302: good[4] + " more"}
    item = text(40)
    planted = {400: text(30) + " " + item}
    docs = [(i, t, "en", "s", len(t)) for i, t in (good | junk | copies | planted).items()]
    home = tmp_path_factory.mktemp("corpus")
    rows = {
        "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": ([(i, 1, 0) for i in good] + [(i, 0, 0) for i in junk], "doc_id long, quality int, toxic int"),
        "benchmark": ([(1, item)], "item_id long, text string"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{home}/{name}.parquet")
    return str(home), good, junk


def test_pipeline(spark, corpus):
    home, good, junk = corpus
    got = corpus_pipeline.run(spark, home).collect()
    kept = {r["doc_id"] for r in got}
    assert not kept & set(junk) and 400 not in kept and not kept & {300, 302}
    assert len(kept & set(good)) >= 0.97 * len(good)
    for i in kept:
        own = sorted((r["start"], r["length"]) for r in got if r["doc_id"] == i)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))


def test_stages_keep_the_columns(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, corpus[0])
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        assert stage(spark, docs.limit(0), corpus[0]).count() == 0


def test_registered():
    assert [k.split("_")[0] for k in QUERIES] == [f"op{n}" for n in range(1, 14)] and set(ORACLE_SQL) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "packing"]
