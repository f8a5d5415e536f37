import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import cases
from textloom.functions import text as T
from textloom.operators import analysis, building, evaluation
from textloom.operators.building import Part, merged


def test_blocks_against_a_pass_in_order(spark):
    """The windows give what one pass over a document gives that remembers what it has kept."""
    rng = random.Random(5)
    words = ["alpha beta", "alpha  beta", "gamma " * 16, "home", "", "x y z", "Delta"]
    rows = [(d, n // 6, n, rng.choice(["prose", "prose", "code"]), rng.choice(words)) for d in range(8) for n in range(30)] + [(9, 0, 0, "prose", "menu"), (9, 0, 1, "prose", None)]
    got = {(r["doc_id"], r["n"]): r["keep"] for r in building.clean_blocks(spark.createDataFrame(rows, "doc_id long, section long, n int, type string, text string")).collect()}
    want, seen, local = {}, {}, {}
    for d, s, n, kind, text in rows:
        clean = " ".join((text or "").split()).lower() if kind == "prose" else (text or "").strip().replace("  ", " ").lower()
        bad = clean in ("", "home", "menu")
        short = kind == "prose" and len(clean.split()) < 15
        keep = not bad and not (short and clean in seen.setdefault(d, set())) and clean not in local.setdefault((d, s), set())
        want[d, n] = keep
        if not bad and not (short and clean in seen[d]):
            local[d, s].add(clean)
        if not bad:
            seen.setdefault(d, set()).add(clean)
    assert got == want
    whole = {r["doc_id"]: r for r in building.cleaned_documents(building.clean_blocks(spark.createDataFrame(rows, "doc_id long, section long, n int, type string, text string"))).collect()}
    assert whole[9]["empty"] and whole[9]["removed"] == 2 and not whole[0]["empty"]


def test_adjacent_parts():
    long = "word " * 40
    assert merged([Part("A", "short", ("u",)), Part("A", long, ("u",))]) == [Part("A", f"short\n\n{long}", ("u",))]
    two = merged([Part("A", "short", ("u",)), Part("B", long, ("u",)), Part("C", "Tail", ("u",))])
    assert [p.section for p in two] == ["A + adjacent subsections", "C"] and "Related subsection: B" in two[0].body
    assert len(merged([Part("A", "short", ("u",)), Part("A", long, ("v",))])) == 2
    assert len(merged([Part("A", "short", ("u",), True), Part("A", long, ("u",))])) == 2
    assert len(merged([Part("A", long, ("u",)), Part("A", "goes on", ("u",)), Part("A", "Then", ("u",))])) == 2
    assert len(merged([Part("A", "short", ()), Part("A", "word " * 600, ())])) == 2


def test_merge_adjacent_rows(spark):
    rows = [(1, 1, "S", "Long " * 40, None, "u"), (1, 0, "S", "one", False, "u"), (2, 0, None, None, False, None), (2, 1, "S", "x", False, None)]
    got = building.merge_adjacent(spark.createDataFrame(rows, "document_id long, n int, section string, body string, alone boolean, source string"), ["source"]).collect()
    assert sorted((r["document_id"], r["n"]) for r in got) == [(1, 0), (2, 0)] and next(r for r in got if r["document_id"] == 1)["body"].startswith("one\n\nLong")


def test_manifest(spark):
    rows = [(1, "a", "mysql", None, "single", "http://x", "n"), (2, "a", "odd", "bad", "single", "http://y", None), (3, "b", "mysql", "current", "sitemap", "http://x", ""), (4, "c", "mysql", "exact", None, None, "n"), (5, "d", "mysql", "exact", "archive", None, "n")]
    got = building.manifest_faults(spark.createDataFrame(rows, "n int, id string, dialect string, version_status string, collector string, url string, source_name string"), ["source_name"], ("mysql",)).collect()
    assert sorted((r["n"], r["fault"]) for r in got) == [(2, "duplicate_id"), (2, "invalid_dialect"), (2, "invalid_status"), (2, "missing_source_name"), (3, "duplicate_url"), (3, "missing_source_name"), (4, "invalid_collector"), (5, "missing_url")]


def test_selection_and_shards(spark):
    rows = spark.range(10).withColumnRenamed("id", "k")
    assert building.selected(rows, spark.createDataFrame([(3,), (3,), (7,)], "k long"), "k").count() == 2
    with pytest.raises(ValueError, match="not in the corpus"):
        building.selected(rows, spark.createDataFrame([(30,)], "k long"), "k")
    part = lambda a, b: rows.filter(F.col("k").between(a, b))
    assert building.concatenated([("x", part(0, 4), 0, 4), ("y", part(5, 9), 5, 9)], "k").count() == 10
    for bad in ([("x", part(0, 3), 0, 4)], [("x", part(0, 4), 0, 4), ("y", part(6, 9), 6, 9)], [("x", part(0, 1).union(part(0, 1)), 0, 3)]):
        with pytest.raises(ValueError):
            building.concatenated(bad, "k")


def test_usable_fragments(spark):
    rows = [("SELECT 1", "x", False), ("words only", "x", False), ("ERROR 1064 here", "x", True), ("```\nopen", "x", False), ("one two three four five six seven eight", "Syntax", False), ("Table:\n- a: 1", "x", False)]
    df = spark.createDataFrame(rows, "t string, s string, e boolean")
    assert [r[0] for r in df.select(T.is_usable_fragment(F.col("t"), F.col("s"), F.col("e"))).collect()] == [True, False, True, False, True, True]


def test_judged_rates_keep_failures(spark):
    rows = [("a", "success", 1, True, 0.5), ("a", None, None, None, None), ("a", "failed", 0, False, 1.0)]
    r = analysis.judged(spark.createDataFrame(rows, "s string, status string, retry int, ok boolean, score double"), ["s"], ["ok"], ["score"], "status", "retry").first()
    assert (r["results"], r["successes"], r["failures"], r["recovered"], r["ok"], r["score"]) == (3, 1, 2, 1, 0.333333, 0.5)
    with pytest.raises(Exception, match="outside"):
        analysis.judged(spark.createDataFrame([("a", "success", 0, True, 1.5)], "s string, status string, retry int, ok boolean, score double"), ["s"], ["ok"], ["score"], "status", "retry").collect()


def test_gates(spark):
    rows = spark.createDataFrame([("a", 0.5, 0.46), ("b", 0.5, 0.3), ("c", 0.0, 0.0), ("d", 0.1, None)], "metric string, control double, candidate double")
    got = {r["metric"]: r["passed"] for r in analysis.gates(rows, {"a": ("drops_by", 0.05), "b": ("falls_by", 0.5), "c": ("falls_by", 0.1), "d": ("at_least", 0.0)}).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": False}


def test_case_functions(spark):
    df = spark.createDataFrame([("select a_b(x) -> c", 5.0, None, None, 5.0), ("DROP t", 1.0, 2.0, 3.0, 3.0), ("x", None, 2.0, 3.0, 2.5), ("y", None, 0.0, 1.0, float("nan"))], "sql string, e double, lo double, hi double, o double")
    got = df.select(cases.diagnostic_tokens(F.col("sql"), F.lit(" E1 "), F.lit(None).cast("string")).alias("t"), cases.matches(F.col("e"), F.col("lo"), F.col("hi"), F.col("o")).alias("m"), cases.oracle_type(F.col("sql"), F.lit(1), F.lit(1)).alias("k")).collect()
    assert got[0]["t"] == ["E1", "->", "a_b"] and [r["m"] for r in got] == [True, False, True, False] and [r["k"] for r in got] == ["scalar", "schema_state", "scalar", "scalar"]


def test_any_relevance(spark):
    run = spark.createDataFrame([(1, 5, 2), (1, 6, 1), (1, 7, 8)], "query_id long, chunk_id long, rank int")
    qrels = spark.createDataFrame([(1, 5, 1), (1, 7, 2), (1, 9, 1), (1, 6, 0)], "query_id long, chunk_id long, relevance int")
    r, none = evaluation.any_relevance(run, qrels, spark.createDataFrame([(1,), (2,)], "query_id long")).orderBy("query_id").collect()
    assert (r["mrr_10_any"], r["recall_5_any"], r["recall_10_any"], r["p_5_any"], r["hit_5_any"]) == (0.5, 0.333333, 0.666667, 0.2, 1.0) and none["mrr_10_any"] == 0.0
