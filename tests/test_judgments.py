"""Saved judgments against what is asked now; attempts; alignment in time; values of replays."""

from pyspark.sql import functions as F

from textloom.operators import judgments

SAVED = "query_id long, context string, status string, attempts array<struct<attempt int, status string>>"


def test_only_what_holds_is_kept(spark):
    now = spark.createDataFrame([(i, f"text {i}", None if i == 2 else "e") for i in range(1, 9)], "id long, answer string, evidence string")
    held = {r["query_id"]: r["context"] for r in judgments.contexts(now, "id", ["answer", "evidence"]).collect()}
    ok, twice = [(1, "success")], [(1, "failed"), (2, "success")]
    rows = [
        (1, held[1], "success", ok), (2, held[2], "success", twice), (3, "other", "success", ok), (4, held[4], "failed", twice), (5, held[5], "failed", [(1, "failed")]),
        (6, held[6], "success", ok), (6, held[6], "success", ok), (99, "x", "success", ok), (7, held[7], "failed", [(i, "failed") for i in (1, 2, 3)]),
    ]
    saved = spark.createDataFrame(rows, SAVED)
    got = {r["query_id"]: (r["state"], r["faults"]) for r in judgments.compared(saved, judgments.contexts(now, "id", ["answer", "evidence"])).collect()}
    assert got == {1: ("holds", []), 2: ("holds", []), 3: ("changed", []), 4: ("unsound", ["last", "gave_up"]), 5: ("unsound", ["gave_up"]), 6: ("repeated", []), 7: ("holds", []), 8: ("new", []), 99: ("gone", [])}
    todo = judgments.to_do(saved, judgments.contexts(now, "id", ["answer", "evidence"]))
    assert {r[0] for r in todo.collect()} == {3, 4, 5, 6, 8}
    # an empty text is not a missing one
    other = judgments.contexts(now.na.fill("", ["evidence"]), "id", ["answer", "evidence"])
    assert {r["query_id"] for r in judgments.compared(saved, other).filter("state = 'changed'").collect()} == {2, 3}


def test_attempts(spark):
    cases = [([], "success", ["count"]), (None, "success", ["count"]), ([(1, "failed")] * 4, "failed", ["count", "sequence"]), ([(2, "success")], "success", ["sequence"]), ([(1, "maybe")], "maybe", ["status"]),
             ([(1, "success"), (2, "success")], "success", ["early_success"]), ([(1, None)], None, ["status", "last"]), ([(1, "failed"), (2, "failed"), (3, "success")], "success", [])]
    rows = spark.createDataFrame([(i, "c", s, a) for i, (a, s, _) in enumerate(cases)], SAVED).select("query_id", judgments.attempt_faults(F.col("attempts"), F.col("status"), 3).alias("f"))
    assert {r[0]: r[1] for r in rows.collect()} == {i: f for i, (_, _, f) in enumerate(cases)}


def test_answers_meet_the_judgment_after_them(spark):
    answers = spark.createDataFrame([(1, "a", 10), (1, "a", 20), (1, "b", 10), (2, "a", 5), (None, "a", 1)], "query_id long, system string, at long")
    judged = spark.createDataFrame([(1, "a", 5, "early"), (1, "a", 12, "x"), (1, "a", 15, "y"), (1, "a", 20, "z"), (3, "a", 1, "lost"), (None, "a", 2, "null")], "query_id long, system string, at long, decision string")
    got = {tuple(r) for r in judgments.aligned(answers, judged).collect()}
    assert got == {(1, "a", 10, 15, "y"), (1, "a", 20, 20, "z"), (1, "b", 10, None, None), (2, "a", 5, None, None), (1, "a", None, 5, "early"), (3, "a", None, 1, "lost"), (None, "a", 1, 2, "null")}
    lacks = sorted((r["query_id"], r["system"], r["lacks"]) for r in judgments.unmatched(judgments.aligned(answers, judged)).collect())
    assert lacks == [(1, "a", "answer"), (1, "b", "judgment"), (2, "a", "judgment"), (3, "a", "answer")]


def test_values_of_replays(spark):
    rows = [("scalar", "[[5]]", "s"), ("scalar", "[[1],[2]]", "s"), ("scalar", "[[1,2]]", None), ("scalar", None, "s"), ("row_count", "[[1],[2]]", "s"), ("row_count", None, "s"), ("schema_state", "[[1]]", '{"t":1}'), ("ordered_rows", '[["a"]]', "s")]
    value, fault = judgments.oracle_value(F.col("kind"), F.col("rows"), F.col("snapshot"))
    got = [(r[0], r[1] is None) for r in spark.createDataFrame(rows, "kind string, rows string, snapshot string").coalesce(1).select(value, fault).collect()]
    assert got == [("5", True), (None, False), (None, False), (None, False), ("2", True), ("0", True), ('{"t":1}', True), ('[["a"]]', True)]
