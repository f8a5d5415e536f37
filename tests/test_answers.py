import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import answers


def test_serialized_sections(spark):
    row = spark.createDataFrame([("Why?\r\nWell", None, "8.0", " ", "boom")], "user_problem string, dialect string, version string, sql string, error_message string")
    text = row.select(answers.serialized({c: F.col(c) for c in row.columns}).alias("t")).first()["t"]
    assert text == "Question:\nWhy?\nWell\n\nVersion:\n8.0\n\nObserved error or behavior:\nboom"
    back = spark.createDataFrame([(text,)], "t string").select(answers.section_of(F.col("t"), "Version").alias("v"), answers.section_of(F.col("t"), "SQL").alias("s")).first()
    assert (back["v"], back["s"]) == ("8.0", None)


def test_online_drops_labels(spark):
    cases = spark.createDataFrame([(1, "p", "secret")], "query_id long, user_problem string, root_cause string")
    assert answers.online(cases).columns == ["query_id", "user_problem"]


@pytest.mark.parametrize(
    ("change", "grounded", "want"),
    [({}, True, []), ({"confidence": 1.5}, True, ["confidence"]), ({"citations": ["p1", "p1"]}, True, ["repeated_citation"]), ({"citations": ["p9"]}, True, ["unknown_citation"]), ({}, False, ["closed_book_cites"]), ({"more": 1}, True, ["keys"])],
)
def test_answer_contract(spark, change, grounded, want):
    made = {k: "x" for k in answers.ANSWER_KEYS} | {"confidence": 0.5, "citations": ["p1"]} | change
    row = spark.createDataFrame([(json.dumps(made), ["p1", "p2"], grounded)], "a string, s array<string>, g boolean")
    assert row.select(answers.answer_faults(F.col("a"), F.col("s"), F.col("g")).alias("f")).first()["f"] == want


def test_not_json(spark):
    row = spark.createDataFrame([("no",)], "a string").select(answers.answer_faults(F.col("a"), F.array(), F.lit(True)).alias("f")).first()
    assert row["f"][0] == "not_an_object"


def test_judgment(spark):
    for text, want in (('```json\n{"winner": "A", "score": 0.5}\n```', "A"), ('{"winner": "A", "score": 2}', None), ('{"winner": "A", "score": 1, "x": 1}', None), ("what", None)):
        got = spark.createDataFrame([(text,)], "t string").select(answers.judgment(F.col("t")).alias("j")).first()["j"]
        assert (got and got["winner"]) == want


def test_outcomes(spark):
    rows = spark.createDataFrame([(False, True), (True, None), (True, True), (None, None)], "a boolean, b boolean")
    assert tuple(answers.outcomes(rows, "a", "b").first()) == (1, 1, 1, 1, 0.0)
