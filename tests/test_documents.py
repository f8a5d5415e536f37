"""JSON documents and CSV tables: what is written is read, what does not fit is an error, files are replaced whole."""

import json
import os

import pytest

from textloom.sources.documents import read_csv, read_json, write_csv, write_json

SCHEMA = "name string, n int, tags array<string>"


def test_a_document_is_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/report.json"
    row = spark.createDataFrame([("a \"b\" é", 1, ["x", None])], SCHEMA)
    write_json(row, path)
    assert json.loads((tmp_path / "report.json").read_text()) == {"name": 'a "b" é', "n": 1, "tags": ["x", None]}
    assert read_json(spark, path, SCHEMA).collect() == row.collect()
    write_json(spark.createDataFrame([(None, 2, None)], SCHEMA), path)
    assert json.loads((tmp_path / "report.json").read_text()) == {"name": None, "n": 2, "tags": None}
    for rows in ([], [("a", 1, None)] * 2):
        with pytest.raises(ValueError):
            write_json(spark.createDataFrame(rows, SCHEMA), path)
    assert json.loads((tmp_path / "report.json").read_text())["n"] == 2
    assert [f for f in os.listdir(tmp_path) if not f.startswith(".")] == ["report.json"]


def test_a_document_that_does_not_fit_is_an_error(spark, tmp_path):
    for text in ("{", '{"n": "many"}'):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(Exception, match="(?i)malformed"):
            read_json(spark, f"file://{tmp_path}/bad.json", SCHEMA).collect()
    (tmp_path / "good.json").write_text('{\n "n": 3,\n "more": 1\n}')
    assert read_json(spark, f"file://{tmp_path}/good.json", SCHEMA).first()["n"] == 3


@pytest.mark.parametrize("single", [False, True])
def test_tables_go_there_and_back(spark, tmp_path, single):
    rows = [(3, "c"), (1, 'say "x", twice'), (2, "two\nlines"), (5, None), (4, ""), (6, " blanks ")]
    df, path = spark.createDataFrame(rows, "n int, t string").repartition(3), f"file://{tmp_path}/t.csv"
    for _ in range(2):
        write_csv(df, path, ["n"], single)
    got = [tuple(r) for r in read_csv(spark, path, "n int, t string").collect()]
    assert sorted(got) == sorted(rows, key=lambda r: r[0]) and os.path.isfile(tmp_path / "t.csv") == single
    if single:
        assert [r[0] for r in got] == [1, 2, 3, 4, 5, 6]


def test_another_header_or_kind_is_an_error(spark, tmp_path):
    (tmp_path / "x.csv").write_text("n,t\n1,a\nmany,b\n")
    with pytest.raises(Exception):
        read_csv(spark, f"file://{tmp_path}/x.csv", "n int, other string").collect()
    with pytest.raises(Exception, match="(?i)malformed"):
        read_csv(spark, f"file://{tmp_path}/x.csv", "n int, t string").collect()
