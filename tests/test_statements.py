"""Statements of scripts against sqlite3's own completeness check, sign by sign."""

import random
import sqlite3

from pyspark.sql import functions as F

from textloom.functions.statements import ends, statements


def plain(sql):
    out, places, held = [], [], ""
    for at, sign in enumerate(sql or "", 1):
        held += sign
        if sign == ";" and sqlite3.complete_statement(held):
            out.append(held.strip(" \t\r\n\f\x0b"))
            places.append(at)
            held = ""
    return [s for s in [*out, held.strip(" \t\r\n\f\x0b")] if s], places


def test_statements_against_sqlite(spark):
    rng = random.Random(9)
    parts = ["SELECT 1", ";", ";", ";", " ", "\n", "'a;b'", "'it''s;'", '"c;"', "`d;`", "[e;]", "-- f; g\n", "/* h; */", "CREATE TRIGGER t BEGIN", " END", ";END;", "create", " temp ", "temporary", " trigger ", "EXPLAIN ", "éend", "end", "$1", "'open;", "/* open;", "-", "/", "*", "UPDATE x SET y=1"]
    scripts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 14))) for _ in range(1500)]
    scripts += [None, "", ";", "  ", "CREATE TEMP TRIGGER a AFTER INSERT ON b BEGIN SELECT 1; SELECT 2; END; SELECT 3", "-- only; a comment", "SELECT 1; -- end; of it\nSELECT 2"]
    rows = spark.createDataFrame(list(enumerate(scripts)), "n long, sql string").repartition(4)
    got = {r["n"]: (r["s"], r["e"]) for r in rows.select("n", statements(F.col("sql")).alias("s"), ends(F.col("sql")).alias("e")).collect()}
    for n, sql in enumerate(scripts):
        assert got[n] == plain(sql), sql
