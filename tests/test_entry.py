"""Every query with an SQL form gives the same rows; the library does without its optional part."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from textloom.plans import analysis, building, corpus, retrieval, semantic

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PLANS = (analysis, building, corpus, retrieval, semantic)
NAMES = sorted(name for plan in PLANS for name in plan.ORACLE)


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{name}')")
    return con


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(map(tuple, frame[names].astype(object).where(frame[names].notna(), None).values.tolist()), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, db, sf, name):
    assert rows(entry.queries()[name](spark, sf).toPandas()) == rows(db.execute(entry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(name for plan in PLANS for name in set(plan.QUERIES) - set(plan.ORACLE)))
def test_runs(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_the_optional_part(tmp_path):
    home = tmp_path / "copy"
    shutil.copytree(HERE, home, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); print(len(q), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=home, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(home)})
    assert done.returncode == 0, done.stderr
    done = subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "-p", "no:cacheprovider", "tests/test_functions.py", "tests/test_answers.py"], cwd=home, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(home)})
    assert done.returncode == 0, done.stdout
