"""Every rule on cases fires for what breaks it, and for nothing else."""

import copy

import pytest
from pyspark.sql import functions as F

from textloom.operators import rules

SIDE = "struct<executed boolean, outcome string>"
SCHEMA = f"""query_id string, dialect string, version_status string, version string, version_min string, version_max string, sql string, user_problem string, expected_behavior string, root_cause string,
  reference_fix_sql string, reference_explanation string, case_flags struct<{', '.join(f'{f} boolean' for f in rules.FLAGS)}>, states_error boolean,
  evidence array<struct<chunk_id string, relevance int, role string, dialect_compatibility string, version_compatibility string>>, primary_evidence_chunk_id string,
  verification struct<method string, status string, original {SIDE}, fixed {SIDE}, engine string, engine_version string, oracle_type string, semantic_passed boolean>"""


def case(**changes):
    one = dict(
        query_id="q", dialect="mysql", version_status="exact", version="8.0", version_min=None, version_max=None, sql="SELECT", user_problem="u", expected_behavior="e", root_cause="r", reference_fix_sql="f", reference_explanation="x",
        case_flags=dict.fromkeys(rules.FLAGS, False), states_error=False, primary_evidence_chunk_id="a",
        evidence=[dict(chunk_id="a", relevance=2, role="primary", dialect_compatibility="compatible", version_compatibility="compatible"), dict(chunk_id="b", relevance=1, role="supporting", dialect_compatibility="unknown", version_compatibility="unknown")],
        verification=dict(method="execution", status="passed", original=dict(executed=True, outcome="o"), fixed=dict(executed=True, outcome="o"), engine="MySQL server", engine_version="8.0.1", oracle_type="ordered_rows", semantic_passed=True),
    )
    one = copy.deepcopy(one)
    for path, value in changes.items():
        at, *more = path.split("__")
        here = one
        while more:
            here, (at, *more) = here[int(at)] if isinstance(here, list) else here[at], more
        here[int(at) if isinstance(here, list) else at] = value
    return one


BROKEN = {
    "dialect": dict(dialect="oracle", verification__engine="Oracle"), "version_status": dict(version_status=None), "unknown_version": dict(version_status="unknown"),
    "unknown_version_min": dict(version_status="unknown", version=None, version_min="1"), "unknown_version_max": dict(version_status="unknown", version=None, version_max="1"),
    "range_version_min": dict(version_status="range", version_max="9"), "range_version_max": dict(version_status="range", version_min="1"), "stated_version": dict(version=None),
    **{f"{f}_filled": {f: v} for f, v in zip(("sql", "user_problem", "expected_behavior", "root_cause", "reference_fix_sql", "reference_explanation"), ("", None, " ", "", None, " "))},
    **{f"flag_{f}": {f"case_flags__{f}": None} for f in rules.FLAGS},
    "evidence_once": dict(evidence__1__chunk_id="a"), "evidence_relevance": dict(evidence__1__relevance=0), "evidence_role": dict(evidence__1__role=None), "evidence_dialect_compatibility": dict(evidence__1__dialect_compatibility="no"),
    "evidence_version_compatibility": dict(evidence__1__version_compatibility=None), "primary_is_evidence": dict(primary_evidence_chunk_id="z"), "primary_relevance": dict(evidence__0__relevance=1), "primary_role": dict(evidence__0__role="comparison"),
    "method": dict(verification__method="guess"), "verified": dict(verification__status="maybe"), "original_outcome": dict(verification__original__outcome=None), "fixed_outcome": dict(verification__fixed__outcome=""),
    "execution_original": dict(verification__original__executed=False), "execution_fixed": dict(verification__fixed__executed=None), "documentation_original": dict(verification__method="documentation_only", verification__oracle_type="documented_behavior", verification__fixed__executed=False),
    "documentation_fixed": dict(verification__method="documentation_only", verification__oracle_type="documented_behavior", verification__original__executed=False), "execution_engine_version": dict(verification__engine_version=None),
    "execution_oracle": dict(verification__oracle_type="documented_behavior"), "documentation_oracle": dict(verification__method="documentation_only", verification__original__executed=False, verification__fixed__executed=False),
    "passed_oracle": dict(verification__method="parser", verification__oracle_type="parser_only"), "passed_semantic": dict(verification__semantic_passed=None), "engine_names_dialect": dict(verification__engine="SQLite"),
}


def test_each_case_rule_fires_alone(spark):
    rows = [case(query_id="fine")] + [case(query_id=name, **changes) for name, changes in BROKEN.items()] + [case(query_id="evidence", evidence=[])]
    got = {}
    for r in rules.failures(spark.createDataFrame(rows, SCHEMA), "query_id", rules.CASE_RULES).collect():
        got.setdefault(r["query_id"], set()).add(r["rule"])
    assert got == {name: {name} for name in BROKEN} | {"evidence": {"evidence", "primary_is_evidence"}}
    assert set(BROKEN) | {"evidence"} == {name for name, *_ in rules.CASE_RULES}
    counts = {r["rule"]: (r["failures"], r["status"]) for r in rules.summary(spark.createDataFrame(rows[:1] + [case(query_id="x", version=None)], SCHEMA), "query_id", rules.CASE_RULES).collect()}
    assert counts["stated_version"] == (1, "FAIL") and counts["sql_filled"] == (0, "PASS") and len(counts) == len(rules.CASE_RULES)


def test_claims_need_their_evidence(spark):
    corpus = spark.createDataFrame([("a", "mysql", "since 8.0.3 it is gone"), ("b", "mariadb", None), ("c", "mysql", "MySQL and MariaDB"), ("d", "duckdb", "x")], "chunk_id string, dialect string, text string")
    flag = lambda name, **more: case(query_id=name, **{f"case_flags__{name}": True}, **more)
    rows = [
        case(query_id="fine"), case(query_id="none", evidence__0__chunk_id="lost"), flag("requires_dialect_reasoning"), flag("requires_version_reasoning"), flag("has_documented_error"),
        flag("compares_mysql_mariadb"), flag("is_duckdb_specific"),
        case(query_id="version", case_flags__requires_version_reasoning=True, evidence__0__version_compatibility="unknown", version_status="unknown"),
        case(query_id="dialect", case_flags__requires_dialect_reasoning=True, evidence__0__relevance=1), case(query_id="one", case_flags__compares_mysql_mariadb=True, evidence__1__chunk_id="a"),
        case(query_id="named", case_flags__compares_mysql_mariadb=True, evidence__1__chunk_id="c", evidence__1__role="comparison"), case(query_id="error", case_flags__has_documented_error=True, states_error=True),
        case(query_id="duck", dialect="duckdb", case_flags__is_duckdb_specific=True, evidence__0__chunk_id="d"), case(query_id="empty", evidence=[]),
    ]
    held = rules.supported(spark.createDataFrame(rows, SCHEMA), corpus, F.coalesce(F.col("text").rlike("since [0-9]"), F.lit(False)))
    got = {}
    for r in rules.failures(held, "query_id", rules.CLAIM_RULES).collect():
        got.setdefault(r["query_id"], set()).add(r["rule"])
    assert got == {
        "none": {"direct_evidence"}, "has_documented_error": {"error_claim"}, "is_duckdb_specific": {"duckdb_dialect", "duckdb_claim"}, "version": {"version_known", "version_claim"},
        "dialect": {"direct_evidence", "dialect_claim"}, "one": {"comparison_claim"}, "empty": {"direct_evidence"},
    }


def test_unknown_kinds_and_fields_are_errors(spark):
    rows = spark.range(1)
    with pytest.raises(KeyError):
        rules.failures(rows, "id", [("x", "guess", "id", ())])
    with pytest.raises(Exception, match="nowhere"):
        rules.failures(rows, "id", [("x", "stated", "nowhere", ())]).collect()
