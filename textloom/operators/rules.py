"""Rules over annotated cases, as a table: each row names a rule, its kind and what it looks at. A table becomes one
projection, so that all rules of a case are decided in one pass, and every failure is a row (id, rule).

Rules on a case alone need no shuffle. Those on what its evidence says join the evidence with the corpus once, by chunk,
and sum it up by case.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, str, str, tuple]


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def _not_in(c: Column, values: tuple) -> Column:
    return ~F.coalesce(c.isin(*values), F.lit(False))


#: Kinds of rules: from a field's column, the rule's values and a function that finds other fields, what makes it fail.
KINDS: dict[str, Callable[[Column, tuple, Callable[[str], Column]], Column]] = {
    "one_of": lambda c, v, of: _not_in(c, v),
    "filled": lambda c, v, of: _blank(c),
    "stated": lambda c, v, of: c.isNull(),
    # values: another field, then those of its values for which this one has to be null, or not
    "null_where": lambda c, v, of: F.coalesce(of(v[0]).isin(*v[1:]), F.lit(False)) & c.isNotNull(),
    "stated_where": lambda c, v, of: F.coalesce(of(v[0]).isin(*v[1:]), F.lit(False)) & c.isNull(),
    "true_where": lambda c, v, of: F.coalesce(of(v[0]).isin(*v[1:]), F.lit(False)) & ~F.coalesce(c, F.lit(False)),
    "false_where": lambda c, v, of: F.coalesce(of(v[0]).isin(*v[1:]), F.lit(False)) & F.coalesce(c, F.lit(False)),
    # values: another field and its value, then values of this one
    "one_of_where": lambda c, v, of: F.coalesce(of(v[0]) == v[1], F.lit(False)) & _not_in(c, v[2:]),
    "none_of_where": lambda c, v, of: F.coalesce(of(v[0]) == v[1], F.lit(False)) & F.coalesce(c.isin(*v[2:]), F.lit(False)),
    "names": lambda c, v, of: of(v[0]).isNotNull() & ~F.coalesce(F.contains(F.lower(c), F.lower(of(v[0]))), F.lit(False)),
    # of a list: it has an element, none of a field's values twice, all of them allowed
    "not_empty": lambda c, v, of: F.coalesce(F.size(c), F.lit(0)) < 1,
    "distinct": lambda c, v, of: F.coalesce(F.size(F.array_distinct(F.transform(c, lambda x: x[v[0]]))) < F.size(c), F.lit(False)),
    "each_of": lambda c, v, of: F.coalesce(F.exists(c, lambda x: _not_in(x[v[0]], v[1:])), F.lit(False)),
    # of a list: the elements whose first field is what another field says; there is one, the first has such values
    "points_into": lambda c, v, of: ~F.coalesce(F.exists(c, lambda x: F.coalesce(x[v[0]] == of(v[1]), F.lit(False))), F.lit(False)),
    "pointed_is": lambda c, v, of: F.coalesce(F.exists(F.slice(F.filter(c, lambda x: F.coalesce(x[v[0]] == of(v[1]), F.lit(False))), 1, 1), lambda x: _not_in(x[v[2]], v[3:])), F.lit(False)),
    "holds": lambda c, v, of: ~F.coalesce(c, F.lit(False)),
}


def failures(rows: DataFrame, id_col: str, rules: list[Rule]) -> DataFrame:
    """(id_col, rule) for each rule that a row breaks. A field may lie in a structure (a.b). A rule of an unknown kind, or
    on a field that is not there, is an error."""
    of = lambda name: F.col(name)
    checks = [F.when(KINDS[kind](of(field), values, of), F.lit(name)) for name, kind, field, values in rules]
    return rows.select(F.col(id_col), F.explode(F.array_compact(F.array(*checks))).alias("rule"))


def summary(rows: DataFrame, id_col: str, rules: list[Rule]) -> DataFrame:
    """(rule, failures, status) for every rule, also those that nothing breaks."""
    named = rows.sparkSession.createDataFrame([(name,) for name, *_ in rules], "rule string")
    counts = failures(rows, id_col, rules).groupBy("rule").agg(F.count(F.lit(1)).alias("failures"))
    out = named.join(counts, "rule", "left").na.fill(0, ["failures"])
    return out.withColumn("status", F.when(F.col("failures") == 0, "PASS").otherwise("FAIL"))


# What an annotated case may say.
DIALECTS = ("mysql", "mariadb", "sqlite", "duckdb", "postgresql")
STATUSES = ("exact", "range", "current", "legacy", "unknown")
FLAGS = ("requires_dialect_reasoning", "requires_version_reasoning", "has_documented_error", "compares_mysql_mariadb", "is_duckdb_specific")
COMPATIBLE = ("compatible", "incompatible", "unknown", "not_applicable")

CASE_RULES: list[Rule] = [
    ("dialect", "one_of", "dialect", DIALECTS),
    ("version_status", "one_of", "version_status", STATUSES),
    *((f"unknown_{f}", "null_where", f, ("version_status", "unknown")) for f in ("version", "version_min", "version_max")),
    *((f"range_{f}", "stated_where", f, ("version_status", "range")) for f in ("version_min", "version_max")),
    ("stated_version", "stated_where", "version", ("version_status", "exact", "current", "legacy")),
    *((f"{f}_filled", "filled", f, ()) for f in ("sql", "user_problem", "expected_behavior", "root_cause", "reference_fix_sql", "reference_explanation")),
    *((f"flag_{f}", "stated", f"case_flags.{f}", ()) for f in FLAGS),
    ("evidence", "not_empty", "evidence", ()),
    ("evidence_once", "distinct", "evidence", ("chunk_id",)),
    ("evidence_relevance", "each_of", "evidence", ("relevance", 1, 2)),
    ("evidence_role", "each_of", "evidence", ("role", "primary", "supporting", "comparison")),
    *((f"evidence_{f}", "each_of", "evidence", (f, *COMPATIBLE)) for f in ("dialect_compatibility", "version_compatibility")),
    ("primary_is_evidence", "points_into", "evidence", ("chunk_id", "primary_evidence_chunk_id")),
    ("primary_relevance", "pointed_is", "evidence", ("chunk_id", "primary_evidence_chunk_id", "relevance", 2)),
    ("primary_role", "pointed_is", "evidence", ("chunk_id", "primary_evidence_chunk_id", "role", "primary")),
    ("method", "one_of", "verification.method", ("execution", "parser", "documentation_only")),
    ("verified", "one_of", "verification.status", ("passed", "failed", "not_available")),
    *((f"{side}_outcome", "filled", f"verification.{side}.outcome", ()) for side in ("original", "fixed")),
    *((f"execution_{side}", "true_where", f"verification.{side}.executed", ("verification.method", "execution")) for side in ("original", "fixed")),
    *((f"documentation_{side}", "false_where", f"verification.{side}.executed", ("verification.method", "documentation_only")) for side in ("original", "fixed")),
    ("execution_engine_version", "stated_where", "verification.engine_version", ("verification.method", "execution")),
    ("execution_oracle", "none_of_where", "verification.oracle_type", ("verification.method", "execution", "parser_only", "documented_behavior", "not_available")),
    ("documentation_oracle", "one_of_where", "verification.oracle_type", ("verification.method", "documentation_only", "documented_behavior")),
    ("passed_oracle", "none_of_where", "verification.oracle_type", ("verification.status", "passed", "parser_only", "not_available")),
    ("passed_semantic", "true_where", "verification.semantic_passed", ("verification.status", "passed")),
    ("engine_names_dialect", "names", "verification.engine", ("dialect",)),
]


def supported(cases: DataFrame, corpus: DataFrame, changes: Column) -> DataFrame:
    """cases (query_id, dialect, version_status, case_flags, error_fields stated, evidence) with what the evidence in corpus
    (chunk_id, dialect, text) says: direct (relevant in full, compatible, of the case's dialect), version_change (a direct
    one for which changes holds, and whose version compatibility is decided), two_systems (evidence of both MySQL and MariaDB,
    or a comparison that names both), duckdb. Evidence that the corpus lacks says nothing."""
    e = cases.select("query_id", F.col("dialect").alias("wanted"), F.explode("evidence").alias("e")).select("query_id", "wanted", "e.*")
    found = e.join(corpus.select("chunk_id", "dialect", F.lower(F.coalesce("text", F.lit(""))).alias("_text"), changes.alias("_changes")), "chunk_id")
    direct = (F.col("relevance") == 2) & (F.col("dialect_compatibility") == "compatible") & (F.col("dialect") == F.col("wanted"))
    both = (F.col("role") == "comparison") & F.contains("_text", F.lit("mysql")) & F.contains("_text", F.lit("mariadb"))
    any_ = lambda c, name: F.bool_or(F.coalesce(c, F.lit(False))).alias(name)
    said = found.groupBy("query_id").agg(
        any_(direct, "direct"), any_(direct & F.col("version_compatibility").isin("compatible", "incompatible") & F.col("_changes"), "version_change"),
        any_(F.col("dialect") == "mysql", "_a"), any_(F.col("dialect") == "mariadb", "_b"), any_(both, "_both"), any_(direct & (F.col("dialect") == "duckdb"), "duckdb"),
    )
    said = said.withColumn("two_systems", (F.col("_a") & F.col("_b")) | F.col("_both")).drop("_a", "_b", "_both")
    return cases.join(said, "query_id", "left")


CLAIM_RULES: list[Rule] = [
    ("direct_evidence", "holds", "direct", ()),
    ("dialect_claim", "true_where", "direct", ("case_flags.requires_dialect_reasoning", True)),
    ("version_known", "none_of_where", "version_status", ("case_flags.requires_version_reasoning", True, "unknown")),
    ("version_claim", "true_where", "version_change", ("case_flags.requires_version_reasoning", True)),
    ("error_claim", "true_where", "states_error", ("case_flags.has_documented_error", True)),
    ("comparison_dialect", "one_of_where", "dialect", ("case_flags.compares_mysql_mariadb", True, "mysql", "mariadb")),
    ("comparison_claim", "true_where", "two_systems", ("case_flags.compares_mysql_mariadb", True)),
    ("duckdb_dialect", "one_of_where", "dialect", ("case_flags.is_duckdb_specific", True, "duckdb")),
    ("duckdb_claim", "true_where", "duckdb", ("case_flags.is_duckdb_specific", True)),
]
