"""Column functions on test cases: kinds of expected results, their comparison, aliases, diagnostic tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of results by verb, and their other names.
SCHEMA_VERBS, DATA_VERBS = ("CREATE", "ALTER", "DROP"), ("INSERT", "UPDATE", "DELETE", "MERGE")
ORACLE_ALIASES = {
    "schema_and_rows": "database_state", "table_state": "database_state",
    "constraint_behavior": "database_state", "storage_type": "scalar", "scalar_and_type": "scalar",
}
OPERATORS = ("->>", "->", "::", "<=", ">=", "<>", "!=")


def oracle_type(sql: Column, rows: Column, columns: Column) -> Column:
    """What a statement's result is compared as; a single value is a scalar."""
    verb = F.upper(F.regexp_extract(sql, r"^\s*(\S+)", 1))
    return F.when(verb.isin(*SCHEMA_VERBS), "schema_state").when(verb.isin(*DATA_VERBS), "database_state").when((rows == 1) & (columns == 1), "scalar").otherwise("ordered_rows")


def canonical_oracle(name: Column) -> Column:
    return reduce(lambda c, x: c.when(name == x[0], x[1]), ORACLE_ALIASES.items(), F.when(F.lit(False), "")).otherwise(name)


def matches(expected: Column, low: Column, high: Column, observed: Column) -> Column:
    """Whether an observed number is the expected one, or, where there are bounds, finite and in [low, high)."""
    finite = ~F.isnan(observed) & (F.abs(observed) != float("inf"))
    return F.coalesce(F.when(low.isNotNull() & high.isNotNull(), finite & (observed >= low) & (observed < high)).otherwise(observed.eqNullSafe(expected)), F.lit(False))


def diagnostic_tokens(sql: Column, *identifiers: Column, most: int = 12) -> Column:
    """What names a fault: identifiers, operators, called functions, words with an underscore; each once, in this order."""
    empty = F.array().cast("array<string>")
    given = F.filter(F.transform(F.array(*identifiers), lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False))) if identifiers else empty
    sql = F.coalesce(sql, F.lit(""))
    operators = F.filter(F.array(*map(F.lit, OPERATORS)), lambda x: F.contains(sql, x))
    calls = F.regexp_extract_all(sql, F.lit(r"\b([A-Za-z_][A-Za-z0-9_$]*)\s*\("), F.lit(1))
    words = F.filter(F.regexp_extract_all(sql, F.lit(r"\b[A-Za-z_][A-Za-z0-9_$]*\b"), F.lit(0)), lambda x: F.contains(x, F.lit("_")))
    return F.slice(F.array_distinct(F.concat(given, operators, calls, words)), 1, most)


def task_success(*parts: Column) -> Column:
    """All of them; a null is a failure."""
    return reduce(lambda a, b: a & b, [F.coalesce(p, F.lit(False)) for p in parts])
