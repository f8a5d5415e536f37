"""Online queries, prompts and the contract of grounded answers: projections, closed validation, citations, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What an online query may show, what it must not, an answer's keys.
SAFE = ("query_id", "dialect", "version", "user_problem", "sql", "error_message", "error_code", "sqlstate", "error_symbol")
FORBIDDEN = ("root_cause", "expected_behavior", "reference_fix_sql", "evidence", "relevance", "verification", "error_category", "case_flags")
ANSWER_KEYS = ("root_cause", "explanation", "corrected_sql", "dialect_compatibility", "version_compatibility", "confidence", "citations", "assumptions", "limitations")
SECTIONS = (("Question", "user_problem"), ("SQL dialect", "dialect"), ("Version", "version"), ("SQL", "sql"), ("Observed error or behavior", "error_message"))


def online(cases: DataFrame) -> DataFrame:
    """The whitelisted fields that cases has; a forbidden one can't slip in by another name of the plan."""
    out = cases.select(*[c for c in SAFE if c in cases.columns])
    if set(out.columns) & set(FORBIDDEN):
        raise ValueError("a label would leak into the query")
    return out


def serialized(fields: dict[str, Column]) -> Column:
    """Titled sections between empty lines; empty ones are left out, line ends are LF."""
    lines = lambda c: F.regexp_replace(F.trim(c.cast("string")), r"\r\n?", "\n")
    return F.concat_ws("\n\n", *[F.when(F.coalesce(lines(fields[f]), F.lit("")) != "", F.concat(F.lit(f"{title}:\n"), lines(fields[f]))) for title, f in SECTIONS if f in fields])


def section_of(text: Column, title: str) -> Column:
    """The section of a serialized query, null where there is none."""
    return F.nullif(F.regexp_extract(text, rf"(?s)(?:^|\n\n){title}:\n(.*?)(?:\n\n|$)", 1), F.lit(""))


def passage(title: Column, section: Column, text: Column) -> Column:
    return F.concat_ws("\n", *[F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.concat(F.lit(f"{name}: "), c)) for name, c in (("Title", title), ("Section", section), ("Text", text))])


def answer_faults(answer: Column, supplied: Column, grounded: Column) -> Column:
    """What is wrong with a JSON answer, as an array of names: not an object, other keys, a confidence outside of 0 to 1,
    repeated or unknown citations, citations of a closed-book answer."""
    keys = F.array_sort(F.coalesce(F.json_object_keys(answer), F.array().cast("array<string>")))
    confidence = F.get_json_object(answer, "$.confidence").cast("double")
    cited = F.coalesce(F.from_json(F.get_json_object(answer, "$.citations"), "array<string>"), F.array().cast("array<string>"))
    no = lambda name, good: F.when(~F.coalesce(good, F.lit(False)), name)
    return F.array_compact(F.array(
        no("not_an_object", F.json_object_keys(answer).isNotNull()), no("keys", keys == F.array(*map(F.lit, sorted(ANSWER_KEYS)))), no("confidence", (confidence >= 0) & (confidence <= 1)),
        no("repeated_citation", F.size(F.array_distinct(cited)) == F.size(cited)), no("unknown_citation", ~grounded | (F.size(F.array_except(cited, supplied)) == 0)), no("closed_book_cites", grounded | (F.size(cited) == 0)),
    ))


def prompt(system: str, query: Column, evidence: Column) -> Column:
    """System text, query and compact JSON of the evidence array."""
    return F.concat_ws("\n\n", F.lit(system), query, F.when(F.size(evidence) > 0, F.concat(F.lit("Evidence:\n"), F.to_json(evidence))))


def side(ordinal: Column) -> Column:
    """Which system is shown first: even rows A, odd rows B."""
    return F.when(F.pmod(ordinal, F.lit(2)) == 0, "A").otherwise("B")


def judgment(text: Column) -> Column:
    """(winner, score): of a judge's reply, with or without a code fence; null unless it has just these keys, in range."""
    body = F.regexp_replace(F.trim(text), r"(?s)^```(?:json)?\s*|\s*```$", "")
    r = F.from_json(body, "winner string, score double")
    good = (F.array_sort(F.json_object_keys(body)) == F.array(F.lit("score"), F.lit("winner"))) & r["winner"].isin("A", "B", "tie") & r["score"].between(0, 1)
    return F.when(good, r)


def attempts(rows: Column) -> Column:
    """(tries, tokens, seconds) over an array of attempts with tokens and ns."""
    total = lambda f: F.aggregate(rows, F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x[f], F.lit(0)))
    return F.struct(F.size(rows).alias("tries"), total("tokens").alias("tokens"), (total("ns") / 1e9).alias("seconds"))


def improvement(task: Column, components: Column, relevance: Column) -> Column:
    return 100 * task + 10 * components + relevance


def outcomes(rows: DataFrame, before: str, after: str) -> DataFrame:
    """One row: improved, regressed, both, neither, delta; a null is a failure and stays in the count."""
    a, b = F.coalesce(F.col(before), F.lit(False)), F.coalesce(F.col(after), F.lit(False))
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return rows.agg(n(~a & b, "improved"), n(a & ~b, "regressed"), n(a & b, "both"), n(~a & ~b, "neither"), F.round(F.avg(b.cast("int")) - F.avg(a.cast("int")), 6).alias("delta"))
