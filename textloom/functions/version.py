"""Column functions on dialect and version labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DIALECTS = ("postgresql", "mysql", "sqlite", "mariadb", "duckdb")
ALIASES = {
    "postgres": "postgresql", "postgresql": "postgresql", "pgsql": "postgresql", "mysql": "mysql", "mysql community": "mysql",
    "mysql community edition": "mysql", "sqlite": "sqlite", "sqlite3": "sqlite", "mariadb": "mariadb", "maria db": "mariadb", "duckdb": "duckdb",
}
_TOKEN = r"v?([0-9]{1,2}(?:[._][0-9]{1,3}){0,2})(?![A-Za-z0-9]|[._][0-9])"
RELEASE = (
    r"(?i)\b(?:release(?:[\s_-]+notes?)?|version|changelog|change[\s_-]*log|what'?s[\s_-]+new(?:\s+in)?|releaselog)\b(?:\s*[:#=/\\_-]\s*|\s+)"
    r"(?:(?:[A-Za-z][A-Za-z0-9-]*)\s*[-_/\\]\s*){0,4}" + _TOKEN,
    "(?i)" + _TOKEN + r"(?:\s+[A-Za-z][A-Za-z0-9-]*){0,3}\s+(?:release(?:[\s_-]+notes?)?|version|changelog|change[\s_-]*log)\b",
    r"(?i)\b(?:PostgreSQL|MySQL|SQLite|MariaDB|DuckDB)\s+v?([0-9]{1,2}(?:[._][0-9]{1,3}){2})(?![A-Za-z0-9]|[._][0-9])",
)
_BOUND = r"(?<![\w.])v?([0-9]{1,3}(?:\.[0-9]{1,3}){0,2})(?!\w|%|\.[0-9])"
_LABEL = r"(?:(?:PostgreSQL|MySQL|SQLite|MariaDB|DuckDB)\s+)?"
MINIMUM = (
    rf"(?i)\b(?:added|introduced|implemented|available|supported)\s+(?:only\s+)?(?:in|since|from|starting\s+(?:in|with)|as\s+of)\s+(?:version\s+)?{_LABEL}{_BOUND}",
    rf"(?i)\b(?:PostgreSQL|MySQL|SQLite|MariaDB|DuckDB)\s+starting\s+with\s+(?:version\s+)?{_BOUND}",
    rf"(?i)\bsince\s+version\s+{_BOUND}",
    rf"(?i)\brequires?\s+(?:version\s+)?{_BOUND}\s+(?:or\s+(?:later|newer|higher)|and\s+later|\+)",
    rf"(?i)\b{_BOUND}\s+(?:and|or)\s+(?:later|newer|higher)\b",
)
MAXIMUM = (
    rf"(?i)\b(?:before|prior\s+to|older\s+than)\s+(?:version\s+)?{_BOUND}",
    rf"(?i)\b(?:removed|dropped|no\s+longer\s+(?:available|supported))\s+(?:in|since|from|as\s+of)\s+(?:version\s+)?{_BOUND}",
)
NEW_FEATURE = r"(?i)\b(?:new\s+features?|what'?s\s+new|now\s+supports?|was\s+added|has\s+been\s+added|introduc(?:e|ed|ing)|newly\s+available)\b"
SIGNATURE = r"->>|->|::|[A-Za-z_][A-Za-z_0-9$]*"
CALL = r"\b([A-Za-z_][A-Za-z_0-9$]*)\s*\("
GENERIC_CALLS = ("cast", "coalesce", "count", "max", "min", "sum", "avg", "values")
KEYWORDS = (
    "all and as asc by case create delete desc distinct else end from group having in insert into join limit not null on or order over select "
    "set table then union update using values when where with"
).split()


def normalize_dialect(value: Column) -> Column:
    """The dialect's own name; an unknown one is an error."""
    key = F.lower(F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"\s+", " "))
    found = reduce(lambda c, x: c.when(key == x[0], x[1]), list(ALIASES.items())[1:], F.when(key == next(iter(ALIASES)), next(iter(ALIASES.values()))))
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unsupported dialect: "), F.coalesce(value, F.lit("null")))))


def known_dialect(value: Column) -> Column:
    name = F.lower(F.trim(value))
    return F.when(name.isin(*DIALECTS), name)


def dialect_compatibility(query: Column, document: Column) -> Column:
    q, d = known_dialect(query), known_dialect(document)
    related = q.isin("mysql", "mariadb") & d.isin("mysql", "mariadb")
    return F.when(q.isNull() | d.isNull(), "unknown").when(q == d, "compatible").when(related, "related").otherwise("incompatible")


def is_wrong_dialect(query: Column, document: Column) -> Column:
    return F.coalesce(known_dialect(query) != known_dialect(document), F.lit(False))


def _label(version: Column, low: Column, high: Column, status: str) -> Column:
    text = lambda c: c.cast("string")
    return F.struct(text(version).alias("version"), text(low).alias("version_min"), text(high).alias("version_max"), F.lit(status).alias("version_status"))


def parse_label(value: Column) -> Column:
    """(version, version_min, version_max, version_status): unknown, current, range, exact."""
    text, none = F.regexp_replace(value, r"^\s+|\s+$", ""), F.lit(None)
    part = lambda pattern, i: F.regexp_extract(text, pattern, i)
    span = r"(?i)^v?([0-9]+(?:\.[0-9]+){0,2})\s*(?:-|–|—|to)\s*v?([0-9]+(?:\.[0-9]+){0,2}|x)$"
    family, exact, major = r"(?i)^v?([0-9]+\.[0-9]+)\.x$", r"(?i)^v?([0-9]+(?:\.[0-9]+){1,2})$", r"(?i)^v?([0-9]{1,2})$"
    return (
        F.when(text.isNull() | (text == ""), _label(none, none, none, "unknown"))
        .when(F.lower(text).isin("current", "latest", "stable"), _label(F.lit("current"), none, none, "current"))
        .when(text.rlike(span), _label(text, part(span, 1), part(span, 2), "range"))
        .when(text.rlike(family), _label(F.concat(part(family, 1), F.lit(".x")), F.concat(part(family, 1), F.lit(".0")), F.concat(part(family, 1), F.lit(".x")), "range"))
        .when(text.rlike(exact), _label(part(exact, 1), part(exact, 1), part(exact, 1), "exact"))
        .when(text.rlike(major), _label(part(major, 1), F.concat(part(major, 1), F.lit(".0")), F.concat(part(major, 1), F.lit(".x")), "range"))
        .otherwise(_label(text, none, none, "unknown"))
    )


def scope(version: Column, low: Column, high: Column, status: Column) -> Column:
    status = F.coalesce(F.nullif(status, F.lit("")), F.lit("unknown"))
    given = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("?"))
    return F.when(status == "range", F.concat(given(low), F.lit(".."), given(high))).otherwise(F.coalesce(F.nullif(version, F.lit("")), status))


def release_version(text: Column) -> Column:
    """The number next to an explicit release label, as parse_label reads it; null where there is none."""
    text = F.regexp_replace(text, r"(?<=[0-9])_(?=[0-9])", ".")
    found = F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in RELEASE])
    # as an array of one, so that the search is not repeated in every branch
    return F.when(found.isNotNull(), F.element_at(F.transform(F.array(found), parse_label), 1))


_NUMBERS = r"(?i)^v?([0-9]{1,3})(?:\.([0-9]{1,3}))?(?:\.([0-9]{1,3}))?$"


def _packed(text: Column, pattern: str) -> Column:
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).cast("long"), F.lit(0))
    return F.when(text.rlike(pattern), part(1) * 1000000 + part(2) * 1000 + part(3))


def number(text: Column) -> Column:
    """A version as one ordered number: major * 10^6 + minor * 10^3 + patch."""
    return _packed(F.regexp_replace(text, r"^\s+|\s+$", ""), _NUMBERS)


def target(text: Column) -> Column:
    """The half-open interval (low, high) that a query's version stands for; "pre" labels have no low."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    exact = number(trimmed)
    before = _packed(trimmed, r"(?i)^pre[-\s]*v?([0-9]{1,3})(?:\.([0-9]{1,3}))?(?:\.([0-9]{1,3}))?$")
    return F.struct(exact.alias("low"), F.coalesce(exact + 1, before).alias("high"))


def range_end(text: Column) -> Column:
    """The exclusive end of a range label: 8.x, 8.0 and 8.0.3 end at 9.0.0, 8.1.0 and 8.0.4."""
    t = F.regexp_replace(F.lower(F.regexp_replace(text, r"^\s+|\s+$", "")), "^v+", "")
    n = number(F.regexp_replace(t, r"\.x$", ""))
    parts = F.size(F.split(F.regexp_replace(t, r"\.x$", ""), r"\."))
    next_major, next_minor = (F.floor(n / 1000000) + 1) * 1000000, (F.floor(n / 1000) + 1) * 1000
    wild = F.when(parts == 1, next_major).when(parts == 2, next_minor)
    return F.when(t.endswith(".x"), wild).otherwise(F.when(parts == 1, next_major).when(parts == 2, next_minor).otherwise(n + 1)).cast("long")


def bounds(text: Column, patterns: tuple[str, ...]) -> Column:
    """Every explicit version bound in a passage, as numbers."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns])
    return F.filter(F.transform(found, number), lambda x: x.isNotNull())


def directly_diagnostic(sql: Column, code: Column, state: Column, symbol: Column, passage: Column) -> Column:
    """Whether a passage names what the query's SQL or error is about."""
    sql, folded = F.coalesce(sql, F.lit("")), F.lower(passage)
    tokens = F.transform(F.regexp_extract_all(sql, F.lit(SIGNATURE), F.lit(0)), F.lower)
    calls = F.filter(F.transform(F.regexp_extract_all(sql, F.lit(CALL), F.lit(1)), F.lower), lambda x: ~x.isin(*GENERIC_CALLS))
    named = F.array_distinct(F.filter(tokens, lambda t: ~t.isin(*KEYWORDS) & ((F.length(t) >= 4) | t.isin("->", "->>", "::"))))
    there = F.transform(F.regexp_extract_all(passage, F.lit(SIGNATURE), F.lit(0)), F.lower)
    called = F.transform(F.regexp_extract_all(folded, F.lit(r"(?<![a-z0-9_$])([a-z_][a-z_0-9$]*)\s*\("), F.lit(1)), lambda x: x)
    signs = reduce(lambda a, b: a | b, [sql.contains(x) & passage.contains(x) for x in ("->>", "->", "::")])
    leading = (F.size(tokens) >= 2) & (F.size(F.array_except(F.slice(tokens, 1, 2), there)) == 0)
    exact = reduce(lambda a, b: a | b, [F.coalesce((x != "") & F.contains(folded, F.lower(x)), F.lit(False)) for x in (code, state, symbol)])
    return F.arrays_overlap(calls, called) | signs | (F.size(F.array_intersect(named, there)) >= 2) | leading | exact


def version_compatibility(q: dict[str, Column], p: dict[str, Column]) -> Column:
    """Category of a passage for a query: the first rule that holds decides.

    q: dialect, version, sql, error_code, sqlstate, error_symbol. p: dialect, version_min, version_max, version_status,
    source_type, title, section, text.
    """
    some = lambda c: F.nullif(c, F.lit(""))
    text = F.concat_ws("\n", some(p["title"]), some(p["section"]), some(p["text"]))
    t = target(q["version"])
    low, high = t["low"], t["high"]
    least, most = bounds(text, MINIMUM), bounds(text, MAXIMUM)
    holds = F.exists(least, lambda b: F.coalesce(low >= b, F.lit(False))) | F.exists(most, lambda b: F.coalesce(high <= b, F.lit(False)))
    excludes = F.exists(least, lambda b: F.coalesce(high <= b, F.lit(False))) | F.exists(most, lambda b: F.coalesce(low >= b, F.lit(False)))
    direct = directly_diagnostic(q["sql"], q["error_code"], q["sqlstate"], q["error_symbol"], text)
    doc_low, doc_high = number(p["version_min"]), range_end(p["version_max"])
    fresh = F.coalesce((p["source_type"] == "release_notes") & text.rlike(NEW_FEATURE) & doc_low.isNotNull(), F.lit(False))
    meets = doc_low.isNotNull() & doc_high.isNotNull() & ~F.coalesce(low >= doc_high, F.lit(False)) & ~F.coalesce(high <= doc_low, F.lit(False))
    return (
        F.when(is_wrong_dialect(q["dialect"], p["dialect"]), "not_applicable")
        .when(low.isNull() & high.isNull(), "unknown")
        .when(holds, "compatible")
        .when(excludes & direct, "compatible")
        .when(excludes, "incompatible")
        .when(fresh & (high <= doc_low) & direct, "compatible")
        .when(fresh & (high <= doc_low), "incompatible")
        .when(fresh & (low >= doc_low), "compatible")
        .when(meets, "compatible")
        .when(p["version_status"] == "unknown", "unknown")
        .when((p["version_status"] == "current") & doc_low.isNull() & doc_high.isNull(), "unknown")
        .otherwise("general")
    )
