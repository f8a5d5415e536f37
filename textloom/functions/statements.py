"""Statements of SQL scripts as a column: where each ends, with quotes, comments and trigger bodies seen as such.

A text is cut into tokens that cover it, and one aggregate runs a small machine over them: what ends a statement is a
semicolon outside of quotes and comments, and, in the body of a trigger, only the one after END.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Quotes and comments (to the end of the text where they are not closed), semicolons, words, white space, any other sign.
TOKEN = r"""(?s)'[^']*'?|"[^"]*"?|`[^`]*`?|\[[^\]]*\]?|--[^\n]*\n?|/\*.*?(?:\*/|\z)|;|[A-Za-z0-9_$\x{80}-\x{10FFFF}]+|[ \t\r\n\f]+|."""
KINDS = {"explain": 3, "create": 4, "temp": 5, "temporary": 5, "trigger": 6, "end": 7}
SEMICOLON, BLANK, OTHER = 0, 1, 2
# The states of SQLite's completeness check, a row a state: nothing yet, complete, statement, EXPLAIN, CREATE,
# trigger body, semicolon in it, END after that; a column a kind: semicolon, blank, other, EXPLAIN, CREATE, TEMP, TRIGGER, END.
NEXT = (
    (1, 0, 2, 3, 4, 2, 2, 2),
    (1, 1, 2, 3, 4, 2, 2, 2),
    (1, 2, 2, 2, 2, 2, 2, 2),
    (1, 3, 3, 2, 4, 2, 2, 2),
    (1, 4, 2, 2, 2, 4, 5, 2),
    (6, 5, 5, 5, 5, 5, 5, 5),
    (6, 6, 5, 5, 5, 5, 5, 7),
    (1, 7, 5, 5, 5, 5, 5, 5),
)
COMPLETE = 1


def _kind(token: Column) -> Column:
    found = F.when(token == ";", SEMICOLON).when(token.rlike(r"^(?:\s|--|/\*)"), BLANK)
    for word, kind in KINDS.items():
        found = found.when(F.lower(token) == word, kind)
    return found.otherwise(OTHER)


def ends(sql: Column) -> Column:
    """Positions, from 1, of the semicolons that end a statement. Null text has none."""
    table = F.array(*[F.lit(x) for row in NEXT for x in row])
    start = F.struct(F.lit(0).alias("state"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))

    def step(a: Column, token: Column) -> Column:
        state = F.element_at(table, a["state"] * len(NEXT[0]) + _kind(token) + 1)
        at = a["at"] + F.length(token)
        done = (token == ";") & (state == COMPLETE)
        return F.struct(F.when(done, 0).otherwise(state).alias("state"), at.alias("at"), F.when(done, F.concat(a["found"], F.array(at))).otherwise(a["found"]).alias("found"))

    tokens = F.coalesce(F.regexp_extract_all(sql, F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))
    return F.aggregate(tokens, start, step, lambda a: a["found"])


def statements(sql: Column) -> Column:
    """The statements in order, trimmed, blank ones left out; what follows the last semicolon is one too."""
    def cut(found: Column) -> Column:
        bounds = F.concat(F.array(F.lit(0)), found)
        after = F.concat(found, F.array(F.length(sql)))
        return F.filter(F.zip_with(bounds, after, lambda a, b: F.btrim(F.substring(sql, a + 1, b - a), F.lit(" \t\r\n\f\x0b"))), lambda s: s != "")

    return F.when(sql.isNull(), F.array().cast("array<string>")).otherwise(F.element_at(F.transform(F.array(ends(sql)), cut), 1))
