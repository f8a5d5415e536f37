"""The patterns that Spark is given match what the stated ones match, and long odd texts don't overflow the stack."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T

PIECES = ["a", "B_1", "x$y", "é", "日本", "1", "22", ".", "..", "'", "''", '"', '""', "`", "--", "/*", "*/", "\n", "\r", "\r\n", " ", ":", "::", ":=", "@", "$", "$1", "->", "->>", "|", "||", "&", "<", ">=", "!", "!=", "(", ";", "{", "]", "^", "~", "%", "\\", "?", "#", "İ"]


def texts(n: int) -> list[str]:
    draw = random.Random(7)
    return ["".join(draw.choices(draw.sample(PIECES, draw.randint(2, len(PIECES))), k=draw.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("pattern", list(T.SAME))
def test_the_same_matches(spark, pattern):
    made = spark.createDataFrame([(t,) for t in texts(3000)], "t string")
    stated = F.regexp_extract_all("t", F.lit(pattern), F.lit(0))
    assert made.filter(~T.all_of(F.col("t"), pattern).eqNullSafe(stated)).take(3) == []


def test_long_texts_after_a_quote(spark):
    words, n = "word " * 30000, 30000
    given = {"'" + words: n, f"'{words}'": 1, "'''" + words: n + 1, '"' + words: n, "''" * n + "'": 1, "a" + ".a" * n: 1, "1" + ".1" * n: 1}
    made = spark.createDataFrame(list(given.items()), "t string, n int")
    assert made.filter(F.size(T.sql_tokens(F.col("t"))) != F.col("n")).count() == 0
    assert spark.createDataFrame([("a" + ".a" * n + " 1" + ".1" * n,)], "t string").select(F.size(T.field_tokens(F.col("t")))).first()[0] == 2


@pytest.mark.parametrize("tokens", [T.pool_tokens, T.word_tokens, T.lexical_tokens])
def test_long_dotted_numbers(spark, tokens):
    assert spark.createDataFrame([("1" + ".1" * 30000 + " ab",)], "t string").select(F.size(tokens(F.col("t")))).first()[0] == 2
