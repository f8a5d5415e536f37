import re

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import version as V


def value(spark, column, **given):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in given.items())
    return spark.createDataFrame([tuple(given.values())], schema).select(column.alias("x")).first()["x"]


def test_sql_tokens(spark):
    text = "SELECT a.b ->> 'it''s' FROM t -- note\nWHERE x >= 3.35.0 AND y = $1"
    got = value(spark, T.sql_tokens(F.col("t")), t=text)
    assert got == ["select", "a.b", "->>", "'it''s'", "from", "t", "-- note", "where", "x", ">=", "3.35.0", "and", "y", "=", "$1"]


def test_field_tokens(spark):
    assert value(spark, T.field_tokens(F.col("t")), t="Foo::BAR >= 14.2 and SQLSTATE 42P01") == "foo :: bar >= 14.2 and sqlstate 42p01".split()


def test_word_tokens_are_unicode(spark):
    text = "Größe été x_1 3.14 日本 don't"
    want = re.findall(r"[A-Za-z_][A-Za-z_0-9$]*|\d+(?:\.\d+)*|\w+", text)
    assert value(spark, T.word_tokens(F.col("t")), t=text) == want
    assert value(spark, T.word_count(F.col("t")), t=None) == 0


def test_normalize_and_shingles(spark):
    assert value(spark, T.normalize_for_hash(F.col("t")), t="SELECT  *\r\nFROM users;\n\n\n\n x ") == "select *\nfrom users;\n\n x"
    assert value(spark, T.shingles(F.col("t"), 5), t=["a", "b"]) == ["a", "b"]
    assert value(spark, T.shingles(F.col("t"), 2), t=["a", "b", "a", "b"]) == ["a b", "b a"]
    assert value(spark, T.ngrams(F.col("t"), 5), t=["a", "b"]) == []


def test_boilerplate_and_flags(spark):
    yes = ["Home", "- Back to top", "previous next up", "Docs / "]
    no = ["Homes", "the previous page is", ""]
    for t in yes + no:
        assert value(spark, T.is_boilerplate(F.col("t")), t=t) == (t in yes), t
    assert value(spark, T.contains_sql(F.col("t")), t="text\n  select 1") and not value(spark, T.contains_sql(F.col("t")), t="they select one")
    assert value(spark, T.contains_error_code(F.col("t"), F.lit("sqlite")), t="SQLITE_BUSY") and not value(spark, T.contains_error_code(F.col("t"), F.lit("mysql")), t="SQLITE_BUSY")
    assert value(spark, T.topic(F.lit("x"), F.col("t"), F.lit("docs")), t="A window function here") == "functions"
    assert value(spark, T.topic(F.lit("x"), F.col("t"), F.lit("release_notes")), t="error") == "release_notes"


def test_secrets_have_lines(spark):
    text = "a\nAKIA" + "A" * 16 + "\nx AKIA" + "B" * 16 + " ghp_" + "a" * 30
    got = value(spark, T.secrets(F.col("t")), t=text)
    assert [(r["type"], r["line"]) for r in got] == [("aws_access_key", 2), ("aws_access_key", 3), ("github_token", 3)]


def test_urls(spark):
    url = "HTTPS://Example.COM//a//b?utm_source=x&b=2&a=1#frag"
    assert value(spark, T.canonical_url(F.col("t")), t=url) == "https://example.com/a/b?a=1&b=2"
    assert value(spark, T.is_valid_url(F.col("t")), t=url) and not value(spark, T.is_valid_url(F.col("t")), t="ftp://x/y") and not value(spark, T.is_valid_url(F.col("t")), t="nothing")


def test_clean(spark):
    assert value(spark, T.clean_prose(F.col("t")), t="<p>a &amp; b</p><!-- c -->\n\n\n\n {% hint style=\"info\" %}x") == "a & b \n\nNote: x"
    assert value(spark, T.clean_atomic(F.col("t")), t="\n  \n a  \n b\n\n") == " a\n b"
    assert value(spark, T.chunk_body(F.col("t")), t="Title: x\n\nbody\n\nmore") == "body\n\nmore"


def test_version_numbers(spark):
    assert value(spark, V.number(F.col("t")), t="v8.0.30") == 8000030 and value(spark, V.number(F.col("t")), t="latest") is None
    for label, end in (("8.x", 9000000), ("8.0", 8001000), ("8.0.3", 8000004), ("8.0.x", 8001000), ("8", 9000000), ("y", None)):
        assert value(spark, V.range_end(F.col("t")), t=label) == end, label
    t = value(spark, V.target(F.col("t")), t="pre-3.37.0")
    assert (t["low"], t["high"]) == (None, 3037000)
    assert value(spark, V.release_version(F.col("t")), t="Release Notes 8_0_30")["version"] == "8.0.30"
    assert value(spark, V.release_version(F.col("t")), t="E.25. Release 14 > E.25.2")["version"] == "14"
    assert value(spark, V.release_version(F.col("t")), t="chapter 25.2") is None


def test_dialects(spark):
    cases = [("mysql", "MariaDB", "related"), ("mysql", "mysql ", "compatible"), ("mysql", None, "unknown"), ("sqlite", "duckdb", "incompatible")]
    for q, d, want in cases:
        assert value(spark, V.dialect_compatibility(F.col("q"), F.col("d")), q=q, d=d) == want
    assert value(spark, V.normalize_dialect(F.col("t")), t=" Maria  DB ") == "mariadb"


def test_normalized_text_is_that_of_plain_replacements(spark):
    """Texts without what is replaced are left alone, any others are searched: the same for every mixture, and for null."""
    import itertools

    texts = ["".join(x) for n in range(1, 6) for x in itertools.product("A \t\n\r", repeat=n)] + ["É  Ü\r\n\r\n\r\nß", "", None]
    got = spark.createDataFrame([(x,) for x in texts], "t string").select("t", T.normalize_for_hash(F.col("t"))).collect()
    plain = lambda t: re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]{2,}|\t", " ", re.sub(r"\r\n?", "\n", t))).strip(" \t\n\x0b\f\r").lower()
    assert all(b == (None if a is None else plain(a)) for a, b in got) and len(got) == len(texts)


def test_error_tokens_are_those_of_the_plain_alternatives(spark):
    import random

    plain = r"(?i)\b(?:SQLSTATE\s*[=:]?\s*)?(?:[0-9A-Z]{5})\b|\b(?:ER_|SQLITE_)[A-Z0-9_]+\b|\bERROR\s+[0-9]{3,5}\b"
    rng = random.Random(9)
    parts = ["SQLSTATE", "sqlstate", "Error", "ER_", "sqlite_", "BUSY", "42P01", "1064", "12", " ", "  ", "=", ":", "_", "é", "K", "abcde", "-", ".", "\n"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(9))) for _ in range(3000)] + [None]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select(T.all_of(F.col("t"), plain).alias("a"), T.all_of(F.col("t"), T.ERROR_TOKEN).alias("b")).collect()
    assert all(a == b for a, b in rows) and sum(len(a) for a, _ in rows) > 500
