import io
import tarfile
import zipfile

import pytest
from pyspark.sql.types import StructType

from textloom.sources import archives, parsers, runs
from textloom.streaming import incremental

PAGE = """<html><head><title>Guide</title></head><body><nav><p>Menu</p></nav><h1>Guide</h1><p>First <b>bold</b> &amp; more</p>
<h2>Syntax</h2><pre>SELECT 1
FROM t</pre><ul><li>one</li><li>two</li></ul><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>
<div class="cookie-bar"><p>Cookies</p></div><script>"<p>no</p>"</script></body></html>"""


def test_markup():
    got = list(parsers.markup(PAGE, "Guide"))
    assert got == [
        ("Guide", "prose", "First bold & more"), ("Guide > Syntax", "code", "```sql\nSELECT 1\nFROM t\n```"), ("Guide > Syntax", "prose", "- one"),
        ("Guide > Syntax", "prose", "- two"), ("Guide > Syntax", "table", "Table:\n- A: 1 | B: 2"),
    ]


def test_markdown_and_plain():
    got = list(parsers.markdown("---\nx: y\n---\n# A\ntext\nmore\n\n## B\n```sql\nSELECT 1\n```\n| a | b |\n|---|---|\n| 1 | 2 |\n- item\n", "T"))
    assert [(s, k) for s, k, _ in got] == [("T > A", "prose"), ("T > B", "code"), ("T > B", "table"), ("T > B", "prose")]
    assert "Table:\n- a: 1 | b: 2" in [t for _, _, t in got]
    got = list(parsers.plain("Head\n====\nSome text\n\nSELECT 1;\n\nSELECT 1\n  FROM t;", "T"))
    assert got == [("T > Head", "prose", "Some text"), ("T > Head", "prose", "SELECT 1;"), ("T > Head", "code", "```text\nSELECT 1\n  FROM t;\n```")]


def test_plain_headings_stand_anywhere():
    """A rule makes a heading of the line above it inside of a paragraph too; only = and - rule, three of them at least."""
    got = list(parsers.plain("intro\nHeading\n===\nbody\r\nmore\nLast\n -=-=\n\nno\n~~~~\nno\n--\n---\n===\nx", "T"))
    assert got == [("T", "prose", "intro"), ("T > Heading", "prose", "body more"), ("T > Last", "prose", "no ~~~~ no"), ("T > --", "prose", "=== x")]
    assert list(parsers.plain("", "T")) == list(parsers.plain("\n \n", "T")) == list(parsers.plain("A\n----", "T")) == []
    # several lines that name a statement or an error anywhere
    assert [k for _, k, _ in parsers.plain("an ERROR came\nof it\n\na selection\nof rows\n\none ERROR line", "T")] == ["code", "prose", "prose"]


def test_error_catalogue():
    text = 'start-error-number 1000\nER_HASHCHK 42S02\n  eng "no \\"hash\\""\n  ger "nein"\nER_NISAMCHK\n  eng "isam"\nskip-to-error-number 2000\nER_LAST\n  eng "last"\n'
    got = list(parsers.error_catalogue(text, "E"))
    assert [s for s, _, _ in got] == ["E > ER_HASHCHK", "E > ER_NISAMCHK", "E > ER_LAST"]
    assert "Error number: 1000\nSQLSTATE: 42S02" in got[0][2] and "Error number: 1001" in got[1][2] and "Error number: 2000" in got[2][2]


def test_help_tables():
    sql = "INSERT INTO help_category (a) VALUES (3,'Math',1,'');\nINSERT INTO help_topic (a) VALUES (1,3,'ABS','It\\'s abs','SELECT ABS(1)','http://x');"
    assert list(parsers.help_tables(sql, "H")) == [("H > Math > ABS", "prose", "It's abs"), ("H > Math > ABS", "code", "```sql\nSELECT ABS(1)\n```")]


def test_parse_documents_keeps_failures(spark):
    rows = spark.createDataFrame([(1, PAGE, "html", "Guide"), (2, "x", "unknown", "t"), (3, None, "text", None)], "id long, text string, f string, t string")
    got = parsers.parse_documents(rows, "id", "text", "f", "t").collect()
    assert len([r for r in got if r["id"] == 1]) == 5 and [r["error"] for r in got if r["id"] == 2] == ["KeyError: 'unknown'"] and not [r for r in got if r["id"] == 3]


def test_runs_round_trip(spark, tmp_path):
    run = spark.createDataFrame([("q1", "b", 2, -0.0, "t"), ("q1", "a", 1, 1.5, "t")], "query_id string, chunk_id string, rank int, score double, tag string")
    runs.write_run(run, str(tmp_path / "run"))
    assert [tuple(r) for r in runs.read_run(spark, str(tmp_path / "run")).orderBy("rank").collect()] == [("q1", "a", 1, 1.5, "t"), ("q1", "b", 2, 0.0, "t")]
    (tmp_path / "bad").write_text("q1 Q0 a 0 1.0 t\n")
    with pytest.raises(Exception, match="not a run line"):
        runs.read_run(spark, str(tmp_path / "bad")).collect()


def test_qrels_merge(spark):
    rows = lambda x: spark.createDataFrame(x, "query_id string, chunk_id string, relevance int")
    base, pool = rows([("q", "a", 2)]), rows([("q", "a", 0), ("q", "b", 0)]).select("query_id", "chunk_id")
    assert runs.merge_qrels(base, rows([("q", "b", 1)]), pool).count() == 2
    with pytest.raises(ValueError, match="twice"):
        runs.merge_qrels(base, rows([("q", "a", 1)]), pool)
    with pytest.raises(ValueError, match="outside"):
        runs.merge_qrels(base, rows([("q", "c", 1)]), pool)


def test_archives(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("top/a.html", "<p>x</p>")
        z.writestr("top/skip.bin", "y")
    (tmp_path / "x.zip").write_bytes(data.getvalue())
    got = archives.read_archives(spark, str(tmp_path / "x.zip"), include=("*.html",), strip=1).collect()
    assert [(r["member"], bytes(r["content"])) for r in got] == [("a.html", b"<p>x</p>")]


def test_no_member_is_lost(spark, tmp_path):
    """Large members come out whole; one over a limit, and an archive that can't be read, are rows with an error."""
    large = bytes(range(256)) * 36_000  # over 8 MB
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("large.bin", large)
        z.writestr("small.txt", "y")
    with tarfile.open(tmp_path / "y.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("a/b.txt")
        info.size = 3
        t.addfile(info, io.BytesIO(b"tar"))
    (tmp_path / "z.zip").write_bytes(b"no archive")
    rows = lambda **more: {(r["archive"].rsplit("/", 1)[1], r["member"]): r for r in archives.read_archives(spark, str(tmp_path), **more).collect()}
    got = rows()
    assert bytes(got["x.zip", "large.bin"]["content"]) == large and bytes(got["y.tar.gz", "a/b.txt"]["content"]) == b"tar"
    assert got["z.zip", None]["error"].startswith("BadZipFile") and len(got) == 4
    got = rows(most_bytes=1000)
    assert got["x.zip", "large.bin"]["content"] is None and "over 1000" in got["x.zip", "large.bin"]["error"] and got["x.zip", "small.txt"]["error"] is None


def test_strict_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    schema = StructType.fromDDL("a int")
    assert runs.read_jsonl(spark, str(tmp_path / "x.jsonl"), schema).count() == 2
    with pytest.raises(Exception, match="not a JSON line"):
        runs.read_jsonl(spark, str(tmp_path / "x.jsonl"), schema, strict=True).collect()


def test_journal_writes_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, v string")
    rows.write.parquet(str(tmp_path / "in"))
    for n in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        incremental.append_journal(stream, str(tmp_path / "out"), str(tmp_path / f"c{n}"), ["id"]).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
