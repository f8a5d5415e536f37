"""Queries on the steps from documents to chunk records, with the same in SQL. Lines of documents play blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import version as V
from textloom.operators import building, checks, chunking
from textloom.plans.retrieval import _dialect, _quoted, table

DIALECTS = ("postgresql", "mysql", "sqlite", "mariadb", "duckdb")


def _blocks(spark, sf):
    """Five lines to a section; every seventh line is code."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    return lines.select("doc_id", F.floor(F.col("n") / 5).alias("section"), "n", F.when(F.col("n") % 7 == 3, "code").otherwise("prose").alias("type"), "text")


def clean_blocks(spark, sf):
    return building.cleaned_documents(building.clean_blocks(_blocks(spark, sf)))


def document_enrich(spark, sf):
    """Every third page is a release note; a page's number gives its labels."""
    p = F.col("page_id")
    label = F.concat_ws(".", (p % 20).cast("string"), (p % 7).cast("string"))
    pages = table(spark, sf, "pages").select("page_id", F.when(p % 2 == 0, "  Maria   DB").otherwise("Postgres").alias("dialect"), F.when(p % 3 == 0, "release_notes").otherwise("docs").alias("source_type"),
        F.when(p % 4 == 3, label).alias("version"), F.lit(None).cast("string").alias("version_min"), F.lit(None).cast("string").alias("version_max"), F.when(p % 4 == 1, "bogus").when(p % 4 == 2, "current").when(p % 4 == 3, "exact").alias("version_status"))
    context = F.when(p % 5 == 0, F.lit("No label here")).otherwise(F.concat(F.lit("Release notes "), label))
    return building.enriched(pages, context).select("page_id", "dialect", "version", "version_min", "version_max", "version_status", "inferred")


def _pieces(spark, sf):
    """Windows of 60 words with what plays a chunk's title and section."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", F.posexplode(chunking.fixed_windows(F.col("text"), 60)).alias("n", "body"))
    section = F.when(F.col("n") % 4 == 1, "Syntax").when(F.col("n") % 4 == 2, "Returns").otherwise(F.col("source"))
    return docs.withColumn("section", section).withColumn("text", T.rendered(F.col("source"), F.col("section"), F.col("body")))


def chunk_filter(spark, sf):
    rows = _pieces(spark, sf)
    kept = building.chunk_kept(F.col("body"), F.col("text"), F.col("section"), T.contains_sql(F.col("text")), T.contains_error_code(F.col("text"), F.lit("mysql")))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("chunks"), F.count(F.when(kept, 1)).alias("kept"))


def chunk_records(spark, sf):
    rows = _pieces(spark, sf).select(
        F.col("doc_id").cast("string").alias("document_id"), _dialect(F.col("lang")).alias("dialect"), F.lit("docs").alias("source_type"), F.col("source").alias("title"),
        "section", F.lit(0).alias("section_index"), F.col("n").alias("part_index"), F.lit("fixed").alias("strategy"), "text",
    )
    return building.chunk_records(rows).select("document_id", F.col("part_index").cast("long").alias("part_index"), "chunk_id", "content_hash", "contains_sql", "contains_error_code", "contains_version_or_compatibility", "topic")


def merged_chunks(spark, sf):
    """Sentences' lines as small chunks; a document's source is the scope."""
    rows = _blocks(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    parts = rows.select(F.col("doc_id").alias("document_id"), "n", F.concat(F.lit("s"), F.col("section")).alias("section"), F.col("text").alias("body"), F.lit(False).alias("alone"), "source")
    return building.merge_adjacent(parts, ["source"]).select("document_id", F.col("n").cast("long").alias("n"), "section", F.sha2("body", 256).alias("sha256"))


def manifest_faults(spark, sf):
    """Suppliers play the entries of a manifest."""
    s = F.col("s_suppkey")
    entries = table(spark, sf, "supplier").select(
        s.alias("n"), F.concat(F.lit("source"), s % 90).alias("id"), F.when(s % 6 == 5, "oracle").when(s % 6 == 0, "postgresql").when(s % 6 == 1, "mysql").when(s % 6 == 2, "sqlite").when(s % 6 == 3, "mariadb").otherwise("duckdb").alias("dialect"),
        F.when(s % 8 == 1, "odd").when(s % 8 == 2, "current").alias("version_status"), F.when(s % 5 == 0, "archive").when(s % 5 == 1, "single").when(s % 5 == 2, "url_list").when(s % 5 == 3, "sitemap").alias("collector"),
        F.when(s % 9 != 4, F.concat(F.lit("http://x/"), s % 50)).alias("url"), F.when(F.col("s_acctbal") >= 0, F.col("s_name")).alias("source_name"),
    )
    return building.manifest_faults(entries, ["source_name"], DIALECTS)


def selected_corpus(spark, sf):
    """The documents whose ids items have."""
    wanted = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"))
    return building.selected(table(spark, sf, "documents"), wanted, "doc_id").select("doc_id", "lang", F.sha2("text", 256).alias("sha256"))


def shard_concat(spark, sf):
    """Customers in three shards, whose ids must run on."""
    rows = table(spark, sf, "customer")
    low, high = rows.agg(F.min("c_custkey"), F.max("c_custkey")).first()
    cut = low + (high - low) // 3, low + 2 * (high - low) // 3
    ranges = (("first", low, cut[0]), ("second", cut[0] + 1, cut[1]), ("third", cut[1] + 1, high))
    joined = building.concatenated([(n, rows.filter(F.col("c_custkey").between(a, b)), a, b) for n, a, b in ranges], "c_custkey")
    return joined.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("low"), F.max("c_custkey").alias("high"))


def exact_dup_counts(spark, sf):
    """Rows that a language, source and normalized text have beyond the first."""
    docs = table(spark, sf, "documents").groupBy("lang", "source", F.sha2(T.normalize_for_hash(F.col("text")), 256).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return docs.agg(F.count(F.lit(1)).alias("keys"), F.sum(F.col("n") - 1).alias("duplicates"))


def _corpus(spark, sf):
    """Documents as a finished corpus: what its checks look at."""
    d, label = F.col("doc_id"), F.regexp_extract("source", "([0-9]+)$", 1)
    status = V.parse_label(F.when(d % 13 == 0, F.lit(None).cast("string")).otherwise(label))["version_status"]
    text = T.rendered(F.col("source"), F.lit("Usage"), F.col("text"))
    rows = table(spark, sf, "documents").select("doc_id", "lang", "source", _dialect(F.col("lang")).alias("dialect"), text.alias("text"), status.alias("version_status"), F.concat(F.lit("https://"), F.col("source"), F.lit(".example/"), d).alias("url"))
    return rows.withColumns({"words": T.word_count(F.col("text")), "topic": T.topic(F.lit("Usage"), F.col("text"), F.lit("docs")), "error": T.contains_error_code(F.col("text"), F.col("dialect"))})


def corpus_checks(spark, sf):
    """Twenty-one checks of a corpus: counts and shares of its rows, and of its dialects, keys and topics."""
    rows, share = _corpus(spark, sf), lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    text, n = F.col("text"), lambda c: F.count(F.when(F.coalesce(c, F.lit(True)), 1))
    usable = T.is_usable_fragment(text, F.lit("Usage"), F.col("error"))
    material = T.material_kept(text, F.col("error"))
    coherent = ((F.col("words") >= 20) | usable) & (T.alnum_share(text) >= 0.2) & ~F.contains(text, F.lit("�")) & T.fences_balanced(text) & F.startswith(text, F.lit("Title:"))
    sources = table(spark, sf, "documents").select("source").distinct().withColumn("listed", F.lit(True))
    marked = rows.join(sources, "source", "left")
    single = checks.suite(marked, {
        "rows_present": (F.count(F.lit(1)), 1, 1e18), "null_ids": (n(F.col("doc_id").isNull()), 0, 0), "duplicate_ids": (F.count("doc_id") - F.countDistinct("doc_id"), 0, 0),
        "required_fields": (n(F.col("dialect").isNull() | F.col("source").isNull() | F.col("url").isNull()), 0, 0), "empty_text": (n(F.trim(text) == ""), 0, 0), "invalid_urls": (n(~T.is_valid_url(F.col("url"))), 0, 0),
        "unknown_dialects": (n(~F.col("dialect").isin(*DIALECTS)), 0, 0), "damaged": (n(T.is_damaged(text)), 0, 0), "short_garbage": (n((F.col("words") < 20) & ~usable), 0, 0), "invalid_status": (n(~F.col("version_status").isin(*building.STATUSES)), 0, 0),
        "least_chunks": (F.count(F.lit(1)), 100, 1e18), "least_words": (F.sum("words"), 10000, 1e18), "version_coverage": (share(F.col("version_status") != "unknown"), 0.9, 1), "dialect_coverage": (share(F.col("dialect").isin(*DIALECTS)), 1, 1),
        "unlisted_sources": (n(F.col("listed").isNull()), 0, 0), "secrets": (F.sum(F.size(T.secrets(text))), 0, 0), "coherent_share": (share(coherent), 0.95, 1),
        "material_kept_share": (F.coalesce(F.avg(F.when(material["applicable"], material["kept"].cast("double"))), F.lit(1.0)), 0.9, 1),
    })
    per = rows.groupBy("dialect").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("topic").alias("topics"))
    groups = checks.suite(per, {"least_of_a_dialect": (F.min("n"), 20, 1e18), "greatest_dialect_share": (F.max("n") / F.sum("n"), 0, 0.35), "least_topics": (F.min("topics"), 2, 1e18)})
    return single.unionByName(groups)


QUERIES = {f.__name__: f for f in (clean_blocks, document_enrich, chunk_filter, chunk_records, merged_chunks, manifest_faults, selected_corpus, shard_concat, exact_dup_counts, corpus_checks)}


# --- the same in SQL ---------------------------------------------------------------------------------------------------

_NORM = lambda c: rf"lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'))"


def _prose_sql(c: str) -> str:
    for entity, sign in T.ENTITIES:
        c = f"replace({c}, {_quoted(entity)}, {_quoted(sign)})"
    for pattern, sign in T.PROSE_RULES:
        sign = _quoted(sign.replace("$1", "\\1")).replace("\n", "' || chr(10) || '")
        c = f"regexp_replace({c}, {_quoted(pattern)}, {sign}, 'g')"
    return c


_ATOMIC_SQL = r"regexp_replace(regexp_replace(replace(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(8203), ''), '(?m)[ \t\f\x0B]+$', '', 'g'), '^(?:[ \t]*\n)+|\n+$', '', 'g')"
_WORDS = lambda c: f"len(regexp_extract_all({c}, {_quoted(T.WORD)}))"
_SPLIT = r"""pc AS (SELECT doc_id, lang, source, k // 60 AS n, CASE WHEN len(w) <= 60 THEN flat ELSE array_to_string(w[k + 1:k + 60], ' ') END AS body FROM (SELECT *, unnest(CASE WHEN len(w) <= 60 THEN [0] ELSE range(0, len(w), 60) END) AS k FROM (
  SELECT doc_id, lang, source, flat, list_filter(regexp_split_to_array(flat, '\s+'), lambda x: x <> '') AS w FROM (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS flat FROM documents)))),
sc AS (SELECT *, CASE n % 4 WHEN 1 THEN 'Syntax' WHEN 2 THEN 'Returns' ELSE source END AS section FROM pc),
ch AS (SELECT *, 'Title: ' || source || CASE WHEN section <> '' AND section <> source THEN chr(10) || 'Section: ' || section ELSE '' END || chr(10) || chr(10) || regexp_replace(body, '^\s+|\s+$', '', 'g') AS text FROM sc)"""
_DIALECT_SQL = "CASE lang WHEN 'en' THEN 'mysql' WHEN 'fr' THEN 'mariadb' WHEN 'de' THEN 'sqlite' ELSE 'duckdb' END"
_HAS = lambda p: f"regexp_matches(text, {_quoted(p)})"
_ERROR_SQL = f"({_HAS(T.GENERIC_ERROR)} OR CASE dialect {' '.join(f'WHEN {_quoted(d)} THEN {_HAS(p)}' for d, p in T.ERROR_OF.items())} ELSE false END)"
_FENCED = "(len(string_split(text, '```')) - 1) % 2 = 0"
_TOPIC_SQL = lambda sample: "CASE " + " ".join(f"WHEN regexp_matches({sample}, {_quoted(p)}) THEN '{n}'" for n, p in T.TOPICS) + " ELSE 'general' END"
_SECRETS_SQL = " + ".join(f"len(regexp_split_to_array(text, {_quoted(p)})) - 1" for _, p in T.SECRETS)
_USABLE = f"({_FENCED} AND (error AND {_HAS(T.ERROR_EVIDENCE)} OR {_HAS(T.SQL_LINE)} OR {_HAS(T.SYNTAX_BLOCK)} OR contains(text, '```') OR {_HAS(T.TABLE_BLOCK)}))"

ORACLE = {
    "clean_blocks": rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
      b AS (SELECT doc_id, n // 5 AS section, n, n % 7 = 3 AS code, CASE WHEN n % 7 = 3 THEN {_ATOMIC_SQL} ELSE {_prose_sql('text')} END AS text FROM l), f AS (SELECT *, {_NORM('text')} AS norm FROM b),
      g AS (SELECT *, text = '' OR regexp_replace(norm, '{T.LIST_MARK}', '') IN ({', '.join(map(_quoted, T.BOILERPLATE))}) OR regexp_matches(regexp_replace(norm, '{T.LIST_MARK}', ''), '{T.BOILERPLATE_LINE}') AS bad FROM f),
      h AS (SELECT *, NOT bad AND NOT (NOT code AND {_WORDS('text')} < 15 AND coalesce(sum(CAST(NOT bad AS INT)) OVER (PARTITION BY doc_id, norm ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0) AS fresh FROM g),
      k AS (SELECT *, fresh AND coalesce(sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id, section, norm ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS keep FROM h)
      SELECT doc_id, count(CASE WHEN keep THEN 1 END) AS kept, count(CASE WHEN NOT keep THEN 1 END) AS removed, sha256(coalesce(string_agg(text, chr(10) ORDER BY n) FILTER (keep), '')) AS content_sha256, count(CASE WHEN keep THEN 1 END) = 0 AS empty FROM k GROUP BY doc_id""",
    "document_enrich": """WITH p AS (SELECT page_id, page_id % 20 || '.' || page_id % 7 AS label, page_id % 3 = 0 AND page_id % 4 IN (0, 1) AND page_id % 5 <> 0 AS inferred FROM pages)
      SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'mariadb' ELSE 'postgresql' END AS dialect, CASE WHEN inferred OR page_id % 4 = 3 THEN label END AS version, CASE WHEN inferred THEN label END AS version_min, CASE WHEN inferred THEN label END AS version_max,
      CASE WHEN inferred THEN 'exact' WHEN page_id % 4 = 2 THEN 'current' WHEN page_id % 4 = 3 THEN 'exact' ELSE 'unknown' END AS version_status, inferred FROM p""",
    "chunk_filter": f"""WITH {_SPLIT} SELECT lang, count(*) AS chunks, count(CASE WHEN {_WORDS('body')} >= 35 OR {_HAS(T.SQL_START)} OR {_HAS(T.GENERIC_ERROR)} OR {_HAS(T.ERROR_OF['mysql'])} OR contains(text, '```') OR contains(text, chr(10) || 'Table:' || chr(10))
      OR regexp_matches(section, {_quoted(T.ATOMIC_SECTION)}) THEN 1 END) AS kept FROM ch GROUP BY lang""",
    "chunk_records": f"""WITH {_SPLIT}, d AS (SELECT *, {_DIALECT_SQL} AS dialect FROM ch)
      SELECT CAST(doc_id AS VARCHAR) AS document_id, n AS part_index, 'chunk_' || dialect || '_' || substr(sha256(doc_id || '|fixed|0|' || n || '|' || section || '|' || sha256(text)), 1, 24) AS chunk_id, sha256(text) AS content_hash, {_HAS(T.SQL_START)} AS contains_sql,
      {_ERROR_SQL} AS contains_error_code, {_HAS(T.VERSION_TALK)} AS contains_version_or_compatibility, {_TOPIC_SQL("section || chr(10) || substr(text, 1, 1000)")} AS topic FROM d""",
    "manifest_faults": f"""WITH e AS (SELECT s_suppkey AS n, 'source' || s_suppkey % 90 AS id, ['postgresql', 'mysql', 'sqlite', 'mariadb', 'duckdb', 'oracle'][s_suppkey % 6 + 1] AS dialect, CASE s_suppkey % 8 WHEN 1 THEN 'odd' WHEN 2 THEN 'current' END AS st,
        CASE s_suppkey % 5 WHEN 0 THEN 'archive' WHEN 1 THEN 'single' WHEN 2 THEN 'url_list' WHEN 3 THEN 'sitemap' END AS c, CASE WHEN s_suppkey % 9 <> 4 THEN 'http://x/' || s_suppkey % 50 END AS url, s_acctbal >= 0 AND s_name <> '' AS named FROM supplier),
      m AS (SELECT *, coalesce(c IN ('archive', 'single', 'sitemap'), false) AS loc FROM e), w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n) > 1 AS again, row_number() OVER (PARTITION BY dialect, loc, url ORDER BY n) > 1 AS url_again FROM m),
      f AS (SELECT n, unnest([CASE WHEN NOT coalesce(named, false) THEN 'missing_source_name' END, CASE WHEN again THEN 'duplicate_id' END, CASE WHEN dialect = 'oracle' THEN 'invalid_dialect' END, CASE WHEN st = 'odd' THEN 'invalid_status' END,
        CASE WHEN c IS NULL THEN 'invalid_collector' END, CASE WHEN loc AND url IS NULL THEN 'missing_url' END, CASE WHEN loc AND url_again THEN 'duplicate_url' END]) AS fault FROM w) SELECT n, fault FROM f WHERE fault IS NOT NULL""",
    "selected_corpus": "SELECT doc_id, lang, sha256(text) AS sha256 FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)",
    "shard_concat": """WITH r AS (SELECT min(c_custkey) AS low, max(c_custkey) AS high FROM customer), c AS (SELECT c_custkey AS k, CASE WHEN c_custkey <= low + (high - low) // 3 THEN 'first' WHEN c_custkey <= low + 2 * (high - low) // 3 THEN 'second' ELSE 'third' END AS shard FROM customer, r)
      SELECT shard, count(*) AS n, min(k) AS low, max(k) AS high FROM c GROUP BY shard""",
    "exact_dup_counts": f"SELECT count(*) AS keys, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM documents GROUP BY lang, source, {_NORM('text')})",
    "corpus_checks": rf"""WITH a AS (SELECT doc_id, lang, source, {_DIALECT_SQL} AS dialect, CASE WHEN doc_id % 13 = 0 THEN 'unknown' ELSE 'range' END AS st, 'Title: ' || source || chr(10) || 'Section: Usage' || chr(10) || chr(10) || regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM documents),
      b AS (SELECT *, {_WORDS('text')} AS words, {_ERROR_SQL} AS error, {_TOPIC_SQL("'Usage' || chr(10) || substr(text, 1, 1000)")} AS topic FROM a),
      c AS (SELECT *, {_USABLE} AS usable, {_HAS(T.FENCE_OPEN)} OR {_HAS(T.SQL_LINE)} OR {_HAS(T.SYNTAX_BLOCK)} OR error AS applicable, {_FENCED} AND (NOT error OR {_HAS(T.ERROR_EVIDENCE)}) AS whole FROM b),
      o AS (SELECT count(*) AS n, count(*) - count(DISTINCT doc_id) AS dup, count(CASE WHEN trim(text) = '' THEN 1 END) AS empty, count(CASE WHEN contains(text, '�') OR regexp_matches(text, {_quoted(T.MOJIBAKE)}) THEN 1 END) AS damaged, count(CASE WHEN words < 20 AND NOT usable THEN 1 END) AS garbage,
        sum(words) AS words, avg(CAST(st <> 'unknown' AS INT)) AS covered, sum({_SECRETS_SQL}) AS secrets, avg(CAST((words >= 20 OR usable) AND length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) / length(text) >= 0.2 AND NOT contains(text, '�') AND {_FENCED} AS INT)) AS coherent,
        coalesce(avg(CASE WHEN applicable THEN CAST(whole AS INT) END), 1.0) AS kept FROM c),
      g AS (SELECT min(n) AS least, max(n) / sum(n) AS share, min(topics) AS topics FROM (SELECT dialect, count(*) AS n, count(DISTINCT topic) AS topics FROM b GROUP BY dialect)),
      x AS (SELECT unnest([{{'check': 'rows_present', 'observed': n::DOUBLE, 'least': 1.0::DOUBLE, 'most': 1e18::DOUBLE}}, {{'check': 'null_ids', 'observed': 0, 'least': 0, 'most': 0}}, {{'check': 'duplicate_ids', 'observed': dup, 'least': 0, 'most': 0}}, {{'check': 'required_fields', 'observed': 0, 'least': 0, 'most': 0}},
        {{'check': 'empty_text', 'observed': empty, 'least': 0, 'most': 0}}, {{'check': 'invalid_urls', 'observed': 0, 'least': 0, 'most': 0}}, {{'check': 'unknown_dialects', 'observed': 0, 'least': 0, 'most': 0}}, {{'check': 'damaged', 'observed': damaged, 'least': 0, 'most': 0}}, {{'check': 'short_garbage', 'observed': garbage, 'least': 0, 'most': 0}},
        {{'check': 'invalid_status', 'observed': 0, 'least': 0, 'most': 0}}, {{'check': 'least_chunks', 'observed': n, 'least': 100, 'most': 1e18}}, {{'check': 'least_words', 'observed': words, 'least': 10000, 'most': 1e18}}, {{'check': 'version_coverage', 'observed': covered, 'least': 0.9, 'most': 1}}, {{'check': 'dialect_coverage', 'observed': 1, 'least': 1, 'most': 1}},
        {{'check': 'unlisted_sources', 'observed': 0, 'least': 0, 'most': 0}}, {{'check': 'secrets', 'observed': secrets, 'least': 0, 'most': 0}}, {{'check': 'coherent_share', 'observed': coherent, 'least': 0.95, 'most': 1}}, {{'check': 'material_kept_share', 'observed': kept, 'least': 0.9, 'most': 1}},
        {{'check': 'least_of_a_dialect', 'observed': least, 'least': 20, 'most': 1e18}}, {{'check': 'greatest_dialect_share', 'observed': share, 'least': 0, 'most': 0.35}}, {{'check': 'least_topics', 'observed': topics, 'least': 2, 'most': 1e18}}], recursive := true) FROM o, g)
      SELECT "check", round(observed, 6) AS observed, least, most, CASE WHEN round(observed, 6) BETWEEN least - 1e-15 AND most + 1e-15 THEN 'PASS' ELSE 'FAIL' END AS status FROM x""",
}
