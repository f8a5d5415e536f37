"""Queries on building and checking the corpus, with the same in SQL. Languages play the part of dialects."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import version as V
from textloom.operators import answers, checks, chunking, dedup, evaluation, leakage, lexical, merkle, percentiles
from textloom.plans.retrieval import _quoted, _tokens_sql, table

SCOPE = ["lang", "source"]


def documents(spark, sf):
    return table(spark, sf, "documents")


def _sets(spark, sf):
    return documents(spark, sf).select(F.col("doc_id").alias("id"), F.coalesce(T.set_tokens(F.col("text")), F.array().cast("array<string>")).alias("items"))


def exact_dedup(spark, sf):
    rows = dedup.exact(documents(spark, sf).select("doc_id", "lang", "text"), ["lang"], T.normalize_for_hash(F.col("text")), "doc_id")
    return rows.select("doc_id", "lang", "keeps")


def _near(spark, sf):
    return dedup.near_keep_first(documents(spark, sf).select(F.col("doc_id").alias("ord"), "lang", "text"), ["lang"])


def near_dup_keep_first(spark, sf):
    return _near(spark, sf).select(F.col("ord").alias("doc_id"), "kept", "kind")


def dedup_report(spark, sf):
    return dedup.report(_near(spark, sf), ["lang"])


def token_set_near_pairs(spark, sf):
    """Representatives of equal token sets with a similarity of 0.82 or more."""
    pairs, _ = dedup.similar_pairs(_sets(spark, sf), 82)
    return pairs


def token_set_members(spark, sf):
    """Every document with its representative in token_set_near_pairs and the number of pairs that one is in."""
    pairs, members = dedup.similar_pairs(_sets(spark, sf), 82)
    links = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    return members.join(links, "node", "left").select(F.col("id").alias("doc_id"), "node", F.coalesce("links", F.lit(0)).alias("links"))


def residual_dup_rate(spark, sf):
    pairs, members = dedup.similar_pairs(_sets(spark, sf), 94)
    touched = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    groups = members.groupBy("node").agg(F.count(F.lit(1)).alias("n")).join(touched.withColumn("t", F.lit(1)), "node", "left")
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("documents"), F.sum(F.when(F.col("t").isNotNull() | (F.col("n") > 1), F.col("n")).otherwise(0)).alias("touched"))


def simhash_bands(spark, sf):
    """Eight bytes of each document's SimHash, the lowest first."""
    words = documents(spark, sf).select("doc_id", F.transform(T.word_tokens(F.col("text")), F.lower).alias("words"))
    h = words.select("doc_id", dedup.simhash(T.shingles(F.col("words"))).alias("h"))
    return h.select("doc_id", F.posexplode(F.array(*[F.shiftrightunsigned("h", 8 * i).bitwiseAND(F.lit(255)) for i in range(8)])).alias("band", "value"))


def url_canonical(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.canonical_url(F.col("url")).alias("url"), T.is_valid_url(F.col("url")).alias("valid"))


def title_extract(spark, sf):
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return table(spark, sf, "pages").select("page_id", F.trim(F.regexp_replace(F.when(title == "", F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1)).otherwise(title), r"\s+", " ")).alias("title"))


def prose_clean(spark, sf):
    cleaned = T.clean_prose(F.col("html"))
    rows = table(spark, sf, "pages").select("page_id", cleaned.alias("cleaned"))
    return rows.select("page_id", F.length("cleaned").cast("long").alias("n"), F.sha2("cleaned", 256).alias("sha"))


def boilerplate_filter(spark, sf):
    lines = documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(T.is_boilerplate(F.col("line")).cast("long")).alias("boilerplate"))


def fixed_chunks(spark, sf):
    rows = chunking.fixed_chunks(documents(spark, sf), "doc_id", "text", 150, 20)
    return rows.select("doc_id", F.col("n").cast("long").alias("n"), F.sha2("chunk", 256).alias("sha"))


def structure_chunks(spark, sf):
    rows = chunking.structure_chunks(documents(spark, sf), "doc_id", "text")
    return rows.select("doc_id", "n", "chunk", T.word_count(F.col("chunk")).alias("words"))


def version_scope_counts(spark, sf):
    """The source's number plays the version."""
    label = F.when(F.col("lang") == "en", F.concat(F.regexp_extract("source", "([0-9]+)$", 1), F.lit(".4.x"))).when(F.col("lang") == "de", F.regexp_extract("source", "([0-9]+)$", 1)).otherwise(F.lit("latest"))
    rows = documents(spark, sf).select("lang", V.parse_label(label).alias("v")).select("lang", "v.*")
    return rows.withColumn("scope", V.scope(F.col("version"), F.col("version_min"), F.col("version_max"), F.col("version_status"))).groupBy("lang", "scope", "version_status").agg(F.count(F.lit(1)).alias("n"))


def topic_classify(spark, sf):
    kind = F.when(F.col("source") == "src1", "release_notes").otherwise("docs")
    rows = documents(spark, sf).select("lang", T.topic(F.lit("Usage"), F.col("text"), kind).alias("topic")).unionByName(table(spark, sf, "part").select(F.lit("part").alias("lang"), T.topic(F.lit(""), F.col("p_name"), F.lit("docs")).alias("topic")))
    return rows.groupBy("lang", "topic").agg(F.count(F.lit(1)).alias("n"))


def flag_detect(spark, sf):
    text = F.col("text")
    n = lambda c, name: F.sum(c.cast("long")).alias(name)
    return documents(spark, sf).groupBy("lang").agg(n(T.contains_sql(text), "sql"), n(T.contains_error_code(text, F.lit("mysql")), "error"), n(T.contains_version_talk(text), "version"), n(T.fences_balanced(text), "fenced"))


def secret_scan(spark, sf):
    """All texts; the tables hold no secrets, so every seventeenth document gets one on a line of its own."""
    planted = F.concat(F.col("text"), F.lit("\nkey AKIA"), F.lpad(F.col("doc_id").cast("string"), 16, "0"))
    texts = documents(spark, sf).select("doc_id", F.when(F.col("doc_id") % 17 == 0, planted).otherwise(F.col("text")).alias("text"))
    return texts.select("doc_id", F.explode(T.secrets(F.col("text"))).alias("s")).select("doc_id", "s.type", F.col("s.line").cast("long").alias("line"))


def encoding_damage(spark, sf):
    return documents(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.coalesce(T.is_damaged(F.col("text")), F.lit(False)).cast("long")).alias("damaged"))


def _stats(rows):
    w = F.col("w")
    return [F.count(F.lit(1)).alias("n"), F.sum("w").alias("words"), F.round(F.avg("w"), 4).alias("mean"), F.median("w").alias("median"), F.min("w").alias("least"), F.max("w").alias("most"), F.round(100 * F.avg((w < 20).cast("int")), 4).alias("short_percent")]


def corpus_stats(spark, sf):
    rows = documents(spark, sf).select("lang", "source", T.word_count(F.col("text")).alias("w"))
    return rows.agg(*_stats(rows))


def lang_stats(spark, sf):
    rows = documents(spark, sf).select("lang", "source", T.word_count(F.col("text")).alias("w"))
    return rows.groupBy("lang").agg(*_stats(rows))


def source_coverage(spark, sf):
    """Every source of the list and every other that documents have, null as one of them."""
    docs = documents(spark, sf)
    none = F.lit(0).cast("long")
    known = spark.range(0, 16).select(F.concat(F.lit("src"), F.col("id")).alias("source"), F.lit(True).alias("expected"), none.alias("documents"), none.alias("langs"), none.alias("rejected"))
    counts = docs.groupBy("source").agg(F.lit(False).alias("expected"), F.count(F.lit(1)).alias("documents"), F.countDistinct("lang").alias("langs"), none.alias("rejected"))
    bad = docs.join(table(spark, sf, "labels").filter("quality = 0"), "doc_id", "left_semi").groupBy("source").agg(F.lit(False).alias("expected"), none.alias("documents"), none.alias("langs"), F.count(F.lit(1)).alias("rejected"))
    return known.unionAll(counts).unionAll(bad).groupBy("source").agg(F.bool_or("expected").alias("expected"), *[F.sum(c).alias(c) for c in ("documents", "langs", "rejected")])


def vocab_size(spark, sf):
    return documents(spark, sf).select("lang", F.explode(T.word_tokens(F.col("text"))).alias("t")).groupBy("lang").agg(F.countDistinct(F.lower("t")).alias("vocabulary"))


def balanced_sample(spark, sf):
    rows = documents(spark, sf).select("doc_id", "lang", "source", (F.col("doc_id") % 7).cast("string").alias("key"))
    return dedup.balanced(rows, "lang", "source", "key", "doc_id", 40, 200).select("doc_id", "lang", F.col("position").cast("long").alias("position"))


def stratified_sample(spark, sf):
    return dedup.stratified(documents(spark, sf).select("doc_id", "lang"), ["lang"], "doc_id", 10)


def constraint_checks(spark, sf):
    docs = documents(spark, sf)
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return checks.suite(docs, {
        "rows": (F.count(F.lit(1)), 1, 1e18), "duplicate_ids": (F.count(F.lit(1)) - F.countDistinct("doc_id"), 0, 0), "missing_text": (F.sum(F.coalesce(F.trim("text") == "", F.lit(True)).cast("int")), 0, 0),
        "unknown_lang": (F.sum((~F.col("lang").isin("en", "fr", "de", "es")).cast("int")), 0, 0), "english_share": (share(F.col("lang") == "en"), 0, 0.35),
        "length_agrees": (share(F.col("n_chars") == F.length("text")), 1, 1), "damaged_share": (share(T.is_damaged(F.col("text"))), 0, 0.01), "readable_share": (share(T.alnum_share(F.col("text")) >= 0.2), 0.95, 1),
    })


def reference_checks(spark, sf):
    pairs = (("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("labels", "doc_id", "documents", "doc_id"))
    out = None
    for child, ck, parent, pk in pairs:
        one = checks.orphans(table(spark, sf, child).select(ck), ck, table(spark, sf, parent), pk).withColumn("child", F.lit(child))
        out = one if out is None else out.unionByName(one)
    return out


def label_agreement(spark, sf):
    return evaluation.kappa(table(spark, sf, "labels"), "quality", "toxic")


def weighted_kappa(spark, sf):
    rows = table(spark, sf, "embeddings").select("label", (F.col("vec_id") % 10).cast("int").alias("other"))
    return evaluation.kappa(rows, "label", "other", quadratic=True)


def confusion_matrix(spark, sf):
    return table(spark, sf, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


def latency_percentiles(spark, sf):
    v, rows = F.col("value"), table(spark, sf, "events")
    sums = rows.groupBy(F.col("event_type").alias("kind")).agg(F.round(F.avg(v), 6).alias("mean"), F.max(v).alias("most"), F.round(F.count(F.lit(1)) / (F.sum(v) / 1000), 6).alias("per_second"))
    found = percentiles.percentiles(rows, ["event_type"], "value", {"p50": 0.5, "p95": 0.95})
    both = found.join(sums, found["event_type"].eqNullSafe(sums["kind"]))
    return both.select("event_type", "mean", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "most", "per_second")


def leakage_5gram(spark, sf):
    words = lambda t: F.transform(T.pool_tokens(t), F.lower)
    hits = leakage.gram_hits(lexical.tokenized(table(spark, sf, "benchmark"), "item_id", words(F.col("text"))), lexical.tokenized(documents(spark, sf), "doc_id", words(F.col("text"))), 5)
    return hits.withColumn("containment", F.round(F.col("shared") / F.greatest(F.lit(1), F.col("grams")), 6)).select("query_id", "chunk_id", "shared", "containment", (F.col("containment") > 0.45).alias("warning"))


def leakage_13gram_run(spark, sf):
    hits = leakage.gram_hits(lexical.tokenized(table(spark, sf, "benchmark"), "item_id", T.pool_tokens(F.col("text"))), lexical.tokenized(documents(spark, sf), "doc_id", T.pool_tokens(F.col("text"))), 13)
    return hits.select("query_id", "chunk_id", "shared")


def machine_relevance(spark, sf):
    """For the candidates of BM25: enough shared content words are relevance 1."""
    from textloom.plans.retrieval import lexical_run

    terms = lambda c: F.array_distinct(T.pool_tokens(F.col(c), content_only=True))
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), terms("text").alias("qt"))
    docs = documents(spark, sf).select(F.col("doc_id").alias("chunk_id"), terms("text").alias("dt"))
    rows = lexical_run(spark, sf, 10).select("query_id", "chunk_id").join(items, "query_id").join(docs, "chunk_id")
    overlap = F.size(F.array_intersect("qt", "dt"))
    return rows.select("query_id", "chunk_id", overlap.cast("long").alias("overlap"), leakage.relevance(F.lit(True), overlap, F.size("qt"), F.lit(False), F.lit(None).cast("int")).cast("long").alias("relevance"))


def conversation_contract(spark, sf):
    """Per conversation: turns are gapless, roles known, system only first, user and assistant take turns."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf, "conversations").withColumn("before", F.lag("role").over(w)).withColumn("first", F.min("turn").over(Window.partitionBy("conv_id")))
    every = lambda c: F.bool_and(F.coalesce(c, F.lit(True)))
    return rows.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"), (F.max("turn") - F.min("turn") + 1 == F.count(F.lit(1))).alias("gapless"), every(F.col("role").isin("system", "user", "assistant")).alias("roles_known"),
        every((F.col("role") != "system") | (F.col("turn") == F.col("first"))).alias("system_first"), every(F.col("role") != F.col("before")).alias("alternates"),
    )


def citation_validity(spark, sf):
    """A conversation's words that are numbers stand for citations of turns; all turns are searched, repeats count."""
    rows = table(spark, sf, "conversations")
    turns = rows.select("conv_id", F.col("turn").cast("string").alias("number"), F.lit(0).alias("n"), F.lit(True).alias("known"))
    numbers = rows.select("conv_id", F.explode(T.all_of(F.col("text"), "[0-9]+")).alias("number"), F.lit(1).alias("n"), F.lit(False).alias("known"))
    sums = turns.unionAll(numbers).groupBy("conv_id", "number").agg(F.sum("n").alias("n"), F.bool_or("known").alias("known"))
    counts = sums.groupBy("conv_id").agg(F.sum("n").alias("cited"), F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("valid"))
    return counts.select("conv_id", "cited", F.round(F.when(F.col("cited") == 0, 1.0).otherwise(F.col("valid") / F.col("cited")), 6).alias("validity"))


def task_success_paired(spark, sf):
    """Quality against not toxic, as two systems that solve a task or not."""
    a, b = F.col("quality") == 1, F.col("toxic") == 0
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return table(spark, sf, "labels").agg(n(~a & b, "improved"), n(a & ~b, "regressed"), n(a & b, "both"), n(~a & ~b, "neither"), F.round(F.avg(b.cast("int")) - F.avg(a.cast("int")), 6).alias("delta"))


def symmetric_difference(spark, sf):
    return checks.set_differences(documents(spark, sf), table(spark, sf, "labels"), "doc_id")


def order_digest(spark, sf):
    return checks.order_digest(documents(spark, sf), "doc_id")


def content_tree(spark, sf):
    """The digest tree of all documents, one level of leaves."""
    nodes = merkle.tree(documents(spark, sf), "doc_id", ["lang", "source", "text"], depth=1)
    return nodes.select(F.col("level").cast("long").alias("level"), "path", "n", "digest")


def content_changes(spark, sf):
    """Documents against a later state of them: every 97th text has one letter changed in place, every 89th document is
    gone, and for every 83rd there is a new one."""
    now, n = documents(spark, sf), F.col("doc_id")
    later = now.filter(n % 89 != 0).withColumn("text", F.when(n % 97 == 0, F.concat(F.lit("~"), F.substring("text", 2, 1 << 30))).otherwise(F.col("text")))
    later = later.unionByName(now.filter(n % 83 == 0).withColumn("doc_id", -1 - n))
    return merkle.changes(now, later, "doc_id", ["lang", "source", "text"])


def recompute_compare(spark, sf):
    """Documents whose recorded length is not the length of their text; every fiftieth record is moved by one."""
    docs = documents(spark, sf)
    return checks.close(docs.select("doc_id", (F.col("n_chars") + F.when(F.col("doc_id") % 50 == 0, 1).otherwise(0)).cast("double").alias("n")), docs.select("doc_id", F.length("text").cast("double").alias("n")), ["doc_id"], "n")


def page_parse_blocks(spark, sf):
    from textloom.sources.parsers import parse_pages

    return parse_pages(table(spark, sf, "pages"), "page_id", "html")


def serialize_queries(spark, sf):
    """Each conversation's first user turn as an online query."""
    turns = table(spark, sf, "conversations").filter("role = 'user'")
    first = turns.groupBy("conv_id").agg(F.min(F.struct("turn", "text")).alias("t")).select(F.col("conv_id").alias("query_id"), F.col("t.text").alias("user_problem"), F.when(F.col("conv_id") % 2 == 0, "mysql").alias("dialect"))
    text = answers.serialized({c: F.col(c) for c in ("user_problem", "dialect")})
    return answers.online(first).select("query_id", F.length(text).cast("long").alias("n"), F.sha2(text, 256).alias("sha256"), answers.side(F.col("query_id")).alias("shown_first"))


def answer_contract(spark, sf):
    """Answers made of labels: quality is the confidence, the id a citation; toxic ones lack a key."""
    rows = table(spark, sf, "labels")
    keys = {k: F.lit("x") for k in answers.ANSWER_KEYS} | {"confidence": F.col("quality") * 2 - F.col("toxic"), "citations": F.array(F.col("doc_id").cast("string"))}
    part = lambda names: F.to_json(F.struct(*[keys[k].alias(k) for k in names]))
    text = F.when(F.col("toxic") == 1, part(answers.ANSWER_KEYS[:-1])).otherwise(part(answers.ANSWER_KEYS))
    supplied = F.array((F.col("doc_id") - F.col("doc_id") % 3).cast("string"))
    faults = answers.answer_faults(text, supplied, F.lit(True))
    return rows.select("doc_id", F.array_join(faults, ",").alias("faults"))


def boilerplate_sections(spark, sf):
    """Short lines that a document has said before, exactly or as the line just above."""
    lines = documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    w = Window.partitionBy("doc_id").orderBy("n")
    marked = lines.withColumn("again", F.row_number().over(Window.partitionBy("doc_id", "line").orderBy("n")) > 1).withColumn("adjacent", F.coalesce(F.lag("line").over(w) == F.col("line"), F.lit(False)))
    return marked.groupBy("doc_id").agg(F.count(F.when(F.col("again"), 1)).alias("again"), F.count(F.when(F.col("adjacent"), 1)).alias("adjacent"))


QUERIES = {f.__name__: f for f in (
    exact_dedup, near_dup_keep_first, dedup_report, token_set_near_pairs, token_set_members, residual_dup_rate, simhash_bands, url_canonical, title_extract, prose_clean, boilerplate_filter,
    fixed_chunks, structure_chunks, version_scope_counts, topic_classify, flag_detect, secret_scan, encoding_damage, corpus_stats, lang_stats,
    source_coverage, vocab_size, balanced_sample, stratified_sample, constraint_checks, reference_checks, label_agreement, weighted_kappa, confusion_matrix, latency_percentiles,
    leakage_5gram, leakage_13gram_run, machine_relevance, conversation_contract, citation_validity, task_success_paired, symmetric_difference, order_digest, content_tree, content_changes, recompute_compare, page_parse_blocks,
    serialize_queries, answer_contract, boilerplate_sections,
)}


# --- the same in SQL ---------------------------------------------------------------------------------------------------

_NORM = r"lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'))"
_SET = "sets AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS s FROM documents)"
_PAIRS = """nodes AS (SELECT min(doc_id) AS node, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s), tok AS (SELECT node, n, unnest(s) AS t FROM nodes),
p AS (SELECT x.node AS a, y.node AS b, count(*) AS common, any_value(x.n) AS size_a, any_value(y.n) AS size_b FROM tok x JOIN tok y ON x.t = y.t AND x.node < y.node AND least(x.n, y.n) * 100 >= greatest(x.n, y.n) * {0} GROUP BY 1, 2),
pairs AS (SELECT * FROM p WHERE common * 100 >= (size_a + size_b - common) * {0})"""
_WORDS = f"w AS (SELECT doc_id, lang, source, len(regexp_extract_all(text, {_quoted(T.WORD)})) AS w FROM documents)"
_STATS = "count(*) AS n, CAST(sum(w) AS BIGINT) AS words, round(avg(w), 4) AS mean, median(w) AS median, min(w) AS least, max(w) AS most, round(100 * avg(CAST(w < 20 AS INT)), 4) AS short_percent"
_GRAMS = """
{d}, {i}, dg AS (SELECT DISTINCT id, array_to_string(tokens[k:k + {n} - 1], ' ') AS g FROM (SELECT id, tokens, unnest(range(1, len(tokens) - {n} + 2)) AS k FROM d)),
ig AS (SELECT DISTINCT id, array_to_string(tokens[k:k + {n} - 1], ' ') AS g FROM (SELECT id, tokens, unnest(range(1, len(tokens) - {n} + 2)) AS k FROM i)),
c AS (SELECT id, count(*) AS grams FROM ig GROUP BY id), hits AS (SELECT ig.id AS query_id, dg.id AS chunk_id, count(*) AS shared FROM ig JOIN dg USING (g) GROUP BY 1, 2)"""


def _gram_sql(n: int) -> str:
    return "WITH " + _GRAMS.format(n=n, d=_tokens_sql("d", "documents", "doc_id", T.POOL_TOKEN), i=_tokens_sql("i", "benchmark", "item_id", T.POOL_TOKEN))


def _kappa_sql(source: str, a: str, b: str, weight: str) -> str:
    return f"""WITH c AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {source} GROUP BY 1, 2), r AS (SELECT a, sum(n) AS ra FROM c GROUP BY a), k AS (SELECT b, sum(n) AS cb FROM c GROUP BY b), t AS (SELECT sum(n) AS t FROM c)
    SELECT CAST(max(t) AS BIGINT) AS n, round(sum(CASE WHEN r.a = k.b THEN coalesce(n, 0) ELSE 0 END) / max(t), 6) AS agreement, round(1 - sum({weight} * coalesce(n, 0) / t) / sum({weight} * ra * cb / (t * t)), 6) AS kappa
    FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c ON c.a = r.a AND c.b = k.b"""


_RULES = " ".join(f"WHEN regexp_matches(sample, {_quoted(p)}) THEN '{n}'" for n, p in T.TOPICS)
_LINE_BOILERPLATE = T.BOILERPLATE_LINE
_POOL = f"list_distinct(list_filter(list_transform(regexp_extract_all(text, {_quoted(T.POOL_TOKEN)}), lambda x: lower(x)), lambda x: x NOT IN ({', '.join(map(_quoted, T.POOL_STOPWORDS))}) AND length(x) > 2))"

ORACLE = {
    "exact_dedup": f"SELECT doc_id, lang, row_number() OVER (PARTITION BY lang, {_NORM} ORDER BY doc_id) = 1 AS keeps FROM documents",
    "token_set_near_pairs": f"WITH {_SET}, {_PAIRS.format(82)} SELECT a, b, common, size_a, size_b FROM pairs",
    "token_set_members": f"""WITH {_SET}, {_PAIRS.format(82)}, l AS (SELECT node, count(*) AS links FROM (SELECT a AS node FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY node),
      m AS (SELECT doc_id, CASE WHEN len(s) > 0 THEN min(doc_id) OVER (PARTITION BY s) ELSE doc_id END AS node FROM sets) SELECT doc_id, node, coalesce(links, 0) AS links FROM m LEFT JOIN l USING (node)""",
    "residual_dup_rate": f"""WITH {_SET}, {_PAIRS.format(94)}, m AS (SELECT doc_id, s, count(*) OVER (PARTITION BY s) AS n, min(doc_id) OVER (PARTITION BY s) AS node FROM sets)
      SELECT count(*) AS documents, count(CASE WHEN len(s) > 0 AND n > 1 OR node IN (SELECT a FROM pairs UNION SELECT b FROM pairs) THEN 1 END) AS touched FROM m""",
    "title_extract": r"SELECT page_id, trim(regexp_replace(CASE WHEN t = '' THEN regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) ELSE t END, '\s+', ' ', 'g')) AS title FROM (SELECT *, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS t FROM pages)",
    "boilerplate_filter": rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents), n AS (SELECT doc_id, regexp_replace({_NORM}, '{T.LIST_MARK}', '') AS line FROM l)
      SELECT doc_id, count(*) AS lines, count(CASE WHEN line IN ({', '.join(map(_quoted, T.BOILERPLATE))}) OR regexp_matches(line, '{_LINE_BOILERPLATE}') THEN 1 END) AS boilerplate FROM n GROUP BY doc_id""",
    "fixed_chunks": r"""WITH f AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS flat FROM documents), w AS (SELECT doc_id, flat, list_filter(regexp_split_to_array(flat, '\s+'), lambda x: x <> '') AS w FROM f),
      c AS (SELECT doc_id, k // 130 AS n, array_to_string(w[k + 1:k + 150], ' ') AS chunk FROM (SELECT doc_id, w, unnest(range(0, len(w), 130)) AS k FROM w WHERE len(w) > 150) UNION ALL SELECT doc_id, 0, flat FROM w WHERE len(w) <= 150)
      SELECT doc_id, n, sha256(chunk) AS sha FROM c""",
    "version_scope_counts": "SELECT lang, CASE lang WHEN 'en' THEN s || '.4.0..' || s || '.4.x' WHEN 'de' THEN s || '.0..' || s || '.x' ELSE 'current' END AS scope, CASE WHEN lang IN ('en', 'de') THEN 'range' ELSE 'current' END AS version_status, count(*) AS n FROM (SELECT lang, regexp_extract(source, '([0-9]+)$', 1) AS s FROM documents) GROUP BY ALL".replace("s || '.4.0..' || s || '.4.x'", "s || '.4.0..' || s || '.4.x'"),
    "topic_classify": f"""SELECT lang, CASE WHEN rn THEN 'release_notes' {_RULES} ELSE 'general' END AS topic, count(*) AS n FROM (
      SELECT lang, source = 'src1' AS rn, 'Usage' || chr(10) || substr(text, 1, 1000) AS sample FROM documents UNION ALL SELECT 'part', false, chr(10) || substr(p_name, 1, 1000) FROM part) GROUP BY ALL""",
    "flag_detect": rf"""SELECT lang, count(CASE WHEN regexp_matches(text, {_quoted(T.SQL_START)}) THEN 1 END) AS sql, count(CASE WHEN regexp_matches(text, {_quoted(T.GENERIC_ERROR)}) OR regexp_matches(text, {_quoted(T.ERROR_OF['mysql'])}) THEN 1 END) AS error,
      count(CASE WHEN regexp_matches(text, {_quoted(T.VERSION_TALK)}) THEN 1 END) AS version, count(CASE WHEN (len(string_split(text, '```')) - 1) % 2 = 0 THEN 1 END) AS fenced FROM documents GROUP BY lang""",
    "secret_scan": " UNION ALL ".join(f"SELECT doc_id, '{n}' AS type, CAST(len(string_split(array_to_string(p[1:k], ''), chr(10))) AS BIGINT) AS line FROM (SELECT doc_id, p, unnest(range(1, len(p))) AS k FROM (SELECT doc_id, regexp_split_to_array(text, {_quoted(p)}) AS p FROM (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN text || chr(10) || 'key AKIA' || lpad(CAST(doc_id AS VARCHAR), 16, '0') ELSE text END AS text FROM documents)))" for n, p in T.SECRETS),
    "encoding_damage": f"SELECT source, count(*) AS documents, count(CASE WHEN contains(text, '�') OR regexp_matches(text, {_quoted(T.MOJIBAKE)}) THEN 1 END) AS damaged FROM documents GROUP BY source",
    "corpus_stats": f"WITH {_WORDS} SELECT {_STATS} FROM w",
    "lang_stats": f"WITH {_WORDS} SELECT lang, {_STATS} FROM w GROUP BY lang",
    "source_coverage": """WITH k AS (SELECT 'src' || i AS s FROM range(16) t(i)), d AS (SELECT source, count(*) AS documents, count(DISTINCT lang) AS langs, count(CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 1 END) AS rejected FROM documents GROUP BY source)
      SELECT coalesce(s, source) AS source, s IS NOT NULL AS expected, coalesce(documents, 0) AS documents, coalesce(langs, 0) AS langs, coalesce(rejected, 0) AS rejected FROM k FULL JOIN d ON s = source""",
    "vocab_size": f"SELECT lang, count(DISTINCT lower(t)) AS vocabulary FROM (SELECT lang, unnest(regexp_extract_all(text, {_quoted(T.WORD)})) AS t FROM documents) GROUP BY lang",
    "balanced_sample": """WITH a AS (SELECT doc_id, lang, source, CAST(doc_id % 7 AS VARCHAR) AS k, row_number() OVER (PARTITION BY lang, source, doc_id % 7 ORDER BY doc_id) AS n FROM documents),
      b AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n, k) AS p FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY p, source) AS position FROM b),
      e AS (SELECT *, row_number() OVER (ORDER BY position, lang) AS r FROM c WHERE position > 40)
      SELECT doc_id, lang, position FROM c WHERE position <= 40 UNION ALL SELECT doc_id, lang, position FROM e WHERE r <= greatest(0, 200 - (SELECT count(*) FROM c WHERE position <= 40))""",
    "stratified_sample": "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 10",
    "constraint_checks": rf"""WITH o AS (SELECT count(*) AS a, count(*) - count(DISTINCT doc_id) AS b, count(CASE WHEN trim(text) = '' OR text IS NULL THEN 1 END) AS c, count(CASE WHEN lang NOT IN ('en', 'fr', 'de', 'es') THEN 1 END) AS d,
        avg(CAST(lang = 'en' AS INT)) AS e, avg(CAST(n_chars = length(text) AS INT)) AS f, avg(CAST(contains(text, '�') OR regexp_matches(text, {_quoted(T.MOJIBAKE)}) AS INT)) AS g, avg(CAST(length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) / length(text) >= 0.2 AS INT)) AS h FROM documents),
      x AS (SELECT unnest([{{'check': 'rows', 'observed': a::DOUBLE, 'least': 1.0::DOUBLE, 'most': 1e18::DOUBLE}}, {{'check': 'duplicate_ids', 'observed': b, 'least': 0, 'most': 0}}, {{'check': 'missing_text', 'observed': c, 'least': 0, 'most': 0}}, {{'check': 'unknown_lang', 'observed': d, 'least': 0, 'most': 0}},
        {{'check': 'english_share', 'observed': e, 'least': 0, 'most': 0.35}}, {{'check': 'length_agrees', 'observed': f, 'least': 1, 'most': 1}}, {{'check': 'damaged_share', 'observed': g, 'least': 0, 'most': 0.01}}, {{'check': 'readable_share', 'observed': h, 'least': 0.95, 'most': 1}}], recursive := true) FROM o)
      SELECT "check", round(observed, 6) AS observed, least, most, CASE WHEN round(observed, 6) BETWEEN least - 1e-15 AND most + 1e-15 THEN 'PASS' ELSE 'FAIL' END AS status FROM x""",
    "reference_checks": "SELECT 'lineitem' AS child, count(*) AS orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
    "label_agreement": _kappa_sql("labels", "quality", "toxic", "(CASE WHEN r.a = k.b THEN 0 ELSE 1 END)"),
    "weighted_kappa": _kappa_sql("(SELECT label, vec_id % 10 AS other FROM embeddings)", "label", "other", "((r.a - k.b) * (r.a - k.b))"),
    "confusion_matrix": "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL",
    "latency_percentiles": "SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS most, round(count(*) / (sum(value) / 1000), 6) AS per_second FROM events GROUP BY event_type",
    "leakage_5gram": _gram_sql(5) + " SELECT query_id, chunk_id, shared, round(shared / greatest(1, grams), 6) AS containment, round(shared / greatest(1, grams), 6) > 0.45 AS warning FROM hits JOIN c ON c.id = query_id",
    "leakage_13gram_run": _gram_sql(13) + " SELECT query_id, chunk_id, shared FROM hits",
    "conversation_contract": """WITH r AS (SELECT *, lag(role) OVER w AS before, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
      SELECT conv_id, count(*) AS turns, max(turn) - min(turn) + 1 = count(*) AS gapless, bool_and(coalesce(role IN ('system', 'user', 'assistant'), true)) AS roles_known, bool_and(coalesce(role <> 'system' OR turn = first, true)) AS system_first, bool_and(coalesce(role <> before, true)) AS alternates FROM r GROUP BY conv_id""",
    "citation_validity": """WITH n AS (SELECT conv_id, unnest(regexp_extract_all(coalesce(text, ''), '[0-9]+')) AS number FROM conversations), k AS (SELECT DISTINCT conv_id, CAST(turn AS VARCHAR) AS number FROM conversations),
      c AS (SELECT conv_id, count(*) AS cited, count(k.number) AS valid FROM n LEFT JOIN k USING (conv_id, number) GROUP BY conv_id)
      SELECT conv_id, coalesce(cited, 0) AS cited, round(coalesce(valid / cited, 1.0), 6) AS validity FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN c USING (conv_id)""",
    "task_success_paired": "SELECT count(CASE WHEN quality <> 1 AND toxic = 0 THEN 1 END) AS improved, count(CASE WHEN quality = 1 AND toxic <> 0 THEN 1 END) AS regressed, count(CASE WHEN quality = 1 AND toxic = 0 THEN 1 END) AS both, count(CASE WHEN quality <> 1 AND toxic <> 0 THEN 1 END) AS neither, round(avg(CAST(toxic = 0 AS INT)) - avg(CAST(quality = 1 AS INT)), 6) AS delta FROM labels",
    "symmetric_difference": "SELECT doc_id, 'a' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY doc_id UNION ALL SELECT doc_id, 'b' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) GROUP BY doc_id",
    "order_digest": """WITH p AS (SELECT doc_id // 1024 AS g, sha256(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY doc_id)) AS d, count(*) AS n FROM documents GROUP BY 1)
      SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(d, chr(10) ORDER BY g)) AS digest FROM p""",
    "content_tree": f"""WITH r AS (SELECT sha256(CAST(doc_id AS VARCHAR))[1:1] AS path, sha256(concat_ws(',', {', '.join(f"coalesce(length({c}) || ':' || {c}, '-')" for c in ("CAST(doc_id AS VARCHAR)", "lang", "source", "text"))})) AS d FROM documents),
      l AS (SELECT path, count(*) AS n, sha256(concat_ws(',', count(*), {', '.join(f"CAST(sum(CAST('0x' || d[{1 + 16 * i}:{15 + 16 * i}] AS BIGINT)) AS VARCHAR)" for i in range(4))})) AS digest FROM r GROUP BY path)
      SELECT CAST(1 AS BIGINT) AS level, path, n, digest FROM l UNION ALL SELECT 0, '', CAST(sum(n) AS BIGINT), sha256(string_agg(path || '=' || digest, ',' ORDER BY path)) FROM l""",
    "content_changes": """SELECT doc_id, CASE WHEN doc_id % 89 = 0 THEN 'gone' ELSE 'changed' END AS change FROM documents WHERE doc_id % 89 = 0 OR doc_id % 97 = 0 AND text[1:1] <> '~'
      UNION ALL SELECT -1 - doc_id, 'new' FROM documents WHERE doc_id % 83 = 0""",
    "recompute_compare": "SELECT doc_id, CAST(n AS DOUBLE) AS expected, CAST(length(text) AS DOUBLE) AS actual FROM (SELECT *, n_chars + CASE WHEN doc_id % 50 = 0 THEN 1 ELSE 0 END AS n FROM documents) WHERE n <> length(text)",
    "machine_relevance": None,
    "serialize_queries": """WITH f AS (SELECT conv_id AS query_id, arg_min(text, turn) AS p, CASE WHEN conv_id % 2 = 0 THEN 'mysql' END AS d FROM conversations WHERE role = 'user' GROUP BY conv_id),
      t AS (SELECT query_id, concat_ws(chr(10) || chr(10), CASE WHEN trim(p) <> '' THEN 'Question:' || chr(10) || trim(p) END, 'SQL dialect:' || chr(10) || d) AS s FROM f)
      SELECT query_id, length(s) AS n, sha256(s) AS sha256, CASE WHEN query_id % 2 = 0 THEN 'A' ELSE 'B' END AS shown_first FROM t""",
    "answer_contract": "SELECT doc_id, concat_ws(',', CASE WHEN toxic = 1 THEN 'keys' END, CASE WHEN quality * 2 - toxic NOT BETWEEN 0 AND 1 THEN 'confidence' END, CASE WHEN doc_id % 3 <> 0 THEN 'unknown_citation' END) AS faults FROM labels",
    "boilerplate_sections": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
      m AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, line ORDER BY n) > 1 AS again, coalesce(lag(line) OVER (PARTITION BY doc_id ORDER BY n) = line, false) AS adjacent FROM l)
      SELECT doc_id, count(CASE WHEN again THEN 1 END) AS again, count(CASE WHEN adjacent THEN 1 END) AS adjacent FROM m GROUP BY doc_id""",
}

from textloom.plans.retrieval import _LEX  # noqa: E402

ORACLE["machine_relevance"] = f"""WITH {_LEX}, q AS (SELECT item_id, {_POOL} AS qt FROM benchmark), d AS (SELECT doc_id, {_POOL} AS dt FROM documents),
  o AS (SELECT query_id, chunk_id, len(list_intersect(qt, dt)) AS overlap, len(qt) AS n FROM lexical JOIN q ON item_id = query_id JOIN d ON doc_id = chunk_id WHERE rank <= 10)
  SELECT query_id, chunk_id, CAST(overlap AS BIGINT) AS overlap, CAST(CASE WHEN overlap >= 3 AND overlap / greatest(1, least(n, 30)) >= 0.12 THEN 1 ELSE 0 END AS BIGINT) AS relevance FROM o"""
from textloom.plans.building import _prose_sql  # noqa: E402

ORACLE["prose_clean"] = f"SELECT page_id, length(c) AS n, sha256(c) AS sha FROM (SELECT page_id, {_prose_sql('html')} AS c FROM pages)"
