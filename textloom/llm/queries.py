"""The queries opN_<name> over the driver's tables, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import language_model
from textloom.llm.common import scratch, table
from textloom.llm.decontamination import contaminated
from textloom.llm.html_text import extract
from textloom.llm.near_duplicates import link
from textloom.llm.packing import Limits, pack_texts
from textloom.llm.phrases import collocations
from textloom.llm.prefix_trie import trie
from textloom.llm.quality import fit, score
from textloom.llm.records import build_index, write_records
from textloom.llm.repeats import without_repeats
from textloom.llm.sharding import shard
from textloom.llm.token_counts import count_tokens, fresh_cache
from textloom.llm.tokenization import vocabulary_path
from textloom.llm.voronoi import top_k


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0, k=20, scale=64)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"), percent=85)


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = language_model.train(docs.filter(~held_out(5)))
    return language_model.score(docs, model).select(
        "doc_id", held_out(5).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "records")
    write_records(table(spark, sf_dir, "documents"), path, vocabulary_path("word_bpe_49k.json"), end_id=2)
    return build_index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32", "file", "file_offset", "frame_length")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))


def held_out(k: int, column: str = "doc_id"):
    """crc32 of the id as text, mod k, is 1. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % k == 1, F.lit(False))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    return fit(docs, table(spark, sf_dir, "labels").filter(~held_out(3)))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, quality_model(spark, docs, sf_dir))
    return scored.select("doc_id", held_out(3).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), end_id=0, limits=Limits(segments=1024))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so that every distinct text is encoded in this run."""
    counted = count_tokens(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), fresh_cache(spark))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), max_n=5, least=100, percent=100, top=2000)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = lambda c: (F.crc32(c.cast("string").cast("binary")) % 4).cast("int")
    return trie(table(spark, sf_dir, "conversations"), base=lambda c: c - c % 20, shared=shared, most=3)


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = without_repeats(table(spark, sf_dir, "documents"), length=100)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_top_k": op2_top_k,
    "op3_decontamination": op3_decontamination,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_language_model": op5_language_model,
    "op6_records": op6_records,
    "op7_html_extraction": op7_html_extraction,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_token_counts": op10_token_counts,
    "op11_collocations": op11_collocations,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_repeats": op13_repeats,
}

# Words and windows as in the contract. Items with fewer than 13 words give one window of their own length.
_OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), hit AS (
  SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.gram = bw.gram AND dw.n = bw.n
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

_OP2_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

_OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), two AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), reach AS (
  SELECT a, b FROM two UNION SELECT reach.a, two.b FROM reach JOIN two ON reach.b = two.a
), least_of AS (
  SELECT a, min(b) AS m FROM reach GROUP BY a
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_of ON a = d.doc_id
"""

_OP11_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d
), g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k)
), f AS (
  SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL
), n AS (
  SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 100
), cut AS (
  SELECT lang, k, phrase, a, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:k], ' ') AS tail FROM (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM c)
), scored AS (
  SELECT cut.lang, cut.phrase, cut.a, x.a AS l, y.a AS r, n.n, j, CAST(1000 * CAST(cut.a AS HUGEINT) * n.n // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = head JOIN f y ON y.lang = cut.lang AND y.phrase = tail JOIN n ON n.lang = cut.lang
), low AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), covered AS (
  SELECT DISTINCT c.lang, c.phrase FROM c JOIN (
    SELECT lang, a, array_to_string(w[s:s + m - 1], ' ') AS part FROM (SELECT *, unnest(generate_series(1, k - m + 1)) AS s FROM c, (SELECT unnest([2, 3, 4]) AS m) WHERE m < k)
  ) x ON x.lang = c.lang AND x.part = c.phrase WHERE 100 * x.a >= 100 * c.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT low.*, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, low.a DESC, low.phrase) AS rank FROM low LEFT JOIN covered USING (lang, phrase) WHERE covered.phrase IS NULL
) WHERE rank <= 2000
"""

# CRC-32 of an id's digits, bit by bit.
_CRC = """xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)), lambda crc, o:
  list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, o)), CAST(4294967295 AS BIGINT)), 4294967295)"""

_OP12_SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS said
  FROM conversations WHERE conv_id IS NOT NULL
), h AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base, CRC % 4 AS h FROM t
), b AS (
  SELECT h.conv_id, 0 AS part, p, said FROM h JOIN t ON t.conv_id = base WHERE p < h UNION ALL SELECT t.conv_id, 1, p, said FROM t JOIN h ON h.conv_id = t.conv_id WHERE p >= h
), whole AS (
  SELECT h.conv_id, coalesce(list(said ORDER BY part, p) FILTER (said IS NOT NULL), []) AS w FROM h LEFT JOIN b USING (conv_id) GROUP BY h.conv_id
), pre AS (
  SELECT conv_id, d, w[1:d] AS path, len(w) = d AS ends FROM (SELECT conv_id, w, unnest(generate_series(0, len(w))) AS d FROM whole)
), node AS (
  SELECT d AS depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ids,
    (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(path[d].t, '[^\x20\x09-\x0D]+')) END AS saved
  FROM pre GROUP BY d, path
), kids AS (
  SELECT node.depth, node.path, count(k.depth) AS n FROM node LEFT JOIN node k ON k.depth = node.depth + 1 AND k.path[1:node.depth] = node.path GROUP BY ALL
), up AS (
  SELECT a AS depth, path[1:a] AS path, sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) AS leaves, sum(saved) AS saved
  FROM (SELECT node.path, node.saved, kids.n, unnest(generate_series(0, node.depth)) AS a FROM node JOIN kids ON kids.depth = node.depth AND kids.path = node.path) GROUP BY ALL
)
SELECT node.conv_id, node.depth, pa.conv_id AS parent_conv_id, node.n_convs, kids.n AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(up.saved AS BIGINT) AS saved_tokens, sha256(node.ids) AS ends_sha256
FROM node JOIN kids ON kids.depth = node.depth AND kids.path = node.path JOIN up ON up.depth = node.depth AND up.path = node.path
LEFT JOIN node pa ON pa.depth = node.depth - 1 AND pa.path = node.path[1:node.depth - 1] AND node.depth > 0
""".replace("CRC", _CRC)

_OP13_SQL = """
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents
), w AS (
  SELECT doc_id, i, md5(b[i:i + 99]) AS m FROM (SELECT doc_id, b, unnest(generate_series(1, n - 99)) AS i FROM d WHERE n >= 100)
), again AS (
  SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY m ORDER BY doc_id, i) > 1
), starts AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM again
), spans AS (
  SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM starts) GROUP BY doc_id, run
), holes AS (
  SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 1) AS before FROM spans
), pieces AS (
  SELECT doc_id, sum(hi - lo) AS removed, count(*) AS n_spans, max(hi) AS last FROM holes GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(hex(b[before:lo - 1]), '' ORDER BY lo) AS x FROM holes JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(CASE WHEN removed IS NULL THEN b ELSE from_hex(x || hex(b[last:n])) END) AS kept_sha256
FROM d LEFT JOIN pieces USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op2_top_k": _OP2_SQL, "op4_near_duplicates": _OP4_SQL, "op3_decontamination": _OP3_SQL, "op11_collocations": _OP11_SQL, "op12_prefix_trie": _OP12_SQL, "op13_repeats": _OP13_SQL}
