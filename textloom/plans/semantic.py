"""Queries on search by latent topics: TF-IDF, its singular values, the texts nearest to each item."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import dense, lsa
from textloom.operators.storage import written
from textloom.plans.retrieval import table

LEAST, MOST, SIZE, DIMENSIONS = 2, 0.98, 30_000, 96


def _words(spark, sf, name, id_col):
    return table(spark, sf, name).select(F.col(id_col).alias("id"), F.col("text"), lsa.words(F.col("text")).alias("words"))


def _weighed(texts, vocab):
    """Rows of texts over the vocabulary; where an id is there twice its rows are one text, and meet in a shuffle."""
    if lsa.one_a_text(texts):
        return lsa.weighed(texts, vocab, T.FIELD_STOPWORDS)
    return lsa.rows_of(lsa.frequencies(texts.select("id", lsa.terms(F.col("text"), T.FIELD_STOPWORDS).alias("terms"))), vocab)


def _fitted(spark, sf):
    """All documents' words, and the vocabulary, written."""
    docs = _words(spark, sf, "documents", "doc_id")
    n = table(spark, sf, "documents").count()
    if lsa.one_a_text(docs):
        found = lsa.chosen(lsa.totals(docs, T.FIELD_STOPWORDS), n, LEAST, MOST, SIZE)
    else:
        found = lsa.vocabulary(lsa.frequencies(docs.select("id", lsa.terms(F.col("text"), T.FIELD_STOPWORDS).alias("terms"))), n, LEAST, MOST, SIZE)
    return docs, written(found, "vocabulary")


def tfidf_vocabulary(spark, sf):
    """The vocabulary of all documents, without stop words: words and pairs of words."""
    _, vocab = _fitted(spark, sf)
    return vocab.select("term", "df", "cf", F.col("place").cast("long").alias("place"), F.round("idf", 6).alias("idf"))


def lsa_spectrum(spark, sf):
    """The singular values of all documents' TF-IDF rows in 96 dimensions."""
    docs, vocab = _fitted(spark, sf)
    values, _ = lsa.decomposed(_weighed(docs, vocab), vocab.count(), DIMENSIONS)
    return spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(values)], "dimension long, singular_value double")


def lsa_topk(spark, sf):
    """For each item the ten documents nearest to it in 96 dimensions, by cosine."""
    docs, vocab = _fitted(spark, sf)
    rows = written(_weighed(docs, vocab), "rows")
    _, basis = lsa.decomposed(rows, vocab.count(), DIMENSIONS)
    asked = _weighed(_words(spark, sf, "benchmark", "item_id"), vocab)
    found = dense.top_k(lsa.projected(asked, basis), lsa.projected(rows, basis), 10)
    return found.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (tfidf_vocabulary, lsa_spectrum, lsa_topk)}


# --- the same in SQL ---------------------------------------------------------------------------------------------------


_WORDS = ", ".join("'" + w.replace("'", "''") + "'" for w in T.FIELD_STOPWORDS)

ORACLE = {
    "tfidf_vocabulary": rf"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '{lsa.WORD}'), lambda x: x NOT IN ({_WORDS})) AS w FROM documents),
      t AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
      f AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term), n AS (SELECT count(*) AS n FROM documents),
      top AS (SELECT f.*, n FROM f, n WHERE df >= {LEAST} AND df <= {MOST} * n ORDER BY cf DESC, term LIMIT {SIZE})
      SELECT term, df, cf, row_number() OVER (ORDER BY term) - 1 AS place, round(ln((1 + n) / (1 + df)) + 1, 6) AS idf FROM top""",
}
