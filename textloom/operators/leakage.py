"""Leakage of query wording into evidence, and heuristic relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T


def gram_hits(queries: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(query_id, chunk_id, shared, grams): distinct runs of so many tokens that a text shares with a query, of so many
    that the query has. Both inputs: id, tokens. Only texts that share one come out. Runs are compared as 64-bit hashes."""
    asked = queries.select(F.col("id").alias("query_id"), T.ngram_hashes(F.col("tokens"), size).alias("g")).select("query_id", F.size("g").cast("long").alias("grams"), F.explode("g").alias("gram"))
    seen = texts.select(F.col("id").alias("chunk_id"), F.explode(T.ngram_hashes(F.col("tokens"), size)).alias("gram"))
    return seen.join(asked, "gram").groupBy("query_id", "chunk_id", "grams").agg(F.count(F.lit(1)).alias("shared"))


def status(run: Column, copied: Column, containment: Column, ratio: Column) -> Column:
    """FAIL for more than 12 tokens in a row or a whole sentence, WARN for much of the wording, else PASS."""
    fail = (run > 12) | copied
    return F.when(fail, "FAIL").when((containment > 0.45) | (ratio > 0.55), "WARN").otherwise("PASS")


def relevance(same_dialect: Column, overlap: Column, query_terms: Column, in_both: Column, explicit: Column) -> Column:
    """The explicit grade where there is one; else 1 for enough shared terms, or for two with both retrievers; else 0."""
    share = overlap / F.greatest(F.lit(1), F.least(query_terms, F.lit(30)))
    found = F.when(same_dialect & (overlap >= 3) & (share >= 0.12), 1).when(same_dialect & in_both & (overlap >= 2), 1).otherwise(0)
    return F.coalesce(explicit, found)
