"""The corpus pipeline over documents: quality, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; all but the last
return the columns of documents. run() writes each stage's result as Parquet in the shared folder and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import materialize, small_batches, table
from textloom.llm.decontamination import contaminated
from textloom.llm.near_duplicates import link
from textloom.llm.packing import pack_texts
from textloom.llm.quality import score
from textloom.llm.queries import quality_model
from textloom.llm.tokenization import vocabulary_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose probability of being good is below one half. The model is fitted on labelled rows of
    docs that are not held out."""
    small_batches(spark)
    model = quality_model(spark, docs, sf_dir)
    return score(docs.select(*COLUMNS), model, name="quality_score").filter(F.col("quality_score") >= 0.5).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (five-word shingles, similarity 0.8 or more): the one with the
    least id. Documents without words, and those with a null id, are in no group. Rows with equal ids are one document, and
    stay or go together."""
    small_batches(spark)
    found = link(docs, percent=80).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(found, "doc_id", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of whose words one in twenty or more lies in a window of a benchmark item."""
    small_batches(spark)
    found = contaminated(docs, table(spark, sf_dir, "benchmark"), carry=("lang", "source", "n_chars")).filter(~F.col("contaminated"))
    return found.select("doc_id", "text", "carried.lang", "carried.source", "carried.n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 1024 tokens."""
    small_batches(spark)
    return pack_texts(docs, vocabulary_path("byte_bpe_50k.json"), end_id=0)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: A trained network and a tokenizer can't be stated in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
