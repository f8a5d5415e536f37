"""Steps between parsed documents and chunk records: cleaning, enrichment, adjacent merges, keep rules, manifests, shards."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import version as V
from textloom.operators.chunking import count

# Vocabularies of a source manifest.
STATUSES = ("exact", "range", "current", "legacy", "unknown")
COLLECTORS = ("archive", "single", "url_list", "sitemap")
#: Prose of fewer words is kept once in a document, longer prose once in a section.
SHORT_WORDS = 15


def clean_blocks(blocks: DataFrame) -> DataFrame:
    """blocks: doc_id, section, n, type and text, one row a block. Adds keep, and text becomes the cleaned one.

    Blocks that are empty, boilerplate or navigation tables go. Of equal blocks of a section the first stays; short prose
    stays only where nothing equal came before it in the document. n gives the order within a document.
    """
    atomic = F.col("type").isin("code", "table")
    cleaned = blocks.withColumn("text", F.when(atomic, T.clean_atomic(F.col("text"))).otherwise(T.clean_prose(F.col("text"))))
    bad = (F.col("text") == "") | T.is_boilerplate(F.col("text")) | (F.col("type") == "table") & T.is_navigation_table(F.col("text"))
    marked = cleaned.withColumn("_bad", F.coalesce(bad, F.lit(True))).withColumn("_print", F.sha2(T.normalize_for_hash(F.col("text")), 256))
    before = Window.partitionBy("doc_id", "_print").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum((~F.col("_bad")).cast("int")).over(before), F.lit(0)) > 0
    short = (F.col("type") == "prose") & (T.word_count(F.col("text")) < SHORT_WORDS)
    fresh = marked.withColumn("_fresh", ~F.col("_bad") & ~(short & seen))
    within = Window.partitionBy("doc_id", "section", "_print").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    again = F.coalesce(F.sum(F.col("_fresh").cast("int")).over(within), F.lit(0)) > 0
    return fresh.withColumn("keep", F.col("_fresh") & ~again).drop("_bad", "_print", "_fresh")


def cleaned_documents(blocks: DataFrame) -> DataFrame:
    """One row per document of clean_blocks' rows: kept and removed blocks, whether nothing is left, and the digest of the
    kept texts in order."""
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col("keep"), F.struct("n", "text")))), lambda x: x["text"])
    return blocks.groupBy("doc_id").agg(
        F.count(F.when(F.col("keep"), 1)).alias("kept"), F.count(F.when(~F.col("keep"), 1)).alias("removed"), F.sha2(F.array_join(texts, "\n"), 256).alias("content_sha256"),
    ).withColumn("empty", F.col("kept") == 0)


def enriched(documents: DataFrame, context: Column) -> DataFrame:
    """documents: dialect, source_type, version, version_min, version_max, version_status. The dialect gets its own name, an
    unknown status becomes "unknown", and release notes without a status take the version that context names; inferred
    says so."""
    status = F.when(F.col("version_status").isin(*STATUSES), F.col("version_status")).otherwise("unknown")
    found = F.when((status == "unknown") & (F.col("source_type") == "release_notes"), V.release_version(context))
    rows = documents.withColumns({"dialect": V.normalize_dialect(F.col("dialect")), "_found": found, "_status": status})
    known = F.col("_found").isNotNull()
    names = ("version", "version_min", "version_max")
    return rows.withColumns({c: F.when(known, F.col(f"_found.{c}")).otherwise(F.col(c)) for c in names} | {"version_status": F.when(known, F.col("_found.version_status")).otherwise(F.col("_status")), "inferred": known}).drop("_found", "_status")


def chunk_kept(body: Column, text: Column, section: Column, has_sql: Column, has_error: Column, least: int = 35) -> Column:
    """Whether a chunk is worth keeping: enough words, or SQL, an error, code, a table, or a section that says what it is."""
    flags = [has_sql, has_error, F.contains(text, F.lit("```")), F.contains(text, F.lit("\nTable:\n")), section.rlike(T.ATOMIC_SECTION)]
    kept = T.word_count(body) >= least
    for f in flags:
        kept = kept | F.coalesce(f, F.lit(False))
    return kept


def chunk_records(chunks: DataFrame, prefix: str = "chunk") -> DataFrame:
    """chunks: document_id, dialect, source_type, title, section, section_index, part_index, strategy, text. Adds chunk_id (of
    all that makes the chunk what it is), content_hash, flags and topic."""
    identity = F.concat_ws("|", "document_id", "strategy", F.col("section_index").cast("string"), F.col("part_index").cast("string"), "section", F.sha2("text", 256))
    text = F.col("text")
    return chunks.withColumns({
        "chunk_id": F.concat_ws("_", F.lit(prefix), "dialect", F.substring(F.sha2(identity, 256), 1, 24)), "content_hash": F.sha2("text", 256), "contains_sql": T.contains_sql(text),
        "contains_error_code": T.contains_error_code(text, F.col("dialect")), "contains_version_or_compatibility": T.contains_version_talk(text), "topic": T.topic(F.col("section"), text, F.col("source_type")),
    })


@dataclass(frozen=True)
class Part:
    section: str
    body: str
    scope: tuple  # what must be equal for two parts to be joined
    alone: bool = False  # an error record


def merged(parts: list[Part], least: int = 35, most: int = 260) -> list[Part]:
    """Neighbours joined where the first is short, or the second goes on in lower case, as far as both are of one scope, none
    stands alone, and twice most words are not exceeded. What comes from another section is introduced by its name."""
    out: list[Part] = []
    for part in parts:
        last = out[-1] if out else None
        wanted = last is not None and (count(last.body) < least or re.match("[a-z]", part.body) is not None)
        if not wanted or last.alone or part.alone or last.scope != part.scope:
            out.append(part)
            continue
        same = last.section == part.section
        body = f"{last.body}\n\n{part.body}" if same else f"{last.body}\n\nRelated subsection: {part.section}\n\n{part.body}"
        if max(count(body), count(last.body) + count(part.body)) > 2 * most:
            out.append(part)
        else:
            name = last.section if same else last.section.split(" + adjacent subsection", 1)[0] + " + adjacent subsections"
            out[-1] = Part(name, body, last.scope)
    return out


def merge_adjacent(chunks: DataFrame, scope: list[str], least: int = 35, most: int = 260) -> DataFrame:
    """chunks: document_id, n, section, body, alone and the scope's columns. One row per merged chunk: document_id, n (anew),
    section, body. A document's chunks meet in one task; nulls in the scope are equal, a null body is an empty one."""
    rows = chunks.withColumns({"body": F.coalesce("body", F.lit("")), "section": F.coalesce("section", F.lit("")), "alone": F.coalesce("alone", F.lit(False)), "scope": F.to_json(F.struct(*scope))})
    held = rows.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("n", "section", "body", "scope", "alone"))).alias("parts"))
    kind = chunks.schema["document_id"].dataType.simpleString()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                found = merged([Part(p["section"], p["body"], (p["scope"],), p["alone"]) for p in batch.column("parts")[at].as_py()], least, most)
                ids = batch.column("document_id").take(pa.array([at] * len(found), pa.int32()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(range(len(found)), pa.int32()), pa.array([p.section for p in found]), pa.array([p.body for p in found])], names=["document_id", "n", "section", "body"])

    return held.mapInArrow(join, f"document_id {kind}, n int, section string, body string")


def manifest_faults(entries: DataFrame, required: list[str], dialects: tuple[str, ...]) -> DataFrame:
    """entries: n (their order), id, dialect, version_status, collector, url and the required columns. Rows (n, fault) for
    what is missing, not of a vocabulary, or there a second time; a sound manifest has none."""
    again = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("n")) > 1
    located = F.col("collector").isin("archive", "single", "sitemap")
    url = F.coalesce("url", F.lit(""))
    marked = entries.withColumn("_located", F.coalesce(located, F.lit(False))).withColumn("_id_again", again("id")).withColumn("_url_again", again("dialect", "_located", "url"))
    outside = lambda c, values: ~F.coalesce(F.col(c).isin(*values), F.lit(False))
    rules = [(f"missing_{c}", F.coalesce(F.col(c).cast("string"), F.lit("")) == "") for c in required]
    rules += [
        ("duplicate_id", F.col("_id_again")), ("invalid_dialect", outside("dialect", dialects)), ("invalid_status", F.col("version_status").isNotNull() & outside("version_status", STATUSES)),
        ("invalid_collector", outside("collector", COLLECTORS)), ("missing_url", F.col("_located") & (url == "")), ("duplicate_url", F.col("_located") & F.col("_url_again")),
    ]
    found = F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules]))
    return marked.select("n", F.explode(found).alias("fault"))


def selected(corpus: DataFrame, wanted: DataFrame, id_col: str) -> DataFrame:
    """The rows of corpus whose id is wanted; a wanted id that corpus lacks is an error."""
    ids = wanted.select(id_col).distinct()
    missing = ids.join(corpus.select(id_col), id_col, "left_anti").limit(3).collect()
    if missing:
        raise ValueError(f"not in the corpus: {[r[0] for r in missing]}")
    return corpus.join(ids, id_col, "left_semi")


def concatenated(shards: list[tuple[str, DataFrame, int, int]], id_col: str) -> DataFrame:
    """shards: (name, rows, first, last) in order. All rows with a column shard; each must hold just the ids from first to
    last, each once, and ranges must follow each other."""
    out, after = None, None
    for name, rows, first, last in shards:
        r = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(id_col).alias("d"), F.min(id_col).alias("low"), F.max(id_col).alias("high")).first()
        if (r["n"], r["d"], r["low"], r["high"]) != (last - first + 1, last - first + 1, first, last):
            raise ValueError(f"{name}: ids must be {first} to {last}, each once")
        if after is not None and first != after:
            raise ValueError(f"{name}: ids must go on from {after}")
        after, one = last + 1, rows.withColumn("shard", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
