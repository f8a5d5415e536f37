"""Queries on tables made here: every row and every part of it counts."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import dedup
from textloom.plans import corpus


@pytest.fixture
def tables(spark, tmp_path):
    def make(**found):
        for name, (rows, schema) in found.items():
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return make


DOCUMENTS = "doc_id long, text string, lang string, source string"


def test_token_set_copies_are_listed(spark, tables):
    words = [f"w{i}" for i in range(20)]
    texts = {1: "a b", 2: "b a", 3: "A, b!", 4: " ".join(words), 5: " ".join(words[::-1]), 6: " ".join([*words[:19], "x"]), 7: "", 8: None, 9: "alone"}
    sf = tables(documents=([(i, t, "en", "s") for i, t in texts.items()], DOCUMENTS))
    got = {r["doc_id"]: (r["node"], r["links"]) for r in corpus.token_set_members(spark, sf).collect()}
    assert got == {1: (1, 0), 2: (1, 0), 3: (1, 0), 4: (4, 1), 5: (4, 1), 6: (6, 1), 7: (7, 0), 8: (8, 0), 9: (9, 0)}


def test_sources_outside_of_the_list_are_counted(spark, tables):
    docs = [(1, "a", "en", "src0"), (2, "a", "de", "src0"), (3, "a", "en", "src19"), (4, "a", "en", "elsewhere"), (5, "a", "fr", None), (6, "a", None, None)]
    sf = tables(documents=(docs, DOCUMENTS), labels=([(2, 0), (3, 0), (4, 1), (6, 0)], "doc_id long, quality int"))
    got = {r["source"]: tuple(r)[1:] for r in corpus.source_coverage(spark, sf).select("source", "expected", "documents", "langs", "rejected").collect()}
    assert len(got) == 19 and sum(r[1] for r in got.values()) == len(docs)
    assert (got["src0"], got["src15"], got["src19"], got["elsewhere"], got[None]) == ((True, 2, 2, 1), (True, 0, 0, 0), (False, 1, 1, 1), (False, 1, 1, 0), (False, 2, 1, 1))


def near_by_brute_force(spark, rows):
    """The greedy pass of the reference over all earlier kept rows."""
    text = F.col("text")
    words = F.transform(T.word_tokens(text), F.lower)
    facts = spark.createDataFrame(rows, "ord long, scope string, text string").select("ord", "scope", T.normalize_for_hash(F.coalesce(text, F.lit(""))).alias("norm"), F.size(words).alias("words"), T.error_tokens(F.coalesce(text, F.lit(""))).alias("errors"), T.shingles(words).alias("items"))
    kept, seen, found = [], set(), {}
    for r in facts.orderBy("ord").collect():
        items, errors = set(r["items"]), set(r["errors"])
        if (r["scope"], r["norm"]) in seen:
            found[r["ord"]] = "exact"
            continue
        for scope, norm, others, marks in kept if r["words"] >= 20 else ():
            a, b = sorted((len(norm), len(r["norm"])))
            if scope == r["scope"] and a >= 0.8 * b and not (errors and marks and errors != marks) and 100 * len(items & others) >= 85 * len(items | others):
                found[r["ord"]] = "near"
                break
        else:
            found[r["ord"]] = None
            kept.append((r["scope"], r["norm"], items, errors))
            seen.add((r["scope"], r["norm"]))
    return found


def near(spark, rows):
    return {r["ord"]: r["kind"] for r in dedup.near_keep_first(spark.createDataFrame(rows, "ord long, scope string, text string"), ["scope"]).collect()}


def test_repeated_lines_meet_each_other(spark):
    line = "the quick brown fox jumps over a lazy dog today\n"
    rows = [(i, "x", line * n) for i, n in ((1, 2), (2, 8), (3, 9), (4, 3), (5, 7), (6, 40), (7, 33), (8, 9))]
    got = near(spark, rows)
    assert got[2] is None and got[3] == "near" and got == near_by_brute_force(spark, rows)


def test_near_keep_first_against_brute_force(spark):
    rng = random.Random(8)
    lines = ["alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight nine ten"]
    rows = []
    for i in range(120):
        text = (rng.choice(lines) + rng.choice(["\n", ".\n", " ;\n"])) * rng.randint(1, 14)
        rows.append((i, rng.choice("xy"), text + rng.choice(["", "", " ERROR 1064", " ERROR 1146", "!", " " + " ".join(f"t{j}" for j in range(rng.randint(1, 3)))])))
    assert near(spark, rows) == near_by_brute_force(spark, rows)


def test_simhash_bands_against_brute_force(spark, tables):
    rng = random.Random(4)
    texts = [None, "", "one", "a b c d", *(" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (5, 6, 9, 40, 300)), "same words here five times " * 9]
    sf = tables(documents=([(i, t, "en", "s") for i, t in enumerate(texts)], DOCUMENTS))
    got = {(r["doc_id"], r["band"]): r["value"] for r in corpus.simhash_bands(spark, sf).collect()}
    items = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", T.shingles(F.transform(T.word_tokens(F.col("text")), F.lower)).alias("items"))
    hashes = items.select("doc_id", F.transform("items", lambda x: F.xxhash64(x)).alias("h")).collect()
    want = {}
    for r in hashes:
        value = sum(1 << bit for bit in range(64) if r["h"] and sum(1 if h >> bit & 1 else -1 for h in r["h"]) >= 0)
        want |= {(r["doc_id"], band): value >> 8 * band & 255 for band in range(8)}
    assert got == want and len(got) == 8 * len(texts)
    assert "simhash_bands" in corpus.QUERIES


def test_citations_of_every_turn_count(spark, tables):
    rows = [(1, 0, "user", "see 7"), (1, 1, "assistant", "as 0 and 0 say"), (1, 2, "user", "thanks"), (2, 0, "user", "no numbers"), (2, 1, "user", None), (3, 5, "user", "5, 5 and 6"), (None, 1, "user", "1")]
    sf = tables(conversations=(rows, "conv_id long, turn int, role string, text string"))
    got = {r["conv_id"]: (r["cited"], r["validity"]) for r in corpus.citation_validity(spark, sf).collect()}
    assert got == {1: (3, 0.666667), 2: (0, 1.0), 3: (3, 0.666667), None: (1, 1.0)}


def test_copies_without_scope_or_text(spark, tables):
    docs = [(1, "a b", None, "s"), (2, "A  b", None, "s"), (3, None, "en", "s"), (4, None, "en", "s"), (5, None, None, "s"), (6, None, None, "s"), (7, "a b", "en", "s")]
    sf = tables(documents=(docs, DOCUMENTS))
    assert {r["doc_id"]: r["keeps"] for r in corpus.exact_dedup(spark, sf).collect()} == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False, 7: True}
    words = [f"token{i}" for i in range(100)]
    rows = [(1, None, "same"), (2, None, "Same"), (3, None, " ".join(words)), (4, None, " ".join([*words[:99], "else"])), (5, "x", " ".join(words)), (6, None, None), (7, None, "")]
    assert near(spark, rows) == near_by_brute_force(spark, rows) | {6: None, 7: "exact"} == {1: None, 2: "exact", 3: None, 4: "near", 5: None, 6: None, 7: "exact"}
