import hashlib
import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import chunking, dedup, dense, evaluation, leakage, lexical, merkle, percentiles, ranking
from textloom.operators.numbering import numbered
from textloom.operators.storage import kept


def run(spark, rows):
    return spark.createDataFrame(rows, "query_id long, chunk_id long, rank int, score double")


def test_rrf_ties(spark):
    a = run(spark, [(1, 10, 1, 3.0), (1, 26, 3, 1.0), (1, 1, 12, 0.5)])
    b = run(spark, [(1, 26, 24, 0.1), (1, 1, 12, 0.2), (1, 7, 1, 0.9)])
    got = ranking.rrf(a, b).orderBy("rank").collect()
    # 26 and 1 have equal sums; the better component rank decides. 7 and 10 are in one list each.
    assert [r["chunk_id"] for r in got] == [26, 1, 7, 10]
    assert got[2]["lexical_rank"] is None and got[3]["dense_rank"] is None


def test_bm25_padding(spark):
    docs = spark.createDataFrame([(2, ["x"]), (1, ["x"]), (3, ["y"]), (4, [])], "id long, tokens array<string>")
    asked = spark.createDataFrame([(9, ["x"])], "id long, tokens array<string>")
    held = index_of(docs)
    got = lexical.padded_top_k(lexical.scores(held, asked, lexical.Bm25(idf="lucene")), held, asked, 4).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == [1, 2, 3, 4] and got[2]["score"] == 0


def index_of(docs):
    return lexical.Index(lexical.postings(docs), numbered(lexical.doc_lengths(docs), ["id"], "place"))


def test_padding_is_what_all_texts_give(spark):
    """Negative scores, queries without a match and such as match the smallest ids, against the ranking of every pair."""
    rng = random.Random(4)
    docs = [(i * 3, [w for w in "abcd" for _ in range(rng.randint(1, 3)) if rng.random() < 0.8]) for i in range(30)]
    asked = [(q, [rng.choice("abcdz") for _ in range(rng.randint(1, 3))]) for q in range(12)] + [(50, ["z"]), (51, ["a"])]
    held = index_of(spark.createDataFrame(docs, "id long, tokens array<string>"))
    queries = spark.createDataFrame(asked, "id long, tokens array<string>")
    scored = lexical.scores(held, queries, lexical.Bm25(idf="okapi"))
    known = {(r["query_id"], r["chunk_id"]): r["score"] for r in scored.collect()}
    got = {}
    for r in lexical.padded_top_k(scored, held, queries, 7).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert min(known.values()) < 0
    for q, _ in asked:
        assert got[q] == [i for _, i in sorted((-known.get((q, i), 0.0), i) for i, _ in docs)][:7], q


def test_numbered(spark):
    rows = spark.createDataFrame([(x % 17, x) for x in range(200)] + [(None, 500)], "k int, v int").repartition(7)
    got = numbered(rows, ["k", "v"], "place").orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(201)) and [(r["k"], r["v"]) for r in got] == [(None, 500), *sorted((x % 17, x) for x in range(200))]
    assert numbered(rows.limit(0), ["k"]).count() == 0


def test_bootstrap_draws_with_replacement(spark):
    values = [(q, float((q * 37) % 11)) for q in range(40)]
    got = evaluation.bootstrap(spark.createDataFrame(values, "query_id long, x double"), "x", rounds=400).first()
    plain = [[int(hashlib.md5(f"42:{b}:{d}".encode()).hexdigest()[:15], 16) % 40 for d in range(40)] for b in range(400)]
    means = sorted(sum(values[i][1] for i in r) / 40 for r in plain)
    assert all(len(set(r)) < 40 for r in plain)
    mean = sum(x for _, x in values) / 40
    assert got["low"] < mean < got["high"] and got["high"] - got["low"] > 0.5
    assert got["mean"] == pytest.approx(sum(means) / 400, abs=1e-5)
    assert evaluation.bootstrap(spark.createDataFrame([], "query_id long, x double"), "x").first()["mean"] is None


def test_kept_tables_follow_their_files(spark, tmp_path):
    made = []
    path = f"file://{tmp_path}/in"

    def build():
        made.append(1)
        return spark.read.option("recursiveFileLookup", "true").parquet(path)

    spark.range(3).write.parquet(path + "/deep/down")
    assert kept(spark, "three", [path], [1], build).count() == kept(spark, "three", [path], [1], build).count() == 3 and len(made) == 1
    spark.range(5).write.parquet(path + "/deep/more")
    assert kept(spark, "three", [path], [1], build).count() == 8 and len(made) == 2
    inner = sorted(p for p in os.listdir(tmp_path / "in/deep/down") if p.endswith(".parquet"))[0]
    file = tmp_path / "in/deep/down" / inner
    os.utime(file, (1_000_000, 1_000_000))  # rewritten in place, as many bytes, its folders unchanged
    assert kept(spark, "three", [path], [1], build).count() == 8 and len(made) == 3


def test_kept_tables_follow_what_they_are_made_by(spark, tmp_path):
    path, made = f"file://{tmp_path}/in", []
    spark.createDataFrame([(1, "a-b c"), (2, "d")], "id long, text string").write.parquet(path)
    texts = spark.read.parquet(path)
    words = lambda pattern: F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda x: F.lower(x))
    held = lambda pattern: lexical.kept_index(spark, "made-by", [path], texts, "id", words(pattern))
    assert held("[a-z]+").postings.count() == held("[a-z]+").postings.count() == 4
    assert held("[a-z-]+").postings.count() == 3  # another tokenizer under the same name
    assert held("[a-z]+").postings.inputFiles() == held("[a-z]+").postings.inputFiles() != held("[a-z-]+").postings.inputFiles()
    build = lambda: made.append(1) or texts
    for by in ([lexical.Bm25(), lexical], [lexical.Bm25(), lexical], [lexical.Bm25(k1=1.2), lexical], [lexical.Bm25(), dense]):
        kept(spark, "by", [path], by, build)
    assert len(made) == 3


def test_binding_tells_another_corpus(spark):
    texts = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "id long, text string")
    docs = lexical.tokenized(texts, "id", F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != ""))
    held, content = index_of(docs), merkle.tree(texts, "id", ["text"])
    bound = lambda held, texts: lexical.binding(held, content, texts, "id", ["text"]).first()
    assert bound(held, texts).asDict() == {"documents": 3, "postings": 2, "tokens": 3, "terms": 2, "bound": True}
    assert not bound(held, texts.filter("id != 3"))["bound"]
    assert not bound(held, texts.replace("a b a", "a c a"))["bound"]  # as many letters and words
    assert not bound(held, texts.na.fill("", ["text"]))["bound"]
    assert not bound(lexical.Index(held.postings.filter("term = 'a'"), held.lengths), texts)["bound"]


def test_changes_are_located(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEAF_ROWS", 2)
    rows = [(i, f"text {i}" if i % 7 else None) for i in range(600)]
    later = [(i, "text x" if i in (5, 100) else "" if i == 7 else t) for i, t in rows if i != 33] + [(1000, "text")]
    a, b = (spark.createDataFrame(r, "id long, text string") for r in (rows, later))
    assert {tuple(r) for r in merkle.changes(a, b, "id", ["text"]).collect()} == {(5, "changed"), (100, "changed"), (7, "changed"), (33, "gone"), (1000, "new")}
    x, y = (merkle.tree(t, "id", ["text"], 3) for t in (a, b))
    found = {r["path"] for r in merkle.differing(x, y).collect()}
    assert found == {hashlib.sha256(str(i).encode()).hexdigest()[:3] for i in (5, 7, 33, 100, 1000)}
    assert merkle.differing(x, merkle.tree(a.repartition(7), "id", ["text"], 3)).count() == 0
    assert merkle.changes(a.limit(0), b.limit(0), "id", ["text"]).count() == 0


def test_percentiles_against_sorted_values(spark, monkeypatch):
    monkeypatch.setattr(percentiles, "BINS", 4)
    rng = random.Random(2)
    groups = {"a": [rng.gauss(0, 1) for _ in range(400)], "b": [10.0**-i for i in range(60)] + [10.0**i for i in range(60)], "c": [7.0] * 90 + [8.0], "d": [1.5], None: [float(rng.randrange(5)) for _ in range(77)], "e": [None, None]}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r[0]: r for r in percentiles.percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", shares).collect()}
    for g, vs in groups.items():
        for name, q in shares.items():
            want = None if vs[0] is None else float(np.percentile(vs, 100 * q))
            assert got[g][name] == (want if want is None else pytest.approx(want, rel=1e-12)), (g, name)
    assert percentiles.percentiles(spark.createDataFrame(rows, "g string, v double"), [], "v", {"p": 0.5}).count() == 1


def test_dense_ties(spark):
    rows = spark.createDataFrame([(2, [1.0, 0.0]), (1, [1.0, 0.0]), (3, [0.0, 1.0])], "id long, vector array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "id long, vector array<double>")
    assert [r["chunk_id"] for r in dense.top_k(asked, rows, 3).orderBy("rank").collect()] == [1, 2, 3]
    assert dense.top_k(asked.limit(0), rows, 3).count() == 0


def test_dense_odd_vectors(spark, monkeypatch):
    """Null, empty, ragged and non-finite vectors, and blocks smaller than the table."""
    monkeypatch.setattr(dense, "ROW_BLOCK", 4)
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5]) for _ in range(4)]) for i in range(30)] + [(40, None), (41, []), (42, [1.0, None, 0.0, 0.0]), (43, [float("nan")] * 4), (44, [float("inf")] * 4), (45, [2.0]), (46, [0.5] * 6)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = {}
    for r in dense.top_k(df.filter("id % 10 = 0 or id > 40"), df, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    fine = {i: v for i, v in rows if v and all(x is not None and abs(x) < 10 for x in v)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    assert got == {q: [i for _, i in sorted((-dot(fine[q], v), i) for i, v in fine.items())][:5] for q in (0, 10, 20, 45, 46)}


def test_metrics(spark):
    r = run(spark, [(1, i + 1, i + 1, 9.0 - i) for i in range(5)])
    q = spark.createDataFrame([(1, 5, 2), (1, 77, 2), (1, 3, 1)], "query_id long, chunk_id long, relevance int")
    m = evaluation.per_query(r, q, spark.createDataFrame([(1,), (2,)], "query_id long")).orderBy("query_id").collect()
    assert (m[0]["mrr_10"], m[0]["recall_5"], m[0]["p_5"], m[0]["hit_5"], m[0]["judged_5"]) == (0.2, 0.5, 0.2, 1.0, 0.4)
    assert m[1]["ndcg_10"] == 0.0 and m[1]["judged_30"] == 0.0


def test_rbo_and_tau(spark):
    a, b = run(spark, [(1, 1, 1, 3.0), (1, 2, 2, 2.0)]), run(spark, [(1, 2, 1, 3.0), (1, 1, 2, 2.0)])
    assert ranking.kendall_tau(a, b, 30).first()["tau"] == -1.0
    both = ranking.paired(a, a, 10).select(ranking.rbo(F.col("a"), F.col("b")).alias("x")).first()["x"]
    assert both == pytest.approx(1.0)


def test_wins_need_equal_queries(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 0.0), (3, 0.5)], "query_id long, m double")
    b = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 0.5)], "query_id long, m double")
    w = evaluation.wins(a, b, "m").first()
    assert (w["wins_a"], w["wins_b"], w["ties"], w["mean_difference"]) == (1, 1, 1, 0.0)
    with pytest.raises(Exception, match="different queries"):
        evaluation.wins(a, b.filter("query_id < 3"), "m").collect()


def test_keep_first_is_greedy(spark):
    rng = random.Random(3)
    for _ in range(3):
        n = 12
        edges = [(a, b) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.25]
        want = []
        for j in range(n):
            if not any((i, j) in edges for i in want):
                want.append(j)
        nodes = spark.range(n).toDF("node")
        got = dedup.keep_first(nodes, spark.createDataFrame(edges, "a long, b long")).filter("kept").orderBy("node").collect()
        assert [r["node"] for r in got] == want


def test_near_keep_first(spark):
    words = [f"token{i}" for i in range(100)]
    other = " ".join([*words[:99], "else"])
    rows = [(1, "x", "SELECT  *\nFROM users;"), (2, "x", " select *\nfrom users;  "), (3, "x", " ".join(words)), (4, "x", other), (5, "y", other), (6, "x", None), (7, "x", None),
            (8, "x", " ".join(words[:80]) + " SQLSTATE 23505"), (9, "x", " ".join(words[:80]) + " SQLSTATE 23503")]
    got = {r["ord"]: r["kind"] for r in dedup.near_keep_first(spark.createDataFrame(rows, "ord long, scope string, text string"), ["scope"]).collect()}
    assert got[2] == "exact" and got[4] == "near" and got[5] is None and got[7] == "exact" and got[9] is None and got[1] is None


def test_similar_pairs_against_brute_force(spark):
    rng = random.Random(5)
    sets = [(i, [str(x) for x in rng.sample(range(14), rng.randint(0, 8))]) for i in range(60)]
    pairs, members = dedup.similar_pairs(spark.createDataFrame(sets, "id long, items array<string>"), 60)
    node = {r["id"]: r["node"] for r in members.collect()}
    got = {(r["a"], r["b"]) for r in pairs.collect()}
    s = {i: frozenset(x) for i, x in sets}
    for i, j in itertools.combinations(range(60), 2):
        if s[i] and s[j]:
            if s[i] == s[j]:
                assert node[i] == node[j]
            elif node[i] != node[j]:
                assert (100 * len(s[i] & s[j]) >= 60 * len(s[i] | s[j])) == (tuple(sorted((node[i], node[j]))) in got)


def test_chunks():
    assert chunking.windows("a b c d e", 2, 1) == ["a b", "b c", "c d", "d e", "e"]
    blocks = [("prose", "Use this."), ("code", "```sql\nSELECT 1\n```"), ("prose", "word " * 300)]
    got = chunking.section_chunks(blocks)
    assert "Use this.\n\n```sql" in got[0] and all(chunking.count(c) <= 2 * 260 for c in got)
    assert chunking.units([("table", "Table:\n" + "\n".join("- a: " + "x " * 50 for _ in range(20)))], 260)[1].startswith("Table:")


def test_units_bind_code_and_tables_to_what_precedes():
    code, table, prose = ("code", "```sql\nSELECT 1\n```"), ("table", "Table:\n- a: 1"), ("prose", "Use this.")
    join = "\n\n".join
    assert chunking.units([prose, code, table, prose, table], 50) == [join([prose[1], code[1], table[1]]), join([prose[1], table[1]])]
    assert chunking.units([code, code, ("prose", " "), table], 50) == [join([code[1], code[1], table[1]])]
    long = ("code", "```\n" + "word " * 90 + "\n```")  # twice the most words, with what precedes, and no further
    assert chunking.units([("prose", "word " * 10), long, code], 50) == [join([("word " * 10).strip(), long[1]]), code[1]]
    rows = [f"- a: {'x ' * 30}{i}" for i in range(200)]
    pieces = chunking.units([("prose", "Before."), ("table", "\n".join(["Table:", *rows])), code], 100)
    assert pieces[0] == "Before." and all(p.startswith("Table:\n- a") for p in pieces[1:]) and pieces[-1].endswith(code[1])
    assert [line for p in pieces[1:] for line in p.split("\n") if line.startswith("- a")] == [r.rstrip() for r in rows]
    assert all(chunking.count(p) <= 100 for p in pieces[1:-1])
    assert chunking.table_pieces("- a: 1\n\n- b: 2", 2) == ["Table:\n- a: 1", "Table:\n- b: 2"]


def test_chunks_carry_whole_sentences():
    shape = chunking.Shape(target=20, least=5, most=30, overlap=8)
    first, second = "One two three four. Five six seven eight nine. Ten eleven twelve.", "A b c d e f g h i j k l m n."
    got = chunking.section_chunks([("prose", first), ("prose", second)], shape)
    assert got == [first, f"{chunking.CARRIED}Five six seven eight nine. Ten eleven twelve.\n\n{second}"]
    assert chunking.carried("word " * 40 + "end.", 8) == chunking.CARRIED + "word " * 7 + "end."
    assert chunking.carried("", 8) == "" and chunking.carried("A b. " + "C " * 11 + "d.", 8).endswith("C " * 11 + "d.")
    # nothing is carried over from code, nor where it does not fit
    assert len(chunking.section_chunks([("code", "```\n" + "x " * 18 + "\n```"), ("prose", second)], shape)) == 2
    assert chunking.CARRIED not in "".join(chunking.section_chunks([("code", "```\n" + "x " * 18 + "\n```"), ("prose", second)], shape))
    bare = chunking.Shape(target=20, least=5, most=30, overlap=0)
    assert chunking.section_chunks([("prose", "x " * 28 + "."), ("prose", "tail.")], bare) == ["x " * 28 + ".\n\ntail."]


def test_leakage(spark):
    q = spark.createDataFrame([(1, list("abcdef"))], "id long, tokens array<string>")
    t = spark.createDataFrame([(5, list("xabcdex")), (6, list("zzz"))], "id long, tokens array<string>")
    r = leakage.gram_hits(q, t, 5).collect()
    assert [(x["chunk_id"], x["shared"], x["grams"]) for x in r] == [(5, 1, 2)]
