import random
import re

import numpy as np

from textloom.llm.decontamination import Matcher, contaminated, word_bounds, words_of
from textloom.llm import voronoi
from textloom.llm.voronoi import top_k


def brute(rows, k, every):
    v = {}
    for i, x in rows:
        if i is not None and x and all(e is not None and np.isfinite(e) for e in x):
            v.setdefault((i, tuple(max(-(2**63), min(2**63 - 1, int(np.floor(64 * float(e))))) for e in x)), None)
    out = {}
    for q, a in v:
        if q % every == 0:
            s = sorted((-sum(p * r for p, r in zip(a, b)), i) for i, b in v if i != q)[:k]
            out[q] = [(i, -t) for t, i in s]
    return out


def check(spark, rows, k=5, every=4, big=False):
    df = spark.createDataFrame([(i, x, "own") for i, x in rows], f"vec_id long, embedding array<{'double' if big else 'float'}>, score string")
    got = {}
    for r in sorted(top_k(df, lambda c: c % every == 0, k=k).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute([(i, [None if e is None else float(e) if big else float(np.float32(e)) for e in x] if x is not None else None) for i, x in rows], k, every)
    assert got == {q: [(i, max(-(2**63), min(2**63 - 1, s))) for i, s in x] for q, x in want.items() if x}


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=6) * (3 if i % 9 == 0 else 0.4)).tolist()) for i in range(160)]
    rows += [(200 + i, [0.5] * 6) for i in range(70)] + [(8, rows[8][1])] * 3  # ties, repeated rows
    rows += [(300, None), (304, [1.0, None, 0.0]), (308, [float("nan")] * 6), (312, [float("inf")] * 6), (None, [1.0] * 6), (316, []), (320, [1.0, 2.0])]
    check(spark, rows)


def test_top_k_small(spark):
    check(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5])])
    check(spark, [(0, [1.0, 0.0])])
    check(spark, [(1, [1.0, 0.0])])


def test_groups_prune_clustered_vectors(spark, monkeypatch):
    """Several groups, several blocks to each, and candidates that are left out of some: the result stays exact."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 6)) * 30
    rows = [(i, (centres[i % 8] + rng.normal(size=6) * 0.2).tolist()) for i in range(640)]
    for name, value in (("PER_PIVOT", 20), ("SENT", 1.0), ("QUERY_BLOCK", 16), ("CANDIDATE_BLOCK", 50), ("REMEMBERED", 10)):
        monkeypatch.setattr(voronoi, name, value)
    seen = []
    plain = voronoi.group_costs
    monkeypatch.setattr(voronoi, "group_costs", lambda *a, **b: seen.append(plain(*a, **b)) or seen[-1])
    check(spark, rows)
    groups = voronoi._choose(seen[0])
    share = dict((g, s) for g, s, _ in seen[0])
    assert groups > 1 and share[groups] < 0.8 and share[1] == 1.0


def test_large_components(spark):
    """Sums that float64 can't hold, and such as 64 bits can't."""
    for top in (2.0**24, 2.0**30, 2.0**40, 2.0**55):
        check(spark, [(i, [top + 64 * i, -top, float(i % 3)]) for i in range(12)] + [(20, [1e30, -1e30, 3.0]), (24, [-top, top, 1.0])][: 2 * (top > 2.0**50)], big=True)


def naive(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, names = words(text), set(), set()
    for name, item in items:
        v = words(item)
        n = min(13, len(v))
        for i in range(max(0, len(v) - n + 1) if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == v[i : i + n]:
                    hit |= set(range(j, j + n))
                    if name is not None:
                        names.add(str(name))
    return len(w), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(w)


def test_contamination_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["a", "B", "été", "x9", "日本", "Don", "t"]
    make = lambda n: rng.choice([" ", ", ", "-\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, make(15)), (2, make(3)), (10, ""), (11, None), (2, make(20)), (None, make(14)), (3, make(40))]
    docs = [(i, make(rng.randint(0, 60))) for i in range(40)] + [(90, None), (91, ""), (92, "z " * 300 + items[0][1] + " z" * 300), (92, items[6][1])]
    benchmark = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, hits int")
    got = contaminated(spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, items string"), benchmark).collect()
    assert len(got) == len(docs)
    have = sorted((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in got)
    want = sorted((i, n, h, tuple(names), c) for (i, t) in docs for n, h, names, c in [naive(t, items)])
    assert have == want
    none = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), benchmark.limit(0)).collect()
    assert not any(r["n_hit"] or r["items"] or r["contaminated"] for r in none)


def test_offsets_point_into_the_original(spark):
    text = "Été. «Hello», WORLD! one two"
    first, last = word_bounds(text)
    assert [text[a:b].lower() for a, b in zip(first, last)] == ["été", "«hello»", "world", "one", "two"]
    assert [w.decode() for w in words_of("Été ABC")] == ["Été".replace("E", "e"), "abc"]
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = contaminated(docs, spark.createDataFrame([(5, "world one")], "item_id long, text string"), carry=()).first()
    (hit,) = r["hits"]
    assert text[hit["start_char"] : hit["end_char"]] == "WORLD! one" and r["items"] == ["5"]


def test_more_words_than_letters():
    rng = random.Random(6)
    make = lambda n: " ".join(f"w{rng.randint(0, 30)}" for _ in range(n))
    items = [(str(i), make(rng.randint(1, 20))) for i in range(12)]
    one, two = Matcher(items, 4), Matcher(items, 4, letters=5)
    assert (one.width, two.width) == (1, 2)
    for _ in range(200):
        words = words_of(make(60) + " other")
        assert one.scan(words) == two.scan(words)
