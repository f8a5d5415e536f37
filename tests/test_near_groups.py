"""The greedy pass over near copies: chains, clusters, and the graphs below it, against plain passes."""

import random

import pytest

from pyspark.sql import functions as F

from textloom.operators import dedup, graphs
from tests.test_whole_results import near, near_by_brute_force


def window(i, size=24):
    return " ".join(f"token{j}" for j in range(i, i + size))


@pytest.mark.parametrize("pairs", [0, 12])
def test_chain_of_a_thousand(spark, monkeypatch, pairs):
    """Each text is near to its neighbours only; ids in order of the chain: every second one goes."""
    monkeypatch.setattr(dedup, "PAIRS", pairs)
    monkeypatch.setattr(dedup, "ROUNDS", 3)
    got = near(spark, [(i, "x", window(i)) for i in range(1000)])
    assert got == {i: "near" if i % 2 else None for i in range(1000)}


@pytest.mark.parametrize("pairs", [0, 12])
def test_clusters_and_shuffled_chains(spark, monkeypatch, pairs):
    """Groups of near copies, chains in any order of ids, copies of both, in two scopes."""
    monkeypatch.setattr(dedup, "PAIRS", pairs)
    rng = random.Random(3)
    texts = [window(i) for i in rng.sample(range(120), 90)]
    for g in range(3):
        base = [f"g{g}t{j}" for j in range(60)]
        for _ in range(25):
            copy = list(base)
            copy[rng.randrange(60)] = f"edit{rng.randrange(5)}"
            texts.append(" ".join(copy) + rng.choice(["", "", " ERROR 1064", " ERROR 1146"]))
    texts += rng.sample(texts, 15)
    rng.shuffle(texts)
    rows = [(i, rng.choice("xxy"), t) for i, t in enumerate(texts)]
    assert near(spark, rows) == near_by_brute_force(spark, rows)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (None, 3)]
    parent = {x: x for e in edges if None not in e for x in e}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


@pytest.mark.parametrize("local", [0, 1_000_000])
def test_pass_in_order(spark, monkeypatch, local):
    monkeypatch.setattr(graphs, "LOCAL_NODES", local)
    rng = random.Random(6)
    edges = {tuple(sorted(rng.sample(range(80), 2))) for _ in range(70)}
    gone = set()
    for b in range(80):
        if any((a, b) in edges and a not in gone for a in range(b)):
            gone.add(b)
    assert {r[0] for r in graphs.dropped_in_order(spark.createDataFrame(sorted(edges), "a long, b long")).collect()} == gone
    assert graphs.dropped_in_order(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similar_pairs_meet_at_their_rarest_tokens(spark, monkeypatch):
    """Tokens of many sets come last in a prefix: sets of 12 common tokens and 8 rare ones are no candidates of each other, and
    sets that travel once to each deal, in small blocks too, give what all pairs give."""
    rng = random.Random(3)
    common = [f"c{i}" for i in range(16)]
    sets = [(i, rng.sample(common, 12) + [f"r{i}-{k}" for k in range(8)]) for i in range(300)]
    sets += [(1000 + i, [*sets[7][1][:19], f"n{i}"]) for i in range(40)] + [(2000, []), (2001, sets[3][1][::-1])]
    hashed = spark.createDataFrame(sets, "node long, items array<string>").select("node", F.transform("items", lambda x: F.xxhash64(x)).alias("h"))
    tokens = dedup._rarest_first(hashed, [], 82)
    met = tokens.groupBy("t").count().filter("count > 45")
    assert met.count() == 0  # else every common token is met by most of the 300 sets
    monkeypatch.setattr(dedup, "BLOCK", 8)
    pairs, members = dedup.similar_pairs(spark.createDataFrame(sets, "id long, items array<string>"), 82)
    got = {(r["a"], r["b"]): (r["common"], r["size_a"], r["size_b"]) for r in pairs.collect()}
    known = {i: set(x) for i, x in sets if x and i != 2001}
    want = {(a, b): (len(known[a] & known[b]), 20, 20) for a in known for b in known if a < b and 100 * len(known[a] & known[b]) >= 82 * len(known[a] | known[b])}
    assert got == want and len(want) == 40 * 41 // 2
    assert dict(members.filter("id >= 2000").collect()) == {2000: 2000, 2001: 3}


@pytest.mark.parametrize("meet", [8, 2048])
def test_only_likely_pairs_leave_the_tasks(spark, monkeypatch, meet):
    """Sets of few common tokens meet by the thousand; candidates are those that are similar, or nearly so. Sets of all sizes, in
    two scopes; frequent tokens in blocks too."""
    rng = random.Random(8)
    sets = [(i, rng.choice("xxy"), [str(x) for x in rng.sample(range(90), rng.randint(30, 50))]) for i in range(300)]
    for i in range(300, 400):
        base, size = rng.choice(sets[:4]), rng.choice([3, 40, 300, 700])
        sets.append((i, base[1], ([*base[2], *(f"more{k}" for k in range(700))])[: size - rng.randint(0, size // 12)] + [f"{i}-{k}" for k in range(rng.randint(0, size // 12))]))
    rows = {}

    def noted(df, name, put=dedup.written):
        out = put(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(dedup, "written", noted)
    monkeypatch.setattr(dedup, "MEET", meet, raising=False)
    pairs, members = dedup.similar_pairs(spark.createDataFrame(sets, "id long, lang string, items array<string>"), 82, ["lang"])
    node, known = dict(members.collect()), {}
    for i, lang, x in sets:
        known.setdefault((lang, frozenset(x)), i)
    assert node == {i: known[lang, frozenset(x)] for i, lang, x in sets}
    want = {(a, b, len(x & y), len(x), len(y)) for (s, x), a in known.items() for (t, y), b in known.items() if a < b and s == t and 100 * len(x & y) >= 82 * len(x | y)}
    assert sorted(map(tuple, pairs.collect())) == sorted(want) and len(want) > 300
    assert rows["candidates"] < 2 * len(want)


def test_near_copies_are_named_once_a_run(spark):
    """Copies with an edit each share most of their 37 prefix tokens, but a pair isn't named at each of them."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    sets = []
    for i in range(60):
        at = rng.randrange(200)
        sets.append((i, [*base[:at], f"e{i}", *base[at + 1 :]]))
    hashed = spark.createDataFrame(sets, "node long, items array<string>").select("node", F.transform("items", lambda x: F.xxhash64(x)).alias("h"))
    got = [tuple(r) for r in dedup._met(hashed, [], 82).collect()]
    assert set(got) == {(a, b) for a in range(60) for b in range(a + 1, 60)}
    assert len(got) < 4 * len(set(got))
