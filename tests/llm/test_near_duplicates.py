import random
import re
from collections import defaultdict

import numpy as np

from textloom.llm.components import components
from textloom.llm.near_duplicates import link
from textloom.llm.shingles import mix, shingle_sets
from textloom.llm.superminhash import _STEP, signatures


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent):
    """Least id reachable, by id, with all pairs compared."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randint(0, 400)) for _ in range(n))
    rows = []
    for g in range(12):
        base = text(rng.randint(20, 120)).split()
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = text(1)
            rows.append(" ".join(copy))
    rows += ["one two three", "One  two\tthree", "one two", "", None, None, " \n ", rows[0].upper(), rows[0]]
    rng.shuffle(rows)
    return list(enumerate(rows, 100))


def test_against_all_pairs(spark):
    for seed, percent in ((1, 85), (2, 80)):
        rows = corpus(seed)
        got = link(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_shingles int"), percent=percent).collect()
        want = brute(rows, percent)
        assert {r["doc_id"]: r["component_id"] for r in got} == want
        assert all(r["n_shingles"] == len(shingles(dict(rows)[r["doc_id"]])) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_repeated_and_null_ids(spark):
    a, b = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(5, a), (5, b), (7, a), (9, b), (None, a), (None, None), (11, a), (11, a)]
    got = link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None) == [(5, 5), (5, 5), (7, 5), (9, 5), (11, 5), (11, 5)]
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    assert link(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_superminhash_is_the_element_wise_walk():
    """Against the textbook form: each element shuffles its own registers, one after the other."""
    m, rng = 32, np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 9, 40, 300)]
    with np.errstate(over="ignore"):
        for s, row in zip(sets, signatures(sets, m)):
            want = [2**64 - 1] * m
            for e in s:
                walk = list(range(m))
                for j in range(m):
                    x = mix(np.array([e + _STEP[j]], dtype=np.uint64))
                    y = int(mix(x ^ _STEP[j])[0])
                    k = j + (((y >> 32) * (m - j)) >> 32)
                    walk[j], walk[k] = walk[k], walk[j]
                    want[walk[j]] = min(want[walk[j]], (j << 48) | (int(x[0]) >> 16))
            assert want == row.tolist()


def test_shingle_sets_by_content():
    texts = ["A b c d e f", "a B\tc\nd  e f", "", "x", "  x ", "a b c d e f a b c d e f", "é É ß . ,"]
    got = shingle_sets([t.encode() for t in texts])
    assert [len(s) for s in got] == [len(shingles(t)) for t in texts]
    assert np.array_equal(got[0], got[1]) and np.array_equal(got[3], got[4])


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)] + [(1, 1), (None, 4)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    near = defaultdict(set)
    for u, v in edges:
        if u is not None and u != v:
            near[u].add(v)
            near[v].add(u)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert got.get(start, start) == min(seen)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
