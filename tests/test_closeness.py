"""Longest common runs and matching ratios of whole texts, against difflib."""

import random
from difflib import SequenceMatcher

from textloom.operators.closeness import closeness, matched


def plain(a, b):
    m = SequenceMatcher(None, a, b, autojunk=False)
    return m.find_longest_match().size, sum(x.size for x in m.get_matching_blocks())


def test_matching_runs_against_difflib():
    rng = random.Random(1)
    for _ in range(600):
        letters = "ab"[: rng.randint(1, 2)] if rng.random() < 0.3 else "abcdefgh"
        a, b = ([rng.choice(letters) for _ in range(rng.randrange(0, 40))] for _ in range(2))
        if rng.random() < 0.5 and b:
            at = rng.randrange(len(b))
            b[at:at] = a[rng.randrange(len(a) + 1) :]
        assert matched(a, b) == plain(a, b), (a, b)


def test_pairs_of_whole_texts(spark):
    rng = random.Random(2)
    query = [f"w{i % 90}" for i in range(300)]
    far = [f"x{rng.randrange(50)}" for _ in range(5000)] + query[130:290] + ["w1", "w2", "z"]  # beyond any prefix
    texts = [(1, far), (2, query), (3, []), (4, None), (5, ["w5", "w6"] * 40)]
    queries = [(7, query), (8, []), (9, None)]
    schema = "id long, tokens array<string>"
    pairs = [(q, t) for q, _ in queries for t, _ in texts]
    got = {(r["query_id"], r["chunk_id"]): (r["run"], r["ratio"]) for r in closeness(spark.createDataFrame(pairs, "query_id long, chunk_id long"), spark.createDataFrame(queries, schema), spark.createDataFrame(texts, schema)).collect()}
    want = {}
    for q, a in queries:
        for t, b in texts:
            run, total = plain(a or [], b or [])
            want[q, t] = (run, 2.0 * total / (len(a or []) + len(b or [])) if a or b else 1.0)
    assert got == want and got[7, 1][0] == 160
