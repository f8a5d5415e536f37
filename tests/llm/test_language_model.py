import math
import re
from collections import Counter

import numpy as np

from textloom.llm import language_model as lm
from textloom.llm.elias_fano import EliasFano


def test_elias_fano_finds_what_is_there():
    rng = np.random.default_rng(0)
    for top, n in ((10, 5), (1000, 900), (2**40, 5000), (2**60, 300), (5, 5), (1, 1)):
        values = np.unique(rng.integers(0, top, n).astype(np.uint64))
        arrays, meta = EliasFano.build(values)
        ef = EliasFano(meta["n"], meta["bits"], arrays["low"], arrays["upper"], arrays["zeros"])
        assert np.array_equal(ef.find(values), np.arange(len(values)))
        others = rng.integers(0, 2 * top + 2, 500).astype(np.uint64)
        want = [int(np.searchsorted(values, x)) if x in values else -1 for x in others]
        assert ef.find(others).tolist() == want
    for gap in (1, 2, 1 << 40):  # runs of one upper part that are longer than a word, at either end and alone
        values = np.unique(np.concatenate([np.arange(300, dtype=np.uint64), gap * 1000 + np.arange(500, dtype=np.uint64) * gap, 2**61 + np.arange(130, dtype=np.uint64)]))
        arrays, meta = EliasFano.build(values)
        ef = EliasFano(meta["n"], meta["bits"], arrays["low"], arrays["upper"], arrays["zeros"])
        keys = rng.permutation(np.concatenate([values, values + np.uint64(1)]))
        place = np.minimum(np.searchsorted(values, keys), len(values) - 1)
        assert np.array_equal(ef.find(keys), np.where(values[place] == keys, place, -1))
    arrays, meta = EliasFano.build(np.empty(0, np.uint64))
    assert EliasFano(0, meta["bits"], arrays["low"], arrays["upper"], arrays["zeros"]).find(np.array([0, 5], np.uint64)).tolist() == [-1, -1]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


TRAIN = ["The cat sat on the mat", "the cat ran", "a dog sat\ton THE mat", "", None, "the the the", "the cat sat on the mat"]


def model_of(texts):
    rows = [words(t) + [None] for t in texts]
    c1, c2, c3 = Counter(), Counter(), Counter()
    for t in rows:
        s = [0, *t]
        c1.update(t)
        c2.update(zip(s, s[1:]))
        c3.update(zip(s, s[1:], s[2:]))
    n, v, k = sum(c1.values()), len(c1), len(rows)
    f1, f2 = Counter(a for a, _ in c2), Counter((a, b) for a, b, _ in c3)

    def p(z, a, b):
        p1 = (c1[b] + 0.5) / (n + 0.5 * (v + 1))
        m = lm.LEFT * f1[a]
        p2 = (c2[a, b] + m * p1) / ((k if a == 0 else c1[a]) + m) if m else p1
        m = lm.LEFT * f2[z, a]
        return p1, (c3[z, a, b] + m * p2) / (c2[z, a] + m) if m else p2

    return p, c1


def test_scores_against_plain_counting(spark):
    docs = [(i, t) for i, t in enumerate([*TRAIN, "the cat sat on a dog", "unseen words only", "the dog ran on the cat"])]
    trained = lm.train(spark.createDataFrame([(t,) for t in TRAIN], "text string"))
    p, c1 = model_of(TRAIN)
    for r in lm.score(spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, score string"), trained).collect():
        s = [None, 0, *words(docs[r["doc_id"]][1]), None]
        both = [p(("none",) if i == 0 else s[i], s[i + 1], s[i + 2]) for i in range(len(s) - 2)]
        assert r["n_tokens"] == len(both) and r["n_known"] == sum(c1[w] > 0 for w in s[2:])
        assert math.isclose(r["base_score"], sum(math.log10(x) for x, _ in both), abs_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(x) for _, x in both), abs_tol=3e-4 * len(both))


def test_probabilities_sum_to_one():
    p, c1 = model_of(TRAIN)
    for z, a in ((0, "the"), ("the", "cat"), ("sat", "on"), ("no", "dog"), ("no", "no"), ("x", 0)):
        assert math.isclose(sum(p(z, a, w)[1] for w in [*c1, "<unknown>"]), 1.0, abs_tol=1e-9)


def test_no_training_rows(spark):
    trained = lm.train(spark.createDataFrame([], "text string"))
    r = lm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), trained).first()
    assert r["n_tokens"] == 3 and r["n_known"] == 0 and r["score"] == r["base_score"]
    assert lm.score(spark.createDataFrame([], "doc_id long, text string"), trained).count() == 0


def test_quantising():
    x = np.array([1.0, 0.5, 1e-3, 1e-11])
    assert np.allclose(lm.restored(lm.quantise(np.log10(x))), x, rtol=3e-4)
    assert np.allclose(lm.restored_count(lm.quantise_count(np.array([1, 2, 1000, 10**11]))), [1, 2, 1000, 10**11], rtol=3e-4)
