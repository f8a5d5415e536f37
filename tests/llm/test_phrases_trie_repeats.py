"""Collocations, prefix tries and repeats on made-up rows, against plain forms."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import phrases, prefix_trie, repeats
from textloom.llm.suffix_sort import COVER, SHIFT, V, equal_prefixes

DOCS = "doc_id long, text string, lang string, rank long, phrase string, n long"


def docs(spark, rows):
    """Rows (doc_id, text, lang), beside columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 7, "x", 9) for r in rows], DOCS).repartition(3)


# --- phrases -----------------------------------------------------------------------------------------------------------


def plain_phrases(rows, max_n, least, percent, top):
    counts, total = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for n in range(1, max_n + 1):
                for i in range(len(words) - n + 1):
                    counts[lang, tuple(words[i : i + n])] += 1
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    covered = set()
    for (lang, words), f in found.items():
        for n in range(2, len(words)):
            for i in range(len(words) - n + 1):
                if 100 * f >= percent * found[lang, words[i : i + n]]:
                    covered.add((lang, words[i : i + n]))
    out = []
    for lang in total:
        scored = []
        for (own, words), a in found.items():
            if own == lang and (own, words) not in covered:
                cuts = [(1000 * a * total[lang] // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def phrase_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("bits,chunk,percent", [(1 << 26, 8 << 20, 100), (64, 300, 100), (1 << 12, 2000, 80)])
def test_phrases_against_plain_counts(spark, monkeypatch, bits, chunk, percent):
    """Also where the bitmap is full, and where texts are summed up in small pieces."""
    monkeypatch.setattr(phrases, "BITS", bits)
    monkeypatch.setattr(phrases, "CHUNK_BYTES", chunk)
    rng = random.Random(bits + percent)
    words = ["a", "A", "b", "é", "É", "z z", "naïve", "x y", "\x00", "𝄞"]
    rows = [(i % 40, rng.choice(["", " ", "\t "]).join(f"{rng.choice(words)}{rng.choice([' ', ' ', '  ', chr(9), '. ', ',', chr(10), chr(11), '?!'])}" for _ in range(rng.randrange(0, 120))), rng.choice(["en", "en", None, "und", ""])) for i in range(60)]
    rows += [(1, None, "en"), (2, "", None), (None, "a a a a a a", "en"), (3, "a b " * 3000, "en"), (3, "a b " * 3000, "en"), (4, "...!!", "de")]
    got = phrase_rows(phrases.collocations(docs(spark, rows), max_n=4, least=6, percent=percent, top=25))
    assert got == plain_phrases(rows, 4, 6, percent, 25) and len(got) > 40


def test_phrases_of_nothing(spark):
    assert phrase_rows(phrases.collocations(docs(spark, []), least=1)) == []
    assert phrase_rows(phrases.collocations(docs(spark, [(1, None, None), (2, "", "en"), (3, ". ,", "en")]), least=1)) == []


def test_scores_beyond_64_bits(spark, monkeypatch):
    """Counts whose products need more than 64 bits; the quotient is floored exactly."""
    big = 3_000_000_000_000
    table = spark.createDataFrame([("en", 1, "a", 2 * big), ("en", 1, "b", big + 1), ("en", 2, "a b", big)], "lang string, n_words int, phrase string, f long")
    monkeypatch.setattr(phrases, "counts", lambda *_: (table, spark.createDataFrame([("en", 9 * big)], "lang string, n long")))
    assert [r[0] for r in phrases.collocations(docs(spark, [])).select("score").collect()] == [1000 * big * 9 * big // (2 * big * (big + 1))]


# --- the trie ----------------------------------------------------------------------------------------------------------


def plain_trie(rows, base=None, shared=None):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [r[2:] for r in sorted(rs)] for c, rs in own.items()}
    whole = {c: (own.get(base(c), [])[: shared(c)] + turns[shared(c) :] if base else turns) for c, turns in own.items()}
    nodes = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    kids = Counter(p[:-1] for p in nodes if p)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in members if len(whole[c]) == len(p))))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids[p], sum(not kids[q] for q in below), sum((len(nodes[q]) - 1) * words(q) for q in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def node_rows(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


def turns(spark, rows):
    return spark.createDataFrame([(*r, 5, "x") for r in rows], "conv_id long, turn long, role string, text string, depth long, digest string").repartition(3)


@pytest.mark.parametrize("ids", [1, 2, 200])
def test_trie_against_plain_form(spark, monkeypatch, ids):
    monkeypatch.setattr(prefix_trie, "IDS", ids)
    rng = random.Random(ids)
    rows = []
    for c in rng.sample(range(-20, 130), 90):
        for t in rng.sample([None, *range(9)], rng.randrange(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", "", None]), rng.choice(["hi", "hi there", "a  b\tc", "", None, " x"])))
    rows += rows[:5] + [(None, 1, "user", "lost"), (500, None, None, None), (501, 1, "", "")]
    crc = lambda c: zlib.crc32(str(c).encode()) % 4
    plain = node_rows(prefix_trie.trie(turns(spark, rows)))
    assert plain == plain_trie(rows)
    # SQL's remainder keeps the sign of the id
    base = lambda c: c - int(np.fmod(c, 20))
    rebuilt = prefix_trie.trie(turns(spark, rows), base=lambda c: c - c % 20, shared=lambda c: (F.crc32(c.cast("string").cast("binary")) % 4).cast("int"), most=3)
    assert node_rows(rebuilt) == plain_trie(rows, base, crc)


def test_trie_of_nothing_and_of_one_long_path(spark):
    assert node_rows(prefix_trie.trie(turns(spark, []))) == node_rows(prefix_trie.trie(turns(spark, [(None, 0, "a", "b")]))) == []
    rows = [(c, t, "user", f"turn {t}") for c in (3, 4) for t in range(150)] + [(5, t, "user", f"turn {t}") for t in range(60)]
    got = prefix_trie.trie(turns(spark, rows))
    assert node_rows(got) == plain_trie(rows)


# --- repeats -----------------------------------------------------------------------------------------------------------


def plain_repeats(rows, length):
    seen, out = set(), []
    key = lambda r: (r[0] is None, r[0] or 0)
    for doc_id, text, _ in sorted(rows, key=key):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if data[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(data[p : p + length])
        spans = sum(1 for p in range(len(data)) if gone[p] and not (p and gone[p - 1]))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def repeat_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


@pytest.mark.parametrize("hot,chunk,block", [(4096, 1 << 20, 3 << 20), (2, 1 << 20, 3 << 20), (4, 700, 2000)])
def test_repeats_against_plain_form(spark, monkeypatch, hot, chunk, block):
    """Also with single suffixes of hot buckets, texts cut into parts, and blocks of a few buckets."""
    for name, value in (("HOT", hot), ("CHUNK_BYTES", chunk), ("BLOCK_BYTES", block)):
        monkeypatch.setattr(repeats, name, value)
    rng = random.Random(hot)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(1, 8)))
    pool = [" ".join(word() for _ in range(rng.randrange(10, 60))) for _ in range(8)]
    rows = [(i, rng.choice(["", " ", "\n"]).join(rng.choice(pool) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randrange(0, 60))) for _ in range(rng.randrange(0, 6))), "en") for i in range(90)]
    rows += [(200, "x" * 700, None), (201, "ab" * 400, None), (202, " " * 120, ""), (203, None, "en"), (204, "", "en"), (205, "y" * 99, "en"), (206, "y" * 100, "en"), (None, "y" * 100, "en")]
    rng.shuffle(rows)
    assert repeat_rows(repeats.without_repeats(docs(spark, rows), 100)) == plain_repeats(rows, 100)


def test_repeats_of_repeated_rows_and_of_nothing(spark):
    assert repeat_rows(repeats.without_repeats(docs(spark, []))) == []
    text = " ".join(f"w{i}" for i in range(60))
    got = repeat_rows(repeats.without_repeats(docs(spark, [(1, text, "en"), (1, text, "de"), (2, text, "en")])))
    whole, none = hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(b"").hexdigest()
    assert got == [(1, len(text), 0, 0, whole)] * 2 + [(2, len(text), len(text), 1, none)]
    one = repeats.without_repeats(docs(spark, [(1, text + "é" + text, "en")]))
    assert one.first()["spans"] == [[len(text) + 2, 2 * len(text) + 2]] and bytes(one.first()["kept"]).decode() == text + "é"
    # equal ids, different texts: one of the two comes first, the other loses what they share
    got = repeats.without_repeats(docs(spark, [(1, text + " a", "en"), (1, text + " b", "en")])).collect()
    assert sorted(r["n_removed"] for r in got) == [0, len(text) + 1]


def test_difference_cover():
    assert {(a - b) % V for a in COVER for b in COVER} == set(range(V))
    assert all((a + SHIFT[a, b]) % V in COVER and (b + SHIFT[a, b]) % V in COVER for a in range(V) for b in range(V))


@pytest.mark.parametrize("seed", range(25))
def test_equal_prefixes_against_a_dictionary(seed):
    rng = random.Random(seed)
    text = bytes(rng.randrange(rng.choice([1, 2, 26])) + 97 for _ in range(rng.randrange(150, 2500)))
    for _ in range(rng.randrange(5)):
        a, size, b = rng.randrange(len(text)), rng.randrange(1, 400), rng.randrange(len(text))
        text = text[:b] + text[a : a + size] + text[b:]
    length = rng.choice([36, 40, 100, 101])
    starts = rng.sample(range(len(text) - length + 1), rng.randrange(1, len(text) - length + 2))
    bucket = np.sort(np.array([rng.randrange(3) for _ in starts]))
    at, kind = equal_prefixes(np.frombuffer(text, np.uint8), np.array(starts), bucket, length)
    want, got = {}, {}
    for p, b in zip(starts, bucket.tolist()):
        want.setdefault((b, text[p : p + length]), []).append(p)
    for p, k in zip(at.tolist(), kind.tolist()):
        got.setdefault(k, []).append(p)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)
