"""Blockwise suffix sorting with a difference cover, for suffixes that are told apart by their first bytes.

Suffixes are sorted one bucket at a time by their first V bytes. Those that agree there are told apart by ranks of a
sample: positions whose residue mod V lies in a difference cover D. For any two positions there is a shift below V that
takes both into the sample, and there the ranks decide. The sample is ranked once per block by its first V bytes, then
by doubling: the position V further has the same residue, so it is in the sample too. However long the common prefixes
are, a block takes memory in proportion to its bytes, and no suffix is compared byte by byte beyond V.
"""

from __future__ import annotations

import numpy as np

#: A perfect difference set: each difference mod 31 but 0 occurs once.
V = 31
COVER = (1, 5, 11, 24, 25, 27)
#: Bytes that are taken into a sort key at a time, beside 24 bits of group.
STEP = 5


def _shifts() -> np.ndarray:
    inside = np.isin(np.arange(V), COVER)
    out = np.empty((V, V), np.int64)
    for a in range(V):
        for b in range(V):
            out[a, b] = next(s for s in range(V) if inside[(a + s) % V] and inside[(b + s) % V])
    return out


SHIFT = _shifts()
#: From a residue to its place in the cover, -1 outside.
_PLACE = np.full(V, -1, np.int64)
_PLACE[list(COVER)] = np.arange(len(COVER))


def words(text: np.ndarray, more: int) -> np.ndarray:
    """For each position of the text, and more positions of zeros behind it, the next 8 bytes as a big-endian number."""
    padded = np.zeros(len(text) + more + 16, np.uint8)
    padded[: len(text)] = text
    n = len(text) + more
    out = np.empty(n + 8, np.uint64)
    for s in range(8):
        part = padded[s : s + (n + 8 - s) // 8 * 8].view(">u8")
        out[s : s + 8 * len(part) : 8] = part
    return out[:n]


def groups(keys: np.ndarray) -> np.ndarray:
    """Numbers from 0 for runs of equal values."""
    new = np.empty(len(keys), np.int64)
    if len(keys):
        new[0] = 0
        np.cumsum(keys[1:] != keys[:-1], out=new[1:])
    return new


def several(group: np.ndarray) -> np.ndarray:
    """Which members of runs are not alone in theirs."""
    same = group[1:] == group[:-1]
    out = np.zeros(len(group), dtype=bool)
    out[1:] |= same
    out[:-1] |= same
    return out


def _refined(at: np.ndarray, group: np.ndarray, word: np.ndarray, depth: int, keep: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions, in order of their groups, sorted within those by the next depth bytes; groups are parted where these
    differ. keep: single ones stay, else they are left out. Up to 2^24 groups."""
    for d in range(0, depth, STEP):
        many = several(group)
        if not keep:
            at, group, many = at[many], group[many], slice(None)
            group = groups(group)
        some, own = at[many], group[many]
        if not len(some):
            break
        key = (groups(own).astype(np.uint64) << np.uint64(8 * STEP)) | (word[some + d] >> np.uint64(64 - 8 * STEP))
        order = np.argsort(key)
        key = key[order]
        if keep:
            at[many] = some[order]
            part = np.zeros(len(at), np.int64)
            part[many] = np.concatenate([[0], key[1:] != key[:-1]]) & np.concatenate([[0], own[1:] == own[:-1]])
            new = np.concatenate([[0], group[1:] != group[:-1]]) | part
            group = np.cumsum(new)
        else:
            at, group = some[order], groups(key)
    if not keep:
        many = several(group)
        at, group = at[many], groups(group[many])
    return at, group


class Sample:
    """Ranks of the suffixes at the cover's residues, by their first depth bytes at least."""

    def __init__(self, word: np.ndarray, n: int, depth: int):
        self.rows = n // V + 2
        rank = np.zeros((self.rows, len(COVER)), np.int64)
        at = np.sort(np.concatenate([np.arange(d, n, V) for d in COVER]))
        where = at // V * len(COVER) + _PLACE[at % V]
        order, group = _refined(at.copy(), np.zeros(len(at), np.int64), word, V, keep=True)
        flat = rank.reshape(-1)
        flat[order // V * len(COVER) + _PLACE[order % V]] = group + 1  # 0 is the end of the text
        covered = 1
        while covered * V < depth:
            further = where + covered * len(COVER)
            second = np.where(further < len(flat), flat[np.minimum(further, len(flat) - 1)], 0)
            key = flat[where] * (len(at) + 2) + second
            order = np.argsort(key)
            flat[where[order]] = groups(key[order]) + 1
            covered *= 2
        self.flat = flat

    def of(self, at: np.ndarray) -> np.ndarray:
        return self.flat[at // V * len(COVER) + _PLACE[at % V]]


def _told_apart(at: np.ndarray, group: np.ndarray, sample: Sample) -> np.ndarray:
    """The order of positions whose groups agree in their first V bytes, by the sample's ranks: all groups are parted at
    once around a pivot of each, until every member has met a pivot as its equal."""
    order, level = np.arange(len(at)), group.copy()
    open_ = np.arange(len(at))
    while len(open_):
        own = level[open_]
        run = groups(own)
        first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        size = np.diff(np.append(first, len(run)))
        pivot = at[order[open_[first + size // 2]]][run]
        mine = at[order[open_]]
        shift = SHIFT[mine % V, pivot % V]
        side = np.sign(sample.of(mine + shift) - sample.of(pivot + shift)) + 1
        key = run * 3 + side
        by = np.argsort(key, kind="stable")
        order[open_] = order[open_][by]
        key = key[by]
        level[open_] = key  # numbers of groups need only differ between neighbours that are open
        rest = (key % 3 != 1) & several(groups(key))
        open_, level = open_[rest], level
    return order


def equal_prefixes(text: np.ndarray, starts: np.ndarray, bucket: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts whose first length bytes occur at another start of the same bucket, and numbers of the classes that are
    equal in them. bucket: ascending, suffixes of other buckets are not compared; length: 36 at least (V and what the last step of STEP bytes takes beyond it)."""
    word = words(text, 2 * length + 2 * V)
    at, group = _refined(starts, groups(bucket), word, -(-V // STEP) * STEP, keep=False)
    if not len(at):
        return at, group
    sample = Sample(word, len(text) + length + V, length)
    order = _told_apart(at, group, sample)
    at, group = at[order], group[order]
    same = group[1:] == group[:-1]
    pair = np.flatnonzero(same)
    for d in [*range(0, length - 8, 8), length - 8]:  # neighbours in the order: all their bytes, once
        pair = pair[word[at[pair] + d] == word[at[pair + 1] + d]]
    joined = np.zeros(len(at), dtype=bool)
    joined[pair + 1] = True
    kind = np.cumsum(~joined)
    many = several(kind)
    return at[many], kind[many]
