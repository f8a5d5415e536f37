"""Word shingles of many texts at once, as sorted arrays of distinct 64-bit hashes."""

from __future__ import annotations

import functools
import hashlib

import numpy as np

#: Bytes that are hashed at a time.
SEGMENT_BITS = 18
SEGMENT = 1 << SEGMENT_BITS
_WHITE = (9, 10, 11, 12, 13, 32)
#: A-Z to a-z, white space to a space, all else to itself.
FOLD = bytes(32 if b in _WHITE else b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15


def mix(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit constants."""
    with np.errstate(over="ignore"):
        return mix(np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.multiply.accumulate(p))
    return out[0], out[1]


_BYTE = stream(0x51, 256)
_PLACE = stream(0x52, 64)


def span_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, which depends on its bytes alone. Spans are in order and don't overlap."""
    out = np.empty(len(first), np.uint64)
    done = 0
    with np.errstate(over="ignore"):
        while done < len(first):
            base = int(first[done])
            to = max(done + 1, int(np.searchsorted(last, base + SEGMENT, side="right")))
            a, b = first[done:to] - base, last[done:to] - base
            part = data[base : base + int(b[-1])]
            power, inverse = _powers(1 << max(SEGMENT_BITS, len(part).bit_length()))
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(_BYTE[part] * power[: len(part)], out=sums[1:])
            out[done:to] = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))
            done = to
    return out


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and first byte of each word of folded bytes."""
    part = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(part) + 2, dtype=bool)
    np.not_equal(part, 32, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return span_hashes(part, edges[0::2], edges[1::2]), edges[0::2]


def shingle_sets(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """For each UTF-8 text the sorted distinct hashes of its runs of so many consecutive words; a shorter text, but not
    an empty one, has one for all its words. Words are split at ASCII white space, A-Z count as a-z."""
    if not texts:
        return []
    with np.errstate(over="ignore"):
        joined = b" ".join(texts).translate(FOLD)
        hashes, starts = word_hashes(joined)
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
        cut = np.searchsorted(starts, bounds)
        runs = np.empty(0, np.uint64)
        if len(hashes) >= words:
            n = len(hashes) - words + 1
            runs = np.zeros(n, dtype=np.uint64)
            for k in range(words):
                runs += hashes[k : k + n] * _PLACE[k]
            runs = mix(runs)
        out = []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if b - a >= words:
                one = np.sort(runs[a : b - words + 1])
                out.append(one[np.concatenate([[True], one[1:] != one[:-1]])])
            elif b > a:
                whole = (hashes[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a) * _PLACE[63]
                out.append(mix(np.array([whole], dtype=np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
        return out


def digest(one: np.ndarray) -> bytes:
    return hashlib.blake2b(one.tobytes(), digest_size=16).digest()


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
