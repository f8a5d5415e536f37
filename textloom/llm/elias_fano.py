"""Elias-Fano sequences with vectorised successor search, over arrays that may be memory-mapped."""

from __future__ import annotations

import numpy as np

BLOCK = 16  # bytes of upper bits to an entry of the directory
_NTH_ZERO = np.array([[([i for i in range(8) if not b >> i & 1] + [0] * 8)[k] for k in range(8)] for b in range(256)], dtype=np.uint8)


class EliasFano:
    """Strictly ascending unsigned 64-bit values. Of each value the lowest bits are stored as they are; the rest are the
    sequence's monotone pointers: a run of ones per upper part, ended by a zero. Parts: low, upper, zeros."""

    def __init__(self, n: int, bits: int, low: np.ndarray, upper: np.ndarray, zeros: np.ndarray):
        self.n, self.bits, self.low, self.upper, self.zeros = n, bits, low, upper.reshape(-1, BLOCK), zeros
        self.words = np.ndarray((max(0, low.nbytes - 7),), "<u8", low, strides=(1,)) if n else None
        self.flags = np.ndarray((max(0, upper.nbytes - 7),), "<u8", upper, strides=(1,)) if n else None
        self.mask = np.uint64((1 << bits) - 1)
        self.parts = int(self.upper.shape[0]) * BLOCK * 8 - n  # zeros stored

    @staticmethod
    def build(values: np.ndarray) -> tuple[dict[str, np.ndarray], dict]:
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = min(56, max(1, (top // max(n, 1)).bit_length() - 1)) if n else 1
        at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
        low = np.zeros(n * bits // 64 + 3, dtype=np.uint64)
        part = values & np.uint64((1 << bits) - 1)
        word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.add.at(low, word, part << off)
        over = off + np.uint64(bits) > np.uint64(64)
        np.add.at(low, word[over] + 1, part[over] >> (np.uint64(64) - off[over]))
        size = (top >> bits) + n + 1
        flags = np.zeros(-(-size // (BLOCK * 8)) * BLOCK * 8, dtype=bool)
        flags[(values >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = True
        upper = np.packbits(flags, bitorder="little")
        ones = np.bitwise_count(upper).reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
        zeros = np.cumsum(BLOCK * 8 - ones) - (BLOCK * 8 - ones)
        return {"low": low, "upper": upper, "zeros": zeros.astype(np.uint32 if size < 1 << 32 else np.uint64)}, {"n": n, "bits": bits}

    def _low(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.bits
        return (self.words[bit >> 3] >> (bit & 7).astype(np.uint64)) & self.mask

    def _before_zero(self, k: np.ndarray) -> np.ndarray:
        """How many values come before the k-th zero (from 0)."""
        block = np.searchsorted(self.zeros, k.astype(self.zeros.dtype), side="right") - 1
        rest = k - self.zeros[block].astype(np.int64)
        rows = self.upper[block]
        free = np.cumsum(8 - np.bitwise_count(rows), axis=1, dtype=np.int16)
        byte = (free <= rest[:, None]).sum(axis=1)
        here = np.arange(len(k))
        rest = rest - np.where(byte > 0, free[here, np.maximum(byte - 1, 0)], 0)
        return block * (BLOCK * 8) + byte * 8 + _NTH_ZERO[rows[here, byte], rest] - k

    def _run(self, part: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Where the runs end that start with these values: how many ones follow the zero before them."""
        bit = start + part  # of the run's first one, or of the zero that ends it
        byte = bit >> 3
        near = byte <= self.upper.size - 8
        end = start.copy()
        word = ~(self.flags[byte[near]] >> (bit[near] & 7).astype(np.uint64))
        ones = np.bitwise_count((word & (~word + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        end[near] += ones
        far = ~near
        far[near] = ones >= 56  # the run may go on beyond the word
        if far.any():
            end[far] = self._before_zero(part[far])
        return end

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it isn't there: the successor search starts in the keys' own run. Keys are looked
        up in their order, so that what lies close is read together."""
        out = np.full(len(keys), -1, dtype=np.int64)
        if not self.n or not len(keys):
            return out
        todo = np.argsort(keys)
        part = (keys[todo] >> np.uint64(self.bits)).astype(np.int64)
        inside = part < self.parts
        todo, part = todo[inside], part[inside]
        want = keys[todo] & self.mask
        start = np.zeros(len(part), dtype=np.int64)
        later = part > 0
        start[later] = self._before_zero(part[later] - 1)
        with np.errstate(over="ignore"):
            end = self._run(part, start)
        some = start < end
        todo, want, lo, hi = todo[some], want[some], start[some], end[some]
        last = hi.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        inside = lo < last
        todo, want, lo = todo[inside], want[inside], lo[inside]
        same = self._low(lo) == want
        out[todo[same]] = lo[same]
        return out
