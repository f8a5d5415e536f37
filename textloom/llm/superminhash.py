"""SuperMinHash signatures of many sets at once.

Each element walks through a random permutation of the registers of its own, and brings rank j of it (plus a fraction)
to register j of the walk; a register keeps the least value. All elements take step j together, and a set is done as
soon as every register holds a value below the next rank: a later step can't lower it (early stopping).
"""

from __future__ import annotations

import numpy as np

from textloom.llm.shingles import mix, stream

_STEP = stream(0x61, 4096)
_RANK = np.uint64(48)
#: Elements that walk on together after the first step (one byte or two per register each).
BLOCK = 60_000


def _draw(elements: np.ndarray, step: int, registers: int) -> tuple[np.ndarray, np.ndarray]:
    """The step's value (rank and fraction) and the place it swaps with."""
    x = mix(elements + _STEP[step])
    value = (np.uint64(step) << _RANK) | (x >> np.uint64(16))
    y = mix(x ^ _STEP[step])
    place = np.uint64(step) + (((y >> np.uint64(32)) * np.uint64(registers - step)) >> np.uint64(32))
    return value, place.astype(np.int64)


def signatures(sets: list[np.ndarray], registers: int) -> np.ndarray:
    """One row per set, none of them empty; the share of equal registers of two rows estimates the Jaccard similarity."""
    n = len(sets)
    out = np.full((n, registers), np.iinfo(np.uint64).max, dtype=np.uint64)
    if not n:
        return out
    flat = out.reshape(-1)
    sizes = np.array([len(s) for s in sets])
    with np.errstate(over="ignore"):
        elements, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
        value, first = _draw(elements, 0, registers)
        np.minimum.at(flat, owner * registers + first, value)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        todo = np.flatnonzero(out.max(axis=1) >= np.uint64(1) << _RANK)
        at = 0
        while at < len(todo):
            to, held = at, 0
            while to < len(todo) and (to == at or held + sizes[todo[to]] <= BLOCK):
                held += sizes[todo[to]]
                to += 1
            rows = todo[at:to]
            pick = np.concatenate([np.arange(ends[r], ends[r + 1]) for r in rows])
            _walk(out, elements[pick], owner[pick], first[pick], rows, registers)
            at = to
    return out


def _walk(out: np.ndarray, elements: np.ndarray, owner: np.ndarray, first: np.ndarray, rows: np.ndarray, registers: int) -> None:
    """Steps 1 and on of the elements of the sets in rows."""
    flat = out.reshape(-1)
    walk = np.tile(np.arange(registers, dtype=np.uint8 if registers <= 256 else np.uint16), (len(elements), 1))
    here = np.arange(len(elements))
    walk[here, first] = 0
    walk[here, 0] = first
    for step in range(1, registers):
        value, place = _draw(elements, step, registers)
        register = walk[here, place]
        walk[here, place] = walk[here, step]
        walk[here, step] = register
        np.minimum.at(flat, owner * registers + register, value)
        open_rows = out[rows].max(axis=1) >= np.uint64(step + 1) << _RANK
        if not open_rows.any():
            return
        if open_rows.sum() <= 0.7 * len(rows):
            rows = rows[open_rows]
            keep = np.isin(owner, rows)
            elements, owner, walk = elements[keep], owner[keep], walk[keep]
            here = np.arange(len(elements))


def band_keys(rows: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per row and band; equal keys mean equal registers of that band."""
    with np.errstate(over="ignore"):
        parts = rows.reshape(len(rows), bands, -1)
        factors = stream(0x62, parts.shape[2])
        return mix((parts * factors).sum(axis=2, dtype=np.uint64) + stream(0x63, bands)).view(np.int64)
