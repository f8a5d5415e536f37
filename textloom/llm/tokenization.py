"""Whole-text encoding with the tokenizers library, each distinct piece of text encoded once.

Neither of the two vocabularies that are known here joins text over a single space between two visible characters, so a
text can be cut there, its pieces encoded one by one, and the ids joined. Pieces repeat much more than texts: a table of
bounded size keeps the ids of each by its 64-bit hash, and all pieces of a batch are looked up at once. A text with any
other run of white space next to a cut is handed to the library whole, and so is every text where the vocabulary is
another one.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

from textloom.llm.shingles import mix, span_hashes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Slots of a process's table, half of which are used at most (16 bytes each, and about 14 for an entry's ids).
SLOTS = 1 << 21
#: Parts of pieces that are no plain word, kept in a dictionary (about 200 bytes each).
FRAGMENTS = 50_000
#: Latin letters, then perhaps other visible ASCII signs but no digit or apostrophe: one word or two in both vocabularies.
#: These letters are their own NFC form, and lower() maps each of them alone.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-įıĲ-ſ]+)([!-&(-/:-@\[-`{-~]*)")
# SHA-256 of the vocabulary files whose texts may be cut at spaces; all others are encoded whole.
CUT_AT_SPACES = {
    "cec27cb89f428497695f4e2a90118d636a594654897a44c0fb11b8f185521820",
    "53fa9d558ea625daafcd57cd61e7be7b3c7043ea584b22d09575cf5ea9131b0a",
}
_FIRST = np.uint64(0x6A09E667F3BCC909)
_IRREGULAR = -1


def _byte_letters() -> dict[int, str]:
    """Byte to letter, as byte-level vocabularies spell bytes: visible ones as themselves, others from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTER_OF = _byte_letters()


def _spelled(word: str) -> str:
    return word if word.isascii() else word.encode().decode("latin-1").translate(_LETTER_OF)


class _Table:
    """Keys to runs of ids: open addressing over arrays, so that an entry takes tens of bytes. It doubles up to SLOTS and
    is emptied when half of those are taken."""

    def __init__(self) -> None:
        self.clear()

    def clear(self, slots: int = 1 << 14) -> None:
        self.keys, self.start, self.size = np.zeros(slots, np.uint64), np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self.used, self.pool, self.filled = 0, np.empty(1 << 16, np.uint32), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot, -1 where it isn't there."""
        out, todo, mask = np.full(len(keys), -1, np.int64), np.arange(len(keys)), np.uint64(len(self.keys) - 1)
        at = (keys & mask).astype(np.int64)
        while len(todo):
            here = self.keys[at]
            same = here == keys
            out[todo[same]] = at[same]
            on = ~same & (here != 0)
            todo, keys, at = todo[on], keys[on], (at[on] + 1) & int(mask)
        return out

    def _place(self, keys: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Distinct keys that aren't there yet."""
        mask = np.uint64(len(self.keys) - 1)
        at = (keys & mask).astype(np.int64)
        while len(keys):
            free = np.flatnonzero(self.keys[at] == 0)
            _, one = np.unique(at[free], return_index=True)
            won = free[one]
            self.keys[at[won]], self.start[at[won]], self.size[at[won]] = keys[won], start[won], size[won]
            rest = np.ones(len(keys), bool)
            rest[won] = False
            keys, start, size, at = keys[rest], start[rest], size[rest], (at[rest] + 1) & int(mask)

    def add(self, keys: np.ndarray, runs: list[list[int] | None]) -> None:
        """Distinct new keys with their ids; None marks an irregular piece."""
        size = np.array([_IRREGULAR if r is None else len(r) for r in runs], np.int32)
        length = np.maximum(size, 0)
        start = self.filled + np.cumsum(length) - length
        total = int(length.sum())
        if self.filled + total > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.filled], np.empty(max(total, self.filled // 2), np.uint32)])
        self.pool[self.filled : self.filled + total] = np.fromiter(chain.from_iterable(filter(None, runs)), np.uint32, total)
        self.filled += total
        self.used += len(keys)
        if 2 * self.used > len(self.keys):
            old = np.flatnonzero(self.keys)
            held = self.keys[old], self.start[old], self.size[old]
            slots = 1 << max(14, (2 * self.used).bit_length())
            self.keys, self.start, self.size = np.zeros(slots, np.uint64), np.zeros(slots, np.int32), np.zeros(slots, np.int32)
            self._place(*held)
        self._place(keys, start.astype(np.int32), size)

    def trim(self) -> None:
        if 2 * self.used > SLOTS or self.filled > 2 * SLOTS:
            self.clear()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, and where each value starts and the last one ends."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bounds = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8, int(bounds[-1])) if bounds[-1] else np.empty(0, np.uint8)
    return data[bounds[0] :], bounds - bounds[0]


class Encoder:
    """encode(column) gives the ids of all texts, one after another, and where each text's start (and the last ends)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, "rb") as f:
            self.cuts = hashlib.sha256(f.read()).hexdigest() in CUT_AT_SPACES
        if not self.cuts:
            return
        self.drops_space = self.tokenizer.normalizer is not None  # white space is no token and ends every word
        self.model, self.split = self.tokenizer.model, self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = os.path.commonprefix(self.special)
        self.table, self.fragments = _Table(), {}

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _word(self, spelled: str) -> list[int]:
        return [t.id for t in self.model.tokenize(spelled)]

    def _fragment(self, spelled: str) -> list[int]:
        if spelled not in self.fragments:
            if len(self.fragments) >= FRAGMENTS:
                self.fragments.clear()
            self.fragments[spelled] = self._word(spelled)
        return self.fragments[spelled]

    def _piece(self, piece: str) -> list[int] | None:
        """A piece between two spaces; it stands for itself after one space, where the vocabulary keeps that. None if it
        starts or ends with white space, or has nothing in it: the text can't be cut there."""
        plain = _PLAIN.fullmatch(piece)
        if plain and self.mark not in plain[2]:
            word = _spelled(plain[1].lower()) if self.drops_space else "\u0120" + _spelled(plain[1])
            return self._fragment(word) + self._fragment(plain[2]) if plain[2] else self.fragments.get(word) or self._word(word)
        if not self.drops_space and (not piece or piece[0].isspace() or piece[-1].isspace()):
            return None
        text = piece if self.drops_space else " " + piece
        if self.mark in piece and any(x in piece for x in self.special):
            return self.whole(text)
        if self.drops_space:
            text = self.tokenizer.normalizer.normalize_str(text)
        return [i for word, _ in self.split(text) for i in self._fragment(word)] if text else []

    def _first(self, piece: str) -> list[int] | None:
        """The first piece of a text that has others."""
        return None if not piece or piece[-1].isspace() else self.whole(piece)

    def _resolve(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each piece where its ids start in the pool and how many they are, the pool, and each text's first piece."""
        data, bounds = utf8(column)
        spaces = np.flatnonzero(data == 32)
        at = np.searchsorted(spaces, bounds[:-1]) + np.arange(len(column))
        n = np.diff(np.append(at, len(spaces) + len(column)))
        starts, ends = np.sort(np.concatenate([bounds[:-1], spaces + 1]), kind="stable"), np.sort(np.concatenate([spaces, bounds[1:]]), kind="stable")
        keys = span_hashes(data, starts, ends)
        lone = np.zeros(len(column), bool)
        if not self.drops_space:
            with np.errstate(over="ignore"):
                keys[at] = mix(keys[at] ^ _FIRST)
            lone = n == 1
        keys[keys == 0] = 1
        slot = self.table.find(keys)
        missing = np.flatnonzero((slot < 0) & ~np.repeat(lone, n))
        if len(missing):
            new, one = np.unique(keys[missing], return_index=True)
            which = missing[one]
            first = np.zeros(len(keys), bool)
            first[at] = not self.drops_space
            raw = data.tobytes()
            made = [(self._first if f else self._piece)(raw[a:b].decode()) for a, b, f in zip(starts[which].tolist(), ends[which].tolist(), first[which].tolist())]
            self.table.add(new, made)
            slot = self.table.find(keys)
        start, size = self.table.start[slot], np.where(slot < 0, 0, self.table.size[slot])
        bad = lone.copy()
        bad[np.repeat(np.arange(len(column)), n)[size == _IRREGULAR]] = True
        pool = self.table.pool[: self.table.filled]
        if bad.any():
            odd = np.flatnonzero(bad)
            runs = [self.whole(column[int(i)].as_py()) for i in odd]
            size[np.repeat(bad, n)] = 0
            size[at[odd]] = [len(r) for r in runs]
            start[at[odd]] = len(pool) + np.cumsum(size[at[odd]]) - size[at[odd]]
            pool = np.concatenate([pool, *[np.array(r, np.uint32) for r in runs]])
        self.table.trim()
        return start.astype(np.int64), size.astype(np.int64), pool, at

    def counts(self, column: pa.Array) -> np.ndarray:
        """How many ids each text has."""
        if not len(column):
            return np.zeros(0, np.int64)
        if not self.cuts:
            return np.array([len(self.whole(t)) for t in column.to_pylist()], np.int64)
        _, size, _, at = self._resolve(column)
        return np.add.reduceat(size, at)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """column: strings, none null."""
        if not self.cuts or not len(column):
            runs = [np.array(self.whole(t), np.uint32) for t in column.to_pylist()]
            return np.concatenate([np.empty(0, np.uint32), *runs]), np.cumsum([0, *map(len, runs)])
        start, size, pool, at = self._resolve(column)
        before = np.cumsum(size) - size
        ids = pool[np.repeat(start - before, size) + np.arange(int(size.sum()))]
        return ids, np.append(before[at], len(ids))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def version_digest(path: str) -> str:
    """Names what decides a count: the vocabulary file, the library's version and the settings."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|tokenizers {tokenizers.__version__}|add_special_tokens=False".encode()).hexdigest()
