"""Token ids of whole texts by a public tokenizer, looked up once per distinct word piece.

The tokenizer drops white space and never joins characters across it, nor across a change between ASCII letters and other
ASCII characters (apostrophes and bars aside, which contractions and special tokens use). So the ids of a text are those
of such pieces in order; a worker keeps the pieces it has met, and the library sees only new ones.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from unicodedata import normalize

import numpy as np
import pyarrow as pa

from . import arrays

SLOT_BITS = 22
SLOTS = 1 << SLOT_BITS
KEPT = SLOTS // 2  # pieces a worker remembers before it starts anew
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_PLAIN &= ~_LETTER
_PLAIN[[0x27, 0x7C]] = False


class Encoder:
    """``specials``: whether the strings of special tokens inside a text become those tokens."""

    _made: dict[tuple[str, bool], Encoder] = {}

    def __init__(self, path: str, specials: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not specials
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    @classmethod
    def of(cls, path: str, specials: bool = True) -> Encoder:
        """The worker's own encoder for a file."""
        if (path, specials) not in cls._made:
            cls._made[path, specials] = cls(path, specials)
        return cls._made[path, specials]

    def _forget(self) -> None:
        self.names = np.zeros(SLOTS, np.uint64)  # open addressing; 0 is free
        self.held = np.zeros(SLOTS, np.int32)
        self.count = self.used = 0
        self.ids = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 12, np.int64)

    def _find(self, names: np.ndarray) -> np.ndarray:
        """Numbers of known pieces, -1 for others."""
        out = np.full(len(names), -1, np.int64)
        open_, slot = np.arange(len(names)), (names >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        while len(open_):
            there = self.names[slot]
            hit = there == names[open_]
            out[open_[hit]] = self.held[slot[hit]]
            on = ~hit & (there != 0)
            open_, slot = open_[on], (slot[on] + 1) & (SLOTS - 1)
        return out

    def _learn(self, names: np.ndarray, pieces: list[str]) -> None:
        """Encode new pieces: words of letters together, by their tokens' word ends, others one by one."""
        plain = [i for i, p in enumerate(pieces) if p.isalpha() and (p.isascii() or normalize("NFC", p).lower().isalpha())]
        found: list = [None] * len(pieces)
        for i in range(0, len(plain), 4096):
            part = plain[i : i + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([pieces[j] for j in part])], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(part):
                for j, x in zip(part, np.split(ids, ends[:-1]), strict=True):
                    found[j] = x
        rest = [j for j, x in enumerate(found) if x is None]
        for i in range(0, len(rest), 1024):
            part = rest[i : i + 1024]
            for j, encoding in zip(part, self.tokenizer.encode_batch_fast([pieces[j] for j in part], add_special_tokens=False), strict=True):
                found[j] = np.array(encoding.ids, np.uint32)
        flat, size = np.concatenate(found), np.array([len(x) for x in found])
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(len(self.ids), np.uint32)))
        while self.count + len(size) + 1 > len(self.begin):
            self.begin = np.concatenate((self.begin, np.zeros(len(self.begin), np.int64)))
        self.ids[self.used : self.used + len(flat)] = flat
        self.begin[self.count + 1 : self.count + len(size) + 1] = self.used + np.cumsum(size)
        self.used += len(flat)
        slots = (names >> np.uint64(64 - SLOT_BITS)).astype(np.int64).tolist()
        for name, slot in zip(names.tolist(), slots, strict=True):
            while self.names[slot]:
                slot = (slot + 1) & (SLOTS - 1)
            self.names[slot], self.held[slot] = name, self.count
            self.count += 1

    def encode(self, column: pa.Array, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, offsets, ids) of slices of a column; ``end`` closes every row's ids."""
        for first, stop, data, offsets in arrays.slices(column, 2 << 20):
            starts, ends, _ = arrays.words(data, offsets)
            letter, plain = _LETTER[data], _PLAIN[data]
            change = np.flatnonzero((letter[:-1] & plain[1:]) | (plain[:-1] & letter[1:])) + 1
            flag = np.zeros(len(data) + 1, bool)
            flag[starts] = flag[change] = True
            begin = np.flatnonzero(flag)
            flag[:] = False
            flag[ends] = flag[change] = True
            stops = np.flatnonzero(flag)
            yield first, *self._gather(data, offsets, begin, stops, stop - first, end)

    def _gather(self, data, offsets, begin, stops, n_rows: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.searchsorted(offsets, begin, "right") - 1
        names = arrays.hash_words(data, begin, stops)
        barred = np.flatnonzero(data == 0x7C)
        if len(barred):  # special tokens are told apart by case
            held = np.unique(np.searchsorted(begin, barred, "right") - 1)
            names[held] = arrays.hash_words(data, begin[held], stops[held], lower=False) ^ np.uint64(0x5BD1E995)
        names |= np.uint64(1)
        index = self._find(names)
        if (index < 0).any():
            distinct, at = np.unique(names[index < 0], return_index=True)
            if self.count + len(distinct) > KEPT:
                self._forget()
                distinct, at = np.unique(names, return_index=True)
            else:
                at = np.flatnonzero(index < 0)[at]
            raw = data.tobytes()
            self._learn(distinct, [raw[begin[j] : stops[j]].decode("utf-8", "replace") for j in at.tolist()])
            index = self._find(names)
        size = self.begin[index + 1] - self.begin[index]
        per_row = np.bincount(rows, weights=size, minlength=n_rows).astype(np.int64)
        out_at = np.concatenate(([0], np.cumsum(per_row + 1)))
        ids = np.full(out_at[-1], end, np.uint32)
        total = int(size.sum())
        before = np.cumsum(size) - size
        source = np.repeat(self.begin[index] - before, size) + np.arange(total)
        target = np.repeat(rows, size) + np.arange(total)  # one closing id per earlier row
        ids[target] = self.ids[source]
        return out_at, ids
