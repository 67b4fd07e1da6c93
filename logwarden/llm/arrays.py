"""Vectorised words and shingles over Arrow string columns.

A word is a run of bytes other than space and 0x09-0x0D; words are named by 64-bit hashes, computed with
prefix sums over whole slices of a column, so no Python loop touches a word. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.default_rng(20240607)
_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE, _STEP = 0x9E3779B97F4A7C15, U(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.ones(1, U), np.ones(1, U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(size, U(base))
            table[0] = 1
            made.append(np.multiply.accumulate(table))
        _powers = made[0], made[1]
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    h = h ^ (h >> U(32))
    h = h * _STEP
    h = h ^ (h >> U(29))
    h = h * U(0xA3B195354A39B70D)
    return h ^ (h >> U(32))


def slices(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of slices of about ``size`` bytes; a longer row stands alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (exclusive) and row numbers of all words of a slice."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    first[cut] = word[cut]
    last = word.copy()
    last[:-1] &= ~word[1:]
    before = cut[cut > 0] - 1
    last[before] |= word[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True, size: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of the words of a slice; long slices are cut between words."""
    out = np.empty(len(starts), U)
    code = _CODE[_LOWER] if lower else _CODE
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + size, "right")))
        low, high = starts[i], ends[j - 1]
        power, inverse = powers(int(high - low))
        sums = np.zeros(high - low + 1, U)
        np.cumsum(code[data[low:high]] * power[: high - low], out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((sums[e] - sums[s]) * inverse[s] + (ends[i:j] - starts[i:j]).astype(U) * _STEP)
        i = j
    return out


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words within a row, and their rows, in text order.

    A row of 1 to k-1 words has its whole sequence as its only run.
    """
    if not len(hashes):
        return np.zeros(0, U), np.zeros(0, np.int64)
    factor, _ = powers(k + 1)
    count = len(hashes)
    whole = np.zeros(max(count - k + 1, 0), U)
    for i in range(k):
        whole += mix(hashes[i : count - k + 1 + i] + U(i)) * factor[i + 1] if count >= k else U(0)
    keep = np.flatnonzero(rows[: len(whole)] == rows[k - 1 :]) if count >= k else np.zeros(0, np.int64)
    per = np.bincount(rows, minlength=n_rows)
    short = np.flatnonzero((per > 0) & (per < k))
    h, r = mix(whole[keep]), rows[keep]
    if len(short):
        first = np.concatenate(([0], np.cumsum(per)))[short]
        extra = per[short].astype(U) * U(0xC2B2AE3D27D4EB4F)
        for i in range(k - 1):
            there = per[short] > i
            extra[there] += mix(hashes[first[there] + i] + U(i)) * factor[i + 1]
        h, r = np.concatenate((h, mix(extra))), np.concatenate((r, short))
        order = np.argsort(r, kind="stable")
        h, r = h[order], r[order]
    return h, r


def bounds(rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Offsets of each row's part of an array ordered by row."""
    return np.searchsorted(rows, np.arange(n_rows + 1))


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row that has words."""
    for i, j, data, offsets in slices(column):
        starts, ends, rows = words(data, offsets)
        h, r = shingles(hash_words(data, starts, ends), rows, j - i, k)
        at = bounds(r, j - i)
        for row in np.flatnonzero(at[1:] > at[:-1]):
            yield i + int(row), np.unique(h[at[row] : at[row + 1]])
