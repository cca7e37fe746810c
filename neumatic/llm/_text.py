"""Vectorised text helpers shared by the operators: byte slices, words, hashes.

Arrow hands a task its texts as one byte buffer with offsets. The helpers work
on such buffers with numpy, a few megabytes at a time, so that memory stays
bounded by a slice (or by the longest single text) whatever the batch holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BASE2 = np.uint64(0xC2B2AE3D27D4EB4F | 1)
_BASE2_INV = np.uint64(pow(int(_BASE2), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between calls."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        have = np.empty(size, dtype=np.uint64)
        have[0] = 1
        have[1:] = base
        np.multiply.accumulate(have, out=have)
        if size <= 4 * SLICE_BYTES:
            _powers[int(base)] = have
    return have[:n]


class Prefix:
    """Polynomial prefix hashes: the hash of any span of a buffer in O(1)."""

    def __init__(self, data: np.ndarray, second: bool = False):
        self.base, self.inv = (_BASE2, _BASE2_INV) if second else (_BASE, _BASE_INV)
        n = len(data)
        self.total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(self.base, n), out=self.total[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hash of data[start:end], element by element."""
        raw = (self.total[end] - self.total[start]) * powers(self.inv, len(self.total))[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of row ranges of about `limit` bytes."""
    data, offsets = buffer_of(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of bytes that are not ASCII white space."""
    solid = ~SPACE[data]
    before = np.empty_like(solid)
    before[:1] = False
    before[1:] = solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = False
    start = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    after[-1:] = False
    after[:-1] = solid[1:]
    after[inner - 1] = False
    end = np.flatnonzero(solid & ~after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word with A-Z lower-cased."""
    return Prefix(LOWER[data]).span(start, end)


_STEP = [np.uint64(pow(0xA0761D6478BD642F | 1, i + 1, 1 << 64)) for i in range(64)]


def windows(h: np.ndarray, row: np.ndarray, width: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first word) of each run of `width` words inside a row.

    With `short`, a row of fewer words (but one at least) gives its whole
    sequence as one window.
    """
    n = len(h)
    if not n:
        return h, row, np.empty(0, np.int64)
    m = n - width + 1
    parts = []
    if m > 0:
        first = np.flatnonzero(row[:m] == row[width - 1 :])
        value = np.zeros(len(first), np.uint64)
        for i in range(width):
            value += h[first + i] * _STEP[i]
        parts.append((mix(value), row[first], first))
    if short:
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        length = np.diff(np.r_[starts, n])
        few = length < width
        if few.any():
            s, k = starts[few], length[few]
            value = np.full(len(s), 0x5851F42D4C957F2D, np.uint64) * k.astype(np.uint64)
            for i in range(width - 1):
                there = i < k
                value[there] += h[s[there] + i] * _STEP[i]
            parts.append((mix(value), row[s], s))
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    value, rows, first = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(first, kind="stable")
    return value[order], rows[order], first[order]


def spark_long(h: np.ndarray) -> np.ndarray:
    """The same bits as signed longs."""
    return h.view(np.int64)


class Table:
    """Open-addressing look-up of 64-bit keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(math.ceil(math.log2(max(1, len(keys)) * 3))))
        n = 1 << self.bits
        self.keys, self.values = np.full(n, np.uint64(2**64 - 1)), np.zeros(n, values.dtype)
        todo, at = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = self.keys[at] == np.uint64(2**64 - 1)
            _, lead = np.unique(np.where(free, at, -1), return_index=True)
            lead = lead[free[lead]]
            self.keys[at[lead]], self.values[at[lead]] = keys[todo[lead]], values[todo[lead]]
            rest = np.ones(len(todo), bool)
            rest[lead] = False
            todo, at = todo[rest], (at[rest] + 1) & (n - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value); the value of a key that is not there is 0."""
        at = self._home(keys)
        have = self.keys[at]
        found = have == keys
        value = np.where(found, self.values[at], self.values.dtype.type(0))
        open_ = np.flatnonzero(~found & (have != np.uint64(2**64 - 1)))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            have = self.keys[at[open_]]
            hit = have == keys[open_]
            found[open_[hit]], value[open_[hit]] = True, self.values[at[open_[hit]]]
            open_ = open_[~hit & (have != np.uint64(2**64 - 1))]
        return found, value


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each distinct value, and for each element which of them it is; by hashing, not sorting."""
    inverse, values = pd.factorize(h)
    lead = np.empty(len(values), np.int64)
    lead[inverse[::-1]] = np.arange(len(h) - 1, -1, -1)
    return lead, inverse
