"""Words and word hashes of a batch of texts, found with array operations.

A word is a run of characters other than the blank and ``\\x09-\\x0d``. These are single
bytes in UTF-8, so words are found in the bytes of the batch. All hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = r"[^\x20\x09-\x0D]+"
SPACES = np.array([0x20, *range(0x09, 0x0E)], dtype=np.uint8)
BASE = 0x9E3779B97F4A7C15 | 1
_WRAP = 1 << 64
#: Bytes of text worked on at a time; a longer text is taken whole.
PIECE = 1 << 17

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[SPACES] = True
#: For letters and digits only: everything else that ASCII has parts words.
NOT_ALNUM = np.array([not (chr(i).isalnum() or i >= 0x80) for i in range(256)])
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers; one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


@lru_cache(maxsize=4)
def _powers(size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < size."""
    out = []
    for b in (base, pow(base, -1, _WRAP)):
        steps = np.full(size, b, dtype=np.uint64)
        steps[:1] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def powers(size: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(size).bit_length())
    return _powers(size, base)


def spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """Polynomial (Rabin-Karp) hashes of ``values[start:end]``, from one running sum."""
    up, down = powers(len(values) + 1, base)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return (total[end] - total[start]) * down[start]


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, a place of each, and the number of every key among them."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    distinct, place = ranked[new], order[new]
    del ranked
    rank = np.cumsum(new)
    rank -= 1
    number = np.empty(len(keys), dtype=np.int64)
    number[order] = rank
    return distinct, place, number


def runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each run, one run after another."""
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(length.sum())


@dataclass
class Words:
    """Words of consecutive rows: bytes ``data[start:end]`` of row ``row``; row i has words first[i] to first[i+1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    text_start: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of every run of ``size`` words of one row."""
        n = len(self) - size + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        at = np.flatnonzero(self.row[:n] == self.row[size - 1 :])
        return at, mix(spans_hash(self.hash, at, at + size))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where its rows begin; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _words(data: np.ndarray, offsets: np.ndarray, fold: bool, breaks: np.ndarray) -> Words:
    if fold:
        data = FOLD[data]
    inside = ~breaks[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]  # a word ends with its row
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(first))
    raw = spans_hash(BYTE_VALUES[data], start, end)
    hashed = mix(raw + (end - start).astype(np.uint64))
    return Words(data, start, end, row, first, hashed, offsets)


def pieces(offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of whole rows of at most that many bytes."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def words(column, fold: bool = False, breaks: np.ndarray = IS_SPACE) -> Words:
    """All words of a string column; ``breaks`` marks the bytes between words."""
    data, offsets = text_bytes(column)
    parts = []
    for a, b in pieces(offsets):
        w = _words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], fold, breaks)
        w.start, w.end, w.row = w.start + offsets[a], w.end + offsets[a], w.row + np.int32(a)
        parts.append(w)
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return Words(data, none, none, none.astype(np.int32), np.zeros(1, np.int64), none.astype(np.uint64), offsets)
    counts = np.concatenate([p.counts() for p in parts])
    first = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=first[1:])
    join = lambda name: np.concatenate([getattr(p, name) for p in parts])
    whole = FOLD[data] if fold else data
    return Words(whole, join("start"), join("end"), join("row"), first, join("hash"), offsets)


def batches(tables: Iterator[pa.RecordBatch], text: str = "text", most: int = 8 << 20) -> Iterator[pa.Table]:
    """Arrow batches cut, between rows, into tables of bounded text."""
    for batch in tables:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        _, offsets = text_bytes(table[text])
        for a, b in pieces(offsets, most):
            yield table.slice(a, b - a)
