"""Monotone integer sequences in a few more bits than log2(universe / length) an element."""

from __future__ import annotations

import numpy as np

LOW_KINDS = {0: np.uint8, 8: np.uint8, 16: np.uint16, 32: np.uint32}


def encode(values: np.ndarray, universe: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Width of the low bits, low bits, high bits of values that don't fall and are below ``universe``.

    Low bits take whole bytes. High bits are unary: a set bit an element, a clear bit a bucket.
    """
    n = len(values)
    need = max(0, (universe // max(1, n)).bit_length() - 1)
    width = next((w for w in LOW_KINDS if w >= need), 32)
    values = values.astype(np.uint64)
    low = (values & np.uint64((1 << width) - 1)).astype(LOW_KINDS[width])
    bits = np.zeros(n + (universe >> width) + 1, dtype=bool)
    bits[(values >> np.uint64(width)).astype(np.int64) + np.arange(n)] = True
    return width, low, np.packbits(bits, bitorder="little")


class EliasFano:
    """A coded sequence; the places of set and clear bits are found once, when it is opened."""

    def __init__(self, width: int, low: np.ndarray, high: np.ndarray, length: int):
        bits = np.unpackbits(high, bitorder="little").view(bool)
        self.width, self.low, self.length = width, low, length
        self.ones = np.flatnonzero(bits)
        zeros = np.flatnonzero(~bits)
        self.before = np.concatenate([[0], zeros - np.arange(len(zeros))])  # elements ahead of each bucket

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return (self.ones[i] - i) << self.width | self.low[i].astype(np.int64)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Position of each value, or -1: the successor search in the bucket of its high bits."""
        found = np.full(len(values), -1, dtype=np.int64)
        bucket = values >> self.width
        rest = (values & ((1 << self.width) - 1)).astype(self.low.dtype)
        at, last = self.before[bucket], self.before[bucket + 1]
        end = last.copy()
        open_ = np.flatnonzero(at < end)
        while len(open_):  # halve the bucket's run; low bits rise inside it
            middle = (at[open_] + end[open_]) >> 1
            below = self.low[middle] < rest[open_]
            at[open_] = np.where(below, middle + 1, at[open_])
            end[open_] = np.where(below, end[open_], middle)
            open_ = open_[at[open_] < end[open_]]
        here = np.flatnonzero(at < last)
        here = here[self.low[at[here]] == rest[here]]
        found[here] = at[here]
        return found
