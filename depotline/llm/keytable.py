"""Lookup of many 64-bit keys at once: an open-addressing table in numpy arrays."""

from __future__ import annotations

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # fixed value: 2^64 / golden ratio, odd


class KeyTable:
    """Row number of each of ``keys`` (distinct, none zero); at most a quarter full."""

    def __init__(self, keys: np.ndarray):
        keys = np.asarray(keys, np.uint64)
        self.bits = max(4, int(4 * max(1, len(keys)) - 1).bit_length())
        size = 1 << self.bits
        self.slots, self.rows = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        todo, at = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = self.rows[at] < 0
            # of several keys for one free slot the last one written has it
            self.rows[at[free]] = todo[free]
            placed = self.rows[at] == todo
            self.slots[at[placed]] = keys[todo[placed]]
            todo, at = todo[~placed], (at[~placed] + 1) & (size - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers, -1 for keys that aren't there."""
        at = self._home(keys)
        rows = self.rows[at]
        other = np.flatnonzero((rows >= 0) & (self.slots[at] != keys))
        while len(other):
            at[other] = (at[other] + 1) & (len(self.slots) - 1)
            rows[other] = self.rows[at[other]]
            other = other[(rows[other] >= 0) & (self.slots[at[other]] != keys[other])]
        return rows
