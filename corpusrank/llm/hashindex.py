"""A static hash table from uint64 keys to row numbers, looked up for whole arrays at once."""

from __future__ import annotations

import numpy as np

MIX = np.uint64(0x9E3779B97F4A7C15)


class HashIndex:
    """Open addressing with linear probing; at most a quarter of the slots are full, so that probes stay short."""

    def __init__(self, keys: np.ndarray) -> None:
        """``keys`` are distinct; key i maps to i."""
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.rows = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.rows[at] < 0
            slot, who = np.unique(at[free], return_index=True)
            chosen = left[free][who]
            self.rows[slot], self.keys[slot] = chosen, keys[chosen]
            waits = self.rows[at] != left
            left, at = left[waits], (at[waits] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MIX) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row number of each key, -1 where it is absent; in the shape of ``keys``."""
        shape, keys = keys.shape, keys.ravel()
        at = self._home(keys)
        out = self.rows[at]
        wrong = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self.mask
            out[wrong] = self.rows[at[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.keys[at[wrong]] != keys[wrong])]
        return out.reshape(shape)
