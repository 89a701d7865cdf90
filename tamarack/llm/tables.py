"""Lookup of 64-bit hashes in numpy."""

from __future__ import annotations

import numpy as np


class Table:
    """Values by 64-bit hash: a table on the top bits says where in the sorted keys to look."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.values = keys, values
        self.bits = max(1, int(len(keys)).bit_length() - 1)
        self.at = np.searchsorted(keys >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.deep = int(np.diff(self.at).max(initial=0))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the keys, or -1."""
        top = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(h), -1, np.int64)
        at, end = self.at[top], self.at[top + 1]
        left = np.flatnonzero(at < end)
        for step in range(self.deep):
            k = at[left] + step
            inside = k < end[left]
            left, k = left[inside], k[inside]
            hit = self.keys[k] == h[left]
            out[left[hit]] = k[hit]
            left = left[~hit]
        return out

    def get(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = self.find(h)
        found = k >= 0
        return found, np.where(found, self.values[np.maximum(k, 0)], 0.0) if len(self.values) else np.zeros(len(h))
