"""A hash table of integers that numpy reads many keys at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_MIX = 0x9E3779B97F4A7C15


class IntTable:
    """Open addressing over numpy arrays: whole arrays of keys are looked up at once; -1 is missing."""

    def __init__(self, bits: int = 16):
        self._bits, self.size = bits, 0
        self._keys = np.full(1 << bits, -1, np.int64)
        self._values = np.full(1 << bits, -1, np.int64)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(_MIX)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at, mask = self._home(keys), (1 << self._bits) - 1
        found = self._keys[at]
        out = self._values[at]
        (left,) = np.nonzero((found != keys) & (found != -1))
        while len(left):
            at[left] = at[left] + 1 & mask
            found = self._keys[at[left]]
            out[left] = self._values[at[left]]
            left = left[(found != keys[left]) & (found != -1)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """For distinct keys that are missing."""
        if (self.size + len(keys)) * 2 > 1 << self._bits:
            kept = self._keys != -1
            keys, values = np.concatenate([self._keys[kept], keys]), np.concatenate([self._values[kept], values])
            self.__init__(max(self._bits + 1, int(len(keys) * 2).bit_length()))
        self.size += len(keys)
        mask = (1 << self._bits) - 1
        for k, h, v in zip(keys.tolist(), self._home(keys).tolist(), values.tolist(), strict=True):
            while self._keys[h] != -1:
                h = h + 1 & mask
            self._keys[h], self._values[h] = k, v

    def get_or(self, keys: np.ndarray, compute: Callable[[int], int]) -> np.ndarray:
        """As :meth:`get`; what is missing is computed, once for each key, and kept."""
        got = self.get(keys)
        if (missing := got < 0).any():
            new, at = np.unique(keys[missing], return_inverse=True)
            values = np.array([compute(k) for k in new.tolist()], np.int64)
            self.put(new, values)
            got[missing] = values[at]
        return got
