"""Bounded tables of what pure functions of byte strings gave, for whole Arrow columns at a time.

Results never depend on what is kept, so a table may forget whenever it likes.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa


class Ragged(NamedTuple):
    """Rows of numbers, one after another in ``flat``."""

    flat: np.ndarray
    sizes: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    def take(self, rows: np.ndarray) -> Ragged:
        sizes = self.sizes[rows]
        at = np.arange(sizes.sum()) + np.repeat(self.starts[rows] - (np.cumsum(sizes) - sizes), sizes)
        return Ragged(self.flat[at], sizes)

    @staticmethod
    def joined(parts: list[Ragged]) -> Ragged:
        return Ragged(*(np.concatenate(x) for x in zip(*parts, strict=True)))


class Memo:
    """``memo.rows(column)`` has a row of numbers for each byte string of a column; ``compute`` makes new ones, many at once.

    Between two columns at most ``limit`` bytes are kept, and if it gets more, those of the last column only.
    """

    def __init__(self, compute: Callable[[list[bytes]], Ragged], kind: str, limit: int = 48 << 20):
        self._compute, self._kind, self._limit = compute, kind, limit
        self._clear()

    def _clear(self) -> None:
        self._number: dict[bytes, int] = {}
        self._rows, self._bytes = Ragged(np.zeros(0, self._kind), np.zeros(0, np.int64)), 0

    def distinct(self, column: pa.Array) -> tuple[np.ndarray, Ragged]:
        """Each string's number, and a row for each number."""
        coded = column.dictionary_encode()
        keys, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.fromiter((self._number.get(k, -1) for k in keys), np.int64, len(keys))
        (new,) = np.nonzero(at < 0)
        if len(new):
            fresh = [keys[i] for i in new.tolist()]
            n = len(self._number)
            self._number.update(zip(fresh, range(n, n + len(fresh)), strict=True))
            at[new] = np.arange(n, n + len(fresh))
            found = self._compute(fresh)
            self._rows = Ragged.joined([self._rows, Ragged(found.flat.astype(self._kind), found.sizes)])
            # a key is an object of some 33 bytes besides its own, and an entry of a dictionary
            self._bytes += sum(map(len, fresh)) + 140 * len(fresh) + found.flat.nbytes
        rows = self._rows.take(at)
        if self._bytes > self._limit:
            self._clear()
            size = coded.dictionary.nbytes + 140 * len(keys) + rows.flat.nbytes
            if size <= self._limit:
                self._number, self._rows, self._bytes = dict(zip(keys, range(len(keys)), strict=True)), rows, size
        return codes, rows

    def rows(self, column: pa.Array) -> Ragged:
        codes, rows = self.distinct(column)
        return rows.take(codes)


def pieces(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A column of byte strings, not copied: ``data`` cut at ``bounds``, which begin with 0 and end with its length."""
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
