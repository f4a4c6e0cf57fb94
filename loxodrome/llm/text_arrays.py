"""Words, shingles and their hashes for whole Arrow columns of texts at once, in numpy.

A column's bytes are one array; where words begin and end is found by a lookup table over bytes. A word's hash is
a polynomial of its bytes, read off a running sum, so no Python object is made for any word.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

_P = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD6E8FEB86659FD93
_CHUNK = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes are ASCII letters and digits, ASCII punctuation but the apostrophe (which begins contractions), or others.
ALNUM_BYTE, PUNCTUATION, OTHER = range(3)
KIND = np.full(256, OTHER, np.uint8)
KIND[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = ALNUM_BYTE
KIND[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = PUNCTUATION


def byte_class(members) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


#: Words are runs of all but space and the control characters 9 to 13.
SPACED = ~byte_class([0x20, *range(0x09, 0x0E)])
#: Words are runs of ASCII letters and digits (after lower-casing) and all of UTF-8 beyond ASCII.
ALNUM = byte_class([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    up = down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            inverse = pow(_P, -1, 1 << 64)
            cls.up, cls.down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (_P, inverse))
        return cls.up, cls.down


class Words(NamedTuple):
    """Words of a run of texts: where each begins and ends in ``data``, its text's number, its hash."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # of each text, the number of its first word; one more at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of strings without nulls."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words_of(texts: pa.Array, member: np.ndarray, lower: bool = True) -> Words:
    data, offsets = column_bytes(texts)
    if lower:
        data = LOWER[data]
    inside = member[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    (starts,), (ends,) = np.nonzero(inside & ~before), np.nonzero(inside & ~after)
    ends = ends + 1
    first = np.searchsorted(starts, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, starts, ends, text, hash_spans(data, starts, ends), first)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes in rising order."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        base = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, base + _CHUNK, "right")))
        n = int(ends[stop - 1] - base)
        up, down = _Powers.get(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data[base : base + n].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        a, b = starts[at:stop] - base, ends[at:stop] - base
        out[at:stop] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(_STEP))
        at = stop
    return out


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, by their first word; runs may cross texts."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= np.uint64(_STEP)
        out += hashes[j : j + n]
    return mix(out)


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's set of distinct ``k``-word shingles, sorted, one after another, and where each set begins.

    A text of fewer words has its whole sequence as one shingle; a text without words has none.
    """
    all_, counts, sets = shingle_hashes(words.hashes, k), words.counts, []
    for i, n in enumerate(counts.tolist()):
        a = int(words.first[i])
        if n >= k:
            h = np.sort(all_[a : a + n - k + 1])
            if len(h) > 1:
                h = h[np.concatenate([[True], h[1:] != h[:-1]])]
        elif n:
            h = mix(shingle_hashes(words.hashes[a : a + n], n) + np.uint64(n))
        else:
            h = np.zeros(0, np.uint64)
        sets.append(h)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])
