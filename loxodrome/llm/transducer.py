"""A deterministic transducer that counts the tokens of a byte-pair encoding, compiled state by state.

A state holds all that the rest of a text can depend on: the node of the suffix automaton over the vocabulary,
and for each position from which some token could still reach on, the last token of the encoding that ends
there, with its count relative to the newest one. A transition on a character carries the *difference* that the character makes to
the count: a merge that reaches back makes it zero or negative. States are canonical, so equal contexts share
one, and few contexts occur; transitions are compiled when first met and kept in one flat table.

The barrier character (the vocabulary's space mark) is special: no piece holds it after another character, so a
run of barriers that follows something else always starts anew. A chunk of text therefore acts on *any* state
by a short map: what its head (up to its first such place) does to the state, then a constant count and a
constant end state. Maps compose associatively, and :func:`scan` composes a row of them in parallel-prefix order.
States that maps hold are written out, so the tables may be emptied at any time.

:meth:`CountingTransducer.count_column` makes the maps of all chunks of a column of texts at once: the segments
between such places act from the initial state, so equal ones count alike, and a bounded memo has the counts.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from loxodrome.llm.bpe_dp import UNKNOWN, Vocabulary
from loxodrome.llm.int_table import IntTable
from loxodrome.llm.memo import Memo, Ragged, pieces
from loxodrome.llm.text_arrays import column_bytes

_OFFSET = 512
#: Longer segments are run through the transducer one by one, not side by side with the others.
LONG_SEGMENT = 96
_SPACE = 0x20
_STRETCH = 1 << 16


class ChunkMap(NamedTuple):
    """``head`` acts on the state that comes in; then, unless ``end`` is None, count ``body`` and go to ``end``."""

    head: str
    body: int
    end: bytes | None


class Transducer:
    """States are numbers, 0 the initial one; ``cost(c)`` is the count of an atom outside the vocabulary."""

    def __init__(self, vocabulary: Vocabulary, cost: Callable[[int], int], max_states: int = 300_000):
        self.vocabulary, self.cost, self._max = vocabulary, cost, max_states
        self.start = array("i", (0, UNKNOWN, 0)).tobytes()
        self.reset()

    def reset(self) -> None:
        self._states, self._number, self._table, self._wide = [self.start], {self.start: 0}, {}, IntTable()

    def _named(self, state: bytes) -> int:
        """The number of a written-out state; the tables are bounded here, as no number is held."""
        if len(self._states) > self._max or len(self._table) > 2 * self._max:
            self.reset()
        return self._numbered(state)

    def _numbered(self, state: bytes) -> int:
        n = self._number.get(state)
        if n is None:
            n = self._number[state] = len(self._states)
            self._states.append(state)
        return n

    def _compile(self, q: int, c: int) -> int:
        """The transition on one atom: the next state's number and the difference it makes to the count."""
        v = self.vocabulary
        old = array("i")
        old.frombytes(self._states[q])
        behind = dict(zip(v.chain[old[0]], zip(old[1::2], old[2::2], strict=True), strict=True))
        node = v.step(old[0], c)
        found, delta, valid = UNKNOWN, self.cost(c), v.valid
        for t, n in v.ends[node]:
            before, count = behind[n - 1]
            if valid(before, t):
                found, delta = t, count + 1
                break
        new = [node]
        for k in v.chain[node][:-1]:
            t, count = behind[k - 1]
            new += (t, count - delta)
        new += (found, 0)
        return self._numbered(array("i", new).tobytes()) << 10 | delta + _OFFSET

    def run(self, state: bytes, atoms) -> tuple[bytes, int]:
        """End state and count of a string of any length from ``state``."""
        n = 0
        for lo in range(0, len(atoms), _STRETCH):
            q, more = self._stretch(self._named(state), atoms[lo : lo + _STRETCH])
            state, n = self._states[q], n + more
        return state, n

    def _stretch(self, q: int, atoms) -> tuple[int, int]:
        table, n = self._table, 0
        for c in self.vocabulary.symbols(atoms):
            got = table.get(q << 21 | c)
            if got is None:
                got = table[q << 21 | c] = self._compile(q, c)
            q = got >> 10
            n += (got & 1023) - _OFFSET
        return q, n

    def run_all(self, words: list) -> np.ndarray:
        """The counts of many short words from the initial state, side by side: all words take a step at once."""
        joined = "".join(words)
        data = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lengths, kind="stable")
        starts, sizes = (np.cumsum(lengths) - lengths)[order], lengths[order]
        self._named(self.start)
        q, counts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for j in range(int(sizes[0]) if len(words) else 0):
            m = int(np.searchsorted(-sizes, -j, "left"))  # words longer than j
            keys = q[:m] << 21 | data[starts[:m] + j]
            got = self._wide.get_or(keys, lambda k: self._compile(k >> 21, k & 0x1FFFFF))
            q[:m] = got >> 10
            counts[:m] += (got & 1023) - _OFFSET
        out = np.empty_like(counts)
        out[order] = counts
        return out


class CountingTransducer(Transducer):
    """Counts whole texts. ``barrier`` is the atom that no token holds after another one; texts have spaces for it."""

    def __init__(self, vocabulary: Vocabulary, barrier: str, cost: Callable[[int], int], max_states: int = 300_000):
        super().__init__(vocabulary, cost, max_states)
        b = re.escape(barrier)
        self.barrier = barrier
        self._segments = re.compile(f"(?:^[^{b}]+|{b}+[^{b}]*)")
        self._border = re.compile(f"(?<=[^{b}]){b}")
        self._memo = Memo(self._counted, "<i4")

    def marked(self, text: str) -> str:
        return text.replace(" ", self.barrier)

    def _counted(self, segments: list[bytes]) -> Ragged:
        """Counts of segments from the initial state."""
        words = [self.marked(s.decode()) for s in segments]
        long = np.fromiter((len(w) > LONG_SEGMENT for w in words), bool, len(words))
        out = np.zeros(len(words), np.int64)
        out[~long] = self.run_all([w for w in words if len(w) <= LONG_SEGMENT])
        out[long] = [self.run(self.start, w)[1] for w in words if len(w) > LONG_SEGMENT]
        return Ragged(out, np.ones(len(words), np.int64))

    def chunk_map(self, chunk: str) -> ChunkMap:
        at = self._border.search(chunk)
        if at is None:
            return ChunkMap(chunk, 0, None)
        *inner, last = self._segments.findall(chunk[at.start() :])
        end, n = self.run(self.start, last)
        return ChunkMap(chunk[: at.start()], sum(self.run(self.start, s)[1] for s in inner) + n, end)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """First ``a``, then ``b``. A border between something and a barrier starts anew as well."""
        if a.end is None:
            joined = a.head + b.head
            cut = self.chunk_map(joined)
            if cut.end is None:
                return ChunkMap(joined, b.body, b.end)
            end, n = (cut.end, 0) if b.end is None else (b.end, b.body)
            return ChunkMap(cut.head, cut.body + n, end)
        if not b.head:
            return a if b.end is None else ChunkMap(a.head, a.body + b.body, b.end)
        fresh = b.head[0] == self.barrier and self._open(a.end)
        end, n = self.run(self.start if fresh else a.end, b.head)
        return ChunkMap(a.head, a.body + n + b.body, end if b.end is None else b.end)

    def _open(self, state: bytes) -> bool:
        """Whether a barrier after a state starts anew: the state's newest token isn't made of barriers."""
        t = np.frombuffer(state, np.int32)[-2]
        return t == UNKNOWN or self.vocabulary.token[int(t)][-1] != self.barrier

    def scan(self, maps: list[ChunkMap]) -> list[ChunkMap]:
        """All prefix compositions, by recursive doubling."""
        out, step = list(maps), 1
        while step < len(out):
            out = [self.compose(out[i - step], out[i]) if i >= step else out[i] for i in range(len(out))]
            step *= 2
        return out

    def _total(self, whole: ChunkMap) -> int:
        return self.run(self.start, whole.head)[1] + whole.body

    def count(self, text: str, chunk: int = 1 << 14) -> int:
        """Tokens of a whole marked text that starts at the initial state."""
        return self._total(self.scan([self.chunk_map(text[i : i + chunk]) for i in range(0, len(text), chunk)])[-1]) if text else 0

    def count_column(self, texts: pa.Array, chunk: int = 1 << 14) -> np.ndarray:
        """The tokens of each text, which begins with a space unless it is empty, by the maps of its chunks of ``chunk`` bytes (4 at least)."""
        data, offsets = column_bytes(texts)
        counts = np.zeros(len(texts), np.int64)
        if not len(data):
            return counts
        sizes = np.diff(offsets)
        per = -(-sizes // chunk)
        owner = np.repeat(np.arange(len(texts)), per)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        begin = offsets[:-1][owner] + nth * chunk
        for _ in range(3):  # a chunk begins with a whole character
            begin = begin - ((data[begin] & 0xC0) == 0x80)
        fresh = np.zeros(len(data) + 1, bool)
        fresh[1:-1] = (data[1:] == _SPACE) & (data[:-1] != _SPACE)
        fresh[begin] = True  # for a text's first chunk it starts anew there; other chunks' first segments are heads
        fresh[len(data)] = True
        bounds = np.nonzero(fresh)[0]
        segment = self._memo.rows(pieces(data, bounds)).flat.astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(segment)])
        first = np.searchsorted(bounds, begin)
        stop = np.append(first[1:], len(bounds) - 1)
        bodies = sums[stop] - sums[first + 1]  # of the segments after the head
        single = per == 1
        at = np.cumsum(per) - per
        # of a single chunk, the map's value at the initial state: its head is a segment that starts there
        counts[single] = bodies[at[single]] + segment[first[at[single]]]
        for i in np.nonzero(per > 1)[0].tolist():
            maps = []
            for k in range(at[i], at[i] + per[i]):
                text = lambda a, b: self.marked(data[bounds[a] : bounds[b]].tobytes().decode())
                one = stop[k] - first[k] == 1
                maps.append(ChunkMap(text(first[k], first[k] + 1), int(bodies[k]), None if one else self.run(self.start, text(stop[k] - 1, stop[k]))[0]))
            counts[i] = self._total(self.scan(maps)[-1])
        return counts
