"""Prefix dynamic programming for byte-pair encoding.

Greedy BPE (merge the pair whose product has the least rank, leftmost first) has a useful structure: cutting
an encoding at a token border gives the encodings of both parts, and a sequence of tokens is an encoding if
every neighbouring pair is. So each prefix of a string has exactly one *last token* that can end its encoding,
and the table of last tokens encodes all prefixes at once. A longer string only extends the table; an edit
only invalidates what follows it, until the table agrees with the old one over the longest token's length.

The same engine serves byte vocabularies (``bytes``) and piece vocabularies (``str``); an atom is one byte or
one character. Tokens are named by rank.
"""

from __future__ import annotations

from collections import deque

import numpy as np

from loxodrome.llm.int_table import IntTable
from loxodrome.llm.memo import Ragged

_NEVER = 1 << 60
#: Stands for an atom outside the vocabulary: nothing merges with it.
UNKNOWN = -1


class Vocabulary:
    """Suffix matching and pair validity over one table of ranks.

    ``ranks`` names each token by a number; merges go by it, or by ``priority[rank]`` where that is given (equal
    ones: leftmost first). ``ends[node]`` lists the tokens that are suffixes of what leads to an automaton's
    node, longest first.
    """

    def __init__(self, ranks: dict, priority: dict | None = None, limit: int = 100_000):
        self.ranks = ranks
        self._of_id = priority or {r: r for r in ranks.values()}
        self._of_token = {t: self._of_id[r] for t, r in ranks.items()} if priority else ranks
        self.size = max(ranks.values()) + 1
        self.token = {r: t for t, r in ranks.items()}
        self.length = {r: len(t) for t, r in ranks.items()}
        self.length[UNKNOWN] = 1
        self.longest = max(self.length.values())
        self._halves: dict = {}
        self._valid: dict = {}
        self._limit = limit
        self._automaton()

    @staticmethod
    def symbols(s):
        return s if isinstance(s, bytes) else map(ord, s)

    def _automaton(self) -> None:
        go, depth, own, children = {}, [0], [None], [[]]
        for t, r in self.ranks.items():
            node = 0
            for c in self.symbols(t):
                key = node << 21 | c
                nxt = go.get(key)
                if nxt is None:
                    nxt = go[key] = len(depth)
                    depth.append(depth[node] + 1)
                    own.append(None)
                    children.append([])
                    children[node].append((c, nxt))
                node = nxt
            own[node] = r
        fail, ends = [0] * len(depth), [()] * len(depth)
        queue = deque((0, c, n) for c, n in children[0])
        while queue:
            parent, c, node = queue.popleft()
            if parent:
                f = fail[parent]
                while f and f << 21 | c not in go:
                    f = fail[f]
                fail[node] = go.get(f << 21 | c, 0)
            r = own[node]
            mine = ((r, depth[node]),) if r is not None and self.halves(r) is not None else ()
            ends[node] = mine + ends[fail[node]]
            queue.extend((node, x, n) for x, n in children[node])
        #: For each node the lengths of its suffixes that begin some token, longest first, and 0.
        self.chain = chain = [(0,)] * len(depth)
        for node in sorted(range(1, len(depth)), key=depth.__getitem__):
            chain[node] = (depth[node], *chain[fail[node]])
        self._go, self._tree, self.fail, self.ends, self.depth = dict(go), go, fail, ends, depth

    def step(self, node: int, c: int) -> int:
        """The automaton's next node."""
        key = node << 21 | c
        got = self._go.get(key)
        if got is None:
            f = node
            while f and f << 21 | c not in self._tree:
                f = self.fail[f]
            got = self._tree.get(f << 21 | c, 0)
            if len(self._go) > len(self._tree) + self._limit:
                self._go = dict(self._tree)
            self._go[key] = got
        return got

    def merged(self, s, stop: int = 1) -> list:
        """Greedy BPE by its definition, until ``stop`` parts are left; to find how a token is put together."""
        parts, get = [s[i : i + 1] for i in range(len(s))], self._of_token.get
        while len(parts) > stop:
            best, at = _NEVER, -1
            for i in range(len(parts) - 1):
                r = get(parts[i] + parts[i + 1], _NEVER)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, r: int):
        """The two tokens of the last merge that makes token ``r``; () for an atom; None if merges never make it."""
        got = self._halves.get(r, 0)
        if got == 0:
            got, t = (), self.token[r]
            if len(t) > 1:
                parts = self.merged(t, 2)
                got = tuple(self.ranks[p] for p in parts) if len(parts) == 2 else None
            self._halves[r] = got
        return got

    def valid(self, a: int, b: int) -> bool:
        """Whether BPE of the two tokens' string gives them back, for tokens that stand alone."""
        if a < 0 or b < 0:
            return True
        key = a * self.size + b
        got = self._valid.get(key)
        if got is None:
            if len(self._valid) > self._limit:
                self._valid.clear()
            got = self._valid[key] = self._seam(a, b)
        return got

    def _seam(self, a: int, b: int) -> bool:
        """Undo the merges on both sides of the seam from the last to the first.

        While two parts face each other, a merge across the seam would win if its rank is below that of the next
        merge on the left, or not above that of the next merge on the right (leftmost first).
        """
        token, get, order, bound = self.token, self._of_token.get, self._of_id, _NEVER
        while True:
            if get(token[a] + token[b], _NEVER) < bound:
                return False
            left, right = self.halves(a), self.halves(b)
            if not left and not right:
                return True
            if left and (not right or order[a] > order[b]):
                bound, a = order[a], left[1]
            else:
                bound, b = order[b] + 1, right[0]


class PrefixTable:
    """The last token of every prefix of one string; grows by appends, and follows edits."""

    def __init__(self, vocabulary: Vocabulary, s):
        self.vocabulary = vocabulary
        self.s = s[:0]
        self.last: list[int] = []
        self._nodes: list[int] = []
        self.append(s)

    def append(self, more) -> None:
        """Exact: ``append(x); append(y)`` leaves what ``append(x + y)`` leaves."""
        begin, self.s = len(self.s), self.s + more
        self._fill(begin, None)

    def edit(self, start: int, stop: int, new) -> int:
        """Replace ``s[start:stop]``; returns how many entries were computed anew."""
        old = (self.last, self._nodes, len(new) - (stop - start), start + len(new))
        self.s = self.s[:start] + new + self.s[stop:]
        self.last, self._nodes = self.last[:start], self._nodes[:start]
        return self._fill(start, old)

    def _fill(self, begin: int, old) -> int:
        v, last, nodes = self.vocabulary, self.last, self._nodes
        go, step, ends, valid, known, size = v._go.get, v.step, v.ends, v.valid, v._valid.get, v.size
        node, agree, i = nodes[-1] if nodes else 0, 0, begin
        for c in v.symbols(self.s[begin:]):
            nxt = go(node << 21 | c)
            node = step(node, c) if nxt is None else nxt
            found = UNKNOWN
            for t, n in ends[node]:
                if n > i or (before := last[i - n]) < 0:
                    found = t
                    break
                ok = known(before * size + t)
                if ok or ok is None and valid(before, t):
                    found = t
                    break
            last.append(found)
            nodes.append(node)
            if old is not None and i >= old[3]:
                # the same last tokens over the longest token's reach: all that follows is the same as before
                agree = agree + 1 if old[0][i - old[2]] == found else 0
                if agree >= v.longest:
                    last.extend(old[0][i - old[2] + 1 :])
                    nodes.extend(old[1][i - old[2] + 1 :])
                    return i + 1 - begin
            i += 1
        return len(self.s) - begin

    def ids(self) -> list[int]:
        out, i, last, length = [], len(self.s), self.last, self.vocabulary.length
        while i > 0:
            t = last[i - 1]
            out.append(t)
            i -= length[t]
        out.reverse()
        return out

    def tokens(self) -> list[tuple]:
        """Each token's rank with the string it covers."""
        out, at = [], 0
        for r in self.ids():
            n = self.vocabulary.length[r]
            out.append((r, self.s[at : at + n]))
            at += n
        return out


def encode(vocabulary: Vocabulary, s) -> list[int]:
    """The token ranks of one string. As the library has it, a string that is a token is that token."""
    r = vocabulary.ranks.get(s)
    return [r] if r is not None else PrefixTable(vocabulary, s).ids()


class SideBySide:
    """Fills the prefix tables of many short strings at once: all strings take a step together.

    The automaton's steps and the validity of pairs are looked up in tables that grow as new ones are met.
    """

    def __init__(self, vocabulary: Vocabulary, limit: int = 200_000):
        self.vocabulary, self._limit = vocabulary, limit
        ends = vocabulary.ends
        self._at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ends), np.int64, len(ends)))])
        flat = np.array([x for node in ends for x in node], np.int64).reshape(-1, 2)
        self._token, self._size = flat[:, 0].copy(), flat[:, 1].copy()
        self._length = np.ones(vocabulary.size + 1, np.int64)  # the last one is UNKNOWN's
        for r, n in vocabulary.length.items():
            self._length[r] = n
        self._steps, self._pairs = IntTable(), IntTable()

    def last_tokens(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' order by falling length, their lengths in that order, and the table by position and word."""
        v, data = self.vocabulary, np.frombuffer(b"".join(words), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lengths, kind="stable")
        starts, sizes = (np.cumsum(lengths) - lengths)[order], lengths[order]
        last = np.full((int(sizes[0]), len(words)), UNKNOWN, np.int32)
        node = np.zeros(len(words), np.int64)
        for table in (self._steps, self._pairs):
            if table.size > self._limit:
                table.__init__()
        for j in range(len(last)):
            m = int(np.searchsorted(-sizes, -j, "left"))  # words longer than j
            node[:m] = self._steps.get_or(node[:m] << 21 | data[starts[:m] + j], lambda k: v.step(k >> 21, k & 0x1FFFFF))
            left, at, stop = np.arange(m), self._at[node[:m]], self._at[node[:m] + 1]
            while True:
                more = at < stop
                left, at, stop = left[more], at[more], stop[more]
                if not len(left):
                    break
                t, start = self._token[at], j + 1 - self._size[at]
                before = last[start - 1, left].astype(np.int64)
                good = (start == 0) | (before < 0)
                (ask,) = np.nonzero(~good)
                good[ask] = self._pairs.get_or(before[ask] * v.size + t[ask], lambda k: int(v.valid(*divmod(k, v.size)))) == 1
                last[j, left[good]] = t[good]
                bad = ~good
                left, at, stop = left[bad], at[bad] + 1, stop[bad]
        return order, sizes, last

    def encode(self, words: list[bytes]) -> Ragged:
        """The ids of each word, read off the tables from their ends."""
        if not words:
            return Ragged(np.zeros(0, "<u4"), np.zeros(0, np.int64))
        order, sizes, last = self.last_tokens(words)
        at, lane, found = sizes - 1, np.arange(len(words)), []
        n = np.zeros(len(words), np.int64)
        while len(lane):
            t = last[at, lane]
            found.append((lane, t))
            n[lane] += 1
            at = at - self._length[t]
            left = at >= 0
            at, lane = at[left], lane[left]
        ends = np.cumsum(n)
        flat = np.empty(int(ends[-1]), "<u4")
        for k, (lane, t) in enumerate(found):
            flat[ends[lane] - 1 - k] = t
        return Ragged(flat, n).take(np.argsort(order, kind="stable"))
