"""Cross-tokenizer alignment: where two tokenizers cut the same text at the same byte, and which of their tokens overlap.

Texts of a slice of an Arrow batch stand one after another, with the documents' byte offsets. The ends of all A tokens
and of all B tokens are counted by byte, once for each tokenizer; a group ends where both have an end. Between two
neighbouring ends of either kind lies a part of just one A token and one B token, so those parts are the links. Running sums over
the bytes give every part its tokens' numbers, and differences of running sums at the documents' bounds give each document its figures.

Three passes over the documents: the first encodes and writes ids; the second counts pairs of ids, summed in every slice
before they are shuffled; the third finds each document's figures. Pair counts of at most ``pairs_sent`` pairs (counted before) go to all tasks
as sorted arrays. Beyond that, each document's distinct pairs are shuffled to the counts instead, with equal results.

Defined cases: texts that are null or empty, or that a tokenizer's tokens don't give back (the space mark itself, say), have no
tokens: all figures 0, an empty digest, no share in the corpus counts. Every row counts, repeated ones too, under whatever
id, null ones as well. Other columns are ignored. An empty table gives no rows. Texts of any length are worked on whole.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loxodrome.llm.frames import SLICE_BYTES, map_batches, narrow, per_slice, resident, slices
from loxodrome.llm.memo import Memo, Ragged, pieces
from loxodrome.llm.text_arrays import byte_class, column_bytes
from loxodrome.llm.workspace import Workspace

#: Bytes after which a space may stand inside a match of A's pattern: white space, separators, first bytes of spaces beyond ASCII.
_STAY = byte_class([*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3])
_SPACE, _MARK = 0x20, "▁"
#: Pair counts of so many pairs at most (17 bytes each) are sent to all tasks.
PAIRS_SENT = 4_000_000
FIGURES = "n_a long, n_b long, n_groups long, n_links long"


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from 256 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and b != _SPACE]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def _table(entries: dict[int, bytes]) -> Ragged:
    """The bytes of each id; an id without an entry has none."""
    rows = [entries.get(i, b"") for i in range(max(entries) + 1)]
    return Ragged(np.frombuffer(b"".join(rows), np.uint8), np.fromiter(map(len, rows), np.int64, len(rows)))


class Pair:
    """Both tokenizers of one process: ids of whole columns, and the bytes of every id."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(a_file)
        self._a.no_truncation()
        self._a.no_padding()
        self._a.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        letters = byte_level()
        special = set(self._a.get_added_tokens_decoder())
        self.a_bytes = _table({i: bytes(letters[c] for c in t) for t, i in self._a.get_vocab(with_added_tokens=False).items() if i not in special})
        self.b_bytes = _table({i: self._piece(i) for i in range(self._b.get_piece_size())})
        self._alone = self._b.piece_to_id(_MARK)
        self._a_memo, self._b_memo = Memo(self._learn_a, "<u4", 40 << 20), Memo(self._learn_b, "<u4", 40 << 20)

    @classmethod
    def load(cls, a_file: str, b_file: str) -> Pair:
        return resident(("pair", a_file, b_file), lambda: cls(a_file, b_file))

    def _piece(self, i: int) -> bytes:
        piece = self._b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self._b.is_byte(i) else piece.replace(_MARK, " ").encode()

    def _learn_a(self, segments: list[bytes]) -> Ragged:
        found = [e.ids for e in self._a.encode_batch_fast([s.decode() for s in segments], add_special_tokens=False)]
        return self._ragged(found)

    def _learn_b(self, segments: list[bytes]) -> Ragged:
        """The library sets a space mark before each; of a lone space that is all there is, and the library leaves it out."""
        found = self._b.encode([s[1:].decode() for s in segments], num_threads=1)
        return self._ragged([x if s != b" " else [self._alone] for s, x in zip(segments, found, strict=True)])

    @staticmethod
    def _ragged(rows: list[list[int]]) -> Ragged:
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        return Ragged(np.fromiter((i for r in rows for i in r), "<u4", int(sizes.sum())), sizes)

    @staticmethod
    def _by_segments(memo: Memo, data: np.ndarray, offsets: np.ndarray, fresh: np.ndarray) -> Ragged:
        """Ids of each text. Neither tokenizer has a token across the beginning of a fresh segment, nor does it look beyond."""
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = fresh
        cut[offsets] = True
        bounds = np.nonzero(cut)[0]
        ids = memo.rows(pieces(data, bounds))
        ends = np.concatenate([[0], np.cumsum(ids.sizes)])[np.searchsorted(bounds, offsets)]
        return Ragged(ids.flat, np.diff(ends))

    def encode(self, texts: pa.Array) -> tuple[Ragged, Ragged]:
        """A's and B's ids of texts that begin with a space; no ids for those that either doesn't give back."""
        data, offsets = column_bytes(texts)
        if not len(data):
            none = Ragged(np.zeros(0, "<u4"), np.zeros(len(texts), np.int64))
            return none, none
        space, before = data[1:] == _SPACE, data[:-1]
        after = np.append(data[2:], np.uint8(_SPACE))
        a = self._by_segments(self._a_memo, data, offsets, space & ~_STAY[after])
        b = self._by_segments(self._b_memo, data, offsets, space & (before != _SPACE))
        good = self._gives_back(self.a_bytes, a, data, offsets) & self._gives_back(self.b_bytes, b, data, offsets)
        return tuple(x if good.all() else _where(x, good) for x in (a, b))

    @staticmethod
    def _gives_back(table: Ragged, ids: Ragged, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        got, sizes = table.take(ids.flat), np.diff(offsets)
        good = _per_row(got.sizes, ids.sizes) == sizes
        if not good.all():
            data, got = Ragged(data, sizes).take(np.nonzero(good)[0]).flat, table.take(_where(ids, good).flat)
        kept = np.nonzero(good)[0]
        differ = np.nonzero(got.flat != data)[0]
        good[kept[np.searchsorted(np.cumsum(sizes[kept]), differ, "right")]] = False
        return good


def _where(ids: Ragged, good: np.ndarray) -> Ragged:
    return Ragged(ids.flat[np.repeat(good, ids.sizes)], np.where(good, ids.sizes, 0))


def _per_row(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums over each row's values: differences of one running sum."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[np.concatenate([[0], np.cumsum(sizes)])])


class Aligned(NamedTuple):
    """Groups and links of a slice of documents."""

    group_a: np.ndarray  # the group of each A token
    group_b: np.ndarray
    link_a: np.ndarray  # the A token of each link, by its place in the slice
    link_b: np.ndarray
    groups: np.ndarray  # of each document, how many
    links: np.ndarray


def align(a_sizes: np.ndarray, b_sizes: np.ndarray, sizes: np.ndarray) -> Aligned:
    """From the bytes of each token of a slice and of each document (those of its tokens)."""
    n = int(sizes.sum())
    at_a = np.bincount(np.cumsum(a_sizes), minlength=n + 1)
    at_b = np.bincount(np.cumsum(b_sizes), minlength=n + 1)
    both, any_ = (at_a & at_b).astype(bool), (at_a | at_b).astype(bool)
    ends = np.nonzero(any_)[0]
    run_both, run_any = np.cumsum(both), np.cumsum(any_)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    # the tokens that hold the byte before an end: as many ends stand before that byte's own end
    link_a, link_b = (np.cumsum(x)[ends - 1] for x in (at_a, at_b))
    group_a, group_b = (run_both[np.cumsum(s) - 1] for s in (a_sizes, b_sizes))
    return Aligned(group_a, group_b, link_a, link_b, np.diff(run_both[bounds]), np.diff(run_any[bounds]))


class _Digits:
    """Texts of ids with what follows them: within a group a comma, after it another mark."""

    def __init__(self, n_a: int, n_b: int):
        rows = [f"{i}{c}".encode() for n, last in ((n_a, "|"), (n_b, ";")) for i in range(n) for c in (",", last)]
        self._rows, self._b = Ragged(np.frombuffer(b"".join(rows), np.uint8), np.fromiter(map(len, rows), np.int64, len(rows))), 2 * n_a

    def written(self, a: np.ndarray, b: np.ndarray, found: Aligned, n_a: np.ndarray, n_b: np.ndarray) -> list[memoryview]:
        """Each document's groups; documents without tokens have an empty one."""
        total = int(found.groups.sum())
        in_a, in_b = (np.bincount(g, minlength=total) for g in (found.group_a, found.group_b))
        first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        start = first_a + first_b
        nth_a = np.arange(len(a)) - first_a[found.group_a]
        nth_b = np.arange(len(b)) - first_b[found.group_b]
        rows = np.empty(len(a) + len(b), np.int64)
        rows[start[found.group_a] + nth_a] = 2 * a.astype(np.int64) + (nth_a == in_a[found.group_a] - 1)
        rows[start[found.group_b] + in_a[found.group_b] + nth_b] = self._b + 2 * b.astype(np.int64) + (nth_b == in_b[found.group_b] - 1)
        text = self._rows.take(rows)
        stops = np.cumsum(_per_row(text.sizes, n_a + n_b)).tolist()
        view = memoryview(text.flat.tobytes())
        return [view[x : y - 1] if y > x else view[:0] for x, y in zip([0, *stops[:-1]], stops, strict=True)]


def _stored(df: DataFrame, a_file: str, b_file: str, id_col: str, text_col: str) -> DataFrame:
    """Each row's number, id, and its A and B ids as unsigned 32-bit integers."""

    def make():
        pair = Pair.load(a_file, b_file)

        def lists(ids: Ragged) -> pa.Array:
            return pieces(ids.flat.astype("<u4").view(np.uint8), np.concatenate([[0], np.cumsum(ids.sizes)]) * 4)

        def work(rows: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
            data, offsets = column_bytes(texts)
            sizes = np.diff(offsets)
            full = sizes > 0
            spaced = np.full(len(data) + int(full.sum()), _SPACE, np.uint8)
            spaced[np.arange(len(data)) + np.repeat(np.cumsum(full), sizes)] = data
            a, b = pair.encode(pieces(spaced, np.concatenate([[0], np.cumsum(sizes + full)])))
            return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), lists(a), lists(b)], names=["row", "id", "a", "b"])

        return work

    numbered = narrow(df, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return per_slice(numbered, "row long, id long, a binary, b binary", "text", make, keeps=True)


class _Slice(NamedTuple):
    """Rows of the stored table with their links."""

    row: pa.Array
    id: pa.Array
    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    found: Aligned

    def keys(self, width: int) -> np.ndarray:
        """Each link's pair of ids, as one number."""
        return self.a[self.found.link_a].astype(np.int64) * width + self.b[self.found.link_b]


def _slices(batches: Iterator[pa.RecordBatch], a_size: np.ndarray, b_size: np.ndarray) -> Iterator[_Slice]:
    for batch in batches:
        at = 0
        for part in slices(batch.column(2), SLICE_BYTES):
            rows = batch.slice(at, len(part))
            at += len(part)
            (a, a_off), (b, b_off) = (column_bytes(rows.column(k)) for k in (2, 3))
            a, b = a.view("<u4"), b.view("<u4")
            n_a, n_b = np.diff(a_off) // 4, np.diff(b_off) // 4
            sizes_a = a_size[a]
            yield _Slice(rows.column(0), rows.column(1), a, b, n_a, n_b, align(sizes_a, b_size[b], _per_row(sizes_a, n_a)))


def _summed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def alignment(
    df: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", pairs_sent: int = PAIRS_SENT, workspace: Workspace | None = None
) -> DataFrame:
    """For every row: ``id_col``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``n_best`` counts the links whose pair is the most frequent of its B id in the whole table, ``count_sum`` sums the links' pair counts.
    """
    work = workspace or Workspace(df.sparkSession)
    pair = Pair(a_file, b_file)
    a_size, b_size = pair.a_bytes.sizes, pair.b_bytes.sizes
    stored = work.save(_stored(df, a_file, b_file, id_col, text_col), "ids")
    counts = work.save(pair_counts(stored, a_size, b_size), "pairs")
    width, known = len(b_size), counts.count()
    # the most frequent of each B id: as many rows as B has ids at most
    top = counts.groupBy((F.col("pair") % width).alias("b")).agg(F.max("n").alias("most"))
    counts = counts.join(F.broadcast(top), F.col("pair") % width == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    if known <= pairs_sent:
        table = counts.toArrow().sort_by("pair")
        sent = df.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))
        out = _figures(stored, a_size, b_size, sent)
    else:
        own = map_batches(stored, lambda batches: _own_pairs(batches, a_size, b_size), "row long, pair long, k long")
        met = own.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("n_best"), F.sum(F.col("k") * F.col("n")).alias("count_sum"))
        out = _figures(stored, a_size, b_size, None).drop("n_best", "count_sum").join(met, "row", "left").fillna(0, ["n_best", "count_sum"])
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def pair_counts(stored: DataFrame, a_size: np.ndarray, b_size: np.ndarray) -> DataFrame:
    """``pair`` (A id times B's size, plus B id) and ``n``: how many links of all documents hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0

        def summed() -> pa.RecordBatch:
            keys = np.concatenate([k for k, _ in held])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], np.concatenate([n for _, n in held])[order]
            first = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
            return pa.RecordBatch.from_arrays([pa.array(keys[first]), pa.array(np.add.reduceat(n, first))], names=["pair", "n"])

        for s in _slices(batches, a_size, b_size):
            if not len(s.found.link_a):
                continue
            held.append(_summed(s.keys(len(b_size))))
            waiting += len(held[-1][0])
            if waiting > 1 << 20:
                yield summed()
                held, waiting = [], 0
        if held:
            yield summed()

    return map_batches(stored, run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _own_pairs(batches: Iterator[pa.RecordBatch], a_size: np.ndarray, b_size: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each document's distinct pairs and how many of its links have them."""
    for s in _slices(batches, a_size, b_size):
        keys, doc = s.keys(len(b_size)), np.repeat(np.arange(len(s.row)), s.found.links)
        if not len(keys):
            continue
        order = np.lexsort((keys, doc))
        keys, doc = keys[order], doc[order]
        first = np.nonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])]))[0]
        k = np.diff(np.append(first, len(keys)))
        yield pa.RecordBatch.from_arrays([s.row.take(pa.array(doc[first])), pa.array(keys[first]), pa.array(k)], names=["row", "pair", "k"])


def _figures(stored: DataFrame, a_size: np.ndarray, b_size: np.ndarray, sent) -> DataFrame:
    """All figures of each row; without the counts those that need them are 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = _Digits(len(a_size), len(b_size))
        for s in _slices(batches, a_size, b_size):
            found, best, total = s.found, np.zeros(len(s.row), np.int64), np.zeros(len(s.row), np.int64)
            if sent is not None and len(found.link_a):
                pairs, n, is_best = sent.value
                at = np.searchsorted(pairs, s.keys(len(b_size)))
                best, total = _per_row(is_best[at], found.links), _per_row(n[at], found.links)
            texts = digits.written(s.a, s.b, found, s.n_a, s.n_b)
            digests = [hashlib.sha256(t).hexdigest() if len(t) else "" for t in texts]
            columns = [s.row, s.id, *map(pa.array, (s.n_a, s.n_b, found.groups, found.links, best, total)), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return map_batches(stored, run, f"row long, id long, {FIGURES}, n_best long, count_sum long, groups_sha256 string")
