"""Lines that many documents share are dropped from all but one of them; Bloom filters find whom to ask.

Two Bloom filters tell which line hashes were seen once and which twice. Every task fills its own pair of ``filter_bits``
bits; pairs merge by ``once = once | other.once`` and ``twice = twice | other.twice | once & other.once``, block by block, so a
hash that two documents hold is always in ``twice``. That filter, of fixed size, goes to all tasks, and only lines in it
are shuffled, as 128-bit digests with their document: these are counted exactly and get the greatest id that holds them. A full filter
lets more lines through, and never loses one, so the result doesn't depend on its size.

Repeated keys of at most ``keys_sent`` (counted before) go to all tasks, which drop lines while they read the texts once more. With more of
them, each document's keys to drop are found by joins and meet their text by a shuffle, with equal results.

Defined cases: a null text is one empty line. Documents are told apart by id: rows of one id are one document, whether their texts are equal or not,
and each of them keeps the lines whose greatest holder is that id. A null id counts as no document, and rows of it keep no line
that is repeated enough among the others. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loxodrome.llm.frames import known_texts, map_batches, narrow, per_slice, slices
from loxodrome.llm.text_arrays import LOWER, SPACED, column_bytes, hash_spans
from loxodrome.llm.workspace import Workspace

#: Bits of each filter, a power of two; two filters of 32 MiB in a task, one goes to all.
FILTER_BITS = 1 << 28
#: Bits of a block: a block's positions are 16-bit integers.
BLOCK_BITS = 1 << 16
#: Repeated keys of at most so many (32 bytes each) are sent to all tasks.
KEYS_SENT = 1_000_000
SCHEMA = "id long, n_lines long, n_dropped long, kept_sha256 string"


class Lines(NamedTuple):
    """Lines of a run of texts: bounds in ``data`` of the lines and of their keys, the lines' text, the keys that are long enough with their hashes."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    key_starts: np.ndarray
    key_ends: np.ndarray
    text: np.ndarray
    long: np.ndarray  # numbers of lines
    hashes: np.ndarray  # of the long lines' keys
    lowered: np.ndarray

    def digest(self, line: int) -> bytes:
        return hashlib.blake2b(self.lowered[self.key_starts[line] : self.key_ends[line]].tobytes(), digest_size=16).digest()

    def distinct(self) -> np.ndarray:
        """Of the long lines (by their place among them), one of each hash in each text."""
        doc = self.text[self.long]
        order = np.lexsort((self.hashes, doc))
        h, d = self.hashes[order], doc[order]
        return order[np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])] if len(order) else order


def lines_of(texts: pa.Array, shortest: int) -> Lines:
    data, offsets = column_bytes(texts)
    breaks = np.nonzero(data == 0x0A)[0]
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    # a text's first line begins where it does, so lines are numbered by how many texts begin up to there; empty texts have one each
    per = 1 + np.diff(np.searchsorted(breaks, offsets))
    text = np.repeat(np.arange(len(texts)), per)
    solid = np.nonzero(SPACED[data])[0]
    lo, hi = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    full = hi > lo
    key_starts, key_ends = starts.copy(), starts.copy()
    key_starts[full], key_ends[full] = solid[lo[full]], solid[hi[full] - 1] + 1
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    long = np.nonzero(points[key_ends] - points[key_starts] >= max(1, shortest))[0]
    lowered = LOWER[data]
    return Lines(data, starts, ends, key_starts, key_ends, text, long, hash_spans(lowered, key_starts[long], key_ends[long]), lowered)


class Filter:
    """A Bloom filter with two positions for each hash."""

    def __init__(self, bits: int, packed: np.ndarray | None = None):
        if bits % BLOCK_BITS or bits & (bits - 1) or bits > 1 << 32:
            raise ValueError(f"filter bits must be a power of two from {BLOCK_BITS} to {1 << 32}")
        self.bits = bits
        self.packed = np.zeros(bits >> 3, np.uint8) if packed is None else packed

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(self.bits - 1)
        return tuple((h & mask).astype(np.int64) for h in (hashes, hashes >> np.uint64(32)))

    def add(self, hashes: np.ndarray) -> None:
        for p in self.places(hashes):
            byte, bit = p >> 3, p & 7
            for b in range(8):
                self.packed[byte[bit == b]] |= np.uint8(1 << b)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        a, b = (self.packed[p >> 3] >> (p & 7).astype(np.uint8) & 1 for p in self.places(hashes))
        return (a & b).astype(bool)

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        """Blocks with any bit: positions where they are few, else the bits."""
        filled = np.nonzero(self.packed)[0]
        if not len(filled):
            return
        size = BLOCK_BITS >> 3
        at = np.append(np.nonzero(np.diff(filled // size, prepend=-1))[0], len(filled))
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            k = int(filled[lo]) // size
            block = self.packed[k * size : (k + 1) * size]
            set_ = np.nonzero(np.unpackbits(block, bitorder="little"))[0]
            yield k, (set_.astype("<u2").tobytes() if 2 * len(set_) < size else block.tobytes())


def block_bits(stored: bytes) -> np.ndarray:
    """A block's bits from how :meth:`Filter.blocks` stored it."""
    size = BLOCK_BITS >> 3
    if len(stored) == size:
        return np.frombuffer(stored, np.uint8).copy()
    bits = np.zeros(BLOCK_BITS, np.uint8)
    bits[np.frombuffer(stored, "<u2")] = 1
    return np.packbits(bits, bitorder="little")


def seen_twice(texts: DataFrame, shortest: int, bits: int) -> DataFrame:
    """``block, twice``: the merged filter of hashes that two rows hold."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = Filter(bits), Filter(bits)
        for batch in batches:
            for part in slices(known_texts(batch.column(0))):
                found = lines_of(part, shortest)
                h, n = np.unique(found.hashes[found.distinct()], return_counts=True)
                twice.add(h[(n > 1) | once.holds(h)])
                once.add(h)
        again = dict(twice.blocks())
        rows = [(k, b, again.get(k, b"")) for k, b in once.blocks()]
        for i in range(0, len(rows), 512):
            k, a, b = zip(*rows[i : i + 512], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["block", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block; only one block's two filters are held."""
        at, once, twice = None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([twice.tobytes()], pa.binary())], names=["block", "twice"])

        for batch in batches:
            for k, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                a, b = block_bits(a), block_bits(b)
                if k != at:
                    if at is not None and twice.any():
                        yield done()
                    at, once, twice = k, a, b
                else:
                    twice |= b | (once & a)
                    once |= a
        if at is not None and twice.any():
            yield done()

    filled = map_batches(texts, fill, "block int, once binary, twice binary")
    return map_batches(filled.repartition("block").sortWithinPartitions("block"), merge, "block int, twice binary")


def suspects(docs: DataFrame, shortest: int, bits: int, twice, keep_row: bool) -> DataFrame:
    """``row, id, hash, digest`` of lines in the filter, once for each row; ``row`` is null unless asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Filter(bits, np.frombuffer(twice.value, np.uint8))
        for batch in batches:
            at = 0
            for part in slices(known_texts(batch.column(2))):
                found = lines_of(part, shortest)
                asked = np.nonzero(held.holds(found.hashes))[0]
                line = found.long[asked]
                once = dict(((t, found.digest(i)), h) for i, t, h in zip(line.tolist(), found.text[line].tolist(), found.hashes[asked].view(np.int64).tolist(), strict=True))
                at_row = pa.array([at + t for t, _ in once], pa.int64())
                at += len(part)
                row = batch.column(0).take(at_row) if keep_row else pa.nulls(len(once), pa.binary())
                digests = pa.array([d for _, d in once], pa.binary())
                yield pa.RecordBatch.from_arrays([row, batch.column(1).take(at_row), pa.array(once.values(), pa.int64()), digests], names=["row", "id", "hash", "digest"])

    return map_batches(docs, run, "row binary, id long, hash long, digest binary")


def _kept(found: Lines, n_rows: int, drop: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
    """Figures of each row, without the lines in ``drop``."""
    n_lines = np.bincount(found.text, minlength=n_rows)
    n_dropped = np.bincount(found.text[drop], minlength=n_rows)
    first = np.cumsum(n_lines) - n_lines
    view, starts, ends, digests = memoryview(found.data), found.starts, found.ends, []
    for i in range(n_rows):
        lo, hi = int(first[i]), int(first[i] + n_lines[i])
        if n_dropped[i]:
            stay = [view[starts[k] : ends[k]] for k in range(lo, hi) if not drop[k]]
            digests.append(hashlib.sha256(b"\n".join(stay)).hexdigest())
        else:
            digests.append(hashlib.sha256(view[starts[lo] : ends[hi - 1]]).hexdigest())
    return pa.RecordBatch.from_arrays([ids, pa.array(n_lines), pa.array(n_dropped), pa.array(digests, pa.string())], names=["id", "n_lines", "n_dropped", "kept_sha256"])


def drop_lines(
    df: DataFrame, shortest: int = 40, documents: int = 5, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = FILTER_BITS, keys_sent: int = KEYS_SENT, workspace: Workspace | None = None
) -> DataFrame:
    """``id_col``, n_lines, n_dropped, kept_sha256 for every row, without the lines of keys that ``documents`` (two at least) documents hold."""
    if documents < 2:
        raise ValueError("a line that one document holds is not repeated")
    spark, work = df.sparkSession, workspace or Workspace(df.sparkSession)
    docs = narrow(df, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blocks = work.save(seen_twice(docs.select("text"), shortest, filter_bits), "twice")
    packed = np.zeros(filter_bits >> 3, np.uint8)
    size = BLOCK_BITS >> 3
    table = blocks.toArrow()  # as large as the filter at most
    for k, bits in zip(table.column("block").to_pylist(), table.column("twice").to_pylist(), strict=True):
        packed[k * size : (k + 1) * size] = np.frombuffer(bits, np.uint8)
    twice = spark.sparkContext.broadcast(packed.tobytes())
    named = docs.select(F.lit(None).cast("binary").alias("row"), "id", "text")
    seen = suspects(named, shortest, filter_bits, twice, keep_row=False)
    repeated = seen.groupBy("digest").agg(F.count_distinct("id").alias("holders"), F.max("id").alias("last"), F.max("hash").alias("hash")).filter(F.col("holders") >= documents)
    repeated = work.save(repeated.select("digest", "hash", "last"), "repeated")
    if repeated.count() <= keys_sent:
        out = _dropped_by_table(docs, shortest, repeated)
    else:
        out = _dropped_by_joins(docs, shortest, filter_bits, twice, repeated)
    return out.select(F.col("id").alias(id_col), "n_lines", "n_dropped", "kept_sha256")


def _dropped_by_table(docs: DataFrame, shortest: int, repeated: DataFrame) -> DataFrame:
    table = repeated.toArrow().sort_by("hash")
    columns = table.column("hash").to_numpy(), table.column("last").to_numpy(), b"".join(table.column("digest").to_pylist())
    sent = docs.sparkSession.sparkContext.broadcast(columns)

    def make():
        hashes, last, digests = sent.value

        def work(rows: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
            found = lines_of(texts, shortest)
            drop = np.zeros(len(found.starts), bool)
            mine = found.hashes.view(np.int64)
            lo, hi = np.searchsorted(hashes, mine), np.searchsorted(hashes, mine, "right")
            own = rows.column(0).to_pylist()
            for j in np.nonzero(hi > lo)[0].tolist():
                line = int(found.long[j])
                digest = found.digest(line)
                for k in range(lo[j], hi[j]):  # more than one where hashes collide
                    if digests[16 * k : 16 * k + 16] == digest:
                        drop[line] = own[found.text[line]] != last[k]
            return _kept(found, len(texts), drop, rows.column(0))

        return work

    return per_slice(docs, SCHEMA, "text", make)


def _dropped_by_joins(docs: DataFrame, shortest: int, bits: int, twice, repeated: DataFrame) -> DataFrame:
    """Rows are named by a digest of id and text; equal rows drop the same lines."""
    named = docs.select(F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("text")).cast("binary"))).alias("row"), "id", "text")
    held = suspects(named, shortest, bits, twice, keep_row=True).join(repeated.select("digest", "last"), "digest").filter(~F.col("id").eqNullSafe(F.col("last")))
    # a row's own distinct lines, once also where the row stands several times
    drops = held.groupBy("row").agg(F.collect_set("digest").alias("drops"))
    joined = named.join(drops, "row", "left").select("id", "text", F.coalesce("drops", F.array().cast("array<binary>")).alias("drops"))

    def make():
        def work(rows: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
            found = lines_of(texts, shortest)
            drop = np.zeros(len(found.starts), bool)
            gone = [set(x) for x in rows.column(2).to_pylist()]
            for line in found.long.tolist():
                drop[line] = bool(gone[found.text[line]]) and found.digest(line) in gone[found.text[line]]
            return _kept(found, len(texts), drop, rows.column(0))

        return work

    return per_slice(joined, SCHEMA, "text", make)


ORACLE = """
WITH x AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, t, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS nth FROM x),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
d AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.last AS dropped FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(dropped AS INTEGER)) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(CASE WHEN NOT dropped THEN line END, chr(10) ORDER BY nth), '')) AS kept_sha256 FROM d GROUP BY doc_id
"""
