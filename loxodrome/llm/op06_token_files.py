"""Token ids in packed binary files: fixed width, block offsets, random access.

Each id takes the least number of bits that holds the vocabulary. A file has the ids of a run of documents in
ascending id order, in blocks of whole documents that begin on a byte:

========  =======================================================================================
payload   blocks of packed ids, least significant bit first
index     documents' doc_id i64 (0 for null), their lengths u64, blocks' first documents u64, their byte offsets
          u64, documents' null flags u8 (1 for a null doc_id)
header    magic ``LXPK``, version u16, bits u16, documents u64, ids u64, blocks u64
footer    offset of the index u64, magic ``LXPK``
========  =======================================================================================

All numbers are little-endian. A reader takes the end of the file, and unpacks any document from its block alone.

Files are written from the executors into the shared folder under names that no other attempt uses; a manifest,
written by Spark's own commit protocol, names those that count. Lost executors and repeated attempts leave at most
files that nothing refers to.

Defined cases: a null text is empty (only the end id); null doc_ids are kept as such and stand before all others; repeated doc_ids stand next to each
other, ordered by a digest of the text; other columns are ignored; a very long text is a block of its own; an empty table gives no files.
"""

from __future__ import annotations

import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loxodrome.llm.frames import SLICE_BYTES, known_texts, map_batches, narrow, resident, slices
from loxodrome.llm.memo import Memo, Ragged, pieces
from loxodrome.llm.text_arrays import KIND, LOWER, OTHER, column_bytes
from loxodrome.llm.workspace import Workspace

MAGIC, VERSION, _HEAD, _FOOT = b"LXPK", 2, struct.Struct("<4sHHQQQ"), struct.Struct("<Q4s")
#: Kinds of bytes as in text_arrays, and gaps that the model drops.
_GAP = 3
_KINDS = KIND.copy()
_KINDS[list(b" \n")] = _GAP
#: Words of one call of the library.
_AT_ONCE = 4000


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Fixed-width packing; the last byte is filled with zeros."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int, skip: int = 0) -> np.ndarray:
    """``n`` ids after the first ``skip`` ones."""
    if bits == 16:
        return np.frombuffer(data, "<u2", n, skip * 2).astype(np.uint32)
    at = (np.arange(skip, skip + n, dtype=np.int64) * bits)[:, None] + np.arange(bits)
    raw = np.frombuffer(data, np.uint8)
    return ((((raw[at >> 3] >> (at & 7)) & 1).astype(np.uint32)) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def _settled(word: str) -> bool:
    """Whether the model's normaliser leaves letters of a word letters."""
    return word.lower().isalpha() and unicodedata.is_normalized("NFC", word)


class PackedWriter:
    """Streams documents into one file. Only the index is held in memory."""

    def __init__(self, sink, bits: int, block_ids: int = 1 << 16):
        self._sink, self.bits, self._limit = sink, bits, block_ids
        self._docs, self._lengths, self._firsts, self._offsets = [], [], [], []
        self._open, self._held, self._at, self.ids = [], 0, 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.extend([doc_id], Ragged(ids, np.array([len(ids)], np.int64)))

    def extend(self, doc_ids: list[int | None], ids: Ragged) -> None:
        """Many documents at once; blocks end where they would if added one by one."""
        ends, sizes, at = np.cumsum(ids.sizes), ids.sizes.tolist(), 0
        while at < len(doc_ids):
            if not self._open:
                self._firsts.append(len(self._docs))
                self._offsets.append(self._at)
            base = int(ends[at - 1]) if at else 0
            stop = min(len(doc_ids), int(np.searchsorted(ends, base + self._limit - self._held)) + 1)
            self._docs += doc_ids[at:stop]
            self._lengths += sizes[at:stop]
            self._open.append(ids.flat[base : int(ends[stop - 1])])
            self._held += int(ends[stop - 1]) - base
            at = stop
            if self._held >= self._limit:
                self._flush()
        self.ids += len(ids.flat)

    def _flush(self) -> None:
        data = pack(np.concatenate(self._open), self.bits)
        self._sink.write(data)
        self._at += len(data)
        self._open, self._held = [], 0

    def close(self) -> None:
        if self._open:
            self._flush()
        docs, nulls = [0 if i is None else i for i in self._docs], [i is None for i in self._docs]
        for column, kind in ((docs, "<i8"), (self._lengths, "<u8"), (self._firsts, "<u8"), (self._offsets, "<u8"), (nulls, "u1")):
            self._sink.write(np.array(column, kind).tobytes())
        self._sink.write(_HEAD.pack(MAGIC, VERSION, self.bits, len(self._docs), self.ids, len(self._firsts)))
        self._sink.write(_FOOT.pack(self._at, MAGIC))
        self._sink.close()


class PackedReader:
    """Random access over an open file; a block at a time is in memory."""

    def __init__(self, source):
        self._source, size = source, source.size()
        source.seek(size - _FOOT.size - _HEAD.size)
        tail = source.read(_FOOT.size + _HEAD.size)
        magic, version, self.bits, docs, self.ids, blocks = _HEAD.unpack_from(tail)
        self._index, end = _FOOT.unpack_from(tail, _HEAD.size)
        if magic != MAGIC or end != MAGIC or version != VERSION:
            raise ValueError("not a packed token file")
        source.seek(self._index)
        read = lambda kind, n: np.frombuffer(source.read(8 * n), kind)
        self.docs, self.lengths = read("<i8", docs), read("<u8", docs).astype(np.int64)
        self.firsts, self._offsets = read("<u8", blocks).astype(np.int64), read("<u8", blocks).astype(np.int64)
        self.nulls = np.frombuffer(source.read(docs), "u1").astype(bool)
        self._starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self._block, self._data = -1, b""

    def __len__(self) -> int:
        return len(self.docs)

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of block after block, the documents' lengths and all their ids."""
        for first, stop in zip(self.firsts.tolist(), [*self.firsts[1:].tolist(), len(self)], strict=True):
            self[first]
            yield self.lengths[first:stop], unpack(self._data, self.bits, int(self._starts[stop] - self._starts[first]))

    def __getitem__(self, i: int) -> np.ndarray:
        block = int(np.searchsorted(self.firsts, i, "right")) - 1
        if block != self._block:
            stop = self._offsets[block + 1] if block + 1 < len(self._offsets) else self._index
            self._source.seek(int(self._offsets[block]))
            self._block, self._data = block, self._source.read(int(stop - self._offsets[block]))
        return unpack(self._data, self.bits, int(self.lengths[i]), int(self._starts[i] - self._starts[self.firsts[block]]))


class WordEncoder:
    """A tokenizers model that drops white space, fed part by part.

    Normalisation, splitting and merges of such a model never cross a space or line end, nor a place where an ASCII
    letter or digit meets ASCII punctuation (the apostrophe, which begins contractions, apart). So a text's ids are
    those of the parts between such places. A column of texts is cut in numpy, and only distinct parts that a bounded
    memo lacks go through the library, many in a call.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.vocabulary = self.model.get_vocab_size(with_added_tokens=True)
        self._memo = Memo(self._learn, "<u4", limit=64 << 20)
        self._ends = np.zeros(self.vocabulary, bool)  # tokens that end a match
        for token, i in self.model.get_vocab(with_added_tokens=False).items():
            self._ends[i] = token.endswith("</w>")
        self._marks = [t.content for t in self.model.get_added_tokens_decoder().values()]

    @classmethod
    def load(cls, path: str) -> WordEncoder:
        return resident(("words", path), lambda: cls(path))

    def encode(self, texts: pa.Array) -> Ragged:
        """The ids of each text. A text that holds a special token's string goes through the library as it is."""
        marked = np.zeros(len(texts), bool)
        for m in self._marks:
            marked |= pc.match_substring(texts, m).to_numpy(zero_copy_only=False)
        data, offsets = column_bytes(texts)
        parts, first = _parts(data, offsets)
        ids = self._memo.rows(parts)
        ends = np.concatenate([[0], np.cumsum(ids.sizes)])
        sizes = ends[first[1:]] - ends[first[:-1]]
        if not marked.any():
            return Ragged(ids.flat, sizes)
        starts = ends[first[:-1]]
        rows = [ids.flat[a : a + n] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
        for i in np.nonzero(marked)[0].tolist():
            rows[i] = np.array(self.model.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4")
        return Ragged(np.concatenate(rows), np.fromiter(map(len, rows), np.int64, len(rows)))

    def _learn(self, parts: list[bytes]) -> Ragged:
        words = [p.decode() for p in parts]
        plain = np.fromiter((w.isalpha() and (w.isascii() or _settled(w)) for w in words), bool, len(words))
        order, found = [], []
        for kind, encode in ((plain, self._plain), (~plain, self._together)):
            (which,) = np.nonzero(kind)
            for lo in range(0, len(which), _AT_ONCE):
                part = which[lo : lo + _AT_ONCE]
                order.append(part)
                found.append(encode([words[i] for i in part.tolist()]))
        return Ragged.joined(found).take(np.argsort(np.concatenate(order), kind="stable"))

    def _plain(self, words: list[str]) -> Ragged:
        """Words of letters are one match each, so a word ends with each token that ends a match."""
        ids = np.array(self.model.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        return Ragged(ids, np.diff(np.concatenate([[0], np.nonzero(self._ends[ids])[0] + 1])))

    def _together(self, words: list[str]) -> Ragged:
        """One call for many words, joined by spaces: a token belongs to the word that its place lies in."""
        e = self.model.encode(" ".join(words), add_special_tokens=False)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        begins = np.fromiter((a for a, _ in e.offsets), np.int64, len(e.ids))
        return Ragged(np.array(e.ids, "<u4"), np.diff(np.searchsorted(begins, np.concatenate([[0], np.cumsum(sizes)]))))


def _parts(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Parts of the texts, those of ASCII in lower case, and the number of each text's first one (one more at the end)."""
    kind = _KINDS[data]
    inside = kind != _GAP
    (kept,) = np.nonzero(inside)
    kind, data = kind[kept], data[kept]
    new = np.ones(len(kept), bool)
    if len(kept):
        new[1:] = (kept[1:] != kept[:-1] + 1) | ((kind[1:] != kind[:-1]) & (kind[1:] < OTHER) & (kind[:-1] < OTHER))
    edges = np.searchsorted(kept, offsets)
    new[edges[edges < len(kept)]] = True
    bounds = np.append(np.nonzero(new)[0], len(kept))
    if len(kept):
        # lower-casing letter by letter is left to the model where letters beyond ASCII stand by
        ascii_ = np.logical_and.reduceat(data < 128, bounds[:-1])
        data = np.where(np.repeat(ascii_, np.diff(bounds)), LOWER[data], data)
    return pieces(data, bounds), np.searchsorted(bounds[:-1], edges)


def write_files(df: DataFrame, tokenizer: str, end_id: int, folder: str, files: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all rows, in ascending id order over ``files`` ranges of ids. Returns the manifest's rows (lazily).

    The manifest: part (the range's number), file, documents, ids.
    """
    d = narrow(df, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("digest"))
    ordered = d.repartitionByRange(files, "id", "digest").sortWithinPartitions("id", "digest").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = WordEncoder.load(tokenizer)
        bits = bits_for(max(encoder.vocabulary, end_id + 1))
        writer = None
        for batch in batches:
            at = 0
            for part in slices(known_texts(batch.column(1)), 4 * SLICE_BYTES):
                ids = batch.column(0).slice(at, len(part)).to_pylist()
                at += len(part)
                if writer is None:
                    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
                    fs.create_dir(root, recursive=True)
                    name = f"tokens-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
                    writer = PackedWriter(fs.open_output_stream(f"{root}/{name}"), bits)
                tokens = encoder.encode(part)
                ended = np.insert(tokens.flat, np.cumsum(tokens.sizes), np.uint32(end_id))
                writer.extend(ids, Ragged(ended, tokens.sizes + 1))
        if writer is not None:
            writer.close()
            rows = [[TaskContext.get().partitionId()], [name], [len(writer._docs)], [writer.ids]]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=["part", "file", "documents", "ids"])

    return map_batches(ordered, run, "part long, file string, documents long, ids long", keeps=True)


def _starts(manifest: DataFrame, run: int = 1024) -> DataFrame:
    """``file, start``: the ids before each file, summed up within runs of parts and over the runs."""
    m = manifest.withColumn("run", F.expr(f"part div {run}"))
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    runs = m.groupBy("run").agg(F.sum("ids").alias("n"))  # a row for each thousand files
    runs = runs.select("run", F.coalesce(F.sum("n").over(before([], "run")), F.lit(0)).alias("before"))
    inside = m.withColumn("inside", F.coalesce(F.sum("ids").over(before(["run"], "part")), F.lit(0)))
    return inside.join(runs, "run").select("file", (F.col("before") + F.col("inside")).alias("start"))


def read_files(manifest: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, start, n_tokens, ids_crc32 of every document, from the files that the manifest names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}") as source:
                    reader, crc = PackedReader(source), []
                    for sizes, ids in reader.blocks():
                        raw, ends = memoryview(ids.astype("<u4").tobytes()), (np.cumsum(sizes) * 4).tolist()
                        crc += [zlib.crc32(raw[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                    first = start + np.cumsum(reader.lengths) - reader.lengths
                    yield pa.RecordBatch.from_arrays([pa.array(reader.docs, mask=reader.nulls), pa.array(first), pa.array(reader.lengths), pa.array(crc, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    files = _starts(manifest).repartition("file")
    return map_batches(files, run, f"{id_col} long, start long, n_tokens long, ids_crc32 long")


def packed_tokens(df: DataFrame, tokenizer: str, end_id: int, file_rows: int = 2500, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, write, and read back. The number of files follows the number of rows; a file is streamed, not held."""
    spark: SparkSession = df.sparkSession
    work = Workspace(spark)
    folder = work.path("tokens")
    files = max(1, -(-df.count() // file_rows))
    manifest = work.save(write_files(df, tokenizer, end_id, folder, files, id_col, text_col), "manifest")
    return read_files(manifest, folder, id_col)
