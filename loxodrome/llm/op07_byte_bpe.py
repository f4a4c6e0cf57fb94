"""Byte-level BPE encoding and decoding by prefix dynamic programming.

A text is cut by the vocabulary's pattern; each match is encoded through the table of last tokens of its
prefixes (:mod:`loxodrome.llm.bpe_dp`). Before that, a column of texts is cut in numpy before every space that a
non-space follows, and, if the pattern keeps them apart, where an ASCII letter or digit meets ASCII punctuation (but
for the apostrophe): the pattern never matches across such a place, so these segments are encoded on their own, and
only distinct ones that a bounded memo lacks. No shuffle: one pass.

The matches of new segments fill their tables side by side; matches of more than ``LONG_PIECE`` bytes do so one at a
time, which only spares the memory of a table as wide as the longest match. Both are the same recurrence.

:class:`ByteBpe` also keeps a document's tables (:meth:`ByteBpe.open`), for exact appends and for cutting and
encoding anew only near an edit.

Defined cases: a null text is empty (no ids, decoded to no bytes); every row is encoded, repeated ones too;
other columns are ignored; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loxodrome.llm.bpe_dp import PrefixTable, SideBySide, Vocabulary, encode
from loxodrome.llm.frames import narrow, per_slice, resident
from loxodrome.llm.memo import Memo, Ragged, pieces
from loxodrome.llm.text_arrays import KIND, OTHER, PUNCTUATION, byte_class, column_bytes

#: Bytes after which a space may stand inside a match: ASCII white space and separators, and bytes that begin a space beyond ASCII.
_STAY = byte_class([*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3])
#: Longer matches are encoded one at a time.
LONG_PIECE = 96
#: A match may depend on so many characters after it: the pattern's longest literal alternative, and one to look ahead.
_AHEAD = 4


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteBpe:
    """Ids are little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.vocabulary = Vocabulary(ranks)
        self.pattern = regex.compile(pattern)
        self._together = SideBySide(self.vocabulary)
        self._memo = Memo(self._learn, "<u4", limit=40 << 20)
        marks, found = [chr(c) for c in range(128) if KIND[c] == PUNCTUATION], self.pattern.findall
        self._apart = all(found(a + p) == [a, p] and found(p + a) == [p, a] for a in "a1" for p in marks)
        # tokens that merges never make; only as a whole match are they found
        odd = [r for r in ranks.values() if self.vocabulary.halves(r) is None]
        self._whole = {self.vocabulary.token[r]: r for r in odd}
        lengths = np.zeros(self.vocabulary.size, np.int64)
        for t, r in ranks.items():
            lengths[r] = len(t)
        self._tokens = Ragged(np.frombuffer(b"".join(self.vocabulary.token.get(r, b"") for r in range(self.vocabulary.size)), np.uint8), lengths)

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBpe:
        return resident(("bytes", path, pattern), lambda: cls(read_ranks(path), pattern))

    def encode_column(self, texts: pa.Array) -> Ragged:
        """The ids of each text."""
        data, offsets = column_bytes(texts)
        space = np.nonzero(data[:-1] == 0x20)[0]
        cut = np.zeros(len(data) + 1, bool)
        cut[space[~_STAY[data[space + 1]]]] = True
        if self._apart and len(data):
            kind = KIND[data]
            cut[1:-1] |= (kind[1:] != kind[:-1]) & (kind[1:] < OTHER) & (kind[:-1] < OTHER)
        cut[offsets] = True
        bounds = np.nonzero(cut)[0] if len(data) else np.zeros(1, np.int64)
        if not len(data):
            return Ragged(np.zeros(0, "<u4"), np.zeros(len(texts), np.int64))
        ids = self._memo.rows(pieces(data, bounds))
        ends = np.concatenate([[0], np.cumsum(ids.sizes)])[np.searchsorted(bounds, offsets)]
        return Ragged(ids.flat, np.diff(ends))

    def encode(self, text: str) -> bytes:
        return self.encode_column(pa.array([text], pa.string())).flat.tobytes()

    def _learn(self, segments: list[bytes]) -> Ragged:
        """Cut segments into matches, and fill the tables of the distinct matches side by side."""
        find = self.pattern.findall
        matches, counts = [], np.zeros(len(segments), np.int64)
        for i, s in enumerate(segments):
            found = find(s.decode())
            counts[i] = len(found)
            matches += found
        coded = pa.array(matches, pa.large_string()).cast(pa.large_binary()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        rows = self._pieces(distinct).take(coded.indices.to_numpy().astype(np.int64))
        ends = np.concatenate([[0], np.cumsum(rows.sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        return Ragged(rows.flat, np.diff(ends))

    def _pieces(self, matches: list[bytes]) -> Ragged:
        long = np.fromiter((len(m) > LONG_PIECE or m in self._whole for m in matches), bool, len(matches))
        (short,), (rest,) = np.nonzero(~long), np.nonzero(long)
        alone = [np.array(encode(self.vocabulary, matches[i]), "<u4") for i in rest.tolist()]
        parts = [self._together.encode([matches[i] for i in short.tolist()])] + [Ragged(a, np.array([len(a)])) for a in alone]
        return Ragged.joined(parts).take(np.argsort(np.concatenate([short, rest]), kind="stable"))

    def decode_column(self, ids: Ragged) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all rows of ids, gathered at once from the vocabulary's concatenated bytes, and each row's number of bytes."""
        out = self._tokens.take(ids.flat)
        ends = np.concatenate([[0], np.cumsum(out.sizes)])[np.concatenate([[0], np.cumsum(ids.sizes)])]
        return out.flat, np.diff(ends)

    def decode(self, ids: bytes) -> bytes:
        return self._tokens.take(np.frombuffer(ids, "<u4")).flat.tobytes()

    def open(self, text: str) -> OpenText:
        return OpenText(self, text)


class OpenText:
    """A text with the table of each match; appends and edits cut and encode only what they touch."""

    def __init__(self, codec: ByteBpe, text: str):
        self.codec, self.text = codec, ""
        self._starts: list[int] = []  # of matches, in characters
        self._tables: list[PrefixTable] = []
        self.replace(0, 0, text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, stop: int, new: str) -> int:
        """Put ``new`` for ``text[start:stop]``; returns how many matches were cut anew.

        Cutting begins at the first match that could depend on the edit, and ends where a match begins at an old
        place behind the edit: from there on the pattern sees what it saw before.
        """
        old, shift = self._starts, len(new) - (stop - start)
        text = self.text[:start] + new + self.text[stop:]
        # the matches before `lo` end at least _AHEAD characters before the edit; a match ends where the next begins
        lo = max(0, bisect_right(old, start - _AHEAD) - 1)
        begin = old[lo] if old else 0
        starts, found, hi = [], [], len(old)
        for m in self.codec.pattern.finditer(text, begin):
            at = m.start()
            if at >= start + len(new):
                k = bisect_left(old, at - shift, lo)
                if k < len(old) and old[k] == at - shift:
                    hi = k
                    break
            starts.append(at)
            found.append(m.group().encode())
        if len(found) == 1 and hi - lo == 1:
            self._edit(self._tables[lo], found[0])
            tables = [self._tables[lo]]
        elif found and hi > lo and found[0].startswith(self._tables[lo].s):
            self._tables[lo].append(found[0][len(self._tables[lo].s) :])
            tables = [self._tables[lo]] + [PrefixTable(self.codec.vocabulary, f) for f in found[1:]]
        else:
            tables = [PrefixTable(self.codec.vocabulary, f) for f in found]
        self._tables = self._tables[:lo] + tables + self._tables[hi:]
        self._starts = old[:lo] + starts + [s + shift for s in old[hi:]]
        self.text = text
        return len(found)

    @staticmethod
    def _edit(table: PrefixTable, new: bytes) -> None:
        """The table follows to ``new``: only entries from the first difference on, until it agrees again."""
        old, most = table.s, min(len(table.s), len(new))
        a = next((i for i in range(most) if old[i] != new[i]), most)
        b = next((i for i in range(most - a) if old[-1 - i] != new[-1 - i]), most - a)
        table.edit(a, len(old) - b, new[a : len(new) - b])

    def ids(self) -> list[int]:
        whole = self.codec.vocabulary.ranks
        return [i for t in self._tables for i in (t.ids() if t.s not in whole else [whole[t.s]])]


def encode_decode(df: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """``id_col``, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (binary, unsigned 32-bit)."""
    schema = f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids

    def make():
        codec = ByteBpe.load(ranks_file, pattern)

        def spans(data: bytes, ends: np.ndarray) -> list[memoryview]:
            view, stops = memoryview(data), ends.tolist()
            return [view[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

        def work(rows: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
            ids = codec.encode_column(texts)
            data, sizes = codec.decode_column(ids)
            each = spans(ids.flat.astype("<u4").tobytes(), np.cumsum(ids.sizes) * 4)
            digests, decoded = ([hashlib.sha256(x).hexdigest() for x in views] for views in (each, spans(data.tobytes(), np.cumsum(sizes))))
            arrays = [rows.column(0), pa.array(ids.sizes), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            kept = [pa.array([bytes(x) for x in each], pa.binary())] * keep_ids
            return pa.RecordBatch.from_arrays(arrays + kept, names=[c.split()[0] for c in schema.split(", ")])

        return work

    return per_slice(narrow(df, id_col, text_col), schema, text_col, make, keeps=True)
