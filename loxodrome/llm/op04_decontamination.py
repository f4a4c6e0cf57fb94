"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of ``window`` words; an item of fewer words is one window. A document holds a window
if its words stand in it in a row. For a whole window to be contained, all its shingles must be, so one necessary
token is enough to join by: each window's *rarest* shingle, by its count over all documents. Documents' shingles that
meet such a token are candidates; the token's offset in the window gives the one place where the window could begin
(positional bound), which must lie inside the document with all its words (length bound); what is left is verified
word by word, on the words' bytes.

A benchmark of at most ``INDEX_BYTES`` of text becomes an index that goes to all tasks: two passes over the documents
without a shuffle, one for the counts, one that joins and verifies. A larger one stays a table: windows, tokens and
documents' candidates (with the words around them) meet by shuffled joins on the token, in three passes over the
documents whatever the benchmark's size; only candidates are shuffled, which filters of a fixed size let through.
Both judge rows by their own texts and give equal results.

Defined cases: null or wordless texts have no words, and such items no windows; a null item_id is the empty string;
items of equal text are each counted; repeated documents each get a row; empty tables on either side
give no hits; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loxodrome.llm.frames import known_texts, map_batches, narrow, per_slice, slices
from loxodrome.llm.text_arrays import ALNUM, Words, shingle_hashes, words_of
from loxodrome.llm.workspace import Workspace

#: Bytes of benchmark text whose index goes to all tasks; an index is some thirty times as large.
INDEX_BYTES = 1 << 20
#: Words of a shingle; shorter windows are one shingle.
SHINGLE = 3
#: Bits of the filter that lets candidates of a larger benchmark through, 16 MB of them.
FILTER_BITS = 1 << 27


class Windows(NamedTuple):
    """Distinct windows of items, grouped by their number of words."""

    words: dict[int, np.ndarray]  # of each length, a row of word hashes for each window
    items: dict[int, list[list[str]]]  # of each of these windows, the items that have it
    sizes: dict[int, np.ndarray]  # of each length, a row of words' numbers of bytes for each window
    texts: dict[int, np.ndarray]  # of each length, all windows' bytes one after another, without gaps between words


class Probes(NamedTuple):
    """For one length of shingles: sorted necessary tokens, and for each the windows and offsets to try."""

    size: int
    tokens: np.ndarray
    length: np.ndarray  # of the window
    window: np.ndarray
    offset: np.ndarray
    maybe: np.ndarray


def windows_of(ids: list[str], texts: list[str | None], window: int) -> Windows:
    words = words_of(pa.array([t or "" for t in texts], pa.string()), ALNUM)
    data, found = words.data.tobytes(), {}
    for i, item in enumerate(ids):
        lo, hi = int(words.first[i]), int(words.first[i + 1])
        own = [data[a:b] for a, b in zip(words.starts[lo:hi].tolist(), words.ends[lo:hi].tolist(), strict=True)]
        n = min(window, len(own))
        for a in range(len(own) - n + 1 if n else 0):
            owners = found.setdefault(n, {}).setdefault(tuple(own[a : a + n]), (words.hashes[lo + a : lo + a + n], []))[1]
            if item not in owners:
                owners.append(item)
    return Windows(
        {n: np.stack([h for h, _ in w.values()]) for n, w in found.items()},
        {n: [o for _, o in w.values()] for n, w in found.items()},
        {n: np.array([[len(x) for x in k] for k in w], np.int64) for n, w in found.items()},
        {n: np.frombuffer(b"".join(b"".join(k) for k in w), np.uint8) for n, w in found.items()},
    )


def _shingles(rows: np.ndarray, size: int) -> np.ndarray:
    """Shingles of each window, a row for each."""
    n = rows.shape[1] - size + 1
    return np.stack([shingle_hashes(np.ascontiguousarray(rows[:, j : j + size]).ravel(), size)[::size] for j in range(n)], axis=1)


def vocabulary(w: Windows) -> dict[int, np.ndarray]:
    """All shingles of the windows, sorted, by shingle length."""
    out: dict[int, list[np.ndarray]] = {}
    for n, rows in w.words.items():
        size = min(SHINGLE, n)
        out.setdefault(size, []).append(_shingles(rows, size).ravel())
    return {k: np.unique(np.concatenate(v)) for k, v in out.items()}


def probes_of(w: Windows, vocab: dict[int, np.ndarray], counts: dict[int, np.ndarray]) -> list[Probes]:
    """Each window's rarest shingle; among equally rare ones the first."""
    out = []
    for size in sorted(vocab):
        tokens, length, number, offset = [], [], [], []
        for n, rows in w.words.items():
            if min(SHINGLE, n) != size:
                continue
            s = _shingles(rows, size)
            at = counts[size][np.searchsorted(vocab[size], s)].argmin(axis=1)
            tokens.append(s[np.arange(len(s)), at])
            length.append(np.full(len(s), n))
            number.append(np.arange(len(s)))
            offset.append(at)
        t, length_, number_, offset_ = map(np.concatenate, (tokens, length, number, offset))
        order = np.argsort(t, kind="stable")
        out.append(Probes(size, t[order], length_[order], number_[order], offset_[order], _flags(t)))
    return out


def _flags(keys: np.ndarray) -> np.ndarray:
    flags = np.zeros(1 << 20, bool)
    flags[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    return flags


def _known(hashes: np.ndarray, keys: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of hashes that are among sorted keys, and the first key's place for each."""
    (i,) = np.nonzero(flags[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
    at = np.searchsorted(keys, hashes[i])
    at[at == len(keys)] = 0
    good = keys[at] == hashes[i] if len(keys) else np.zeros(0, bool)
    return i[good], at[good]


def _equal(words: Words, begin: np.ndarray, w: Windows, length: int, number: np.ndarray) -> np.ndarray:
    """Whether the words of the document from ``begin`` on are those of the window, byte by byte."""
    at = begin[:, None] + np.arange(length)
    same = (words.ends[at] - words.starts[at] == w.sizes[length][number]).all(axis=1)
    (i,) = np.nonzero(same)
    if len(i):
        sizes = w.sizes[length][number[i]]
        total = sizes.sum(axis=1)
        all_ = w.sizes[length].sum(axis=1)
        inside = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
        theirs = w.texts[length][np.repeat((np.cumsum(all_) - all_)[number[i]], total) + inside]
        flat = sizes.ravel()
        ours = words.data[np.arange(flat.sum()) + np.repeat(words.starts[at[i]].ravel() - (np.cumsum(flat) - flat), flat)]
        same[i] = np.logical_and.reduceat(ours == theirs, np.cumsum(total) - total)
    return same


def find(words: Words, w: Windows, probes: list[Probes]) -> tuple[np.ndarray, list[tuple[int, str]]]:
    """Which words are hit, and the (text, item) pairs."""
    delta, owners = np.zeros(len(words.starts) + 1, np.int64), set()
    for p in probes:
        i, at = _known(shingle_hashes(words.hashes, p.size), p.tokens, p.maybe)
        many = np.searchsorted(p.tokens, p.tokens[at], "right") - at  # windows that share a token
        i, at = np.repeat(i, many), np.repeat(at, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        begin, n = i - p.offset[at], p.length[at]
        text = words.text[i]
        inside = (begin >= words.first[text]) & (begin + n <= words.first[text + 1])
        begin, n, number = begin[inside], n[inside], p.window[at[inside]]
        for length in np.unique(n).tolist():
            k = n == length
            b, x = begin[k], number[k]
            same = (words.hashes[b[:, None] + np.arange(length)] == w.words[length][x]).all(axis=1)
            b, x = b[same], x[same]
            same = _equal(words, b, w, length, x)
            b, x = b[same], x[same]
            np.add.at(delta, b, 1)
            np.add.at(delta, b + length, -1)
            for t, y in set(zip(words.text[b].tolist(), x.tolist(), strict=True)):
                owners.update((t, item) for item in w.items[length][y])
    return np.cumsum(delta[:-1]) > 0, sorted(owners)


def _counted(docs: DataFrame, vocab: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """How often each shingle of the benchmark stands in all documents."""
    flags = {k: _flags(v) for k, v in vocab.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(len(v), np.int64) for k, v in vocab.items()}
        for batch in batches:
            for part in slices(known_texts(batch.column(0))):
                words = words_of(part, ALNUM)
                for k, v in vocab.items():
                    i, at = _known(shingle_hashes(words.hashes, k), v, flags[k])
                    whole = words.text[i] == words.text[i + k - 1]
                    total[k] += np.bincount(at[whole], minlength=len(v))
        for k, t in total.items():
            (some,) = np.nonzero(t)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k)), pa.array(some), pa.array(t[some])], names=["k", "i", "n"])

    out = {k: np.zeros(len(v), np.int64) for k, v in vocab.items()}
    # one row for each shingle of a benchmark of INDEX_BYTES at most
    for r in map_batches(docs, run, "k long, i long, n long").groupBy("k", "i").agg(F.sum("n").alias("n")).collect():
        out[r["k"]][r["i"]] = r["n"]
    return out


def _items(benchmark: DataFrame, text_col: str, item_col: str) -> tuple[DataFrame, bool]:
    """``item, text``, and whether their index may go to all tasks."""
    items = narrow(benchmark, item_col, text_col).select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.octet_length("item") + 16).alias("n")).first()["n"] or 0
    return items, size <= INDEX_BYTES


def _index(texts: DataFrame, items: DataFrame, window: int) -> tuple[Windows, list[Probes]]:
    rows = items.orderBy("item", "text").collect()  # of INDEX_BYTES at most
    w = windows_of([r["item"] for r in rows], [r["text"] for r in rows], window)
    vocab = vocabulary(w)
    return w, probes_of(w, vocab, _counted(texts, vocab)) if vocab else []


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, one_in: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``id_col``, n_words, n_hit, items (sorted item ids whose windows occur), contaminated, for every document.

    Contaminated: at least one word in ``one_in`` is hit.
    """
    d = narrow(docs, id_col, text_col)
    items, small = _items(benchmark, text_col, item_col)
    if small:
        out = _met(d, *_index(d.select(text_col), items, window), id_col)
    else:
        out = _met_by_shuffles(d, items, window, id_col).drop("copy")
    return out.withColumn("contaminated", _enough(one_in))


def _enough(one_in: int) -> Column:
    return (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words"))


def _met(d: DataFrame, w: Windows, probes: list[Probes], id_col: str) -> DataFrame:
    """``id_col``, n_words, n_hit, items of every document, by an index that all tasks have."""

    def make():
        def work(rows: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
            words = words_of(texts, ALNUM)
            hit, owners = find(words, w, probes)
            items: list[list[str]] = [[] for _ in range(len(texts))]
            for t, item in owners:
                items[t].append(item)
            hits = np.bincount(words.text[hit], minlength=len(texts))
            arrays = [rows.column(0), pa.array(words.counts.astype(np.int64)), pa.array(hits.astype(np.int64)), pa.array(items, pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(arrays, names=[id_col, "n_words", "n_hit", "items"])

        return work

    return per_slice(d, f"{id_col} long, n_words long, n_hit long, items array<string>", d.columns[1], make)


# --- a benchmark of any size ----------------------------------------------------------------------------------------


def _spot(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _filter(tokens: DataFrame) -> np.ndarray:
    """The filter's bits that the hashes in column ``token`` set: FILTER_BITS / 64 numbers at most reach the driver."""
    spot = F.expr(f"token & {FILTER_BITS - 1}L")
    rows = tokens.groupBy(F.shiftright(spot, 6).alias("i")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(token & {FILTER_BITS - 1}L & 63L as int))")).alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[rows.column("i").to_numpy()] = rows.column("bits").to_numpy()
    return bits.view(np.uint64)


def _passed(words: Words, size: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of shingles of ``size`` words inside one text that the filter lets through."""
    h = shingle_hashes(words.hashes, size)
    spot = _spot(h)
    (i,) = np.nonzero(bits[spot >> 6] >> (spot & 63).astype(np.uint64) & np.uint64(1))
    i = i[words.text[i] == words.text[i + size - 1]]
    return i, h[i]


def _window_rows(items: DataFrame, window: int) -> DataFrame:
    """``item, n, key`` (the window's words, joined by spaces) and ``tokens`` (its shingles' hashes in order)."""

    def make():
        def work(rows: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
            words, out = words_of(texts, ALNUM), ([], [], [], [])
            data = words.data.tobytes()
            for i, item in enumerate(rows.column(0).to_pylist()):
                lo, hi = int(words.first[i]), int(words.first[i + 1])
                own = [data[a:b] for a, b in zip(words.starts[lo:hi].tolist(), words.ends[lo:hi].tolist(), strict=True)]
                n = min(window, len(own))
                size = min(SHINGLE, n)
                h = shingle_hashes(words.hashes[lo:hi], size).view(np.int64) if n else None
                for a in range(len(own) - n + 1 if n else 0):
                    for column, value in zip(out, (item, n, b" ".join(own[a : a + n]).decode(), h[a : a + n - size + 1]), strict=True):
                        column.append(value)
            kinds = (pa.string(), pa.int32(), pa.string(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["item", "n", "key", "tokens"])

        return work

    return per_slice(items, "item string, n int, key string, tokens array<long>", "text", make)


def _met_by_shuffles(d: DataFrame, items: DataFrame, window: int, id_col: str) -> DataFrame:
    """``id_col``, copy (a hash of the text), n_words, n_hit, items of every document."""
    work = Workspace(d.sparkSession)
    text_col = d.columns[1]
    rows = work.save(_window_rows(items, window), "window_rows")
    windows = work.save(rows.groupBy("n", "key").agg(F.first("tokens").alias("tokens")).withColumn("window", F.monotonically_increasing_id()), "windows")
    owners = work.save(rows.select("item", "n", "key").join(windows.select("window", "n", "key"), ["n", "key"]).select("window", "item").distinct(), "owners")
    size = F.least("n", F.lit(SHINGLE))
    tokens = work.save(windows.select("window", "n", size.alias("size"), F.posexplode("tokens").alias("offset", "token")), "tokens")
    docs = d.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("copy"), F.col(text_col).alias("text"))
    counts = work.save(_spread(docs, tokens, lambda words, at, rows: {}, ()).groupBy("size", "token").agg(F.sum("n").alias("count")), "counts")
    # the rarest shingle of each window; among equally rare ones the first
    rare = tokens.join(counts, ["size", "token"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    rare = rare.filter("count > 0").groupBy("window", "n", "size").agg(F.min(F.struct("count", "offset", "token")).alias("r"), F.count(F.lit(1)).alias("met"))
    # a window with a shingle that no document has is in none
    rare = rare.filter(F.col("met") == F.col("n") - F.col("size") + 1)
    probes = work.save(rare.select("window", "n", "size", "r.offset", "r.token").join(windows.select("window", "key"), "window"), "probes")

    def around(words: Words, at: np.ndarray, rows: pa.RecordBatch) -> dict[str, pa.Array]:
        """The document of each candidate, its place, and the words that a window through it may have."""
        text = words.text[at]
        lo = np.maximum(at - (window - 1), words.first[text])
        hi = np.minimum(at + window, words.first[text + 1])
        data, starts, ends = words.data.tobytes(), words.starts.tolist(), words.ends.tolist()
        context = [b" ".join([data[starts[k] : ends[k]] for k in range(a, b)]).decode() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
        own = pa.array(text)
        return {"id": rows.column(0).take(own), "copy": rows.column(1).take(own), "place": pa.array(at - words.first[text]), "before": pa.array(at - lo), "context": pa.array(context, pa.string())}

    met = _spread(docs, probes, around, ("id long", "copy long", "place long", "before long", "context string"))
    met = met.drop("n").join(probes, ["size", "token"])
    inside = F.slice(F.split("context", " "), (F.col("before") - F.col("offset") + 1).cast("int"), F.col("n"))
    met = met.filter(F.col("before") >= F.col("offset")).filter(F.array_join(inside, " ") == F.col("key"))
    met = work.save(met.select("id", "copy", (F.col("place") - F.col("offset")).alias("begin"), "n", "window").distinct(), "met")
    word = met.select("id", "copy", F.explode(F.sequence("begin", F.col("begin") + F.col("n") - 1)).alias("w")).distinct()
    hits = word.groupBy("id", "copy").agg(F.count(F.lit(1)).alias("n_hit"))
    found = met.select("id", "copy", "window").distinct().join(owners, "window").groupBy("id", "copy").agg(F.array_sort(F.collect_set("item")).alias("items"))
    both = hits.withColumnsRenamed({"id": "_id", "copy": "_copy"}).join(found, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_copy") == F.col("copy"))).select("_id", "_copy", "n_hit", "items")
    both = work.save(both, "hits")

    def make():
        return lambda rows, texts: pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(words_of(texts, ALNUM).counts.astype(np.int64))], names=["id", "copy", "n_words"])

    base = per_slice(docs, "id long, copy long, n_words long", "text", make)
    out = base.join(both, F.col("id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy")), "left")
    return out.select(F.col("id").alias(id_col), "copy", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _spread(docs: DataFrame, tokens: DataFrame, more: Callable, kinds: tuple[str, ...]) -> DataFrame:
    """``size, token, n`` and what ``more`` adds, for documents' shingles that a filter of ``tokens`` lets through.

    With no more columns equal ones are counted first; else each place is a row.
    """
    bits = {r["size"]: _filter(tokens.filter(F.col("size") == r["size"]).select("token")) for r in tokens.select("size").distinct().collect()}  # SHINGLE sizes at most
    names = ["size", "token", "n", *(k.split()[0] for k in kinds)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(known_texts(batch.column(2))):
                rows, at = batch.slice(at, len(part)), at + len(part)
                words = words_of(part, ALNUM)
                for size, own in bits.items():
                    place, h = _passed(words, size, own)
                    if not kinds:
                        h, n = np.unique(h, return_counts=True)
                    else:
                        n = np.ones(len(h), np.int64)
                    if len(h):
                        extra = more(words, place, rows)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), size, np.int32)), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64)), *(extra[k] for k in names[3:])], names=names)

    return map_batches(docs, run, ", ".join(["size int", "token long", "n long", *kinds]))


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = 13, one_in: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows that aren't contaminated, with all their columns, judged by their own texts.

    A benchmark that all tasks have takes a pass for the counts and one for the join; beyond that rows meet the
    contaminated ones by id and hash of the text, so rows that share an id, or have none, don't fall together.
    """
    items, small = _items(benchmark, text_col, item_col)
    if not small:
        gone = _met_by_shuffles(narrow(docs, id_col, text_col), items, window, id_col).filter(_enough(one_in)).select(F.col(id_col).alias("_id"), F.col("copy").alias("_copy"))
        return docs.join(gone, docs[id_col].eqNullSafe(gone["_id"]) & (F.xxhash64(docs[text_col]) == gone["_copy"]), "left_anti")
    w, probes = _index(docs.select(text_col), items, window)

    def make():
        def work(rows: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
            words = words_of(texts, ALNUM)
            hits = np.bincount(words.text[find(words, w, probes)[0]], minlength=len(texts))
            return rows.filter(pa.array((hits == 0) | (one_in * hits < words.counts)))

        return work

    return per_slice(docs, docs.schema, text_col, make)
