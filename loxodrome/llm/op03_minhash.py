"""MinHash near-duplicates by a chosen-path set similarity join.

A document is the set of its distinct ``k``-word shingles. Documents with equal sets (by a 128-bit digest and the
size) form a class, and one row stands for it from then on. Every class carries minwise tokens (the least values of
its set under seeded hashes; 64 bits where they are a tree's root, 32 where they part a node) and a one-permutation sketch
of half a byte a bin: values that agree by chance raise an estimate, so that no link is lost by it.

Each of ``trees`` independent trees sends a class down one chosen minwise token; nodes with more than ``limit``
classes branch again, by two further tokens chosen by the node, down to ``depth`` levels. Two sets with similarity J
share a token with probability J, so at the threshold they part in every tree with probability (1 - J)**trees at
the first level and little more below it (:func:`miss_probability`). A node that keeps most of its parent's classes
is a crowd of near copies that tokens don't part; it branches no further and is compared as it is.

Nodes are compared exhaustively on sketches, whose estimate leaves a margin below the threshold
(:func:`sketch_miss`); what passes is confirmed on full sets. The first pass compares each node's classes with one of
them, the first by a seeded hash, by cells of at most ``limit`` rows (and the cells' first ones again, so that no task
sees a whole crowd), and joins what links into components. The second pass compares all remaining pairs of a node
that are in different components, and confirms those that sketches allow on full sets, inside a task that returns only
links that join components: a crowd of thousands of near copies lists no pairs. Nodes that stay large are split into
blocks bounded by rows and by shingles for that, block against block: no cap, no candidate is dropped.

Full sets go to a task as one block and a stream, or as two blocks; a first one is sent once for each 256 of its
partners, not once a pair.

Defined cases of :func:`near_duplicates`: null, empty and wordless texts have empty sets and link with nothing; a
shorter text than ``k`` words is one shingle; repeated rows each get a row; rows with one id are one vertex, with the
links of all their texts; a null id is kept, without a component and without a part in others' components; an empty
table gives no rows; other columns are ignored. :func:`near_groups` judges rows by their texts alone, whatever their
ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loxodrome.llm.components import connected_components
from loxodrome.llm.frames import grouped, map_batches, narrow, per_slice
from loxodrome.llm.text_arrays import SPACED, mix, shingle_sets, words_of
from loxodrome.llm.workspace import Workspace

TOKENS = 32  # minwise tokens of a class
BINS = 256  # of the sketch, half a byte each
#: A node with this share of its parent's classes is a crowd.
CROWD = 0.7
#: Up to so many ids are sent to all tasks to pick documents by; beyond, documents are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Shingles that weigh as much as a row when blocks are cut: a block of 2048 has some 2 ** 20 shingles at most, or is one document.
HEAVY = 512
#: Partners that one copy of a set serves.
SHARED = 256

_SEEDS = mix(np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def miss_probability(j: float, trees: int, depth: int) -> float:
    """That a pair of similarity ``j`` never meets, if all its nodes branch down to ``depth``."""
    meet = 1.0
    for _ in range(depth - 1):
        meet = 1 - (1 - j * meet) ** 2
    return (1 - j * meet) ** trees


def sketch_miss(j: float, least: float) -> float:
    """A bound of the chance that a pair of similarity ``j`` has a sketch estimate below ``least``, if its bins are independent and all used."""
    return sum(math.exp(math.lgamma(BINS + 1) - math.lgamma(k + 1) - math.lgamma(BINS - k + 1) + k * math.log(j) + (BINS - k) * math.log1p(-j)) for k in range(math.ceil(least * BINS)))


def _lists(values: np.ndarray) -> pa.Array:
    rows, each = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * each), pa.array(values.ravel()))


def _sketches(df: DataFrame, k: int, trees: int, id_col: str, text_col: str) -> DataFrame:
    """``id, h, n, d1, d2, roots, tokens, sketch`` of every row; h: a hash of the text; d1, d2: a digest of the set."""

    def make():
        def work(rows: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
            n, d1, d2, tokens, sketch = _sketch(texts, k)
            roots, parts = _lists(tokens.view(np.int64)[:, :trees]), _lists((tokens >> np.uint64(32)).astype(np.uint32).view(np.int32))
            halves = sketch[:, 0::2] << np.uint8(4) | sketch[:, 1::2]
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BINS // 2), len(n), [None, pa.py_buffer(halves.tobytes())]).cast(pa.binary())
            arrays = [rows.column(0), rows.column(1), pa.array(n), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), roots, parts, raw]
            return pa.RecordBatch.from_arrays(arrays, names=["id", "h", "n", "d1", "d2", "roots", "tokens", "sketch"])

        return work

    return per_slice(_hashed(df, id_col, text_col), "id long, h long, n long, d1 long, d2 long, roots array<long>, tokens array<int>, sketch binary", "text", make)


def _small(ids: DataFrame) -> DataFrame:
    """``ids``, sent to all tasks if they are few, so that the texts or sets that they are joined to stay where they are."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _hashed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    d = narrow(df, id_col, text_col)
    return d.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))


def _sketch(texts: pa.Array, k: int):
    hashes, first = shingle_sets(words_of(texts, SPACED), k)
    n = np.diff(first)
    (some,) = np.nonzero(n)
    at = first[some]
    tokens = np.zeros((len(n), TOKENS), np.uint64)
    sketch = np.zeros((len(n), BINS), np.uint8)
    d1, d2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    if len(some):
        for t, seed in enumerate(_SEEDS):
            tokens[some, t] = np.minimum.reduceat((hashes ^ seed) * seed, at)
        d1[some], d2[some] = np.add.reduceat(mix(hashes ^ np.uint64(1)), at), np.add.reduceat(mix(hashes ^ np.uint64(2)), at)
        # sets are sorted, so the first of a run of equal leading bits is the least of its bin
        row, bin_ = np.repeat(np.arange(len(n)), n), (hashes >> np.uint64(56)).astype(np.int64)
        head = np.ones(len(hashes), bool)
        head[1:] = (row[1:] != row[:-1]) | (bin_[1:] != bin_[:-1])
        sketch[row[head], bin_[head]] = ((hashes[head] >> np.uint64(40)) % np.uint64(15) + np.uint64(1)).astype(np.uint8)
    return n, d1, d2, tokens, sketch


def _full_sets(df: DataFrame, wanted: DataFrame, k: int, work: Workspace, id_col: str, text_col: str, repeated: bool) -> DataFrame:
    """``id, set`` of the classes ``id`` with representing rows (``rid``, ``rh``); a set is its sorted 64-bit shingle hashes, as bytes."""

    def make():
        def work_(rows: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
            flat, first = shingle_sets(words_of(texts, SPACED), k)
            ends = first.astype(np.int64) * 8
            sets = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
            return pa.RecordBatch.from_arrays([rows.column(0), sets.cast(pa.binary())], names=["id", "set"])

        return work_

    picked = _small(wanted)
    docs = _hashed(df, id_col, text_col).withColumnRenamed("id", "own")
    docs = docs.join(picked, docs["own"].eqNullSafe(picked["rid"]) & (docs["h"] == picked["rh"])).select(picked["id"], "text")
    sets = work.save(per_slice(docs, "id long, set binary", "text", make), "sets")
    return sets.dropDuplicates(["id"]) if repeated else sets  # rows equal in id and text give one set several times


def _nodes(classes: DataFrame, trees: int, depth: int, limit: int, work: Workspace) -> DataFrame:
    """``node, id, size`` of all nodes with two classes or more that branch no further."""
    roots = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.xxhash64(t, F.element_at("roots", t + 1)))
    rows = classes.select("id", F.explode(roots).alias("node"), F.lit(1 << 62).alias("parent"))
    out = None
    for level in range(1, depth + 1):
        rows = work.save(rows, f"level{level}")
        # written before the join, so that both of its sides are shuffles that adaptive execution may split
        sizes = work.save(rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.max("parent").alias("parent")).filter("size > 1"), f"sizes{level}")
        sized = work.save(rows.drop("parent").join(sizes, "node"), f"nodes{level}")
        work.drop(rows)
        large = (F.col("size") > limit) & (F.col("size") < CROWD * F.col("parent")) if level < depth else F.lit(False)
        final = sized.filter(~large).select("id", "node", "size")
        out = final if out is None else out.unionByName(final)
        if level == depth or not sized.filter(large).limit(1).count():
            return out
        which = F.transform(F.array(F.lit(0), F.lit(1)), lambda s: F.xxhash64("node", s))
        child = F.transform(which, lambda h: F.xxhash64(h, F.element_at("tokens", F.pmod(h, F.lit(TOKENS)).cast("int") + 1)))
        deeper = sized.filter(large).select("id", "node", F.col("size").alias("parent")).join(classes.select("id", "tokens"), "id")
        rows = deeper.select("id", F.explode(child).alias("node"), "parent")
    return out


def _estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity by sketches, of rows of ``a`` with rows of ``b``."""
    used = ((a | b) != 0).sum(axis=-1)
    same = ((a == b) & (a != 0)).sum(axis=-1)
    return same / np.maximum(used, 1)


def _bytes_of(column: pa.Array | pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of bytes, one row after another, and where each row begins (one more at the end)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    column, width = column.cast(pa.large_binary()), np.dtype(kind).itemsize
    ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return raw.view(kind), (ends - ends[0]) // width


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    halves = _bytes_of(column, "u1")[0].reshape(-1, BINS // 2)
    out = np.empty((len(halves), BINS), np.uint8)
    out[:, 0::2], out[:, 1::2] = halves >> 4, halves & 15
    return out


def _pairs(a: np.ndarray, b: np.ndarray, names: tuple[str, str] = ("a", "b")) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=list(names))


def _first_pass(placed: DataFrame, least: float, ratio: float, limit: int, work: Workspace) -> DataFrame:
    """``a, b``: the first class of a cell of a node with others of it, where sketches and sizes allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the open cell, and its first row
        for batch in batches:
            cell, ids, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            sketch = _matrix(batch.column(3))
            heads = np.concatenate([[held is None or cell[0] != held[0]], cell[1:] != cell[:-1]])
            (first,) = np.nonzero(heads)
            again = batch.take(pa.array(first)).filter(pa.compute.greater(batch.take(pa.array(first)).column(5), 1))
            if again.num_rows:  # the first ones of a node's cells meet again
                yield pa.RecordBatch.from_arrays([pa.nulls(again.num_rows, pa.int64()), *(again.column(k) for k in (1, 2, 3, 4, 5))], names=["a", "b", "n", "sketch", "node", "size"])
            p_ids, p_n, p_sketch, at = ids[first], n[first], sketch[first], np.cumsum(heads) - 1
            if not heads[0]:
                p_ids, p_n, p_sketch, at = np.append(held[1], p_ids), np.append(held[2], p_n), np.concatenate([held[3][None], p_sketch]), at + 1
            (i,) = np.nonzero((ids != p_ids[at]) & (np.minimum(n, p_n[at]) >= ratio * np.maximum(n, p_n[at])))
            i = i[_estimate(sketch[i], p_sketch[at[i]]) >= least]
            if len(i):
                none = pa.nulls(len(i), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(p_ids[at[i]]), pa.array(ids[i]), none, pa.nulls(len(i), pa.binary()), none, none], names=["a", "b", "n", "sketch", "node", "size"])
            held = (cell[-1], p_ids[at[-1]], p_n[at[-1]], p_sketch[at[-1]].copy())

    rows, found = placed.select("node", "id", "n", "sketch", "size"), None
    while True:
        cells = F.ceil(F.col("size") / limit).cast("long")
        own = F.xxhash64("node", F.pmod(F.xxhash64("id", F.lit(3)), cells))
        d = rows.select(own.alias("cell"), "id", "n", "sketch", "node", cells.alias("cells"), F.xxhash64("node", "id").alias("order"))
        d = d.repartition("cell").sortWithinPartitions("cell", "order", "id").drop("order")
        out = work.save(map_batches(d, run, "a long, b long, n long, sketch binary, node long, size long"), "pass1")
        pairs = out.filter("a is not null").select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        rows = out.filter("a is null").select("node", F.col("b").alias("id"), "n", "sketch", "size")
        if not rows.limit(1).count():
            return found.distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int, work: Workspace) -> DataFrame:
    """``u, v``: the pairs whose full sets' similarity is ``threshold`` percent or more.

    A set ``a`` meets its partners in cells of some ``SHARED`` of them, as the first row of the cell's stream.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell_, head, own = None, None, 0
        for batch in batches:
            cell, ids, first = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            flat, at = _bytes_of(batch.column(3), "<u8")
            cuts = [0, *(np.nonzero(cell[1:] != cell[:-1])[0] + 1).tolist(), len(cell)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if cell[lo] != cell_:
                    cell_, head, own = cell[lo], flat[at[lo] : at[lo + 1]].copy(), ids[lo]
                    assert first[lo]
                    lo += 1
                if lo == hi:
                    continue
                part, sizes = flat[at[lo] : at[hi]], np.diff(at[lo : hi + 1])
                both = np.add.reduceat(_among(part, head), at[lo:hi] - at[lo], dtype=np.int64)
                good = 100 * both >= threshold * (len(head) + sizes - both)
                if good.any():
                    yield _pairs(np.full(good.sum(), own), ids[lo:hi][good], ("u", "v"))

    per = work.save(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SHARED).cast("long").alias("cells")), "partners")
    cell = lambda of: F.xxhash64("a", of)
    others = pairs.join(per, "a").select(cell(F.pmod(F.xxhash64("b"), F.col("cells"))).alias("cell"), F.col("b").alias("id"), F.lit(False).alias("first"))
    firsts = per.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("c"))
    firsts = firsts.select(cell(F.col("c")).alias("cell"), F.col("a").alias("id"), F.lit(True).alias("first"))
    seats = _small(work.save(others.unionByName(firsts), "seats"))
    rows = sets.join(seats, "id").select("cell", "id", "first", "set")
    rows = rows.repartition("cell").sortWithinPartitions("cell", F.col("first").desc(), "id")
    return map_batches(rows, run, "u long, v long")


def _among(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_, values)
    at[at == len(sorted_)] = 0
    return sorted_[at] == values


def _cells(rows: DataFrame, block: int, work: Workspace) -> DataFrame:
    """Nodes with several components as cells of two blocks, ``left`` and ``right``, whose pairs are to be compared.

    The classes outside a node's heaviest component meet all others of the node.
    """
    weight = 1 + F.floor(F.col("n") / HEAVY)
    sizes = rows.groupBy("node", "component").agg(F.sum(weight).alias("c"))
    # a struct's maximum is its first field's; ties by component
    main = sizes.groupBy("node").agg(F.max(F.struct("c", "component")).alias("main"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    # a component that doesn't dominate its node isn't special: all meet all
    heavy = F.col("main.c") > block
    main = main.select("node", F.when(heavy, F.col("main.component")).alias("main"), F.when(heavy, F.col("all") - F.col("main.c")).otherwise(F.col("all")).alias("few"), F.when(heavy, F.col("main.c")).otherwise(0).alias("many"))
    d = rows.join(work.save(main, "mains"), "node")
    few = ~F.coalesce(F.col("component") == F.col("main"), F.lit(False))
    nf, nm = F.ceil(F.col("few") / block).cast("int"), F.ceil(F.col("many") / block).cast("int")
    spread = F.xxhash64("id", F.lit(7))
    d = d.withColumns({"isfew": few, "nf": nf, "nm": nm})
    d = d.withColumn("own", F.when(F.col("isfew"), F.pmod(spread, F.col("nf").cast("long"))).otherwise(F.col("nf") + F.pmod(spread, F.greatest(F.col("nm"), F.lit(1)).cast("long"))).cast("int"))
    # a few-block i meets every block j >= i; many-blocks meet few-blocks only
    up = F.when(F.col("isfew"), F.transform(F.sequence(F.col("own"), F.col("nf") + F.col("nm") - 1), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"))))
    down = F.when((~F.col("isfew")) | (F.col("own") > 0), F.transform(F.sequence(F.lit(0), F.least(F.col("own"), F.col("nf")) - 1), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"))))
    none = F.array().cast("array<struct<i:int,j:int>>")
    d = d.select("node", "id", "n", "component", "own", F.explode(F.concat(F.coalesce(up, none), F.coalesce(down, none))).alias("meet"))
    return d.select(F.xxhash64("node", "meet.i", "meet.j").alias("cell"), "id", "n", "component", (F.col("own") == F.col("meet.i")).alias("left"), (F.col("own") == F.col("meet.j")).alias("right"), "node")


def _allowed(x: int, right: np.ndarray, same: bool, comp: np.ndarray, n: np.ndarray, sketch: np.ndarray, least: float, ratio: float) -> np.ndarray:
    """Partners of ``x`` in another component whose sketches and sizes allow a link; a block with itself: each pair once."""
    y = right[right > x] if same else right
    y = y[(comp[y] != comp[x]) & (np.minimum(n[y], n[x]) >= ratio * np.maximum(n[y], n[x]))]
    return y[_estimate(sketch[y], sketch[x]) >= least]


def _suspects(cells: DataFrame, least: float, ratio: float) -> DataFrame:
    """The rows of a cell that have a partner which sketches allow. A pair of several nodes counts in the least one only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 0):
            n, comp = (t.column(i).to_numpy() for i in (2, 4))
            sketch = _matrix(t.column(3))
            left, right = (np.nonzero(t.column(i).to_numpy())[0] for i in (5, 6))
            node, seats = t.column(7)[0].as_py(), t.column(8).combine_chunks()
            # the rows of each earlier node
            flat, owner = seats.flatten().to_numpy(), np.repeat(np.arange(len(t)), seats.value_lengths().to_numpy(zero_copy_only=False))
            early = flat < node
            flat, owner = flat[early], owner[early]
            order = np.argsort(flat, kind="stable")
            values, number = np.unique(flat, return_inverse=True)
            members = np.split(owner[order], np.searchsorted(flat[order], values)[1:]) if len(values) else []
            own = np.split(number, np.searchsorted(owner, np.arange(1, len(t))))
            same, marked = bool(len(left) and len(right) and left[0] == right[0]), np.zeros(len(n), bool)
            for x in left.tolist():
                # two marked rows have nothing more to tell
                y = _allowed(x, right[~marked[right]] if marked[x] else right, same, comp, n, sketch, least, ratio)
                if len(y) and len(own[x]):
                    told = np.zeros(len(n), bool)
                    for e in own[x].tolist():
                        told[members[e]] = True
                    y = y[~told[y]]
                if len(y):
                    marked[y] = marked[x] = True
            if marked.any():
                yield from t.select([0, 1, 2, 4, 5, 6]).take(np.nonzero(marked)[0]).combine_chunks().to_batches()

    kinds = "cell long, id long, n long, component long, left boolean, right boolean"
    return map_batches(cells.repartition("cell").sortWithinPartitions("cell"), run, kinds)


def _spanning_links(suspects: DataFrame, sets: DataFrame, threshold: int, ratio: float) -> DataFrame:
    """Links on full sets that join the components of each cell; what a cell has joined already isn't compared again.

    A row's intersections with all others of the cell are counted at once, by lists of the rows that have a shingle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 0):
            ids, n, comp = (t.column(i).to_numpy() for i in (1, 2, 3))
            comp = comp.copy()
            left, right = (np.nonzero(t.column(i).to_numpy())[0] for i in (4, 5))
            flat, at = _bytes_of(t.column(6), "<u8")
            values, number = np.unique(flat, return_inverse=True)
            owners = np.repeat(np.arange(len(t)), n)[np.argsort(number, kind="stable")]
            sizes = np.bincount(number, minlength=len(values))
            starts = np.cumsum(sizes) - sizes
            same, u, v = bool(len(left) and len(right) and left[0] == right[0]), [], []
            for x in left.tolist():
                y = right[right > x] if same else right
                y = y[(comp[y] != comp[x]) & (np.minimum(n[y], n[x]) >= ratio * np.maximum(n[y], n[x]))]
                if not len(y):
                    continue
                own = number[at[x] : at[x + 1]]
                many = sizes[own]
                rows = owners[np.arange(many.sum()) + np.repeat(starts[own] - (np.cumsum(many) - many), many)]
                both = np.bincount(rows, minlength=len(n))[y]
                for k in y[100 * both >= threshold * (n[x] + n[y] - both)].tolist():
                    if comp[k] != comp[x]:
                        u.append(ids[x])
                        v.append(ids[k])
                        comp[comp == comp[k]] = comp[x]
            if u:
                yield _pairs(np.array(u), np.array(v), ("u", "v"))

    rows = sets.join(_small(suspects), "id").select("cell", "id", "n", "component", "left", "right", "set")
    return map_batches(rows.repartition("cell").sortWithinPartitions("cell"), run, "u long, v long")


class _Found:
    """What a run leaves in the shared folder: ``rows`` (id, h, n, row, class), ``classes`` (id, rep) and ``links`` (u, v) between classes."""

    def __init__(self, df: DataFrame, nulls: bool, k: int, threshold: int, trees: int, depth: int, limit: int, block: int, margin: float, id_col: str, text_col: str):
        if not 1 <= trees <= TOKENS:
            raise ValueError(f"trees must be from 1 to {TOKENS}")
        self.work = work = Workspace(df.sparkSession)
        least, ratio = threshold / 100 - margin, threshold / 100
        # a row's number is written with it, so it never changes
        sketches = work.save(_sketches(df, k, trees, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "sketches")
        digest = ["n", "d1", "d2"]
        sound = (F.col("n") > 0) if nulls else (F.col("n") > 0) & F.col("id").isNotNull()
        stands = work.save(sketches.filter(sound).groupBy(*digest).agg(F.min("id").alias("rep"), F.min("row").alias("class")), "stands")
        # a class of very many rows is split by adaptive execution, as both sides are plain shuffles
        rows = sketches.select("id", "h", "row", *digest).join(stands.select(*digest, "class"), digest, "left")
        self.rows = work.save(rows.select("id", "h", "n", "row", F.when(sound, F.col("class")).alias("class")), "rows")
        self.classes = stands.select(F.col("class").alias("id"), "rep")
        first = sketches.select("row", F.col("id").alias("rid"), F.col("h").alias("rh"), "n", "roots", "tokens", "sketch")
        classes = work.save(first.join(stands.select(F.col("class").alias("row")), "row").withColumnRenamed("row", "id"), "classes")
        work.drop(sketches)
        repeated = bool(self.rows.groupBy("id", "h").count().filter("count > 1").limit(1).count())
        sets_of = lambda ids: _full_sets(df, ids.distinct().join(classes.select("id", "rid", "rh"), "id"), k, work, id_col, text_col, repeated)

        nodes = _nodes(classes, trees, depth, limit, work)
        placed = work.save(nodes.join(classes.select("id", "n", "sketch"), "id"), "placed")
        pairs = work.save(_first_pass(placed, least, ratio, limit, work), "pairs1")
        sets = sets_of(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))))
        links = work.save(_confirmed(pairs, sets, threshold, work), "links1")
        component = work.save(connected_components(links, work), "components1")
        # a pair that meets in several nodes is compared in each, but told by the least of them only
        seats = placed.groupBy("id").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
        marked = placed.select("node", "id", "n").join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))
        # most nodes have one component by now; only what is left takes its sketch along
        cells = work.save(_cells(marked, block, work), "cells")
        left = cells.join(seats, "id").join(classes.select("id", "sketch"), "id")
        left = left.select("cell", "id", "n", "sketch", "component", "left", "right", "node", "nodes")
        suspects = work.save(_suspects(left, least, ratio), "suspects")
        self.links = component.filter("id <> component").select(F.col("id").alias("u"), F.col("component").alias("v"))
        self.more = bool(suspects.limit(1).count())
        if self.more:
            found = work.save(_spanning_links(suspects, sets_of(suspects.select("id")), threshold, ratio), "links2")
            self.links = self.links.unionByName(found)
        self.component = component

    def components(self, more: DataFrame | None = None) -> DataFrame:
        """``id, component`` of classes that have links, those of ``more`` included."""
        if more is None and not self.more:
            return self.component
        return self.work.save(connected_components(self.links if more is None else self.links.unionByName(more), self.work), "components2")


def near_duplicates(
    df: DataFrame, k: int = 5, threshold: int = 80, trees: int = 10, depth: int = 8, limit: int = 512, block: int = 2048, margin: float = 0.15, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, n_shingles, component_id, kept for every row. ``threshold``: percent."""
    f = _Found(df, False, k, threshold, trees, depth, limit, block, margin, id_col, text_col)
    again = f.work.save(f.rows.filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("c"), F.min("class").alias("least"), F.max("class").alias("most")).filter("c > 1"), "again")
    several = bool(again.limit(1).count())
    # texts of one id are joined through it
    of_id = f.rows.join(again.filter("least < most").select("id", "least"), "id").select(F.col("class").alias("u"), F.col("least").alias("v")).filter("u is not null")
    component = f.components(of_id if several else None).withColumnRenamed("id", "class")
    known = f.classes.withColumnRenamed("id", "class").join(component, "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = f.work.save(known.groupBy("component").agg(F.min("rep").alias("component_id")), "least_ids")
    known = f.work.save(known.join(least, "component").select("class", "component_id"), "class_components")
    out = f.rows.join(known, "class", "left")
    if several:  # a wordless text of an id that has others
        joined = out.filter("class is not null").select("id", F.col("component_id").alias("_of_id")).distinct().join(again.select("id"), "id")
        out = out.join(joined, "id", "left").withColumn("component_id", F.coalesce("component_id", F.when(F.col("id").isNotNull(), F.col("_of_id"))))
    out = out.withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def near_groups(
    df: DataFrame, k: int = 5, threshold: int = 80, trees: int = 10, depth: int = 8, limit: int = 512, block: int = 2048, margin: float = 0.15, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, text_hash, group for every row that has words: rows of one group are near copies of one another's."""
    f = _Found(df, True, k, threshold, trees, depth, limit, block, margin, id_col, text_col)
    component = f.components().withColumnRenamed("id", "class")
    out = f.rows.filter("class is not null").join(component, "class", "left")
    return out.select(F.col("id").alias(id_col), F.col("h").alias("text_hash"), F.coalesce("component", "class").alias("group"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Of each group of near copies one row stays, with all its columns: that of the least id (nulls last).

    Rows without words all stay. Rows that equal in id are told apart by their texts, and of rows equal in both one stays.
    """
    work = Workspace(df.sparkSession)
    groups = work.save(near_groups(df, id_col=id_col, text_col=text_col, **options), "groups")
    key = F.struct(F.col(id_col).isNull().alias("null"), F.col(id_col).alias("id"), F.col("text_hash").alias("h"))
    first = work.save(groups.groupBy("group").agg(F.min(key).alias("first")), "firsts")
    d = groups.join(first, "group").withColumn("stays", key.eqNullSafe(F.col("first")))
    gone = work.save(d.filter(~F.col("stays")).select(F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "gone")
    same = lambda t: df[id_col].eqNullSafe(t["_id"]) & (F.xxhash64(df[text_col]) == t["_hash"])
    few = _small(gone)
    kept = df.join(few, same(few), "left_anti")
    copies = work.save(d.filter("stays").groupBy(F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash")).count().filter("count > 1").drop("count"), "copies")
    if not copies.limit(1).count():
        return kept
    # rows equal in id and text: the one whose columns have the least digest; it is packed whole, so no name of its own is touched
    own = [df[c] for c in df.columns]
    rows = df.join(copies, same(copies), "left_semi").select(df[id_col].alias("_id"), F.xxhash64(df[text_col]).alias("_hash"), F.struct(*own).alias("_row"), F.xxhash64(*own).alias("_order"))
    one = rows.groupBy("_id", "_hash").agg(F.min_by("_row", "_order").alias("_row")).select("_row.*")
    return kept.join(copies, same(copies), "left_anti").select(*df.columns).unionByName(one)
