"""Embedding near-duplicates by an epsilon grid order join.

Vectors are scaled to length 1, so that a cosine of c is a distance of sqrt(2 - 2c), the join's epsilon. Rows
with equal vectors and labels (by a 128-bit digest) form a class. Vectors are rotated to the principal directions of
all vectors, which keeps distances; a grid over the leading directions, of a width of epsilon at least, orders the
vectors of each label lexicographically by cell (the epsilon grid order). Spark's range partitioning sorts them so, and
each partition cuts its run into intervals of bounded size: no task sees a whole label, nor a whole cell.

Two intervals meet only if their bounding boxes, over all directions, are within epsilon. If their balls are so near
that all their vectors must link, nothing is compared: numbers of vectors are added, and one link joins them. Another
pair of intervals is joined recursively: halves whose boxes are further apart than epsilon are skipped, those that must
link are counted, small ones are compared by matrix products, and what is near the threshold is confirmed by the
cosine of the vectors as given, in doubles.

A task returns link counts and a spanning forest of the links it found, not the links, so that a crowd of mutual
near copies costs no more rows than vectors. Components come from the forests.

Defined cases: vectors that are null, empty, zero or hold null or non-finite values, rows with a null label or id, and
vectors of different length link with nothing; they are rows of the result; repeated rows and ids each get a row (rows
with one id are one vertex of the components, a null id has none); labels may be of any type; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, DoubleType, FloatType

from loxodrome.llm.components import connected_components
from loxodrome.llm.frames import grouped, map_batches, narrow
from loxodrome.llm.workspace import Workspace

_LEAF = 64
#: Least widths of the grid that orders vectors, and of the one by which boxes meet.
_ORDER_WIDTH, _BOX_WIDTH = 0.01, 0.2


def _axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Principal directions of the scaled vectors, from their second moments: dim * dim numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _unit(batch.column(0), dim)
            total += x.T @ x
        i = np.arange(dim * dim)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(total.ravel())], names=["i", "s"])

    rows = map_batches(vectors.select("vector"), run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    moments = np.zeros(dim * dim)
    for r in rows:
        moments[r["i"]] = r["s"]
    _, axes = np.linalg.eigh(moments.reshape(dim, dim))
    return np.ascontiguousarray(axes[:, ::-1])


def _raw(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    x = _raw(column, dim)
    # scaled by the largest component first, so that no square leaves the range of doubles
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _box_gap(a: np.ndarray, b: np.ndarray) -> float:
    """Squared distance of two bounding boxes given as rows of minima and maxima."""
    gap = np.maximum(0, np.maximum(a[0] - b[1], b[0] - a[1]))
    return float(gap @ gap)


def _far(a: np.ndarray, b: np.ndarray) -> float:
    """A bound of the squared distances between the vectors of two boxes."""
    far = np.maximum(a[1] - b[0], b[1] - a[0])
    return float(far @ far)


def join_sequences(x: np.ndarray, raw: np.ndarray, left: np.ndarray, right: np.ndarray, cosine: float, weights: np.ndarray, same: bool):
    """Join two intervals of the grid order (positions into ``x``); ``same``: an interval with itself.

    Returns each position's summed weight of linked vectors, and links that span what is connected.
    """
    reach, sure = 2 - 2 * cosine + 1e-9, 2 - 2 * cosine - 1e-9
    counts, comp, links = np.zeros(len(x), np.int64), np.arange(len(x)), []
    boxes: dict[tuple[int, int], np.ndarray] = {}

    def box(seq: np.ndarray) -> np.ndarray:
        key = (int(seq[0]), len(seq))
        if key not in boxes:
            boxes[key] = np.stack([x[seq].min(axis=0), x[seq].max(axis=0)])
        return boxes[key]

    def span(u: np.ndarray, v: np.ndarray) -> None:
        while True:
            (open_,) = np.nonzero(comp[u] != comp[v])
            if not len(open_):
                return
            u, v = u[open_], v[open_]
            links.append((int(u[0]), int(v[0])))
            comp[comp == comp[v[0]]] = comp[u[0]]

    def leaf(a: np.ndarray, b: np.ndarray, own: bool) -> None:
        c = x[a] @ x[b].T
        i, j = np.nonzero(c >= cosine - 1e-7)
        if own:
            i, j = i[i < j], j[i < j]
        if not len(i):
            return
        u, v = a[i], b[j]
        near = np.abs(c[i, j] - cosine) < 1e-7
        if near.any():
            exact = np.ones(len(u), bool)
            p, q = raw[u[near]], raw[v[near]]
            exact[near] = (p * q).sum(axis=1) / (np.sqrt((p * p).sum(axis=1)) * np.sqrt((q * q).sum(axis=1))) >= cosine
            u, v = u[exact], v[exact]
        np.add.at(counts, u, weights[v])
        np.add.at(counts, v, weights[u])
        span(u, v)

    todo = [(left, right, same)]
    while todo:
        a, b, own = todo.pop()
        if not own and _box_gap(box(a), box(b)) > reach:
            continue
        if _far(box(a), box(b)) <= sure:
            counts[a] += weights[b].sum() - (weights[a] if own else 0)
            if not own:
                counts[b] += weights[a].sum()
            span(np.repeat(a[:1], len(b)), b)
            if not own:
                span(a, np.repeat(b[:1], len(a)))
        elif len(a) <= _LEAF and len(b) <= _LEAF:
            leaf(a, b, own)
        elif own:
            m = len(a) // 2
            todo += [(a[:m], a[:m], True), (a[m:], a[m:], True), (a[:m], a[m:], False)]
        elif len(a) >= len(b):
            m = len(a) // 2
            todo += [(a[:m], b, False), (a[m:], b, False)]
        else:
            m = len(b) // 2
            todo += [(a, b[:m], False), (a, b[m:], False)]
    return counts, links


def _as_text(c: Column, kind: DataType) -> Column:
    """Equal texts for equal labels of any type."""
    if isinstance(kind, FloatType | DoubleType):
        c = c + F.lit(0.0).cast(kind)  # -0.0 and 0.0 are one number
    if isinstance(kind, BinaryType):
        return F.hex(c)
    return F.to_json(F.struct(c)) if kind.typeName() in ("struct", "array", "map", "variant") else c.cast("string")


def embedding_links(
    df: DataFrame, cosine: float = 0.98, interval: int = 1024, leading: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """``id_col``, n_links, component_id, kept for every row."""
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0 and at most 1")
    spark = df.sparkSession
    work = Workspace(spark)
    d = narrow(df, id_col, vector_col, label_col)
    d = d.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), _as_text(F.col(label_col), d.schema[label_col].dataType).alias("label"))
    sound = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0) & F.col("label").isNotNull() & F.col("id").isNotNull()
    # -0.0 and 0.0 are one number
    plain = F.when(F.coalesce(sound, F.lit(False)), F.transform("vector", lambda v: v + F.lit(0.0)))
    d = d.select("id", "label", plain.alias("vector"))
    digest = [F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(s), "label", "vector")).alias(f"d{s}") for s in (1, 2)]
    # a row's number is written with it, so it never changes
    rows = work.save(d.select("id", "label", "vector", *digest, F.monotonically_increasing_id().alias("row")), "rows")
    stands = work.save(rows.filter("vector is not null").groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.min("row").alias("key"), F.count(F.lit(1)).alias("weight")), "stands")
    classes = work.save(rows.select(F.col("row").alias("key"), "label", "vector", F.size("vector").alias("dim")).join(stands.select("key", "rep", "weight"), "key"), "classes")
    found = [_joined(classes.filter(F.col("dim") == r["dim"]), r["dim"], cosine, interval, leading, work) for r in classes.select("dim").distinct().collect()]
    if not found:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    counts, links = found[0]
    for c, k in found[1:]:
        counts, links = counts.unionByName(c), links.unionByName(k)
    of_class = stands.join(counts.groupBy("key").agg(F.sum("n").alias("n")), "key", "left")
    of_class = work.save(of_class.select("d1", "d2", "rep", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("links")), "counts")
    out = rows.select("id", "d1", "d2").join(of_class, ["d1", "d2"], "left").withColumn("rep", F.coalesce("rep", "id"))
    # rows of one id are one vertex: it is linked to the class of each of them
    several = rows.filter("id is not null").groupBy("id").count().filter("count > 1").select("id")
    if several.limit(1).count():
        links = links.unionByName(out.join(several, "id").select(F.col("id").alias("u"), F.col("rep").alias("v")))
    component = work.save(connected_components(links, work), "components")
    out = out.join(component.withColumnRenamed("id", "rep"), "rep", "left")
    component_id = F.coalesce("component", "rep")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), F.coalesce(F.col("id") == component_id, F.lit(False)).alias("kept"))


def _joined(classes: DataFrame, dim: int, cosine: float, interval: int, leading: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Links between different classes of one length of vectors: per class its count, and spanning links."""
    axes = _axes(classes, dim)
    epsilon = float(np.sqrt(2 - 2 * cosine)) + 1e-9
    width, m = max(epsilon, _ORDER_WIDTH), min(leading, dim)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(batch.column(4), dim) @ axes
            cells = np.floor(x[:, :m] / width).astype(np.int64)
            # an order-preserving text of the cells: the grid order is the order of this column
            order = pa.array(["".join(f"{c + 5000:04d}" for c in row) for row in cells.tolist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, order], names=["key", "label", "rep", "weight", "vector", "cell"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of at most ``interval`` rows of one label; the first row of each carries its box, ball and weight."""
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, []

        def closed() -> pa.RecordBatch:
            nonlocal number
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            x, n = _unit(t.column(4), dim) @ axes, len(t)
            middle = x.mean(axis=0)
            radius = float(np.sqrt(((x - middle) ** 2).sum(axis=1).max()))
            first = lambda v, kind: pa.array([v] + [None] * (n - 1), kind)
            lists = [first(v.tolist(), pa.list_(pa.float64())) for v in (x.min(axis=0), x.max(axis=0), middle)]
            seq, number = (part << 32) | number, number + 1
            return pa.RecordBatch.from_arrays([*t.columns[:5], pa.array(np.full(n, seq)), *lists, first(radius, pa.float64()), first(int(t.column(3).to_numpy().sum()), pa.int64())], names=names)

        for batch in batches:
            labels, at = batch.column(1), 0
            change = np.nonzero(pa.compute.not_equal(labels[1:], labels[:-1]).to_numpy(zero_copy_only=False))[0] + 1
            for stop in [*change.tolist(), len(batch)]:
                while at < stop:
                    if held and held[0].column(1)[0] != labels[at]:
                        yield closed()
                        held = []
                    n = min(stop - at, interval - sum(map(len, held)))
                    held.append(batch.slice(at, n))
                    at += n
                    if sum(map(len, held)) == interval:
                        yield closed()
                        held = []
        if held:
            yield closed()

    names = ["key", "label", "rep", "weight", "vector", "seq", "lo", "hi", "middle", "radius", "total"]
    source = classes.select("key", "label", "rep", "weight", "vector")
    placed = map_batches(source, project, "key long, label string, rep long, weight long, vector array<double>, cell string")
    ordered = placed.repartitionByRange("label", "cell", "key").sortWithinPartitions("label", "cell", "key").drop("cell")
    kinds = "key long, label string, rep long, weight long, vector array<double>, seq long, lo array<double>, hi array<double>, middle array<double>, radius double, total long"
    seated = work.save(map_batches(ordered, cut, kinds), "seated")

    # boxes meet by an equi-join on the grid cells that they touch in the first directions, one side widened by a cell
    boxes = seated.filter("lo is not null").select("label", "seq", "lo", "hi", "middle", "radius", "total", "rep")
    lead, step = min(3, dim), max(epsilon, _BOX_WIDTH)
    touched = lambda d, k: F.explode(F.sequence(F.floor(F.col("lo")[k] / step) - d, F.floor(F.col("hi")[k] / step) + d)).alias(f"g{k}")
    sides = []
    for name, widen in (("a", 1), ("b", 0)):
        t = boxes.select("label", "seq", "lo", "hi")
        for k in range(lead):
            t = t.select("label", "seq", "lo", "hi", *[f"g{j}" for j in range(k)], touched(widen, k))
        sides.append(t.select("label", F.col("seq").alias(f"seq_{name}"), *[f"g{j}" for j in range(lead)]))
    near = sides[0].join(sides[1], ["label", *[f"g{j}" for j in range(lead)]]).filter("seq_a <= seq_b").select("seq_a", "seq_b").distinct()
    a, b = (boxes.select(*[F.col(c).alias(f"{c}_{s}") for c in ("seq", "lo", "hi", "middle", "radius", "total", "rep")]) for s in "ab")
    total = lambda parts: F.aggregate(parts, F.lit(0.0), lambda s, g: s + g * g)
    over = lambda p, q: F.zip_with(p, q, lambda x, y: F.greatest(F.lit(0.0), x - y))
    gap = total(over("lo_a", "hi_b")) + total(over("lo_b", "hi_a"))  # of each direction one of them is 0
    apart = F.sqrt(total(F.zip_with("middle_a", "middle_b", lambda x, y: x - y)))
    sure = apart + 2 * F.greatest("radius_a", "radius_b") <= epsilon - 1e-6
    met = near.join(a, "seq_a").join(b, "seq_b").filter(gap <= epsilon * epsilon)
    met = work.save(met.select("seq_a", "seq_b", sure.alias("sure"), "total_a", "total_b", "rep_a", "rep_b"), "met")

    open_ = met.filter("not sure")
    sides = open_.select(F.col("seq_a").alias("seq"), "seq_a", "seq_b").unionByName(open_.filter("seq_a < seq_b").select(F.col("seq_b").alias("seq"), "seq_a", "seq_b"))
    cellmates = seated.select("seq", "key", "rep", "weight", "vector").join(sides, "seq")
    cellmates = cellmates.select(F.xxhash64("seq_a", "seq_b").alias("pair"), (F.col("seq") == F.col("seq_a")).alias("first"), (F.col("seq_a") == F.col("seq_b")).alias("same"), "key", "rep", "weight", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 0):
            first, same = t.column(1).to_numpy(), bool(t.column(2)[0].as_py())
            key, rep, weight = (t.column(i).to_numpy() for i in (3, 4, 5))
            vectors = t.column(6).combine_chunks()
            vectors = pa.concat_arrays(vectors.chunks) if isinstance(vectors, pa.ChunkedArray) else vectors
            raw, x = _raw(vectors, dim), _unit(vectors, dim) @ axes
            order = np.lexsort(np.floor(x[:, :m] / width).T[::-1])  # the grid order again
            left = order[first[order]]
            right = left if same else order[~first[order]]
            counts, links = join_sequences(x, raw, left, right, cosine, weight, same)
            (i,) = np.nonzero(counts)
            u, v = (np.array([rep[p[s]] for p in links], np.int64) for s in (0, 1))
            kind = np.concatenate([np.zeros(len(i), np.int64), np.ones(len(u), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([key[i], u])), pa.array(np.concatenate([counts[i], v]))], names=["kind", "p", "q"])

    results = work.save(map_batches(cellmates.repartition("pair").sortWithinPartitions("pair"), run, "kind long, p long, q long"), "joined")
    # intervals whose vectors all link: each vector has the others' weight, and is joined to its interval's first one
    full = met.filter("sure")
    added = full.select(F.col("seq_a").alias("seq"), F.col("total_b").alias("n"), (F.col("seq_a") == F.col("seq_b")).cast("int").alias("own"), F.col("rep_a").alias("head"))
    added = added.unionByName(full.filter("seq_a < seq_b").select(F.col("seq_b").alias("seq"), F.col("total_a").alias("n"), F.lit(0).alias("own"), F.col("rep_b").alias("head")))
    added = added.groupBy("seq").agg(F.sum("n").alias("n"), F.sum("own").alias("own"), F.min("head").alias("head"))
    inside = seated.select("seq", "key", "rep", "weight").join(added, "seq")
    counts = results.filter("kind = 0").select(F.col("p").alias("key"), F.col("q").alias("n"))
    counts = counts.unionByName(inside.select("key", (F.col("n") - F.col("own") * F.col("weight")).alias("n")))
    links = results.filter("kind = 1").select(F.col("p").alias("u"), F.col("q").alias("v"))
    links = links.unionByName(inside.select(F.col("rep").alias("u"), F.col("head").alias("v"))).unionByName(full.select(F.col("rep_a").alias("u"), F.col("rep_b").alias("v")))
    return counts, links
