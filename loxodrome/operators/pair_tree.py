"""Counts of pairs by distance, by leaves of trees.

Points are dealt to blocks that lie close together, and a task meets one pair of blocks. It cuts the first into leaves of
some 32 points and puts the second's points in order of their distance from a leaf's centre. For each radius, points nearer than it by the
width of the leaf are within it of all the leaf's points, and are counted as a whole; those beyond it by as much are passed over. Only the
points between are compared, by the cosines of all their pairs at once. Cosines are of single precision; those that
can't be told from the radius's are decided by the distance itself.

Tasks hold two blocks and give counts. What is shuffled are the points, once for each block of their key; simulated points are drawn where they are counted.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loxodrome.config import RADIUS_KM
from loxodrome.functions import geo
from loxodrome.functions.shared import saved
from loxodrome.operators.neighbours import haversine_matrix, haversine_of

#: Blocks of a key whose points no single task should meet, and the most points of a block.
PARTS, BLOCK = 24, 1 << 19
#: Two leaves have at most so many pairs of points.
LEAF = 1 << 10
#: Pairs that are compared at once: their cosines stay in a core's cache.
_ROOM = 1 << 16
#: More than single precision may do to the cosine of two unit vectors (3e-7) and to a radius's (6e-8).
_BLUR = 4e-7


def parts_of(most: int, whole: int) -> int:
    """How many blocks a key of ``most`` points is cut into; up to ``whole`` it is one."""
    return 1 if most <= whole else max(-(-most // BLOCK), min(PARTS, -(-most // 1024)) if whole < BLOCK else 1)


def _near(bits: int = 10) -> Column:
    """A number that is close for close points: the bits of three coordinates in turn, then those of a hash."""
    ints = [F.least(F.greatest(F.floor((c + 1.0) * float(1 << (bits - 1))), F.lit(0)), F.lit((1 << bits) - 1)).cast("long") for c in geo.xyz("lon", "lat")]
    turns = [F.shiftleft(F.shiftright(v, b).bitwiseAND(F.lit(1).cast("long")), 3 * b + k + 20) for b in range(bits) for k, v in enumerate(ints)]
    return reduce(lambda x, y: x.bitwiseOR(y), turns, F.xxhash64("lat", "lon").bitwiseAND(F.lit((1 << 20) - 1).cast("long")))


def _blocks(points: DataFrame, keys: tuple[str, ...], parts: int) -> DataFrame:
    """``keys, lat, lon, w, own``: places, how many points are there, and their block."""
    lat, lon = F.col("latitude").cast("double").alias("lat"), F.col("longitude").cast("double").alias("lon")
    p = points.select(*keys, lat, lon).dropna(subset=["lat", "lon"])
    if parts == 1:
        return p.withColumns({"w": F.lit(1).cast("long"), "own": F.lit(0)})
    p = saved(p.groupBy(*keys, "lat", "lon").agg(F.count(F.lit(1)).alias("w")).withColumn("_near", _near()))
    cuts = p.groupBy(*keys).agg(F.percentile_approx("_near", [i / parts for i in range(1, parts)], 10_000).alias("_cuts"))
    d = p.join(F.broadcast(cuts), list(keys)) if keys else p.crossJoin(F.broadcast(cuts))  # a row for each key
    return d.withColumn("own", F.size(F.filter("_cuts", lambda c: c < F.col("_near")))).drop("_cuts", "_near")


def _leaves(xyz: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of points in which leaves of ``size`` follow each other, and where they begin: halved along the longest side."""
    order, starts, todo = np.arange(len(xyz)), [], [(0, len(xyz))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= size:
            starts.append(lo)
            continue
        own = xyz[order[lo:hi]]
        middle = -(-(hi - lo) // size) // 2 * size
        order[lo:hi] = order[lo:hi][np.argpartition(own[:, np.ptp(own, axis=0).argmax()], middle)]
        todo += [(lo, lo + middle), (lo + middle, hi)]
    return order, np.sort(np.array([*starts, len(xyz)]))


class _Tree:
    """A block's points in the order of leaves, with the centre of each leaf and the angle that its points are within."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, w: np.ndarray, size: int):
        a, b = np.radians(lat), np.radians(lon)
        xyz = np.column_stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)])
        order, self.at = _leaves(xyz, size)
        xyz, self.lat, self.lon, self.w = xyz[order], lat[order], lon[order], w[order]
        self.plain = bool((w == 1).all())
        self.single = xyz.astype(np.float32)
        first = self.at[:-1]
        self.n = np.add.reduceat(self.w, first)
        centre = np.add.reduceat(xyz, first)
        length = np.sqrt((centre**2).sum(axis=1))[:, None]
        centre = np.where(length > 1e-3, centre / np.maximum(length, 1e-3), xyz[first])  # points all around have no centre
        away = np.sqrt(((xyz - np.repeat(centre, np.diff(self.at), axis=0)) ** 2).sum(axis=1))
        self.angle = 2.0 * np.arcsin(np.minimum(np.maximum.reduceat(away, first) / 2.0, 1.0)) + 1e-9
        self.centre = centre.astype(np.float32)


def _in_leaf(tree: _Tree, i: slice, edges: np.ndarray, radius: float) -> np.ndarray:
    """Ordered pairs of a leaf's own points up to each radius. Points of one place are at 0, a point isn't its own neighbour."""
    d = haversine_matrix(tree.lat[i], tree.lon[i], tree.lat[i], tree.lon[i], radius)
    pairs = np.outer(tree.w[i], tree.w[i])
    np.fill_diagonal(pairs, tree.w[i] * (tree.w[i] - 1))
    band = np.searchsorted(edges, d.ravel(), "left")
    counts = np.zeros(len(edges) + 1, np.int64)
    np.add.at(counts, band, pairs.ravel())
    return np.cumsum(counts[:-1])


def _met(one: _Tree, two: _Tree, edges: np.ndarray, radius: float) -> tuple[np.ndarray, int]:
    """Ordered pairs of points up to each radius, and how many pairs were compared."""
    same = one is two
    within, compared = np.zeros(len(edges), np.int64), 0
    angles = np.minimum(edges / radius, math.pi)
    cosines = np.cos(angles)
    room_u, room_sure, room_not = np.empty(_ROOM, np.float32), np.empty(_ROOM, bool), np.empty(_ROOM, bool)
    for leaf in range(len(one.n)):
        i = slice(int(one.at[leaf]), int(one.at[leaf + 1]))
        if same:
            within += _in_leaf(one, i, edges, radius)
        start = i.stop if same else 0  # leaves before have met this one
        # points from the nearest to the centre on; cosines are negative, so that they rise
        less = two.single[start:] @ -one.centre[leaf]
        width = one.angle[leaf]
        inner = np.where(angles > width, -np.cos(angles - width) - _BLUR, -2.0)
        inner[edges >= math.pi * radius] = 2.0
        outer = np.where(angles + width < math.pi, -np.cos(np.minimum(angles + width, math.pi)) + _BLUR, 2.0)
        near = np.flatnonzero(less <= np.float32(outer[-1]))
        less = less[near]
        order = np.argsort(less)
        less, near = less[order], near[order] + start
        upto = np.searchsorted(less, inner.astype(np.float32), "right")
        end = np.searchsorted(less, outer.astype(np.float32), "right")
        sums = upto if two.plain else np.concatenate([[0], np.cumsum(two.w[near])])[upto]
        found = one.n[leaf] * sums
        left, right = one.single[i], two.single[near]
        step = max(1, _ROOM // len(left))
        doubt, n_doubt = [], 0

        def decided(doubt=doubt, found=found, near=near, i=i):
            k, a, b = (np.concatenate(x) for x in zip(*doubt, strict=True))
            a, b = a + i.start, near[b]
            hit = haversine_of(one.lat[a], one.lon[a], two.lat[b], two.lon[b], radius) <= edges[k]
            np.add.at(found, k[hit], (one.w[a] * two.w[b])[hit])
            doubt.clear()

        for k in np.flatnonzero(end > upto).tolist():
            for at in range(int(upto[k]), int(end[k]), step):
                to = min(at + step, int(end[k]))
                shape = len(left), to - at
                u, sure, maybe = (r[: shape[0] * shape[1]].reshape(shape) for r in (room_u, room_sure, room_not))
                np.matmul(left, right[at:to].T, out=u)
                compared += u.size
                n_sure = np.count_nonzero(np.greater_equal(u, np.float32(cosines[k] + _BLUR), out=sure))
                found[k] += n_sure if one.plain and two.plain else int(one.w[i] @ (sure @ two.w[near[at:to]]))
                if n_sure < np.count_nonzero(np.greater_equal(u, np.float32(cosines[k] - _BLUR), out=maybe)):
                    a, b = np.divmod(np.flatnonzero(np.not_equal(sure, maybe, out=maybe)), shape[1])
                    doubt.append((np.full(len(a), k), a, b + at))
                    n_doubt += len(a)
                    if n_doubt > 1 << 18:
                        decided()
                        n_doubt = 0
        if doubt:
            decided()
        within += 2 * found
    return within, compared


def _by_band(one: _Tree, two: _Tree, edges: np.ndarray, radius: float) -> np.ndarray:
    """Ordered pairs at each radius of which it is the least that holds them, and at last how many pairs were compared."""
    within, compared = _met(one, two, edges, radius)
    return np.append(np.diff(within, prepend=0), compared)


def _at_radii(total: DataFrame, edges: np.ndarray, keys: tuple[str, ...]) -> DataFrame:
    at = F.element_at(F.array(*[F.lit(e) for e in edges.tolist()]), F.col("band") + 1)
    return total.filter((F.col("band") < len(edges)) & (F.col("c") > 0)).select(*keys, at.alias("radius_km"), "c")


def tree_counts(points: DataFrame, radii, keys: tuple[str, ...] = (), radius: float = RADIUS_KM, leaf: int = LEAF, watch: list | None = None, parts: int = PARTS) -> DataFrame:
    """``keys, radius_km, c``: ordered pairs of points at each radius of which it is the least that holds them.

    ``watch`` gets how many pairs of points were compared.
    """
    edges = np.sort(np.array(radii, float))
    size = math.isqrt(leaf)
    meet = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda o: F.struct(F.least(o, F.col("own")).alias("a"), F.greatest(o, F.col("own")).alias("b")))
    d = _blocks(points, keys, parts)
    d = d.withColumns({"a": F.lit(0), "b": F.lit(0)}) if parts == 1 else d.withColumn("_m", F.explode(meet)).select(*keys, "lat", "lon", "w", "own", F.col("_m.a").alias("a"), F.col("_m.b").alias("b"))
    # few rows of much work each: their number of tasks is given, as sizes say nothing of it
    tasks = max(parts * (parts + 1) // 2, 4 * PARTS if keys else 1, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kinds = {k: points.schema[k].dataType.simpleString() for k in keys}

    def run(t: pa.Table) -> pa.Table:
        lat, lon, w, own, a, b = (t.column(c).to_numpy() for c in ("lat", "lon", "w", "own", "a", "b"))
        trees = {}
        for side in {int(a[0]), int(b[0])}:
            mine = own == side
            trees[side] = _Tree(lat[mine], lon[mine], w[mine], size) if mine.any() else None
        one, two = trees[int(a[0])], trees[int(b[0])]
        counts = _by_band(one, two, edges, radius) if one is not None and two is not None else np.zeros(len(edges) + 1, np.int64)
        bands = np.flatnonzero(counts)
        key = {k: pa.array([t.column(k)[0].as_py()] * len(bands), t.schema.field(k).type) for k in keys}
        return pa.table(key | {"band": pa.array(bands.astype(np.int32)), "c": pa.array(counts[bands])})

    schema = ", ".join([*[f"{k} {v}" for k, v in kinds.items()], "band int, c long"])
    met = d.repartition(tasks, *keys, "a", "b").groupBy(*keys, "a", "b").applyInArrow(run, schema)
    total = saved(met.groupBy(*keys, "band").agg(F.sum("c").alias("c")))
    if watch is not None:
        watch.append((total.filter(F.col("band") == len(edges)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0],))
    return _at_radii(total, edges, keys)


def drawn_counts(spark: SparkSession, n: int, reps: int, draw: Callable, radii, radius: float = RADIUS_KM, block: int = BLOCK) -> DataFrame:
    """``rep, radius_km, c``: as :func:`tree_counts`, for ``n`` points a replicate that tasks draw themselves; no point is shuffled.

    ``draw(rep, first, end)`` gives latitudes and longitudes of the points of these numbers. A task meets two blocks of at most ``block``.
    """
    edges = np.sort(np.array(radii, float))
    size, blocks = math.isqrt(LEAF), max(1, -(-n // block))
    pairs = blocks * (blocks + 1) // 2

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                rep, b = divmod(i, pairs)
                a = 0
                while b >= blocks - a:  # the pairs (0, 0), (0, 1), ..., (1, 1), (1, 2), ...
                    b, a = b - (blocks - a), a + 1
                trees = {}
                for side in {a, a + b}:
                    lat, lon = draw(rep, side * n // blocks, (side + 1) * n // blocks)
                    trees[side] = _Tree(lat, lon, np.ones(len(lat), np.int64), size)
                counts = _by_band(trees[a], trees[a + b], edges, radius)
                bands = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bands), rep)), pa.array(bands.astype(np.int32)), pa.array(counts[bands])], names=["rep", "band", "c"])

    tasks = min(reps * pairs, 10_000) if n else 1
    met = spark.range(0, reps * pairs if n else 0, 1, tasks).mapInArrow(run, "rep long, band int, c long")
    return _at_radii(saved(met.groupBy("rep", "band").agg(F.sum("c").alias("c"))), edges, ("rep",))
