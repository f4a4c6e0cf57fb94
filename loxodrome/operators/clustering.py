"""Second-order statistics of points on a sphere, and kernel density in the plane."""

from __future__ import annotations

import math
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loxodrome.config import BROADCAST_ROWS, RADIUS_KM, SEED
from loxodrome.functions import stats
from loxodrome.functions.shared import saved
from loxodrome.operators import neighbours, pair_tree, ranking, resample

#: Radii in km: 50 steps from 50 to 2500.
RADII_KM = tuple(50.0 * (i + 1) for i in range(50))


def _identified(points: DataFrame) -> DataFrame:
    return points if "id" in points.columns else resample.numbered(points.select("longitude", "latitude")).withColumnRenamed("row_seq", "id")


def pair_counts(points: DataFrame, radii=RADII_KM, keys: tuple[str, ...] = (), radius: float = RADIUS_KM, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``keys, radius_km, pairs``: ordered pairs up to each radius. Each pair is counted once, at its least radius.

    Points of a key meet in one task up to ``broadcast_rows``; more are cut into blocks, of which each pair is a task.
    """
    counts = pair_tree.tree_counts(points, radii, keys, radius, parts=pair_tree.parts_of(_most(points, keys), broadcast_rows))
    return _summed(points.select(*keys).distinct() if keys else points.sparkSession.range(1).select(), counts, radii, keys)


def _summed(every: DataFrame, counts: DataFrame, radii, keys: tuple[str, ...]) -> DataFrame:
    """``keys, radius_km, pairs``: counts at their least radius summed up to each, with zeros for the keys of ``every`` that have none."""
    every = every.select(*keys, F.explode(F.array(*[F.lit(float(r)) for r in radii])).alias("radius_km"))
    mine = counts.withColumnRenamed("radius_km", "_r")
    met = every.join(mine, list(keys)) if keys else every.join(F.broadcast(mine))  # a row for each radius
    summed = met.filter(F.col("_r") <= F.col("radius_km")).groupBy(*keys, "radius_km").agg(F.sum("c").alias("pairs"))
    return every.join(summed, [*keys, "radius_km"], "left").na.fill(0, ["pairs"])


def _most(points: DataFrame, keys: tuple[str, ...]) -> int:
    """The number of points of the key that has most."""
    if not keys:
        return points.count()
    return points.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def _area(radius: float) -> float:
    return 4.0 * math.pi * radius * radius


def ripley_k(points: DataFrame, radii=RADII_KM, radius: float = RADIUS_KM, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``radius_km, k_observed, k_csr``."""
    p = saved(_identified(points))
    n = p.count()
    if n < 2:
        raise ValueError("Ripley's K needs at least 2 points")
    k = F.col("pairs") / float(n) * (_area(radius) / n)
    return pair_counts(p, radii, radius=radius, broadcast_rows=broadcast_rows).select("radius_km", k.alias("k_observed"), stats.csr_k("radius_km", radius).alias("k_csr"))


def pair_correlation(k: DataFrame, radius: float = RADIUS_KM) -> DataFrame:
    """Adds ``g_observed``; null where the circle has no length."""
    length = 2.0 * math.pi * radius * F.sin(F.col("radius_km") / radius)
    d = ranking.gradient(k, "radius_km", "k_observed", "_slope")
    return d.withColumn("g_observed", F.when(length > 0, F.col("_slope") / length)).drop("_slope")


def nearest_neighbour_cdf(points: DataFrame, radii=RADII_KM, radius: float = RADIUS_KM, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``radius_km, nn_cdf_observed, nn_cdf_csr``."""
    p = saved(_identified(points))
    n = p.count()
    if n <= broadcast_rows:

        def work(i, lat1, lon1, j, lat2, lon2, same):
            d = neighbours.haversine_matrix(lat1, lon1, lat2, lon2, radius)
            if same:
                np.fill_diagonal(d, np.inf)
            if not d.size:
                return {"i": i[:0], "d": np.zeros(0)}
            return {"i": np.concatenate([i, j]), "d": np.concatenate([d.min(axis=1), d.min(axis=0)])}

        kind = p.schema["id"].dataType.simpleString()
        near = neighbours.in_blocks(p, (), n, work, f"i {kind}, d double").groupBy("i").agg(F.min("d").alias("d")).filter(F.col("d") <= max(radii)).withColumn("c", F.lit(1).cast("long"))
    else:
        near = neighbours.nearest_other(p, max(radii), radius)
    steps = F.array(*[F.lit(float(r)) for r in radii])
    counts = near.select("c", F.explode(F.filter(steps, lambda r: r >= F.col("d"))).alias("radius_km")).groupBy("radius_km").agg(F.sum("c").alias("c"))
    every = p.sparkSession.range(1).select(F.explode(steps).alias("radius_km"))
    d = every.join(counts, "radius_km", "left").na.fill(0, ["c"])
    csr = 1.0 - F.exp(-(n / _area(radius)) * stats.csr_k("radius_km", radius))
    return d.select("radius_km", (F.col("c") / float(max(n, 1))).alias("nn_cdf_observed"), csr.alias("nn_cdf_csr"))


def csr_envelope(spark, n: int, radii=RADII_KM, radius: float = RADIUS_KM, sims: int = 199, seed: int = SEED) -> DataFrame:
    """``radius_km, k_env_lo, k_env_hi``: 2.5 and 97.5 percentiles of K over simulations, which tasks draw and count, so that only counts are shuffled."""
    counts = pair_tree.drawn_counts(spark, n, sims, partial(resample.sphere_block, seed=seed), radii, radius)
    k = _summed(spark.range(sims).withColumnRenamed("id", "rep"), counts, radii, ("rep",)).withColumn("k", F.col("pairs") / float(n) * (_area(radius) / n))
    return ranking.quantiles_of_few(k, ["radius_km"], "k", {"k_env_lo": 0.025, "k_env_hi": 0.975})


def spatial_stats(points: DataFrame, radii=RADII_KM, radius: float = RADIUS_KM, sims: int = 199, seed: int = SEED) -> tuple[DataFrame, dict]:
    """All curves by radius, and a summary; clustered means K above its envelope at any radius."""
    n = points.count()
    table = pair_correlation(ripley_k(points, radii, radius), radius).join(nearest_neighbour_cdf(points, radii, radius), "radius_km")
    table = table.join(csr_envelope(points.sparkSession, n, radii, radius, sims, seed), "radius_km").orderBy("radius_km").cache()
    clustered = table.filter("k_observed > k_env_hi").limit(1).count() > 0
    return table, {"n_points": n, "n_sims": sims, "sphere_radius_km": radius, "clustered_at_small_radii": clustered}


class KernelTiles(NamedTuple):
    """How densities are expanded: terms in each direction, width of tiles and reach in units where the kernel is exp(-d^2)."""

    terms: int = 20
    width: float = 0.5
    reach: float = 6.5

    def error(self) -> float:
        """A bound of a point's error, relative to the kernel's greatest value: of both truncated series, and of tiles beyond reach.

        The kernel's derivatives are at most 1.09 * 2^(n/2) * sqrt(n!), and (m + n)! is at most 2^(m+n) m! n!; so in one
        direction the terms left out are at most a tail times a whole sum of width^n / sqrt(n!).
        """
        terms = [self.width**n / math.sqrt(math.factorial(n)) for n in range(120)]
        one = 2 * 1.09 * sum(terms[self.terms :]) * sum(terms)
        return one * (2 + one) + math.exp(-self.reach * self.reach)


def kernel_density(points: DataFrame, resolution: float = 0.25, exact: bool = False, tiles: KernelTiles = KernelTiles()) -> DataFrame:
    """``longitude, latitude, density`` at nodes from edge to edge, both included: Gaussian kernels, Scott's width.

    Points are summed to moments of tiles of half a kernel's width or so; each tile of nodes turns the moments of the tiles within reach into one
    polynomial, which its nodes evaluate. Work grows with points plus nodes, not with their product, and the error of
    a density is at most ``tiles.error()`` times the greatest value of a single point's kernel. With ``exact``, every node meets every point.
    """
    p = points.select(F.col("longitude").cast("double").alias("x"), F.col("latitude").cast("double").alias("y")).dropna()
    m = p.agg(F.count(F.lit(1)).alias("n"), F.var_samp("x").alias("xx"), F.var_samp("y").alias("yy"), F.covar_samp("x", "y").alias("xy")).first()
    if m["n"] < 2 or m["xx"] * m["yy"] - m["xy"] ** 2 <= 0:
        raise ValueError("kernel density needs points that don't lie on a line")
    scott = m["n"] ** (-1.0 / 3.0)  # the square of n ** (-1 / 6), for two dimensions
    spread = m["xx"] * scott, m["xy"] * scott, m["yy"] * scott
    scale = 1.0 / (m["n"] * 2.0 * math.pi * math.sqrt(spread[0] * spread[2] - spread[1] ** 2))
    sums = _exact_sums(p, spread, resolution) if exact else _tiled_sums(p, spread, resolution, tiles)
    return sums.select("longitude", "latitude", (F.col("s") * scale).alias("density"))


def _exact_sums(p: DataFrame, spread: tuple[float, float, float], resolution: float) -> DataFrame:
    """Every node meets every distinct point. A task adds up its own points at all nodes, in blocks of 256 nodes and 2,000 points."""
    a, b, c = spread
    det = a * c - b * b
    n_x, n_y = round(360 / resolution) + 1, round(180 / resolution) + 1
    weights = saved(p.groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("w")))
    # a task for some thousand points: their bytes say little of the work
    tasks = max(1, min(-(-weights.count() // 2000), int(p.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches):
        total = np.zeros(n_x * n_y)
        for batch in batches:
            x, y, w = (batch.column(k).to_numpy() for k in range(3))
            for at in range(0, len(total), 256):
                i = np.arange(at, min(at + 256, len(total)))
                lon, lat = -180.0 + (i % n_x) * resolution, -90.0 + (i // n_x) * resolution
                for k in range(0, len(x), 2000):
                    u, v = lon[:, None] - x[None, k : k + 2000], lat[:, None] - y[None, k : k + 2000]
                    total[i] += np.exp(-0.5 * (c * u * u - 2.0 * b * u * v + a * v * v) / det) @ w[k : k + 2000]
        for at in range(0, len(total), 10_000):
            part = total[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), pa.array(part)], names=["id", "s"])

    sums = weights.repartition(tasks, "x", "y").mapInArrow(run, "id long, s double").groupBy("id").agg(F.sum("s").alias("s"))
    return sums.select((F.lit(-180.0) + (F.col("id") % n_x) * F.lit(resolution)).alias("longitude"), (F.lit(-90.0) + F.floor(F.col("id") / n_x) * F.lit(resolution)).alias("latitude"), "s")


def tile_moments(p: DataFrame, to_tiles, tiles: KernelTiles) -> DataFrame:
    """``i, j, m``: of each tile with points the sums of a^k b^l / (k! l!), row by row, a and b being distances from its centre."""
    n, width = tiles.terms, tiles.width

    def run(batches):
        for batch in batches:
            s, t = to_tiles(*(batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)))
            i, j = np.floor(s / width).astype(np.int64), np.floor(t / width).astype(np.int64)
            order = np.lexsort((j, i))
            i, j, s, t = i[order], j[order], s[order], t[order]
            first = np.nonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))[0]
            one, two = (_powers(x - (k + 0.5) * width, n) for x, k in ((s, i), (t, j)))
            for at, end in zip(first.tolist(), [*first[1:].tolist(), len(i)], strict=True):
                m = (one[at:end].T @ two[at:end]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n * n, i[at])), pa.array(np.full(n * n, j[at])), pa.array(np.arange(n * n)), pa.array(m)], names=["i", "j", "k", "v"])

    sums = p.select("x", "y").mapInArrow(run, "i long, j long, k long, v double").groupBy("i", "j", "k").agg(F.sum("v").alias("v"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda r: r["v"])  # terms squared
    return sums.groupBy("i", "j").agg(listed.alias("m"))


def _powers(x: np.ndarray, n: int) -> np.ndarray:
    """x^k / k! for k below n, a row for each x."""
    return np.cumprod(np.concatenate([np.ones((len(x), 1)), x[:, None] / np.arange(1, n)[None]], axis=1), axis=1)


def _hermite(x: np.ndarray, n: int) -> np.ndarray:
    """For each x the matrix of exp(-x^2) H_{k+l}(x), k and l below n."""
    h = np.empty((2 * n, len(x)))
    h[0] = np.exp(-x * x)
    h[1] = 2 * x * h[0]
    for k in range(1, 2 * n - 1):
        h[k + 1] = 2 * x * h[k] - 2 * k * h[k - 1]
    return h[np.add.outer(np.arange(n), np.arange(n))].transpose(2, 0, 1)


def _tiled_sums(p: DataFrame, spread: tuple[float, float, float], resolution: float, tiles: KernelTiles) -> DataFrame:
    a, b, c = spread
    one, lean = math.sqrt(2 * a), b / a
    two, n, width = math.sqrt(2 * (c - b * lean)), tiles.terms, tiles.width
    to_tiles = lambda x, y: (x / one, (y - lean * x) / two)  # noqa: E731  here the kernel is exp(-d^2)
    known = saved(tile_moments(p, to_tiles, tiles)).select(F.col("i").alias("_i"), F.col("j").alias("_j"), "m")
    corners = [to_tiles(x, y) for x in (-180.0, 180.0) for y in (-90.0, 90.0)]
    (i0, i1), (j0, j1) = ((math.floor(min(v) / width), math.floor(max(v) / width)) for v in zip(*corners, strict=True))
    n_j = j1 - j0 + 1
    here = p.sparkSession.range((i1 - i0 + 1) * n_j).select((F.floor(F.col("id") / n_j) + i0).alias("i"), (F.col("id") % n_j + j0).alias("j"))
    far = math.ceil(tiles.reach / width) + 1
    near = [(u, v) for u in range(-far, far + 1) for v in range(-far, far + 1) if math.hypot(max(abs(u) - 1, 0), max(abs(v) - 1, 0)) * width <= tiles.reach]
    steps = F.array(*[F.struct(F.lit(u).alias("u"), F.lit(v).alias("v")) for u, v in near])
    around = here.withColumn("_s", F.explode(steps)).select("i", "j", (F.col("i") + F.col("_s.u")).alias("_i"), (F.col("j") + F.col("_s.v")).alias("_j"))
    # a tile of nodes comes even if no point is within reach
    met = around.join(known, ["_i", "_j"]).unionByName(here.withColumns({"_i": F.lit(None).cast("long"), "_j": F.lit(None).cast("long"), "m": F.lit(None).cast("array<double>")}))
    sign = (-1.0) ** np.arange(n)
    n_x, n_y = round(360 / resolution) + 1, round(180 / resolution) + 1

    def nodes_of(i: int, j: int) -> tuple[np.ndarray, ...]:
        """The nodes whose place lies in a tile: those of the box around it are looked at."""
        x = np.array([i, i + 1]) * width * one
        y = np.add.outer(np.array([j, j + 1]) * width * two, lean * x)
        k = np.arange(max(0, math.floor((x.min() + 180) / resolution) - 1), min(n_x - 1, math.ceil((x.max() + 180) / resolution) + 1) + 1)
        r = np.arange(max(0, math.floor((y.min() + 90) / resolution) - 1), min(n_y - 1, math.ceil((y.max() + 90) / resolution) + 1) + 1)
        lon, lat = (v.ravel() for v in np.meshgrid(-180.0 + k * resolution, -90.0 + r * resolution))
        s, t = to_tiles(lon, lat)
        own = (np.floor(s / width) == i) & (np.floor(t / width) == j)
        return lon[own], lat[own], s[own], t[own]

    def evaluated(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        lon, lat, s, t = nodes_of(i, j)
        rows = table.filter(pc.is_valid(table.column("m")))
        total = np.zeros(len(lon))
        if len(lon) and rows.num_rows:
            m = pc.list_flatten(rows.column("m")).to_numpy().reshape(-1, n, n)
            h, g = (_hermite((k - rows.column(c).to_numpy()) * width, n) for k, c in ((i, "_i"), (j, "_j")))
            series = (h.transpose(0, 2, 1) @ m @ g).sum(axis=0) * np.outer(sign, sign)
            total = ((_powers(s - (i + 0.5) * width, n) @ series) * _powers(t - (j + 0.5) * width, n)).sum(axis=1)
        return pa.table({"longitude": lon, "latitude": lat, "s": total})

    return met.groupBy("i", "j").applyInArrow(evaluated, "longitude double, latitude double, s double")
