"""Replicates of a point table: bootstrap, jackknife, permutations, random points on the sphere.

Draws are md5 hashes of (seed, replicate, draw), so tasks may be repeated and other engines can check them. A
replicate is a key, not a copy. Resamples with replacement are drawn as counts of cells or bins (:func:`multinomial`), so their
cost follows the number of cells, not of rows; those without are cut at a hash that is found from counts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from loxodrome.config import SEED, Grid
from loxodrome.functions import stats
from loxodrome.functions.shared import saved
from loxodrome.operators import asymmetry, rates
from loxodrome.operators.grid import cell_of


def numbered(points: DataFrame, order: list[str] | None = None, ranges: int = 64) -> DataFrame:
    """Rows with ``row_seq`` from 0 in the order of all (or the named) columns, nulls first.

    Rows are numbered side by side within ranges of the first column (at quantiles of numbers, by the beginnings of anything
    else), and ranges by how many rows stand before them.
    """
    if "row_seq" in points.columns:
        return points
    order = order or points.columns
    first = F.col(order[0])
    if isinstance(points.schema[order[0]].dataType, NumericType):
        cuts = points.agg(F.coalesce(F.percentile_approx(first.cast("double"), [i / ranges for i in range(1, ranges)], 10_000), F.array().cast("array<double>")).alias("_cuts"))
        below = F.size(F.filter("_cuts", lambda c: c < first.cast("double")))
        d = points.crossJoin(F.broadcast(cuts)).withColumn("_range", F.when(first.isNotNull(), below)).drop("_cuts")  # one row
    else:
        d = points.withColumn("_range", F.substring(first.cast("string"), 1, 4))
    sizes = d.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # over ranges, not rows
    offsets = sizes.select(F.col("_range").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    d = d.withColumn("_inside", inside).join(offsets, F.col("_range").eqNullSafe(F.col("_of")))
    return d.withColumn("row_seq", (F.col("_before") + F.col("_inside")).cast("long")).drop("_range", "_of", "_before", "_inside")


#: Children of a node of the tree of counts, and hexadecimal digits of a hash that uniform draws take.
FAN, DIGITS = 256, 13


def uniform(seed: int, rep: int, level: int, child: int) -> float:
    """A reproducible draw from [0, 1), the same in any engine that has md5."""
    return int(hashlib.md5(f"{seed}:{rep}:{level}:{child}".encode()).hexdigest()[:DIGITS], 16) / 16.0**DIGITS


def binomial_inverse(n: np.ndarray, p: float, u: np.ndarray) -> np.ndarray:
    """The least k with P(X <= k) > u for X binomial of n and p: summed from where the lower tail is below 1e-16."""
    if p <= 0.0 or p >= 1.0 or not len(n):
        return n.copy() if p >= 1.0 else np.zeros_like(n)
    mean, reach = n * p, 9.0 * np.sqrt(n * p * (1.0 - p)) + 25.0
    low = np.maximum(np.floor(mean - reach), 0.0)
    out = np.zeros_like(n)
    width = int(np.max(np.minimum(np.ceil(mean + reach), n) - low)) + 1
    at = np.array([math.lgamma(a + 1.0) - math.lgamma(b + 1.0) - math.lgamma(a - b + 1.0) if b else 0.0 for a, b in zip(n.tolist(), low.tolist(), strict=True)])
    log_mass = at + low * math.log(p) + (n - low) * math.log1p(-p)
    step = max(1, (1 << 20) // width)  # rows of a block of bounded size
    for i in range(0, len(n), step):
        s = slice(i, i + step)
        k = low[s, None] + np.arange(width - 1)
        left = np.maximum(n[s, None] - k, 0.0)
        with np.errstate(divide="ignore"):
            ratios = np.log(left) - np.log(k + 1.0) + (math.log(p) - math.log1p(-p))
        logs = log_mass[s, None] + np.concatenate([np.zeros((len(k), 1)), np.cumsum(ratios, axis=1)], axis=1)
        below = np.cumsum(np.exp(logs), axis=1) <= u[s, None]
        out[s] = np.minimum(low[s] + below.sum(axis=1), n[s]).astype(n.dtype)
    return out


def _deal(seed: int, level: int):
    """Tasks that deal each node's counts to its children, one child after the other: what is left is binomial in its share."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                left = np.array(batch.column("counts")[row].as_py(), dtype=np.int64)
                children, weights = batch.column("children")[row].as_py(), batch.column("weights")[row].as_py()
                rest, dealt = sum(weights), []
                for child, weight in zip(children, weights, strict=True):
                    some = np.flatnonzero(left)
                    u = np.array([uniform(seed, r, level, child) for r in some.tolist()])
                    got = np.zeros_like(left)
                    got[some] = binomial_inverse(left[some], 1.0 if weight >= rest else weight / rest, u)
                    dealt.append(got)
                    left, rest = left - got, rest - weight
                yield pa.RecordBatch.from_arrays([pa.array(children, pa.int64()), pa.array([d.tolist() for d in dealt], pa.list_(pa.int64()))], names=["node", "counts"])

    return deal


def multinomial(weights: DataFrame, key: str, weight: str, replicates: int, seed: int = SEED) -> DataFrame:
    """``rep, <key>, count``: how often each key is drawn when as many draws as all weights are made, in proportion to them.

    ``weights`` has a row for each key, its weight a whole number; null is a key. Keys are the leaves of a tree of nodes of
    ``FAN`` children, at least two levels deep. From its root on, every node's number of draws is split among its children by
    binomial draws from md5 of (seed, replicate, level, child): the same as drawing one by one, at the cost of the keys. A
    node's numbers in all replicates are one row. Keys that aren't drawn have no row; no weights give no rows.
    """
    leaves = saved(numbered(weights.filter(F.col(weight) > 0).select(key, F.col(weight).cast("long").alias("_w")), [key]))
    nodes, tree, wide = leaves.select(F.col("row_seq").alias("child"), "_w"), [], leaves.count()
    while len(tree) < 2 or wide > 1:
        up = nodes.groupBy(F.floor(F.col("child") / FAN).cast("long").alias("node")).agg(F.array_sort(F.collect_list(F.struct("child", "_w"))).alias("_c"), F.sum("_w").alias("_w"))
        tree.append(up.select("node", F.col("_c.child").alias("children"), F.col("_c._w").alias("weights"), "_w"))
        nodes, wide = up.select(F.col("node").alias("child"), "_w"), -(-wide // FAN)
    tasks = int(weights.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = tree[-1].select("node", F.array_repeat("_w", replicates).alias("counts"))
    for level in range(len(tree) - 1, -1, -1):
        todo = tree[level].select("node", "children", "weights").join(counts, "node").repartition(tasks, "node")  # few small rows of much work each
        counts = todo.mapInArrow(_deal(seed, level), "node long, counts array<long>")
    each = counts.select(F.col("node").alias("row_seq"), F.posexplode("counts").alias("rep", "count")).filter("count > 0")
    return each.join(leaves, "row_seq").select(F.col("rep").cast("long").alias("rep"), key, "count")


def without_replacement(points: DataFrame, fractions: tuple[float, ...], replicates: int, seed: int = SEED) -> DataFrame:
    """For each fraction and replicate the max(1, round(fraction * n)) rows of least hash, ties by the row's number.

    Counts of the hashes' first three digits tell in which of their 4096 ranges each replicate is cut. Rows of lower ranges stay
    without being sorted or shuffled; only those of the range that is cut are ranked.
    """
    rows = saved(numbered(points))
    n = rows.count()
    spark = points.sparkSession
    keys = ["fraction_retained", "rep"]
    wanted = spark.createDataFrame([(float(f), max(1, round(f * n))) for f in fractions], "fraction_retained double, keep long")
    each = rows.withColumn("fraction_retained", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    each = each.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"))))
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("fraction_retained").cast("string"), F.col("rep").cast("string"), F.col("row_seq").cast("string")).cast("binary"))
    each = each.withColumn("_hash", h).withColumn("_range", F.substring("_hash", 1, 3))
    sizes = each.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over ranges
    cut = sizes.withColumn("_before", before).join(F.broadcast(wanted), "fraction_retained").filter("_before < keep and _before + _n >= keep")
    cut = saved(cut.select(*keys, F.col("_range").alias("_cut"), (F.col("keep") - F.col("_before")).alias("_room")))  # a row for each replicate
    met = each.join(F.broadcast(cut), keys).filter("_range <= _cut")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_hash", "row_seq"))
    split = met.filter("_range = _cut").withColumn("_rank", rank).filter("_rank <= _room").drop("_rank")
    return met.filter("_range < _cut").unionByName(split).drop("_hash", "_range", "_cut", "_room")


def permuted(df: DataFrame, column: str, key: str, seed: int = SEED) -> DataFrame:
    """``column`` shuffled over all rows: values in one seeded order meet rows in another. Keys must be distinct."""
    if df.groupBy(key).count().filter("count > 1").limit(1).count():
        raise ValueError(f"{key} isn't distinct")
    h = lambda salt: F.md5(F.concat_ws(":", F.lit(f"{seed}:{salt}"), F.col(key).cast("string")).cast("binary"))
    base = df.select(key, column, h("a").alias("_a"), h("b").alias("_b"))
    values = _placed(base, "_a", key).select(F.col(column).alias("_value"), "_place")
    places = _placed(base, "_b", key).select(key, "_place")
    return df.drop(column).join(places.join(values, "_place").select(key, F.col("_value").alias(column)), key)


def _placed(df: DataFrame, h: str, key: str) -> DataFrame:
    """Rows with ``_place``, from 0, in the order of a hash (and the key): by ranges of its first three digits, side by side."""
    d = df.withColumn("_range", F.substring(h, 1, 3))
    sizes = d.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # 4096 at most
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(h, key)) - 1
    return d.withColumn("_inside", inside).join(offsets, "_range").withColumn("_place", F.col("_before") + F.col("_inside"))


def sphere_points(spark: SparkSession, n: int, replicates: int, seed: int = SEED) -> DataFrame:
    """``rep, id, latitude, longitude``: points uniform on the sphere."""
    part = lambda a: F.conv(F.substring(F.col("_h"), a, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    d = spark.range(replicates * n).select(F.floor(F.col("id") / n).alias("rep"), (F.col("id") % n).alias("id"))
    d = d.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col("id").cast("string")).cast("binary")))
    return d.select("rep", "id", F.degrees(F.asin(2.0 * part(1) - 1.0)).alias("latitude"), (360.0 * part(9) - 180.0).alias("longitude"))


def sphere_block(rep: int, first: int, end: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Latitudes and longitudes of the points ``first`` to ``end`` of a replicate of :func:`sphere_points`, for tasks that draw their own."""
    drawn = b"".join(hashlib.md5(b"%d:%d:%d" % (seed, rep, i)).digest()[:8] for i in range(first, end))
    u = np.frombuffer(drawn, ">u4").reshape(-1, 2) / 4294967296.0
    return np.degrees(np.arcsin(2.0 * u[:, 0] - 1.0)), 360.0 * u[:, 1] - 180.0


def _unit_hits(fm: DataFrame, drawn: DataFrame, keys: tuple[str, ...], unit: str, grid: Grid) -> DataFrame:
    """Per replicate and unit: all its cells, and the distinct cells (``cell_key``) that hold a drawn point.

    Only points move between replicates, so the grid is counted once and never copied.
    """
    u = F.coalesce(F.col(unit).cast("string"), F.lit("nan")).alias("unit")
    cells = fm.select(cell_of("lon_centre", "lat_centre", grid, clip=False).alias("cell_key"), u)
    sizes = cells.groupBy("unit").agg(F.count(F.lit(1)).alias("n_cells"))
    hit = drawn.select(*keys, "cell_key").distinct()
    hits = hit.join(cells, "cell_key").groupBy(*keys, "unit").agg(F.count(F.lit(1)).alias("n_hotspots"))
    every = drawn.select(*keys).distinct().crossJoin(F.broadcast(sizes))  # units are few
    return every.join(hits, [*keys, "unit"], "left").na.fill(0, ["n_hotspots"])


def bootstrap_enrichment(fm: DataFrame, points: DataFrame, n_boot: int = 500, seed: int = SEED, unit: str = "geology_unit", label: str = "has_hotspot", grid: Grid = Grid()) -> DataFrame:
    """Per unit the observed ratio with 95 % limits, mean and deviation over resampled catalogues."""
    observed = rates.enrichment(fm, unit, label).select("unit", "enrichment_ratio")
    per_cell = points.groupBy(cell_of("longitude", "latitude", grid, clip=False).alias("cell_key")).agg(F.count(F.lit(1)).alias("n"))
    drawn = saved(multinomial(per_cell, "cell_key", "n", n_boot, seed))  # read twice
    per = rates.enrichment_of_counts(_unit_hits(fm, drawn, ("rep",), unit, grid), ("rep",))
    boot = per.groupBy("unit").agg(
        F.percentile("enrichment_ratio", 0.025).alias("boot_lo"),
        F.percentile("enrichment_ratio", 0.975).alias("boot_hi"),
        F.avg("enrichment_ratio").alias("boot_mean"),
        F.stddev_pop("enrichment_ratio").alias("boot_std"),
    )
    return observed.join(boot, "unit", "left").orderBy(F.col("enrichment_ratio").desc_nulls_last(), "unit")


_SHORT = {"Sub-Jovian": "sub_jovian_vs_anti", "Leading": "leading_vs_trailing", "Northern": "northern_vs_southern"}


def jackknife(fm: DataFrame, points: DataFrame, fractions=(0.9, 0.75, 0.5), replicates: int = 100, seed: int = SEED, unit: str = "geology_unit", grid: Grid = Grid()) -> DataFrame:
    """How often each claim survives random deletion: ``fraction_retained, metric, survival_rate, summary``."""
    keys = ("fraction_retained", "rep")
    kept = without_replacement(points.select("longitude", "latitude"), fractions, replicates, seed)
    hit = kept.withColumn("cell_key", cell_of("longitude", "latitude", grid, clip=False))
    per = rates.enrichment_of_counts(_unit_hits(fm, hit, keys, unit, grid), keys)
    hits = per.groupBy("fraction_retained", "unit").agg(F.sum(F.coalesce("significant", F.lit(False)).cast("int")).alias("hits"))
    units = hits.select(
        "fraction_retained",
        F.concat(F.lit("enrichment_"), "unit").alias("metric"),
        (F.col("hits") / replicates).alias("survival_rate"),
        F.format_string(f"%d/{replicates} replicates Bonferroni-sig.", "hits").alias("summary"),
    )
    tests = asymmetry.tested(asymmetry.side_counts(kept, keys)).filter("p_binom is not null")
    short = F.coalesce(*[F.when(F.col("comparison").startswith(a), F.lit(f"binomial_{b}")) for a, b in _SHORT.items()])
    tests = tests.groupBy("fraction_retained", short.alias("metric")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("p_binom") < 0.05).cast("int")).alias("s"), F.percentile("p_binom", 0.5).alias("m"))
    tests = tests.select("fraction_retained", "metric", (F.col("s") / F.col("n")).alias("survival_rate"), F.format_string("p < 0.05 in %d/%d replicates. Median p = %.3f.", "s", "n", "m").alias("summary"))
    return units.unionByName(tests).orderBy(F.col("fraction_retained").desc(), "metric")
