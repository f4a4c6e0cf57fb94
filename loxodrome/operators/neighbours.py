"""Distance joins on the sphere and the plane, and points in polygons.

Small sides are broadcast behind a check of their size. Beyond it, both sides are bucketed into cells of the distance
at issue and meet by an equi-join of neighbouring cells; the nearest neighbour widens its cells until all are served.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loxodrome.config import BROADCAST_ROWS, RADIUS_KM, STRESS_MAXIMA
from loxodrome.functions import geo
from loxodrome.functions.checks import require_columns
from loxodrome.functions.shared import saved


#: Points of a block whose pairs are met as a matrix.
PAIR_BLOCK = 1000


def _small(df: DataFrame, limit: int) -> bool:
    return df.limit(limit + 1).count() <= limit


def _cells(lon: Column, lat: Column, width: float) -> Column:
    """The cube of a unit-sphere point, as a struct of three numbers."""
    return F.struct(*[F.floor(c / width).cast("int").alias(n) for n, c in zip("xyz", geo.xyz(lon, lat), strict=True)])


def _half_around(cell: Column) -> Column:
    """A cube and the 13 of its neighbours that follow it."""
    after = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) >= (0, 0, 0)]
    steps = F.array(*[F.struct(*[F.lit(d).alias(n) for n, d in zip("xyz", s, strict=True)]) for s in after])
    return F.transform(steps, lambda s: F.struct(*[(cell[n] + s[n]).alias(n) for n in "xyz"]))


def _around(cell: Column) -> Column:
    """A cube and its 26 neighbours."""
    steps = F.array(*[F.struct(*[F.lit(d).alias(n) for n, d in zip("xyz", (i, j, k), strict=True)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    return F.transform(steps, lambda s: F.struct(*[(cell[n] + s[n]).alias(n) for n in "xyz"]))


def nearest_great_circle(cells: DataFrame, points: DataFrame, out: str = "dist_nearest_hotspot_km", radius: float = RADIUS_KM, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Cells with the distance to the closest point; infinity if there is none."""
    p = points.select(F.col("longitude").cast("double").alias("_lon"), F.col("latitude").cast("double").alias("_lat")).dropna().distinct()
    c = cells.select("cell_id", "lon_centre", "lat_centre")
    d = geo.haversine_km("lat_centre", "lon_centre", "_lat", "_lon", radius)
    if _small(p, broadcast_rows):
        best = c.join(F.broadcast(p)).groupBy("cell_id").agg(F.min(d).alias("_d"))
    else:
        best = _nearest_by_cubes(c, p, d, radius)
    return cells.join(best, "cell_id", "left").withColumn(out, F.coalesce("_d", F.lit(float("inf")))).drop("_d")


def _nearest_by_cubes(c: DataFrame, p: DataFrame, d: Column, radius: float) -> DataFrame:
    """Cubes of doubling width: a cell is served once its best point is within the width that its cubes cover."""
    width, left, served = 2.0 ** -math.ceil(math.log2(max(2.0, math.sqrt(p.count())))), c, None
    while True:
        cubes = p.withColumn("_cube", F.explode(F.array_distinct(_around(_cells(F.col("_lon"), F.col("_lat"), width)))))
        found = left.withColumn("_cube", _cells(F.col("lon_centre"), F.col("lat_centre"), width)).join(cubes, "_cube").groupBy("cell_id").agg(F.min(d).alias("_d"))
        if width >= 2.0:
            return found if served is None else served.unionByName(found)
        sure = found.filter(F.col("_d") <= 2.0 * radius * math.asin(width / 2.0)).cache()
        served = sure if served is None else served.unionByName(sure)
        left, width = left.join(sure.select("cell_id"), "cell_id", "left_anti").cache(), width * 2.0
        if not left.limit(1).count():
            return served


def distance_to_stress_maxima(cells: DataFrame, maxima=STRESS_MAXIMA, out: str = "dist_tidal_stress_max_km") -> DataFrame:
    """A projection: the least of a few constant-point distances."""
    d = [geo.haversine_km("lat_centre", "lon_centre", a, b) for a, b in maxima]
    return cells.withColumn(out, d[0] if len(d) == 1 else F.least(*d))


def pairs_within(points: DataFrame, r_max: float, keys: tuple[str, ...] = (), id_col: str = "id", radius: float = RADIUS_KM, block: int = PAIR_BLOCK) -> DataFrame:
    """All ordered pairs (i, j), i != j, of points of the same ``keys`` up to ``r_max`` apart, with their distance.

    Points are dealt to cubes at least as wide as the chord of ``r_max``, and a cube's points to blocks of some ``block``. Blocks of a cube and of
    the neighbours that follow it meet, each two in one task, as matrices: cosines leave pairs that may be near enough, and the distance
    itself decides. So work and rows moved follow the pairs that are the result, and a task's memory the block.
    """
    angle = min(r_max / radius, math.pi)
    p = points.select(*keys, F.col(id_col).alias("_id"), F.col("latitude").cast("double").alias("_lat"), F.col("longitude").cast("double").alias("_lon")).dropna(subset=["_id", "_lat", "_lon"])
    # no narrower than for a block's points, so that tasks aren't many more than blocks
    width = min(2.0, max(2.0 * math.sin(angle / 2.0) * (1 + 1e-9) + 1e-9, math.sqrt(4.0 * math.pi * block / max(1, p.count()))))
    p = saved(p.withColumn("_c", _cells(F.col("_lon"), F.col("_lat"), width)))
    sizes = saved(p.groupBy(*keys, "_c").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_parts")))
    one = sizes.select(*keys, F.col("_c").alias("_c1"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_p1"))
    two = one.withColumnsRenamed({"_c1": "_c2", "_p1": "_p2"})
    meet = one.withColumn("_c2", F.explode(_half_around(F.col("_c1")))).join(two, [*keys, "_c2"])
    meet = saved(meet.filter((F.col("_c1") != F.col("_c2")) | (F.col("_p1") <= F.col("_p2"))))
    pair = ["_c1", "_p1", "_c2", "_p2"]
    own = p.join(sizes, [*keys, "_c"]).withColumn("_p", F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("int")).drop("_parts")
    sides = [own.withColumnsRenamed({"_c": f"_c{k}", "_p": f"_p{k}"}).join(meet, [*keys, f"_c{k}", f"_p{k}"]).select(*keys, *pair, "_id", "_lat", "_lon", F.lit(k).alias("_side")) for k in (1, 2)]
    # few rows of much work each: their number of tasks is given, as sizes say nothing of it
    tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-meet.count() // 4), 4000))
    least = math.cos(angle) - 1e-12

    def run(t: pa.Table) -> pa.Table:
        first = t.column("_side").to_numpy() == 1
        lat, lon = t.column("_lat").to_numpy(), t.column("_lon").to_numpy()
        x, y = np.radians(lat), np.radians(lon)
        xyz = np.column_stack([np.cos(x) * np.cos(y), np.cos(x) * np.sin(y), np.sin(x)])
        left, right = np.flatnonzero(first), np.flatnonzero(~first)
        i, j = np.divmod(np.flatnonzero(xyz[left] @ xyz[right].T >= least), max(1, len(right)))
        i, j = left[i], right[j]
        d = haversine_of(lat[i], lon[i], lat[j], lon[j], radius)
        ids = t.column("_id").combine_chunks()
        code = ids.dictionary_encode().indices.to_numpy()
        hit = np.flatnonzero((d <= r_max) & (code[i] != code[j]))
        i, j, d = i[hit], j[hit], d[hit]
        if any(t.column(f"{c}1")[0] != t.column(f"{c}2")[0] for c in ("_c", "_p")):  # a block with itself has both orders
            i, j, d = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([d, d])
        return pa.table({k: pa.repeat(t.column(k)[0], len(d)) for k in keys} | {"i": ids.take(pa.array(i)), "j": ids.take(pa.array(j)), "d": pa.array(d)})

    kind = p.schema["_id"].dataType.simpleString()
    schema = ", ".join([*[f"{k} {points.schema[k].dataType.simpleString()}" for k in keys], f"i {kind}, j {kind}, d double"])
    return sides[0].unionByName(sides[1]).repartition(tasks, *keys, *pair).groupBy(*keys, *pair).applyInArrow(run, schema)


def nearest_other(points: DataFrame, r_max: float, radius: float = RADIUS_KM) -> DataFrame:
    """``d, c``: distances to the nearest other point, for those up to ``r_max``, with how many points have them.

    Points that share a place are at 0. Places look for others in cubes of doubling width, from one at which no cube holds many, and
    are served once their best is within the width that the cubes cover; so those still left are as far apart as the cubes are wide.
    """
    p = points.select(F.col("latitude").cast("double").alias("_lat"), F.col("longitude").cast("double").alias("_lon")).dropna()
    p = saved(p.groupBy("_lat", "_lon").agg(F.count(F.lit(1)).alias("c")))
    served = p.filter("c > 1").select(F.lit(0.0).alias("d"), "c")
    cube = lambda w: _cells(F.col("_lon"), F.col("_lat"), w)
    width = 2.0 ** -math.ceil(math.log2(max(2.0, math.sqrt(p.count()))))
    while width > 2.0**-20 and p.groupBy(cube(width)).count().filter("count > 64").limit(1).count():
        width /= 2.0
    left = p.filter("c = 1").select("_lat", "_lon")
    while left.limit(1).count():
        own = p.select(F.col("_lat").alias("_lat2"), F.col("_lon").alias("_lon2"), cube(width).alias("_cube"))
        met = left.withColumn("_cube", F.explode(F.array_distinct(_around(cube(width))))).join(own, "_cube").filter("_lat <> _lat2 or _lon <> _lon2")
        found = saved(met.groupBy("_lat", "_lon").agg(F.min(geo.haversine_km("_lat", "_lon", "_lat2", "_lon2", radius)).alias("d")))
        reach = math.inf if width >= 2.0 else 2.0 * radius * math.asin(width / 2.0) * (1 - 1e-12)
        sure = found.filter(F.col("d") <= min(reach, r_max))
        served = served.unionByName(sure.select("d", F.lit(1).cast("long").alias("c")))
        if reach >= r_max:
            break
        left, width = saved(left.join(found.filter(F.col("d") <= reach), ["_lat", "_lon"], "left_anti")), width * 2.0
    return served.filter(F.col("d") <= r_max)


def haversine_of(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray, radius: float = RADIUS_KM) -> np.ndarray:
    """Great-circle distances of points in degrees, of shapes that numpy brings together."""
    a, b, c, d = (np.radians(x) for x in (lat1, lon1, lat2, lon2))
    s, t = np.sin((c - a) / 2.0), np.sin((d - b) / 2.0)
    return 2.0 * radius * np.arcsin(np.sqrt(np.clip(s * s + np.cos(a) * np.cos(c) * t * t, 0.0, 1.0)))


def haversine_matrix(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray, radius: float = RADIUS_KM) -> np.ndarray:
    """Great-circle distances of all pairs of two small sets of points in degrees."""
    return haversine_of(lat1[:, None], lon1[:, None], lat2[None], lon2[None], radius)


def in_blocks(points: DataFrame, keys: tuple[str, ...], n: int, work, schema: str, block: int = 1000, id_col: str = "id") -> DataFrame:
    """``work(keys, ids, lat, lon, ids2, lat2, lon2, same)`` for all pairs of blocks of points of the same ``keys``.

    For points of which all pairs count: blocks are matrices, a task has one pair of them, and each pair of points
    stands in one pair of blocks. ``work`` gives a dictionary of columns.
    """
    blocks = max(1, -(-n // block))
    own = F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int")
    meet = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least(o, F.col("_own")).alias("a"), F.greatest(o, F.col("_own")).alias("b")))
    d = points.select(*keys, F.col(id_col).alias("_id"), F.col("latitude").cast("double").alias("_lat"), F.col("longitude").cast("double").alias("_lon"), own.alias("_own"))
    d = d.withColumn("_cell", F.explode(meet)).select(*keys, "_id", "_lat", "_lon", "_own", F.col("_cell.a").alias("_a"), F.col("_cell.b").alias("_b"))

    def run(t: pa.Table) -> pa.Table:
        ids, lat, lon, mine, a, b = (t.column(c).to_numpy() for c in ("_id", "_lat", "_lon", "_own", "_a", "_b"))
        left, right = mine == a[0], mine == b[0]
        key = [t.column(k)[0].as_py() for k in keys]
        out = work(ids[left], lat[left], lon[left], ids[right], lat[right], lon[right], bool(a[0] == b[0]))
        rows = len(next(iter(out.values())))
        return pa.table({k: pa.array([v] * rows, t.schema.field(k).type) for k, v in zip(keys, key, strict=True)} | {k: pa.array(v) for k, v in out.items()})

    kinds = ", ".join([f"{k} {points.schema[k].dataType.simpleString()}" for k in keys] + [schema])
    return d.groupBy(*keys, "_a", "_b").applyInArrow(run, kinds)


def nearest_planar(cells: DataFrame, source: DataFrame, value: str, out: str | None = None, bucket: float = 1.0, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Cells with ``value`` of the source point closest in degrees, without wrap-around; ties go to the least point.

    A source point at a cell's very centre is found by an equi-join; only other cells search.
    """
    require_columns(source, ("longitude", "latitude", value), "source")
    out = out or value
    s = source.select(F.col("longitude").cast("double").alias("_x"), F.col("latitude").cast("double").alias("_y"), F.col(value).alias("_v")).filter("_x is not null and _y is not null")
    # one value for each place: the least, as ties have no other order
    s = s.groupBy("_x", "_y").agg(F.min_by("_v", F.struct(F.col("_v").isNull(), F.col("_v"))).alias("_v"))
    c = cells.select("cell_id", F.col("lon_centre").alias("_cx"), F.col("lat_centre").alias("_cy"))
    exact = c.join(s, (F.col("_cx") == F.col("_x")) & (F.col("_cy") == F.col("_y"))).select("cell_id", "_v")
    rest = c.join(exact.select("cell_id"), "cell_id", "left_anti")
    d2 = (F.col("_cx") - F.col("_x")) * (F.col("_cx") - F.col("_x")) + (F.col("_cy") - F.col("_y")) * (F.col("_cy") - F.col("_y"))
    pick = F.min(F.struct(d2.alias("d2"), F.col("_y").alias("y"), F.col("_x").alias("x"), F.col("_v").alias("v"))).alias("_b")
    if _small(s, broadcast_rows):
        found = rest.join(F.broadcast(s)).groupBy("cell_id").agg(pick).select("cell_id", F.col("_b.v").alias("_v"))
    else:
        found, width = None, bucket
        while True:
            near = lambda c: F.floor(c / width).cast("long")  # noqa: B023, E731
            steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
            spread = s.withColumn("_n", F.explode(steps)).withColumns({"_gx": near(F.col("_x")) + F.col("_n.i"), "_gy": near(F.col("_y")) + F.col("_n.j")})
            met = rest.withColumns({"_gx": near(F.col("_cx")), "_gy": near(F.col("_cy"))}).join(spread, ["_gx", "_gy"]).groupBy("cell_id").agg(pick)
            sure = (met if width >= 720.0 else met.filter(F.col("_b.d2") <= width * width)).select("cell_id", F.col("_b.v").alias("_v")).cache()
            found = sure if found is None else found.unionByName(sure)
            rest, width = rest.join(sure.select("cell_id"), "cell_id", "left_anti").cache(), width * 4.0
            if width > 4 * 720.0 or not rest.limit(1).count():
                break
    return cells.join(exact.unionByName(found), "cell_id", "left").withColumn(out, F.col("_v")).drop("_v")


def polygon_tiles(polygons: DataFrame, bucket: float) -> DataFrame:
    """Tiles ``_tx, _ty`` that a polygon covers, wholly or in part: ``_unit, _seq, _whole, _edges``.

    Edges are dealt to the strips of latitude that they reach, as only those can cross a ray of that strip. A tile that no
    edge of its strip reaches lies inside or outside as a whole, which its centre tells; tiles outside are left out, and
    only tiles with an edge carry their strip's edges for the tests of points.
    """
    tile = lambda v: F.floor(v / bucket).cast("int")
    spans = lambda a, b: F.sequence(tile(F.least(a, b)), tile(F.greatest(a, b)))
    e = polygons.select("_unit", "_seq", F.explode("_edges").alias("e"))
    e = e.withColumn("_ty", F.explode(spans(F.col("e.y1"), F.col("e.y2"))))
    strips = e.groupBy("_seq", "_ty").agg(F.first("_unit").alias("_unit"), F.collect_list("e").alias("_edges"))
    reached = F.array_distinct(F.flatten(F.transform("_edges", lambda x: spans(x["x1"], x["x2"]))))
    strips = strips.withColumn("_reached", reached)
    tiles = strips.withColumn("_tx", F.explode(F.sequence(F.array_min("_reached"), F.array_max("_reached"))))
    tiles = tiles.withColumn("_whole", ~F.array_contains("_reached", F.col("_tx")))
    centre = geo.within((F.col("_tx") + 0.5) * bucket, (F.col("_ty") + 0.5) * bucket, F.col("_edges"))
    kept = tiles.filter(~F.col("_whole") | centre)
    return kept.select("_tx", "_ty", "_unit", "_seq", "_whole", F.when(~F.col("_whole"), F.col("_edges")).alias("_edges"))


def assign_polygons(cells: DataFrame, polygons: DataFrame, unit: str = "unit_name", out: str = "geology_unit", bucket: float = 10.0, broadcast_rows: int = 2_000) -> DataFrame:
    """Cells with the unit of the first polygon (by ``polygon_seq``) that holds their centre, else ``UNKNOWN``.

    Polygons have ``rings``: array<array<struct<x, y>>>. Few polygons are broadcast; many meet the cells through the
    tiles of ``bucket`` degrees that they cover (:func:`polygon_tiles`): only cells of tiles that an edge reaches are tested, by the edges of their strip.
    """
    require_columns(polygons, (unit, "rings"), "polygons")
    seq = F.col("polygon_seq") if "polygon_seq" in polygons.columns else F.xxhash64(F.to_json("rings"))
    edges = F.flatten(F.transform("rings", geo.ring_edges))
    p = polygons.select(F.col(unit).alias("_unit"), seq.alias("_seq"), edges.alias("_edges"))
    side = lambda f, n: f(F.transform("_edges", lambda e: e[n]))
    p = p.withColumns({"_x0": side(F.array_min, "x1"), "_x1": side(F.array_max, "x1"), "_y0": side(F.array_min, "y1"), "_y1": side(F.array_max, "y1")})
    inside_box = F.col("lon_centre").between(F.col("_x0"), F.col("_x1")) & F.col("lat_centre").between(F.col("_y0"), F.col("_y1"))
    c = cells.select("cell_id", "lon_centre", "lat_centre")
    if _small(polygons, broadcast_rows):
        met = c.join(F.broadcast(p), inside_box).filter(geo.within("lon_centre", "lat_centre", F.col("_edges")))
    else:
        tile = lambda v: F.floor(v / bucket).cast("int")
        tiles = saved(polygon_tiles(p.select("_unit", "_seq", "_edges"), bucket))
        met = c.withColumns({"_tx": tile(F.col("lon_centre")), "_ty": tile(F.col("lat_centre"))}).join(tiles, ["_tx", "_ty"])
        met = met.filter(F.col("_whole") | geo.within("lon_centre", "lat_centre", F.col("_edges")))
    first = met.groupBy("cell_id").agg(F.min_by("_unit", "_seq").alias(out))
    return cells.join(first, "cell_id", "left").withColumn(out, F.coalesce(F.col(out).cast("string"), F.lit("UNKNOWN")))
