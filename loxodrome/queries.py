"""Queries of the point-pattern engine over the driver's tables, each with the same in DuckDB SQL.

The tables hold no coordinates, so points are laid out from their keys on a spherical lattice, alike in both
engines. Computed numbers are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loxodrome.config import Grid
from loxodrome.functions import geo, stats
from loxodrome.functions.shared import saved
from loxodrome.operators import asymmetry, clustering, hypotheses, models, neighbours, ranking, rates, resample
from loxodrome.operators import grid as gridding
from loxodrome.plans import features, scenes
from loxodrome.sources import polygons as polygon_sources
from loxodrome.sources import tables
from loxodrome.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

COARSE = Grid(5.0)
MIDDLE = Grid(2.0)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lattice(df: DataFrame, key: str, *columns: Column) -> DataFrame:
    """Rows with ``longitude`` and ``latitude`` on a spherical lattice of as many points as the table has rows."""
    turn = F.col(key).cast("double") * 137.50776
    lat = F.degrees(F.asin((F.col(key).cast("double") + 0.5) / F.lit(max(df.count(), 1) / 2.0) - 1.0))
    return df.select(*columns, (turn - 360.0 * F.floor(turn / 360.0) - 180.0).alias("longitude"), lat.alias("latitude"))


def customers(s: SparkSession, d: str) -> DataFrame:
    return lattice(_t(s, d, "customer"), "c_custkey", F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


def suppliers(s: SparkSession, d: str) -> DataFrame:
    return lattice(_t(s, d, "supplier"), "s_suppkey", F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("value"))


def orders(s: SparkSession, d: str) -> DataFrame:
    power = F.when(F.col("o_orderkey") % 17 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice"))
    return lattice(_t(s, d, "orders"), "o_orderkey", F.col("o_orderkey").cast("string").alias("name"), power.alias("power_gw"))


def unit_cells(s: SparkSession, d: str, grid: Grid = COARSE) -> DataFrame:
    """Cells labelled by customers, with a unit from the parts' brands; a few cells aren't observed."""
    cells = gridding.assign_points(gridding.base_grid(s, grid), customers(s, d), grid, order="name")
    parts = _t(s, d, "part")
    units = parts.select(F.col("p_partkey").alias("_k"), F.when(F.col("p_partkey") % 11 == 0, F.lit("NoData")).otherwise(F.col("p_brand")).alias("geology_unit"))
    return cells.withColumn("_k", F.col("cell_id") % parts.count()).join(units, "_k", "left").drop("_k")


def power_cells(s: SparkSession, d: str, grid: Grid = COARSE) -> DataFrame:
    return gridding.assign_power(gridding.base_grid(s, grid), orders(s, d), grid, order="name")


def scored(s: SparkSession, d: str) -> DataFrame:
    """Labelled documents with a score from their length."""
    docs = _t(s, d, "documents").select("doc_id", "lang", (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("score"))
    return docs.join(_t(s, d, "labels").select("doc_id", "quality"), "doc_id")


# --- SQL pieces ---------------------------------------------------------------------------------------------------


def _lattice_sql(table: str, key: str, columns: str) -> str:
    k = f"CAST({key} AS DOUBLE)"
    turn = f"({k} * CAST(137.50776 AS DOUBLE))"
    n = f"(SELECT count(*) FROM {table})"
    return f"SELECT {columns}, {turn} - 360.0::DOUBLE * floor({turn} / 360.0::DOUBLE) - 180.0::DOUBLE AS longitude, degrees(asin(({k} + 0.5::DOUBLE) / (CAST({n} AS DOUBLE) / 2.0::DOUBLE) - 1.0::DOUBLE)) AS latitude FROM {table}"


PTS = f"pts AS ({_lattice_sql('customer', 'c_custkey', 'c_custkey AS id, c_name AS name')})"
SUP = f"sup AS ({_lattice_sql('supplier', 's_suppkey', 's_suppkey AS id, s_name AS name, s_acctbal AS value')})"
ORD = f"ord AS ({_lattice_sql('orders', 'o_orderkey', 'CAST(o_orderkey AS VARCHAR) AS name, CASE WHEN o_orderkey % 17 = 0 THEN 0.0::DOUBLE ELSE o_totalprice END AS power_gw')})"


def _grid_sql(g: Grid) -> str:
    r = f"{g.resolution}::DOUBLE"
    return (
        f"cells AS (SELECT i AS cell_id, {g.lon_min + g.resolution / 2}::DOUBLE + CAST(i % {g.n_lon} AS DOUBLE) * {r} AS lon_centre, "
        f"{g.lat_min + g.resolution / 2}::DOUBLE + CAST(i // {g.n_lon} AS DOUBLE) * {r} AS lat_centre FROM range({g.n_cells}) t(i))"
    )


def _cell_sql(g: Grid, lon: str = "longitude", lat: str = "latitude", clip: bool = True) -> str:
    ix = f"CAST(floor(({lon} - {g.lon_min}::DOUBLE) / {g.resolution}::DOUBLE) AS BIGINT)"
    iy = f"CAST(floor(({lat} - {g.lat_min}::DOUBLE) / {g.resolution}::DOUBLE) AS BIGINT)"
    if clip:
        return f"least(greatest({iy}, 0), {g.n_lat - 1}) * {g.n_lon} + least(greatest({ix}, 0), {g.n_lon - 1})"
    return f"CASE WHEN {ix} BETWEEN 0 AND {g.n_lon - 1} AND {iy} BETWEEN 0 AND {g.n_lat - 1} THEN {iy} * {g.n_lon} + {ix} END"


def _r(e: str, digits: int = 6) -> str:
    return f"round({e}, {digits}) + 0.0::DOUBLE"


def _haversine_sql(a: str, b: str, c: str, d: str) -> str:
    s, t = f"sin((radians({c}) - radians({a})) / 2.0::DOUBLE)", f"sin((radians({d}) - radians({b})) / 2.0::DOUBLE)"
    return f"3643.2::DOUBLE * asin(sqrt(least(greatest({s} * {s} + cos(radians({a})) * cos(radians({c})) * {t} * {t}, 0.0::DOUBLE), 1.0::DOUBLE)))"


def _labelled_sql(g: Grid = COARSE) -> str:
    return (
        f"{PTS}, {_grid_sql(g)}, per AS (SELECT {_cell_sql(g)} AS cell_id, count(name) AS c, string_agg(name, ';' ORDER BY name) AS names FROM pts GROUP BY 1), "
        "fm AS (SELECT cells.*, coalesce(c, 0) AS hotspot_count, CASE WHEN coalesce(c, 0) > 0 THEN 1 ELSE 0 END AS has_hotspot, coalesce(names, '') AS hotspot_names, "
        "CASE WHEN p_partkey % 11 = 0 THEN 'NoData' ELSE p_brand END AS geology_unit FROM cells LEFT JOIN per USING (cell_id) "
        "LEFT JOIN part ON p_partkey = cells.cell_id % (SELECT count(*) FROM part))"
    )


def _power_sql(g: Grid = COARSE) -> str:
    return (
        f"{ORD}, {_grid_sql(g)}, pper AS (SELECT {_cell_sql(g)} AS cell_id, count(*) AS power_count, max(power_gw) AS primary_power_gw, avg(power_gw) AS mean_power_gw, sum(power_gw) AS sum_power_gw, "
        "string_agg(name, ';' ORDER BY name) AS power_names FROM ord WHERE power_gw > 0 GROUP BY 1), "
        "pw AS (SELECT cells.*, coalesce(power_count, 0) AS power_count, coalesce(primary_power_gw, 0.0) AS primary_power_gw, coalesce(mean_power_gw, 0.0) AS mean_power_gw, "
        "coalesce(sum_power_gw, 0.0) AS sum_power_gw, coalesce(power_names, '') AS power_names, ln(1.0::DOUBLE + coalesce(primary_power_gw, 0.0)) AS log_primary_power FROM cells LEFT JOIN pper USING (cell_id)), "
        "obs AS (SELECT * FROM pw WHERE power_count > 0)"
    )


def _chi2_sql(x: str) -> str:
    h = f"(({x}) / 2.0::DOUBLE)"
    return f"CASE WHEN {h} > 36 THEN 0.0::DOUBLE WHEN {h} <= 0 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - list_sum([exp(-{h} + (n + 0.5::DOUBLE) * ln({h}) - lgamma(n + 1.5::DOUBLE)) FOR n IN range(0, 151)])) END"


def _binomial_sql(k: str, n: str) -> str:
    return f"CASE WHEN {n} = 0 THEN NULL WHEN 2 * {k} = {n} THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2.0::DOUBLE * list_sum([exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2.0::DOUBLE)) FOR i IN range(0, least({k}, {n} - {k}) + 1)])) END"


_ENRICHMENT_SELECT = (
    "t AS (SELECT *, sum(h) OVER () / sum(n) OVER () AS base, count(*) OVER () AS k FROM u), "
    "e AS (SELECT unit, n, h, k, base * n AS ex, CAST(h AS DOUBLE) / n AS p FROM t), "
    "f AS (SELECT *, h / nullif(ex, 0) AS ratio, (p + 3.8416::DOUBLE / (2.0 * n)) / (1 + 3.8416::DOUBLE / n) AS mid, "
    "1.96::DOUBLE * sqrt(p * (1 - p) / n + 3.8416::DOUBLE / (4.0 * n * n)) / (1 + 3.8416::DOUBLE / n) AS half, coalesce((h - ex) * (h - ex) / nullif(ex, 0), 0.0) AS x FROM e), "
    f"z AS (SELECT *, {_chi2_sql('x')} AS p_raw FROM f)"
)

# --- grids and points -----------------------------------------------------------------------------------------------


def held(s: SparkSession, d: str, points: DataFrame, grid: Grid = COARSE) -> DataFrame:
    """Cells that hold points of the table, with how many."""
    counts = points.groupBy(gridding.cell_of("longitude", "latitude", grid).alias("cell_id")).agg(F.count(F.lit(1)).alias("n_points"))
    return gridding.base_grid(s, grid).join(counts, "cell_id")


def _held_sql(points: str, g: Grid = COARSE) -> str:
    """``held`` from ``pts`` or ``ord``."""
    return f"{_grid_sql(g)}, hn AS (SELECT {_cell_sql(g)} AS cell_id, count(*) AS n_points FROM {points} GROUP BY 1), held AS (SELECT * FROM cells JOIN hn USING (cell_id))"


@query(
    f"WITH {ORD}, {_held_sql('ord', Grid())} SELECT cell_id, lon_centre, lat_centre, lon_centre - 0.5 AS lon_min, lon_centre + 0.5 AS lon_max, lat_centre - 0.5 AS lat_min, lat_centre + 0.5 AS lat_max, coalesce(n_points, 0) AS n_points FROM cells LEFT JOIN hn USING (cell_id)"
)
def base_grid(s, d):
    """All cells, with how many orders fall into each."""
    counts = held(s, d, orders(s, d), Grid()).select("cell_id", "n_points")
    return gridding.base_grid(s).join(counts, "cell_id", "left").na.fill(0, ["n_points"])


@query(
    f"WITH {PTS}, {_grid_sql(MIDDLE)}, per AS (SELECT {_cell_sql(MIDDLE)} AS cell_id, count(name) AS c, string_agg(name, ';' ORDER BY name) AS names FROM pts GROUP BY 1) "
    "SELECT cell_id, coalesce(c, 0) AS hotspot_count, CASE WHEN coalesce(c, 0) > 0 THEN 1 ELSE 0 END AS has_hotspot, coalesce(names, '') AS hotspot_names FROM cells LEFT JOIN per USING (cell_id)"
)
def hotspot_grid(s, d):
    out = gridding.assign_points(gridding.base_grid(s, MIDDLE), customers(s, d), MIDDLE, order="name")
    return out.select("cell_id", "hotspot_count", "has_hotspot", "hotspot_names")


@query(f"WITH {_power_sql()} SELECT cell_id, power_count, {_r('primary_power_gw', 4)} AS primary_power_gw, {_r('mean_power_gw', 4)} AS mean_power_gw, {_r('sum_power_gw', 2)} AS sum_power_gw, power_names, {_r('log_primary_power')} AS log_primary_power FROM pw")
def power_grid(s, d):
    c = power_cells(s, d)
    r = lambda n, k: (F.round(n, k) + F.lit(0.0)).alias(n)
    return c.select("cell_id", "power_count", r("primary_power_gw", 4), r("mean_power_gw", 4), r("sum_power_gw", 2), "power_names", r("log_primary_power", 6))


@query(f"WITH {PTS} SELECT id, {_cell_sql(COARSE, clip=False)} AS cell_id FROM pts")
def cells_without_clipping(s, d):
    return customers(s, d).select("id", gridding.cell_of("longitude", "latitude", COARSE, clip=False).alias("cell_id"))


@query("SELECT p_partkey, p_type, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS code FROM part")
def units_encoded(s, d):
    return gridding.encode_units(_t(s, d, "part").select("p_partkey", "p_type"), "p_type", "code")


@query("SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS type_index, (SELECT CAST(count(DISTINCT p_type) AS INTEGER) FROM part) AS type_size FROM part")
def units_onehot_sparse(s, d):
    return gridding.onehot_vectors(_t(s, d, "part").select("p_partkey", "p_type"), "p_type", "type").select("p_partkey", "type_index", "type_size")


@query("SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS is_F, CAST(o_orderstatus = 'O' AS INTEGER) AS is_O, CAST(o_orderstatus = 'P' AS INTEGER) AS is_P FROM orders")
def units_onehot(s, d):
    out = gridding.onehot_units(_t(s, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "is_")
    have = [c for c in ("is_F", "is_O", "is_P") if c in out.columns]
    return out.select("o_orderkey", *have, *[F.lit(0).alias(c) for c in ("is_F", "is_O", "is_P") if c not in have])


# --- distances ------------------------------------------------------------------------------------------------------


@query(f"WITH {PTS}, {_grid_sql(COARSE)} SELECT cell_id, {_r('min(' + _haversine_sql('lat_centre', 'lon_centre', 'latitude', 'longitude') + ')', 4)} AS dist_nearest_hotspot_km FROM cells, pts GROUP BY cell_id")
def nearest_hotspot(s, d):
    out = neighbours.nearest_great_circle(gridding.base_grid(s, COARSE), customers(s, d))
    return rounded(out.select("cell_id", "dist_nearest_hotspot_km"), 4)


@query(ORACLES["nearest_hotspot"])
def nearest_hotspot_bucketed(s, d):
    """The same by cubes and equi-joins, as for point tables too large to broadcast."""
    out = neighbours.nearest_great_circle(gridding.base_grid(s, COARSE), customers(s, d), broadcast_rows=0)
    return rounded(out.select("cell_id", "dist_nearest_hotspot_km"), 4)


_STRESS = "least(" + ", ".join(_haversine_sql("lat_centre", "lon_centre", f"{a}::DOUBLE", f"{b}::DOUBLE") for a, b in ((0.0, 0.0), (0.0, 180.0), (90.0, 0.0), (-90.0, 0.0))) + ")"


@query(f"WITH {ORD} SELECT name, {_r(_STRESS.replace('lat_centre', 'latitude').replace('lon_centre', 'longitude'), 4)} AS dist_tidal_stress_max_km FROM ord")
def stress_distance(s, d):
    points = orders(s, d).withColumnsRenamed({"latitude": "lat_centre", "longitude": "lon_centre"})
    return rounded(neighbours.distance_to_stress_maxima(points).select("name", "dist_tidal_stress_max_km"), 4)


_PLANAR = f"WITH {SUP}, {_grid_sql(COARSE)}, m AS (SELECT cell_id, value, row_number() OVER (PARTITION BY cell_id ORDER BY (lon_centre - longitude) * (lon_centre - longitude) + (lat_centre - latitude) * (lat_centre - latitude), latitude, longitude, value) AS k FROM cells, sup) SELECT cell_id, value AS tidal_heating_flux FROM m WHERE k = 1"


@query(_PLANAR)
def nearest_flux(s, d):
    source = suppliers(s, d).withColumnRenamed("value", "flux_w_m2")
    return tables.add_flux(gridding.base_grid(s, COARSE), source, grid=COARSE).select("cell_id", "tidal_heating_flux")


@query(_PLANAR)
def nearest_flux_bucketed(s, d):
    out = neighbours.nearest_planar(gridding.base_grid(s, COARSE), suppliers(s, d), "value", "tidal_heating_flux", bucket=4.0, broadcast_rows=0)
    return out.select("cell_id", "tidal_heating_flux")


def _boxes(s, d) -> DataFrame:
    rows = [(r["r_name"], -180.0 + 60 * r["r_regionkey"], -102.5 + 60 * r["r_regionkey"], -62.5, 40.0 + 5 * r["r_regionkey"]) for r in _t(s, d, "region").orderBy("r_regionkey").collect()]
    return polygon_sources.boxes(s, rows)


_BOXES = "bx AS (SELECT r_regionkey AS k, r_name AS u, -180.0 + 60 * r_regionkey AS x0, -102.5 + 60 * r_regionkey AS x1, -62.5 AS y0, 40.0 + 5 * r_regionkey AS y1 FROM region)"
_PIP = f"WITH {_BOXES}, {_grid_sql(COARSE)} SELECT cell_id, coalesce((SELECT arg_min(u, k) FROM bx WHERE lon_centre > x0 AND lon_centre < x1 AND lat_centre > y0 AND lat_centre < y1), 'UNKNOWN') AS geology_unit FROM cells"


@query(_PIP)
def polygon_units(s, d):
    return neighbours.assign_polygons(gridding.base_grid(s, COARSE), _boxes(s, d)).select("cell_id", "geology_unit")


@query(_PIP)
def polygon_units_bucketed(s, d):
    return neighbours.assign_polygons(gridding.base_grid(s, COARSE), _boxes(s, d), broadcast_rows=0).select("cell_id", "geology_unit")


_DIST = _haversine_sql("a.latitude", "a.longitude", "b.latitude", "b.longitude")


@query(f"WITH {SUP} SELECT a.id AS i, b.id AS j, {_r(_DIST, 4)} AS d FROM sup a, sup b WHERE a.id <> b.id AND {_DIST} <= 1000")
def pairs_within(s, d):
    pairs = neighbours.pairs_within(suppliers(s, d), 1000.0)
    return pairs.withColumn("d", F.floor(F.col("d") * 1e4 + 0.5) / 1e4)  # many rows: round() takes each through a decimal


# --- rates ----------------------------------------------------------------------------------------------------------


@query(
    f"WITH {_labelled_sql()}, u AS (SELECT coalesce(geology_unit, 'nan') AS unit, count(*) AS n, CAST(sum(has_hotspot) AS BIGINT) AS h FROM fm GROUP BY 1), {_ENRICHMENT_SELECT} "
    f"SELECT unit, n AS n_cells, h AS n_hotspots, {_r('ex')} AS expected_hotspots, {_r('p')} AS observed_rate, {_r('ratio')} AS enrichment_ratio, {_r('greatest(mid - half, 0.0)')} AS wilson_lo, {_r('least(mid + half, 1.0)')} AS wilson_hi, "
    f"{_r('x')} AS chi2_contribution, {_r('p_raw')} AS p_raw, {_r('least(1.0, p_raw * k)')} AS p_bonferroni, least(1.0, p_raw * k) < 0.05 AS significant FROM z"
)
def enrichment(s, d):
    return rounded(rates.enrichment(unit_cells(s, d)))


_BANDS = "b(i, lat_band, lo, hi) AS (VALUES (0, '-90° to -45°', -90, -45), (1, '-45° to +0°', -45, 0), (2, '+0° to +45°', 0, 45), (3, '+45° to +90°', 45, 90))"


@query(
    f"WITH {_labelled_sql()}, {_BANDS}, c AS (SELECT lat_band, CAST(lo AS DOUBLE) AS lat_min, CAST(hi AS DOUBLE) AS lat_max, count(cell_id) AS t, count(CASE WHEN trim(coalesce(geology_unit, 'None')) NOT IN ('NoData', 'UNKNOWN', 'nan', '') AND cell_id IS NOT NULL THEN 1 END) AS o, "
    "CAST(coalesce(sum(has_hotspot), 0) AS BIGINT) AS h FROM b LEFT JOIN fm ON lat_centre >= lo AND lat_centre < hi GROUP BY 1, 2, 3) "
    f"SELECT lat_band, lat_min, lat_max, t AS total_cells, o AS observed_cells, h AS n_hotspots, {_r('round(100.0::DOUBLE * (t - o) / t, 2)')} AS unobserved_pct, {_r('h / CAST(t AS DOUBLE)')} AS raw_rate, {_r('h / CAST(o AS DOUBLE)')} AS adjusted_rate, "
    f"{_r('round((h / CAST(o AS DOUBLE)) / nullif(h / CAST(t AS DOUBLE), 0), 3)')} AS rate_ratio FROM c"
)
def coverage_bias(s, d):
    return rounded(rates.coverage(unit_cells(s, d)))


_PBANDS = "b(i, lat_band, lo, hi) AS (VALUES " + ", ".join(f"({i}, '{n}', {a}::DOUBLE, {z}::DOUBLE)" for i, (a, z, n) in enumerate(((-90, -60, "south polar"), (-60, -30, "south mid-latitude"), (-30, 0, "south low-latitude"), (0, 30, "north low-latitude"), (30, 60, "north mid-latitude"), (60, 90, "north polar")))) + ")"
_SUMS = f"count(cell_id) AS n_power_cells, CAST(coalesce(sum(power_count), 0) AS BIGINT) AS power_count, {_r('coalesce(sum(sum_power_gw), 0.0)', 2)} AS sum_power_gw, {_r('avg(primary_power_gw)', 4)} AS mean_primary_power_gw, {_r('max(primary_power_gw)', 4)} AS max_primary_power_gw"
_SHARE = _r("coalesce(sum(sum_power_gw), 0.0) / (SELECT sum(sum_power_gw) FROM obs)")


def _money(df: DataFrame) -> DataFrame:
    digits = {"sum_power_gw": 2, "polar_sum_power_gw": 2, "nonpolar_sum_power_gw": 2}
    out = [(F.round(c, digits.get(c, 4 if c.endswith("_gw") else 6)) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c != "power_definition"]
    return df.select(*out)


@query(f"WITH {_power_sql()}, {_PBANDS} SELECT lat_band, lo AS lat_min, hi AS lat_max, {_SUMS}, {_SHARE} AS fraction_total_power FROM b LEFT JOIN obs ON lat_centre >= lo AND lat_centre < hi GROUP BY 1, 2, 3")
def power_by_latitude(s, d):
    return _money(rates.power_by_latitude(power_cells(s, d)))


@query(
    f"WITH {_power_sql()}, fu AS (SELECT cell_id AS c2, p_type AS geology_unit FROM cells LEFT JOIN part ON p_partkey = cell_id % (SELECT count(*) FROM part)) "
    f"SELECT coalesce(geology_unit, 'nan') AS geology_unit, {_SUMS}, {_SHARE} AS fraction_total_power FROM obs LEFT JOIN fu ON c2 = cell_id GROUP BY 1"
)
def power_by_unit(s, d):
    """All cells, with units from all rows of the parts."""
    parts = _t(s, d, "part")
    units = parts.select(F.col("p_partkey").alias("_k"), F.col("p_type").alias("geology_unit"))
    fm = gridding.base_grid(s, COARSE).withColumn("_k", F.col("cell_id") % parts.count()).join(units, "_k", "left")
    return _money(rates.power_by_unit(fm, power_cells(s, d)))


@query(
    f"WITH {_power_sql()}, th(t) AS (VALUES (55), (60), (65)), q AS (SELECT t, count(CASE WHEN abs(lat_centre) >= t THEN 1 END) AS a, count(CASE WHEN abs(lat_centre) < t THEN 1 END) AS b, sum(CASE WHEN abs(lat_centre) >= t THEN sum_power_gw ELSE 0.0 END) AS ps, sum(CASE WHEN abs(lat_centre) < t THEN sum_power_gw ELSE 0.0 END) AS ns, "
    "avg(CASE WHEN abs(lat_centre) >= t THEN primary_power_gw END) AS pm, avg(CASE WHEN abs(lat_centre) < t THEN primary_power_gw END) AS nm FROM th, obs GROUP BY t) "
    f"SELECT t AS polar_threshold_abs_lat, a AS polar_power_cells, b AS nonpolar_power_cells, {_r('ps', 2)} AS polar_sum_power_gw, {_r('ns', 2)} AS nonpolar_sum_power_gw, {_r('pm', 4)} AS polar_mean_primary_power_gw, {_r('nm', 4)} AS nonpolar_mean_primary_power_gw, {_r('ps / nullif(ps + ns, 0)')} AS polar_fraction_total_power FROM q"
)
def polar_sensitivity(s, d):
    return _money(rates.polar_sensitivity(power_cells(s, d)))


@query(
    f"WITH {_power_sql()}, rk AS (SELECT *, row_number() OVER (ORDER BY primary_power_gw DESC, cell_id) AS k FROM obs), rm(m) AS (VALUES (0), (1), (5), (10)), q AS (SELECT m, count(*) AS c, sum(sum_power_gw) AS t, sum(CASE WHEN abs(lat_centre) >= 60 THEN sum_power_gw ELSE 0.0 END) AS p, sum(CASE WHEN abs(lat_centre) < 60 THEN sum_power_gw ELSE 0.0 END) AS n, max(primary_power_gw) AS x FROM rm JOIN rk ON k > m GROUP BY m) "
    f"SELECT m AS removed_top_n_cells, c AS remaining_power_cells, {_r('t', 2)} AS sum_power_gw, {_r('p', 2)} AS polar_sum_power_gw, {_r('n', 2)} AS nonpolar_sum_power_gw, {_r('x', 4)} AS max_remaining_primary_power_gw, {_r('p / nullif(t, 0)')} AS polar_fraction_total_power FROM q"
)
def outlier_sensitivity(s, d):
    return _money(rates.outlier_sensitivity(power_cells(s, d)))


_SUITE = {
    "latitude": ("power_by_latitude", "lat_band", "sum_power_gw", "fraction_total_power"),
    "geology": ("power_by_unit", "geology_unit", "sum_power_gw", "fraction_total_power"),
    "outlier_sensitivity": ("outlier_sensitivity", "removed_top_n_cells", "sum_power_gw", "polar_fraction_total_power"),
    "polar_sensitivity": ("polar_sensitivity", "polar_threshold_abs_lat", "polar_sum_power_gw", "polar_fraction_total_power"),
}


@query(" UNION ALL ".join(f"SELECT '{part}' AS part, CAST({key} AS VARCHAR) AS key, {total} AS sum_power_gw, {share} AS share FROM ({ORACLES[name]})" for part, (name, key, total, share) in _SUITE.items()))
def power_suite(s, d):
    """Keys, sums and shares of all four tables of the suite."""
    parts = _t(s, d, "part")
    units = parts.select(F.col("p_partkey").alias("_k"), F.col("p_type").alias("geology_unit"))
    fm = gridding.base_grid(s, COARSE).withColumn("_k", F.col("cell_id") % parts.count()).join(units, "_k", "left")
    suite = rates.power_suite(fm, saved(power_cells(s, d)))
    tables_ = [suite[part].select(F.lit(part).alias("part"), F.col(key).cast("string").alias("key"), F.round(total, 2).alias("sum_power_gw"), (F.round(share, 6) + F.lit(0.0)).alias("share")) for part, (_, key, total, share) in _SUITE.items()]
    return tables_[0].unionByName(tables_[1]).unionByName(tables_[2]).unionByName(tables_[3])


# --- point statistics -----------------------------------------------------------------------------------------------

_SIDES = " UNION ALL ".join(
    f"SELECT '{a} vs {b}' AS comparison, CAST(coalesce(sum(CAST({x} AS INTEGER)), 0) AS BIGINT) AS n_a, CAST(coalesce(sum(CAST({y} AS INTEGER)), 0) AS BIGINT) AS n_b FROM pts"
    for (a, b), (x, y) in zip(asymmetry.SIDES, (("abs(longitude) < 90", "abs(longitude) >= 90"), ("(longitude > 0 AND longitude <= 180)", "(longitude <= 0 AND longitude > -180)"), ("latitude > 0", "latitude <= 0")), strict=True)
)


@query(f"WITH {PTS}, c AS ({_SIDES}), t AS (SELECT *, n_a + n_b AS n_total FROM c) SELECT comparison, n_a, n_b, n_total, {_r('n_a / CAST(nullif(n_total, 0) AS DOUBLE)')} AS fraction_a, {_r(_binomial_sql('n_a', 'n_total'))} AS p_binom FROM t")
def asymmetry_tests(s, d):
    return rounded(asymmetry.tested(asymmetry.side_counts(customers(s, d))))


def _multinomial_sql(source: str, key: str, weight: str, reps: int) -> str:
    """``mn``: ``rep, key, c`` drawn by the same tree of nodes of 256 children, for up to 65,536 keys; needs WITH RECURSIVE."""
    u = "('0x' || substr(md5('42:' || rep || ':' || lv || ':' || tr.child), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
    reach = "(9.0::DOUBLE * sqrt(n * p * (1 - p)) + 25)"
    mass = "exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(p) + (n - j) * ln(greatest(1 - p, 1e-300::DOUBLE)))"
    below = f"list_reduce([{{'c': {mass}, 'k': CAST(0 AS BIGINT)}} FOR j IN range(lo, hi + 1)], lambda a, b: {{'c': a.c + b.c, 'k': a.k + CAST(a.c <= u AS BIGINT)}})"

    def draw(state: str, on: str, keep: str) -> str:
        shares = f"SELECT {keep}, tr.i, tr.child, left_n AS n, w, rest, w / CAST(rest AS DOUBLE) AS p, {u} AS u FROM {state} AS st JOIN tr ON {on} AND tr.i = st.i + 1 WHERE left_n > 0"
        bounds = f"SELECT *, CAST(greatest(floor(n * p - {reach}), 0) AS BIGINT) AS lo, CAST(least(ceil(n * p + {reach}), n) AS BIGINT) AS hi FROM ({shares})"
        return f"SELECT *, CASE WHEN w >= rest THEN n ELSE least(n, lo + f.k + CAST(f.c <= u AS BIGINT)) END AS k FROM (SELECT *, {below} AS f FROM ({bounds}))"

    after = "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    return (
        f"lf AS (SELECT {key} AS key, CAST({weight} AS BIGINT) AS w, row_number() OVER (ORDER BY {key} NULLS FIRST) - 1 AS pos FROM {source} WHERE {weight} > 0), "
        "nd AS (SELECT pos // 256 AS node, CAST(sum(w) AS BIGINT) AS w FROM lf GROUP BY 1), "
        f"tr AS (SELECT 1 AS lv, CAST(0 AS BIGINT) AS parent, node AS child, node AS i, w, CAST(sum(w) OVER (ORDER BY node {after}) AS BIGINT) AS rest FROM nd "
        f"UNION ALL SELECT 0, pos // 256, pos, pos % 256, w, CAST(sum(w) OVER (PARTITION BY pos // 256 ORDER BY pos {after}) AS BIGINT) FROM lf), "
        f"d1 AS (SELECT rep, CAST(-1 AS BIGINT) AS i, (SELECT CAST(sum(w) AS BIGINT) FROM lf) AS left_n, CAST(0 AS BIGINT) AS k FROM range({reps}) a(rep) UNION ALL SELECT rep, i, n - k, k FROM ({draw('d1', 'lv = 1', 'rep')})), "
        "d0 AS (SELECT rep, i AS parent, CAST(-1 AS BIGINT) AS i, k AS left_n, CAST(-1 AS BIGINT) AS child, CAST(0 AS BIGINT) AS k FROM d1 WHERE i >= 0 AND k > 0 "
        f"UNION ALL SELECT rep, parent, i, n - k, child, k FROM ({draw('d0', 'lv = 0 AND tr.parent = st.parent', 'rep, st.parent')})), "
        "mn AS (SELECT rep, key, k AS c FROM d0 JOIN lf ON pos = child WHERE k > 0)"
    )


_HIST = "least(CAST(floor((longitude + 180.0::DOUBLE) / 10.0::DOUBLE) AS BIGINT), 35)"


@query(
    f"WITH RECURSIVE {SUP}, bins AS (SELECT bin FROM range(36) t(bin)), ob AS (SELECT {_HIST} AS bin, count(*) AS c FROM sup GROUP BY 1), {_multinomial_sql('ob', 'bin', 'c', 1000)}, "
    "fl AS (SELECT a.rep, bins.bin, coalesce(mn.c, 0) AS c FROM range(1000) a(rep) CROSS JOIN bins LEFT JOIN mn ON mn.rep = a.rep AND mn.key = bins.bin), "
    "ci AS (SELECT bin, quantile_cont(c, 0.025) AS lo, quantile_cont(c, 0.975) AS hi FROM fl GROUP BY bin) "
    f"SELECT CAST(bin AS INTEGER) AS bin, coalesce(c, 0) AS count, -175.0::DOUBLE + bin * 10 AS bin_centre, {_r('lo')} AS ci_lo, {_r('hi')} AS ci_hi FROM bins LEFT JOIN ob USING (bin) JOIN ci USING (bin)"
)
def longitude_histogram(s, d):
    out = asymmetry.histogram_limits(suppliers(s, d), "longitude", asymmetry.LON_BINS, 1000)
    return rounded(out.select("bin", "count", "bin_centre", "ci_lo", "ci_hi"))


_RAD = "r AS (SELECT 50.0::DOUBLE * (k + 1) AS radius_km FROM range(50) t(k))"
_AREA = "(4.0::DOUBLE * pi() * 1821.6::DOUBLE * 1821.6::DOUBLE)"
_CSR = "(2.0::DOUBLE * pi() * 1821.6::DOUBLE * 1821.6::DOUBLE * (1.0 - cos(radius_km / 1821.6::DOUBLE)))"
_KSQL = f"{SUP}, {_RAD}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM sup), dd AS (SELECT a.id AS i, {_DIST} AS d FROM sup a, sup b WHERE a.id <> b.id), k AS (SELECT radius_km, (SELECT count(*) FROM dd WHERE d <= radius_km) / n * ({_AREA} / n) AS kv FROM r, n)"


@query(f"WITH {_KSQL} SELECT radius_km, {_r('kv', 2)} AS k_observed, {_r(_CSR, 2)} AS k_csr FROM k")
def ripley_k(s, d):
    return rounded(clustering.ripley_k(suppliers(s, d)), 2)


@query(f"WITH {_KSQL.replace(SUP, PTS).replace('FROM sup', 'FROM pts').replace('sup b', 'pts b')} SELECT radius_km, {_r('kv', 2)} AS k_observed, {_r(_CSR, 2)} AS k_csr FROM k")
def ripley_k_tree(s, d):
    """More points, by the descent over cubes."""
    return rounded(clustering.ripley_k(customers(s, d), broadcast_rows=0), 2)


@query(
    f"WITH {_KSQL}, w AS (SELECT *, lag(kv) OVER o AS p, lead(kv) OVER o AS q FROM k WINDOW o AS (ORDER BY radius_km)), g AS (SELECT radius_km, CASE WHEN p IS NULL THEN (q - kv) / 50 WHEN q IS NULL THEN (kv - p) / 50 ELSE (q - p) / 100 END AS s FROM w) "
    f"SELECT radius_km, {_r('s / (2.0 * pi() * 1821.6::DOUBLE * sin(radius_km / 1821.6::DOUBLE))')} AS g_observed FROM g"
)
def pair_correlation(s, d):
    return rounded(clustering.pair_correlation(clustering.ripley_k(suppliers(s, d))).select("radius_km", "g_observed"))


@query(f"WITH {_KSQL}, nn AS (SELECT i, min(d) AS d FROM dd GROUP BY i) SELECT radius_km, {_r('(SELECT count(*) FROM nn WHERE d <= radius_km) / n')} AS nn_cdf_observed, {_r(f'1 - exp(-(n / {_AREA}) * {_CSR})')} AS nn_cdf_csr FROM r, n")
def nearest_neighbour_cdf(s, d):
    return rounded(clustering.nearest_neighbour_cdf(suppliers(s, d)))


_SIMS = "sp AS (SELECT rep, id, degrees(asin(2.0 * (('0x' || substr(h, 1, 8))::BIGINT / 4294967296.0::DOUBLE) - 1.0)) AS latitude, 360.0 * (('0x' || substr(h, 9, 8))::BIGINT / 4294967296.0::DOUBLE) - 180.0 AS longitude FROM (SELECT rep, id, md5('42:' || rep || ':' || id) AS h FROM range(199) a(rep), range((SELECT count(*) FROM supplier)) b(id)))"


@query(
    f"WITH {_SIMS}, {_RAD}, dd AS (SELECT a.rep, {_DIST} AS d FROM sp a JOIN sp b ON a.rep = b.rep AND a.id <> b.id), k AS (SELECT rep, radius_km, (SELECT count(*) FROM dd WHERE dd.rep = z.rep AND d <= radius_km) / n * ({_AREA} / n) AS kv FROM range(199) z(rep), r, (SELECT CAST(count(*) AS DOUBLE) AS n FROM supplier)) "
    f"SELECT radius_km, {_r('quantile_cont(kv, 0.025)', 2)} AS k_env_lo, {_r('quantile_cont(kv, 0.975)', 2)} AS k_env_hi FROM k GROUP BY radius_km"
)
def csr_envelope(s, d):
    return rounded(clustering.csr_envelope(s, _t(s, d, "supplier").count()), 2)


@query(
    f"WITH {SUP}, m AS (SELECT CAST(count(*) AS DOUBLE) AS n, var_samp(longitude) AS xx, var_samp(latitude) AS yy, covar_samp(longitude, latitude) AS xy FROM sup), c AS (SELECT n, xx * pow(n, -1.0 / 3.0) AS a, xy * pow(n, -1.0 / 3.0) AS b, yy * pow(n, -1.0 / 3.0) AS c FROM m), "
    "nodes AS (SELECT -180.0::DOUBLE + i * 0.25 AS x, -90.0::DOUBLE + j * 0.25 AS y FROM range(1441) t(i), range(721) u(j)) "
    "SELECT x AS longitude, y AS latitude, round(sum(exp(-0.5::DOUBLE * (c * (x - longitude) * (x - longitude) - 2.0 * b * (x - longitude) * (y - latitude) + a * (y - latitude) * (y - latitude)) / (a * c - b * b))) / (max(n) * 2.0 * pi() * sqrt(max(a * c - b * b))) * 1e6, 6) + 0.0::DOUBLE AS density_ppm FROM nodes, sup, c GROUP BY x, y"
)
def kernel_density(s, d):
    k = clustering.kernel_density(suppliers(s, d))
    return k.select("longitude", "latitude", (F.round(F.col("density") * 1e6, 6) + F.lit(0.0)).alias("density_ppm"))


@query(ORACLES["kernel_density"].replace("i * 0.25", "i * 5.0").replace("j * 0.25", "j * 5.0").replace("range(1441)", "range(73)").replace("range(721)", "range(37)"))
def kernel_density_blocked(s, d):
    k = clustering.kernel_density(suppliers(s, d), 5.0, exact=True)
    return k.select("longitude", "latitude", (F.round(F.col("density") * 1e6, 6) + F.lit(0.0)).alias("density_ppm"))


@query(
    f"SELECT * FROM ({ORACLES['ripley_k']}) JOIN ({ORACLES['pair_correlation']}) USING (radius_km) JOIN ({ORACLES['nearest_neighbour_cdf']}) USING (radius_km) JOIN ({ORACLES['csr_envelope']}) USING (radius_km)"
)
def spatial_stats(s, d):
    """All curves of one catalogue in one table."""
    table, _ = clustering.spatial_stats(suppliers(s, d))
    digits = {c: 2 for c in ("k_observed", "k_csr", "k_env_lo", "k_env_hi")}
    return table.select("radius_km", *[(F.round(c, digits.get(c, 6)) + F.lit(0.0)).alias(c) for c in table.columns if c != "radius_km"])


# --- patterns and resampling ----------------------------------------------------------------------------------------

_PHI, _LAM = "radians(lat_centre)", "radians(lon_centre)"
_SQL_PATTERNS = {
    "asthenosphere": f"pow(cos({_PHI}), 2) * (1 + 2 * pow(cos({_LAM}), 2)) / 3.0::DOUBLE",
    "deep_mantle": f"pow(sin({_PHI}), 2) + 0.15::DOUBLE * pow(cos({_PHI}), 2) * (1 + 0.3::DOUBLE * cos(2 * {_LAM}))",
    "magma_ocean": f"pow(cos({_PHI}), 2) * (1 + 0.3::DOUBLE * cos(2 * {_LAM}))",
    "uniform": "1.0::DOUBLE",
    "synthetic_proxy": f"pow(cos({_LAM}), 2) * pow(cos({_PHI}), 2) + 0.3::DOUBLE * pow(sin({_PHI}), 2)",
}


def _pattern_sql(source: str) -> str:
    raw = ", ".join(f"greatest({e}, 1e-6::DOUBLE) AS r_{n}" for n, e in _SQL_PATTERNS.items())
    unit = ", ".join(f"r_{n} / (sum(r_{n} * cos({_PHI})) OVER () / sum(cos({_PHI})) OVER ()) AS tidal_template_{n}" for n in _SQL_PATTERNS)
    return f"raw AS (SELECT *, {raw} FROM {source}), pat AS (SELECT *, {unit} FROM raw)"


@query(f"WITH {ORD}, {_held_sql('ord')}, {_pattern_sql('held')} SELECT cell_id, " + ", ".join(f"{_r(f'tidal_template_{n}')} AS tidal_template_{n}" for n in _SQL_PATTERNS) + " FROM pat")
def patterns(s, d):
    """Patterns of mean 1 over the cells that hold orders."""
    out = hypotheses.attach_patterns(held(s, d, orders(s, d)))
    return rounded(out.select("cell_id", *[f"tidal_template_{n}" for n in stats.PATTERNS]))


_LL = " UNION ALL ".join(f"SELECT '{n}' AS template, tidal_template_{n} AS h, has_hotspot AS y, lat_centre FROM pat" for n in _SQL_PATTERNS)
_CELL_AREA = "abs(sin(radians(lat_centre) + radians(0.5::DOUBLE)) - sin(radians(lat_centre) - radians(0.5::DOUBLE)))"


@query(
    f"WITH {_labelled_sql()}, {_pattern_sql('fm')}, ur AS (SELECT geology_unit AS gu, greatest(avg(has_hotspot), 1e-6) AS rt FROM fm GROUP BY 1), ug AS (SELECT rt, has_hotspot, lat_centre FROM fm JOIN ur ON gu IS NOT DISTINCT FROM geology_unit), "
    f"al AS ({_LL} UNION ALL SELECT 'geology_insample', rt / (sum(rt * cos({_PHI})) OVER () / sum(cos({_PHI})) OVER ()), has_hotspot, lat_centre FROM ug), "
    f"sm AS (SELECT template, CAST(sum(y) AS DOUBLE) AS n, sum({_CELL_AREA} * h) AS tot, sum(CASE WHEN y > 0 THEN y * ln({_CELL_AREA} * h) ELSE 0 END) AS yl FROM al GROUP BY 1), "
    "l AS (SELECT template, yl + n * ln(n / tot) - n AS ll FROM sm), q AS (SELECT template, ll, 2 - 2 * ll AS aic, (SELECT ll FROM l WHERE template = 'uniform') AS l0 FROM l), x AS (SELECT *, 2 * (ll - l0) AS c2 FROM q) "
    f"SELECT template, {_r('ll', 4)} AS log_lik, {_r('aic', 4)} AS aic, {_r('aic - min(aic) OVER ()', 4)} AS delta_aic, {_r('1 - ll / l0', 4)} AS pseudo_r2, {_r('c2', 4)} AS lr_chi2, {_r(_chi2_sql('greatest(c2, 0.0)'), 4)} AS lr_p_value FROM x"
)
def hypotheses_compared(s, d):
    return rounded(hypotheses.compare(unit_cells(s, d)), 4)


_KEEP = "kp(f, keep) AS (SELECT f, greatest(1, CAST(round_even(f * (SELECT count(*) FROM sup), 0) AS BIGINT)) FROM (VALUES (0.9::DOUBLE), (0.75::DOUBLE), (0.5::DOUBLE)) t(f))"


@query(
    f"WITH {SUP}, {_KEEP}, rk AS (SELECT f, keep, rep, id, longitude, latitude, row_number() OVER (PARTITION BY f, rep ORDER BY md5('42:' || f || ':' || rep || ':' || id), id) AS k FROM kp, range(100) r(rep), sup) "
    "SELECT f AS fraction_retained, rep, CAST(count(*) AS BIGINT) AS kept, CAST(sum(CAST(latitude > 0 AS INTEGER)) AS BIGINT) AS north FROM rk WHERE k <= keep GROUP BY 1, 2"
)
def jackknife_samples(s, d):
    pts = suppliers(s, d).select("longitude", "latitude", F.col("id").alias("row_seq"))
    kept = resample.without_replacement(pts, (0.9, 0.75, 0.5), 100)
    return kept.groupBy("fraction_retained", "rep").agg(F.count(F.lit(1)).alias("kept"), F.sum((F.col("latitude") > 0).cast("long")).alias("north"))


@query(
    f"WITH RECURSIVE {_labelled_sql()}, cl AS (SELECT {_cell_sql(COARSE, 'lon_centre', 'lat_centre', False)} AS ck, coalesce(geology_unit, 'nan') AS unit FROM fm), sz AS (SELECT unit, count(*) AS n FROM cl GROUP BY 1), "
    f"pc AS (SELECT {_cell_sql(COARSE, clip=False)} AS ck, count(*) AS c FROM pts GROUP BY 1), {_multinomial_sql('pc', 'ck', 'c', 500)}, hc AS (SELECT rep, key AS ck FROM mn), "
    "ob AS (SELECT unit, h / nullif(n * (sum(h) OVER () / sum(n) OVER ()), 0) AS er FROM (SELECT coalesce(geology_unit, 'nan') AS unit, count(*) AS n, sum(has_hotspot) AS h FROM fm GROUP BY 1)), "
    "hu AS (SELECT rep, unit, count(*) AS h FROM hc JOIN cl USING (ck) GROUP BY 1, 2), al AS (SELECT rep, unit, n, coalesce(h, 0) AS h FROM range(500) a(rep) CROSS JOIN sz LEFT JOIN hu USING (rep, unit)), "
    "rt AS (SELECT rep, unit, h / nullif(n * (sum(h) OVER (PARTITION BY rep) / sum(n) OVER (PARTITION BY rep)), 0) AS ratio FROM al) "
    f"SELECT unit, {_r('any_value(er)')} AS enrichment_ratio, {_r('quantile_cont(ratio, 0.025)')} AS boot_lo, {_r('quantile_cont(ratio, 0.975)')} AS boot_hi, {_r('avg(ratio)')} AS boot_mean, {_r('stddev_pop(ratio)')} AS boot_std FROM rt JOIN ob USING (unit) GROUP BY 1"
)
def bootstrap_enrichment(s, d):
    return rounded(resample.bootstrap_enrichment(unit_cells(s, d), customers(s, d), grid=COARSE))


_SHORT_SIDES = " UNION ALL ".join(
    f"SELECT f, rep, 'binomial_{name}' AS metric, CAST(sum(CAST({a} AS INTEGER)) AS BIGINT) AS k, CAST(sum(CAST({a} OR {b} AS INTEGER)) AS BIGINT) AS n FROM kt GROUP BY 1, 2"
    for name, a, b in (
        ("sub_jovian_vs_anti", "(abs(longitude) < 90)", "(abs(longitude) >= 90)"),
        ("leading_vs_trailing", "(longitude > 0 AND longitude <= 180)", "(longitude <= 0 AND longitude > -180)"),
        ("northern_vs_southern", "(latitude > 0)", "(latitude <= 0)"),
    )
)


@query(
    f"WITH {_labelled_sql()}, {SUP}, {_KEEP}, sq AS (SELECT row_number() OVER (ORDER BY longitude, latitude) - 1 AS id, longitude, latitude FROM sup), "
    "rk AS (SELECT f, keep, rep, longitude, latitude, row_number() OVER (PARTITION BY f, rep ORDER BY md5('42:' || f || ':' || rep || ':' || id), id) AS k FROM kp, range(100) r(rep), sq), kt AS (SELECT f, rep, longitude, latitude FROM rk WHERE k <= keep), "
    f"cl AS (SELECT {_cell_sql(COARSE, 'lon_centre', 'lat_centre', False)} AS ck, coalesce(geology_unit, 'nan') AS unit FROM fm), sz AS (SELECT unit, count(*) AS n FROM cl GROUP BY 1), "
    f"hc AS (SELECT DISTINCT f, rep, {_cell_sql(COARSE, clip=False)} AS ck FROM kt), hu AS (SELECT f, rep, unit, count(*) AS h FROM hc JOIN cl USING (ck) GROUP BY 1, 2, 3), "
    "al AS (SELECT f, rep, unit, n, coalesce(h, 0) AS h FROM (SELECT f FROM kp) CROSS JOIN range(100) a(rep) CROSS JOIN sz LEFT JOIN hu USING (f, rep, unit)), "
    "ex AS (SELECT *, sum(h) OVER w / sum(n) OVER w * n AS e, count(*) OVER w AS units FROM al WINDOW w AS (PARTITION BY f, rep)), x AS (SELECT *, coalesce((h - e) * (h - e) / nullif(e, 0), 0.0) AS x FROM ex), "
    f"sg AS (SELECT f, unit, CAST(sum(CAST(least(1.0, ({_chi2_sql('x')}) * units) < 0.05 AS INTEGER)) AS BIGINT) AS hits FROM x GROUP BY 1, 2), "
    f"sd AS ({_SHORT_SIDES}), bp AS (SELECT f, metric, {_binomial_sql('k', 'n')} AS p FROM sd), bt AS (SELECT f, metric, count(*) AS n, CAST(sum(CAST(p < 0.05 AS INTEGER)) AS BIGINT) AS s, quantile_cont(p, 0.5) AS m FROM bp WHERE p IS NOT NULL GROUP BY 1, 2) "
    f"SELECT f AS fraction_retained, 'enrichment_' || unit AS metric, {_r('hits / 100.0::DOUBLE')} AS survival_rate, printf('%d/100 replicates Bonferroni-sig.', hits) AS summary FROM sg "
    f"UNION ALL SELECT f, metric, {_r('s / CAST(n AS DOUBLE)')}, printf('p < 0.05 in %d/%d replicates. Median p = %.3f.', s, n, m) FROM bt"
)
def stability(s, d):
    return rounded(resample.jackknife(unit_cells(s, d), suppliers(s, d), grid=COARSE))


@query(f"""SELECT metric, {', '.join(f'max(CASE WHEN fraction_retained = {f} THEN survival_rate END) AS retained_{round(100 * f)}' for f in (0.9, 0.75, 0.5))} FROM ({ORACLES['stability']}) GROUP BY metric""")
def survival_by_fraction(s, d):
    found = resample.jackknife(unit_cells(s, d), suppliers(s, d), grid=COARSE)
    return rounded(scenes.survival_table(found, (0.9, 0.75, 0.5)).select("metric", *[F.col(f"`{f}`").alias(f"retained_{round(100 * f)}") for f in (0.9, 0.75, 0.5)]))


# --- ranks, quantiles, histograms -----------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS midrank FROM lineitem")
def midranks(s, d):
    return ranking.midranks(_t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", "midrank").select("l_orderkey", "l_linenumber", "midrank")


@query(
    "WITH a AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS x, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE AS y FROM lineitem) "
    "SELECT count(*) AS n, round(corr(x, y), 6) AS rho FROM a"
)
def spearman(s, d):
    return rounded(ranking.spearman(_t(s, d, "lineitem"), "l_quantity", "l_extendedprice"))


@query("SELECT event_type, round(quantile_cont(value, 0.025), 6) AS lo, round(quantile_cont(value, 0.5), 6) AS mid, round(quantile_cont(value, 0.975), 6) AS hi FROM events GROUP BY event_type")
def event_quantiles(s, d):
    return rounded(ranking.quantiles(_t(s, d, "events"), ["event_type"], "value", {"lo": 0.025, "mid": 0.5, "hi": 0.975}))


@query(
    "WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events), b AS (SELECT event_type, least(CAST(floor((value - lo) / ((hi - lo) / 20)) AS INTEGER), 19) AS bin, count(*) AS c FROM events, r GROUP BY 1, 2), "
    "e AS (SELECT event_type, CAST(k AS INTEGER) AS bin FROM (SELECT DISTINCT event_type FROM events), range(20) t(k)) "
    "SELECT event_type, bin, coalesce(c, 0) AS count, round(lo + (hi - lo) / 20 / 2 + bin * ((hi - lo) / 20), 6) + 0.0::DOUBLE AS bin_centre, round(coalesce(c, 0) / sum(coalesce(c, 0)) OVER (PARTITION BY event_type) / ((hi - lo) / 20), 6) + 0.0::DOUBLE AS density FROM e LEFT JOIN b USING (event_type, bin), r"
)
def event_histogram(s, d):
    return rounded(ranking.data_range_histogram(_t(s, d, "events").select("event_type", "value"), "value", 20, ("event_type",)))


@query("SELECT 'l_discount' AS x, 'l_discount' AS y, 1.0::DOUBLE AS r UNION ALL SELECT 'l_quantity', 'l_quantity', 1.0 UNION ALL SELECT 'l_quantity', 'l_extendedprice', round(corr(l_quantity, l_extendedprice), 6) FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) + 0.0 FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_extendedprice', 1.0 UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) + 0.0 FROM lineitem")
def correlations(s, d):
    return rounded(features.correlations(_t(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@query("SELECT l_orderkey, l_linenumber, round(coalesce(CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END, (SELECT median(CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END) FROM lineitem)), 6) AS q FROM lineitem")
def median_imputed(s, d):
    rows = _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")).alias("q"))
    return rounded(ranking.median_filled(rows, ["q"]))


@query("SELECT 'c_custkey' AS \"column\", CAST(count(*) - count(c_custkey) AS BIGINT) AS n_null FROM customer UNION ALL SELECT 'c_name', CAST(count(*) - count(c_name) AS BIGINT) FROM customer UNION ALL SELECT 'c_nationkey', CAST(count(*) - count(c_nationkey) AS BIGINT) FROM customer UNION ALL SELECT 'c_acctbal', CAST(count(*) - count(c_acctbal) AS BIGINT) FROM customer UNION ALL SELECT 'c_mktsegment', CAST(count(*) - count(c_mktsegment) AS BIGINT) FROM customer")
def null_report(s, d):
    return features.null_report(_t(s, d, "customer"))


_NUMERIC = ("c_custkey", "c_nationkey", "c_acctbal")


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min, round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS q50, round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q75, max({c})::DOUBLE AS max FROM customer"
        for c in _NUMERIC
    )
)
def described(s, d):
    return rounded(features.describe(_t(s, d, "customer"), list(_NUMERIC)))


@query("SELECT p_brand, count(*) AS count, round(count(*) / (SELECT count(*) FROM part)::DOUBLE, 6) AS share FROM part GROUP BY 1")
def brand_counts(s, d):
    return rounded(features.value_counts(_t(s, d, "part"), "p_brand"))


# --- models ---------------------------------------------------------------------------------------------------------

_SC = "sc AS (SELECT doc_id, lang, n_chars / (n_chars + 1000.0::DOUBLE) AS score, quality FROM documents JOIN labels USING (doc_id))"


def _ranking_sql(source: str, by: str, y: str) -> str:
    """``rm``: areas under both curves for each group; null for a single class."""
    return (
        f"r AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY score) + (count(*) OVER (PARTITION BY {by}, score) - 1) / 2.0::DOUBLE AS mr FROM {source}), a AS (SELECT {by}, sum({y}) AS p, count(*) AS n, sum(CASE WHEN {y} = 1 THEN mr END) AS s FROM r GROUP BY 1), "
        f"g AS (SELECT {by}, score, sum({y}) AS tp, count(*) AS c FROM {source} GROUP BY 1, 2), w AS (SELECT *, sum(tp) OVER o AS ctp, sum(c) OVER o AS cc, sum(tp) OVER (PARTITION BY {by}) AS p FROM g WINDOW o AS (PARTITION BY {by} ORDER BY score DESC)), ap AS (SELECT {by}, sum(tp / nullif(p, 0)::DOUBLE * ctp / cc) AS v FROM w GROUP BY 1), "
        f"rm AS (SELECT {by}, CASE WHEN p > 0 AND n > p THEN round((s - p * (p + 1) / 2.0::DOUBLE) / (p * (n - p))::DOUBLE, 6) END AS auc_roc, CASE WHEN p > 0 AND n > p THEN round(v, 6) END AS pr_auc FROM a JOIN ap USING ({by}))"
    )


def _class_sql(source: str, by: str, y: str, said: str) -> str:
    """``cm``: counts and scores of each group at the threshold ``said``."""
    count = ", ".join(f"CAST(sum(CAST({hit} AND {y} = {label} AS INTEGER)) AS DOUBLE) AS {name}" for name, hit, label in (("tp", said, 1), ("fp", said, 0), ("fn", f"NOT ({said})", 1), ("tn", f"NOT ({said})", 0)))
    return (
        f"c AS (SELECT {by}, {count}, avg((score - {y}) * (score - {y})) AS b FROM {source} GROUP BY 1), "
        f"cm AS (SELECT {by}, CAST(tp + fp + fn + tn AS BIGINT) AS n_test, CAST(tp + fn AS BIGINT) AS n_positive_test, {_r('coalesce(tp / nullif(tp + fp, 0), 0)')} AS precision, {_r('coalesce(tp / nullif(tp + fn, 0), 0)')} AS recall, {_r('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)')} AS f1, {_r('b')} AS brier, "
        f"{_r('coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0)')} AS mcc FROM c)"
    )


@query(f"WITH {_SC}, {_ranking_sql('sc', 'lang', 'quality')} SELECT * FROM rm")
def ranking_metrics(s, d):
    return rounded(models.ranking_metrics(scored(s, d), "score", "quality", "lang"))


@query(f"WITH {_SC}, {_class_sql('sc', 'lang', 'quality', 'score >= 0.5')} SELECT * FROM cm")
def class_metrics(s, d):
    return rounded(models.class_metrics(scored(s, d), "score", "quality", "lang", inclusive=True))


@query(
    f"WITH {_SC}, e AS (SELECT lang, list_distinct(quantile_cont(score, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS q FROM sc GROUP BY 1), b AS (SELECT lang, score, quality, CAST(len([x FOR x IN list_sort(q)[2:-2] IF x < score]) AS INTEGER) AS bin FROM sc JOIN e USING (lang)) "
    "SELECT lang, bin, round(avg(score), 6) AS mean_predicted, round(avg(quality), 6) + 0.0 AS fraction_positive, count(*) AS n FROM b GROUP BY 1, 2"
)
def calibration(s, d):
    return rounded(models.calibration(scored(s, d), "score", "quality", "lang", bins=5))


@query(
    f"WITH {_SC}, g AS (SELECT lang, score, sum(quality) AS tp, count(*) AS c FROM sc GROUP BY 1, 2), w AS (SELECT lang, score, sum(tp) OVER o AS ctp, sum(c) OVER o AS cc, sum(tp) OVER (PARTITION BY lang) AS p FROM g WINDOW o AS (PARTITION BY lang ORDER BY score DESC)) "
    "SELECT lang, round(score, 6) AS threshold, round(ctp / cc::DOUBLE, 6) + 0.0 AS precision, round(ctp / nullif(p, 0)::DOUBLE, 6) + 0.0 AS recall FROM w"
)
def precision_recall(s, d):
    return rounded(models.precision_recall(scored(s, d), "score", "quality", "lang"))


@query(f"WITH {PTS}, {_held_sql('pts')}, {_BANDS} SELECT i AS fold, lat_band, count(cell_id) AS n_cells, count(cell_id) * 100.0::DOUBLE / (SELECT count(*) FROM held) AS pct FROM b LEFT JOIN held ON lat_centre >= lo AND lat_centre < hi GROUP BY 1, 2")
def folds_described(s, d):
    """Bands of the cells that hold customers."""
    return models.LatitudeBands().describe(saved(held(s, d, customers(s, d))))


@query(
    f"WITH {ORD}, o AS (SELECT ln(1 + power_gw) AS y, latitude AS x, CASE WHEN latitude < -45 THEN 0 WHEN latitude < 0 THEN 1 WHEN latitude < 45 THEN 2 ELSE 3 END AS f FROM ord WHERE power_gw > 0), k AS (SELECT k FROM range(4) t(k)), "
    "m AS (SELECT k, count(*) AS n, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, covar_pop(x, y) AS xy FROM k JOIN o ON f <> k GROUP BY k) SELECT CAST(k AS INTEGER) AS fold, n AS n_train, round(my, 6) AS intercept, round(n * xy / sx / (n + 1.0), 6) + 0.0 AS coefficient FROM m"
)
def ridge_by_band(s, d):
    o = orders(s, d).filter("power_gw > 0").select(F.log1p("power_gw").alias("y"), F.col("latitude").alias("x"))
    marked = models.LatitudeBands().assign(o, "x").cache()
    fits = models.fit_linear(marked, ["x"], "y", models._conditions(4)[:-1])
    return rounded(s.createDataFrame([(k, int(m["n"]), m["intercept"], float(m["coef"][0])) for k, m in enumerate(fits)], "fold int, n_train long, intercept double, coefficient double"))


def matrix(s, d, grid: Grid = COARSE) -> DataFrame:
    return features.feature_matrix(s, suppliers(s, d), _boxes(s, d), grid=grid)


_UNITS_IN_BOXES = "un AS (SELECT cell_id, coalesce((SELECT arg_min(u, k) FROM bx WHERE lon_centre > x0 AND lon_centre < x1 AND lat_centre > y0 AND lat_centre < y1), 'UNKNOWN') AS geology_unit FROM cells)"
_NEAREST = f"nn AS (SELECT cell_id, min({_haversine_sql('lat_centre', 'lon_centre', 'latitude', 'longitude')}) AS dn FROM cells, sup GROUP BY 1)"


def _matrix_sql(g: Grid = COARSE) -> str:
    return f"{SUP}, {_BOXES}, {_grid_sql(g)}, per AS (SELECT {_cell_sql(g)} AS cell_id, count(*) AS c FROM sup GROUP BY 1), {_UNITS_IN_BOXES}, {_NEAREST}, {_FX}"


_FX = (
    f"fx AS (SELECT cell_id, CASE WHEN lat_centre < -45 THEN 0 WHEN lat_centre < 0 THEN 1 WHEN lat_centre < 45 THEN 2 ELSE 3 END AS fold, CAST(coalesce(c, 0) > 0 AS INTEGER) AS y, {_SQL_PATTERNS['synthetic_proxy']} AS x1, "
    f"CAST(dense_rank() OVER (ORDER BY geology_unit) - 1 AS DOUBLE) AS x2, dn AS x3, {_STRESS} AS x4 FROM cells LEFT JOIN per USING (cell_id) JOIN un USING (cell_id) JOIN nn USING (cell_id))"
)
_MATRIX = _matrix_sql()


def _logistic_sql(columns: tuple[int, ...] = (1, 2, 3, 4), y: str = "y", tag: str = "", steps: int = 40) -> str:
    """``mo``: for each fold (and 4: all rows) the balanced, penalised model of ``fx``, by Newton steps; ``st`` has its scales."""
    d = len(columns)
    x, b = range(1, d + 1), range(d + 1)
    st, tr, nw, mo = (f"{n}{tag}" for n in ("st", "tr", "nw", "mo"))
    z = " + ".join(f"b{i} * z{i}" for i in b)
    state = ", ".join(f"b{i}" for i in b)
    tail = lambda i, j: " + 1.0::DOUBLE" if i == j and i else " + 1e-12::DOUBLE" if i == j else ""
    sums = [f"sum(w * p * (1 - p) * z{i} * z{j}){tail(i, j)} AS a{i}{j}" for i in b for j in range(i, d + 1)] + [f"sum(w * (p - y) * z{i}){f' + b{i}' if i else ''} AS g{i}" for i in b]
    system = f"SELECT k, step, {state}, {', '.join(sums)} FROM (SELECT {nw}.*, y, w, {', '.join(f'z{i}' for i in b)}, 1.0::DOUBLE / (1.0::DOUBLE + exp(-greatest(least({z}, 700.0), -700.0))) AS p FROM {nw} JOIN {tr} USING (k) WHERE step < {steps}) GROUP BY k, step, {state}"
    for q in range(d):  # elimination of one unknown after the other
        kept = [f"a{i}{j}" for i in range(q + 1) for j in range(i, d + 1)] + [f"g{i}" for i in range(q + 1)]
        less = [f"a{i}{j} - a{q}{i} * a{q}{j} / a{q}{q} AS a{i}{j}" for i in range(q + 1, d + 1) for j in range(i, d + 1)] + [f"g{i} - a{q}{i} * g{q} / a{q}{q} AS g{i}" for i in range(q + 1, d + 1)]
        system = f"SELECT k, step, {state}, {', '.join(kept + less)} FROM ({system})"
    for i in reversed(b):
        done = "".join(f" - a{i}{j} * e{j}" for j in range(i + 1, d + 1))
        system = f"SELECT *, (g{i}{done}) / a{i}{i} AS e{i} FROM ({system})"
    return (
        f"{st} AS (SELECT k, CAST(count(*) AS DOUBLE) AS n, CAST(sum({y}) AS DOUBLE) AS pos, {', '.join(f'avg(x{c}) AS m{i}, stddev_pop(x{c}) AS s{i}' for i, c in enumerate(columns, 1))} FROM range(5) t(k) JOIN fx ON fold <> k GROUP BY k), "
        f"{tr} AS (SELECT k, {y} AS y, CASE WHEN {y} = 1 THEN n / (2 * pos) ELSE n / (2 * (n - pos)) END AS w, 1.0::DOUBLE AS z0, {', '.join(f'(x{c} - m{i}) / s{i} AS z{i}' for i, c in enumerate(columns, 1))} FROM {st} JOIN fx ON fold <> k), "
        f"{nw} AS (SELECT k, 0 AS step, {', '.join(f'0.0::DOUBLE AS b{i}' for i in b)} FROM {st} UNION ALL SELECT k, step + 1, {', '.join(f'b{i} - e{i}' for i in b)} FROM ({system})), {mo} AS (SELECT * FROM {nw} WHERE step = {steps})"
    )


def _scored_sql(columns: tuple[int, ...] = (1, 2, 3, 4), y: str = "y", tag: str = "") -> str:
    """Rows of the test folds with their score."""
    z = " + ".join(f"b{i} * (x{c} - m{i}) / s{i}" for i, c in enumerate(columns, 1))
    return f"SELECT fold, {y} AS y, 1.0::DOUBLE / (1.0::DOUBLE + exp(-round(b0 + {z}, 9))) AS score FROM fx JOIN mo{tag} AS mo ON mo.k = fold JOIN st{tag} AS st ON st.k = fold"


_FITTED = f"WITH RECURSIVE {_MATRIX}, {_logistic_sql()}"
_OUT_OF_FOLD = f"pr AS ({_scored_sql()})"
_ORIGINS = (("tidal_heating_flux", "analytical proxy (not observed)"), ("geology_encoded", "observed / external"), ("dist_nearest_hotspot_km", "target-derived (from hotspot catalogue)"), ("dist_tidal_stress_max_km", "analytical proxy (not observed)"))


#: The sets by the numbers of their columns, and their label.
_SETS = {"all": ((1, 2, 3, 4), "y"), "no_leakage": ((1, 2, 4), "y"), "geology_only": ((2,), "y"), "tidal_only": ((1,), "y"), "null": ((1, 2, 4), "ys")}
_ABLATION = (
    f"WITH RECURSIVE {_matrix_sql(Grid()).replace('fx AS (', 'fz AS (')}, va AS (SELECT y AS ys, row_number() OVER (ORDER BY md5('42:a:' || cell_id), cell_id) AS place FROM fz), pl AS (SELECT cell_id, row_number() OVER (ORDER BY md5('42:b:' || cell_id), cell_id) AS place FROM fz), "
    f"fx AS (SELECT fz.*, ys FROM fz JOIN pl USING (cell_id) JOIN va USING (place)), {', '.join(_logistic_sql(c, y, f'_{n}', 25) for n, (c, y) in _SETS.items())}, "
    f"pr AS ({' UNION ALL '.join(f"SELECT '{n}:' || fold AS m, y, score FROM ({_scored_sql(c, y, f'_{n}')})" for n, (c, y) in _SETS.items())}), {_class_sql('pr', 'm', 'y', 'score > 0.5')}, {_ranking_sql('pr', 'm', 'y')}, "
    "ev AS (SELECT string_split(m, ':')[1] AS feature_set, CAST(string_split(m, ':')[2] AS INTEGER) AS fold, * EXCLUDE (m) FROM cm LEFT JOIN rm USING (m)) "
)
_MEASURES = ("precision", "recall", "f1", "auc_roc", "pr_auc")


@query(
    f"{_ABLATION} SELECT feature_set, {', '.join(f'round({f}({c}), 4) + 0.0 AS {c}_{n}' for c in _MEASURES for n, f in (('mean', 'avg'), ('std', 'stddev_pop')))}, feature_set = 'all' AS is_leaky_baseline, feature_set = 'null' AS is_null_sanity_check FROM ev GROUP BY 1"
)
def ablation(s, d):
    """At the reference size of 64,800 cells."""
    return rounded(models.ablation(matrix(s, d, Grid())), 4)


@query(f"{_ABLATION} SELECT * FROM ev")
def ablation_by_fold(s, d):
    return rounded(models.ablation_folds(matrix(s, d, Grid())))


@query(
    f"{_FITTED}, mr AS (SELECT *, {', '.join(f'rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS r{c}' for c in ('x1', 'x2', 'x3', 'x4', 'y'))} FROM fx), "
    f"cr AS (SELECT {', '.join(f'corr(x{i}, y) AS p{i}, corr(rx{i}, ry) AS q{i}' for i in range(1, 5))} FROM mr), "
    f"lv AS ({' UNION ALL '.join(f"SELECT '{n}' AS feature, '{o}' AS derivation_source, p{i} AS r, q{i} AS rho, b{i} AS b, {i == 3} AS made FROM cr, mo WHERE k = 4" for i, (n, o) in enumerate(_ORIGINS, 1))}) "
    "SELECT feature, derivation_source, round(r, 4) + 0.0 AS pearson_r, round(rho, 4) + 0.0 AS spearman_r, round(b, 4) + 0.0 AS lr_coef, round(abs(b), 4) AS abs_coef, made OR abs(r) >= 0.6 OR abs(b) >= 5 AS suspected_leakage, "
    "concat_ws('; ', CASE WHEN made THEN 'target-derived by construction' END, CASE WHEN abs(r) >= 0.6 THEN printf('|r|=%.2f ≥ 0.6', abs(r)) END, CASE WHEN abs(b) >= 5 THEN printf('|coef|=%.2f ≥ 5.0', abs(b)) END) AS flag_reason FROM lv"
)
def leakage_audit(s, d):
    return rounded(models.leakage_audit(matrix(s, d)), 4)


@query(f"{_FITTED}, {_OUT_OF_FOLD}, {_class_sql('pr', 'fold', 'y', 'score > 0.5')}, {_ranking_sql('pr', 'fold', 'y')} SELECT * FROM cm LEFT JOIN rm USING (fold)")
def trained_folds(s, d):
    return rounded(models.train(matrix(s, d))[1])


_BOTH = "n_positive_test > 0 AND n_positive_test < n_test"


@query(f"{_FITTED}, {_OUT_OF_FOLD}, {_class_sql('pr', 'fold', 'y', 'score >= 0.5')} SELECT fold, CASE WHEN {_BOTH} THEN brier END AS brier, CASE WHEN {_BOTH} THEN mcc END AS mcc, CASE WHEN NOT ({_BOTH}) THEN 'single-class test fold' END AS note FROM cm")
def validation_scores(s, d):
    return rounded(models.validate(matrix(s, d))["scores"])


_REGRESSED = (
    f"WITH {_MATRIX}, {_power_sql().replace(_grid_sql(COARSE) + ', ', '')}, rg AS (SELECT cell_id, fold, log_primary_power AS t, x1, x2, x4 AS x3 FROM obs JOIN fx USING (cell_id)), "
    "ms AS (SELECT k, CAST(count(*) AS DOUBLE) AS n, avg(t) AS mt, " + ", ".join(f"avg(x{i}) AS m{i}, stddev_pop(x{i}) AS s{i}, covar_pop(x{i}, t) AS c{i}" for i in (1, 2, 3)) + ", corr(x1, x2) AS r12, corr(x1, x3) AS r13, corr(x2, x3) AS r23 FROM range(4) f(k) JOIN rg ON fold <> k GROUP BY k), "
    "gm AS (SELECT *, n + 1 AS a, n * r12 AS u, n * r13 AS v, n * r23 AS w, n * c1 / s1 AS y1, n * c2 / s2 AS y2, n * c3 / s3 AS y3 FROM ms), dt AS (SELECT *, a * a * a + 2 * u * v * w - a * (u * u + v * v + w * w) AS det FROM gm), "
    "bt AS (SELECT *, ((a * a - w * w) * y1 + (v * w - a * u) * y2 + (u * w - a * v) * y3) / det AS b1, ((v * w - a * u) * y1 + (a * a - v * v) * y2 + (u * v - a * w) * y3) / det AS b2, ((u * w - a * v) * y1 + (u * v - a * w) * y2 + (a * a - u * u) * y3) / det AS b3 FROM dt), "
    "pd AS (SELECT fold, cell_id, t, mt + " + " + ".join(f"b{i} * (x{i} - m{i}) / s{i}" for i in (1, 2, 3)) + " AS p FROM rg JOIN bt ON k = fold) "
)


@query(f"{_REGRESSED} SELECT fold, cell_id, {_r('t')} AS observed_log_power, {_r('p')} AS predicted_log_power, {_r('t - p')} AS residual_log_power FROM pd")
def power_regression(s, d):
    out = models.power_regression(matrix(s, d), power_cells(s, d))["residuals"]
    return rounded(out.select("fold", "cell_id", "observed_log_power", "predicted_log_power", "residual_log_power"))


@query(
    f"{_REGRESSED}, rk AS (SELECT fold, t, p, rank() OVER (PARTITION BY fold ORDER BY t) + (count(*) OVER (PARTITION BY fold, t) - 1) / 2.0::DOUBLE AS rt, rank() OVER (PARTITION BY fold ORDER BY p) + (count(*) OVER (PARTITION BY fold, p) - 1) / 2.0::DOUBLE AS rp FROM pd) "
    f"SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n_test, {_r('1 - avg((t - p) * (t - p)) / var_pop(t)', 4)} AS r2, {_r('sqrt(avg((t - p) * (t - p)))', 4)} AS rmse, {_r('avg(abs(t - p))', 4)} AS mae, {_r('corr(rt, rp)', 3)} AS spearman FROM rk GROUP BY fold"
)
def power_regression_folds(s, d):
    """How well each band is told by the others."""
    found = models.power_regression(matrix(s, d), power_cells(s, d))["folds"]
    rows = [(f["fold"], int(f["n_test"]), f["r2"], f["rmse"], f["mae"], f["spearman"]) for f in found]  # a row for each band
    out = s.createDataFrame(rows, "fold int, n_test long, r2 double, rmse double, mae double, spearman double")
    return rounded(out.withColumn("spearman", F.round("spearman", 3)), 4)


@query(
    f"{_REGRESSED} SELECT count(*) AS n, {_r('1 - avg((t - p) * (t - p)) / var_pop(t)', 4)} AS r2, {_r('sqrt(avg((t - p) * (t - p)))', 4)} AS rmse, {_r('avg(abs(t - p))', 4)} AS mae FROM pd"
)
def power_regression_overall(s, d):
    found = models.power_regression(matrix(s, d), power_cells(s, d))
    m = found["overall_oof"]
    return rounded(s.createDataFrame([(found["n_observed_power_cells"], m["r2"], m["rmse"], m["mae"])], "n long, r2 double, rmse double, mae double"), 4)


@query(f"WITH {_power_sql()}, {_BANDS} SELECT i AS fold, lat_band, count(cell_id) AS n_cells, count(cell_id) * 100.0::DOUBLE / (SELECT count(*) FROM obs) AS pct FROM b LEFT JOIN obs ON lat_centre >= lo AND lat_centre < hi GROUP BY 1, 2")
def observed_folds_described(s, d):
    """Bands of the cells that hold power, from the table."""
    return models.LatitudeBands().describe(saved(power_cells(s, d).filter("power_count > 0")))


# --- plans and scenes -----------------------------------------------------------------------------------------------


@query(
    f"WITH {SUP}, {_BOXES}, {_grid_sql(COARSE)}, per AS (SELECT {_cell_sql(COARSE)} AS cell_id, count(*) AS c FROM sup GROUP BY 1), {_UNITS_IN_BOXES}, {_NEAREST} "
    f"SELECT cell_id, coalesce(c, 0) AS hotspot_count, {_r(_SQL_PATTERNS['synthetic_proxy'])} AS tidal_heating_flux, geology_unit, CAST(dense_rank() OVER (ORDER BY geology_unit) - 1 AS INTEGER) AS geology_encoded, {_r('dn', 4)} AS dist_nearest_hotspot_km FROM cells LEFT JOIN per USING (cell_id) JOIN un USING (cell_id) JOIN nn USING (cell_id)"
)
def feature_matrix(s, d):
    m = matrix(s, d)
    r = lambda c, k: (F.round(c, k) + F.lit(0.0)).alias(c)
    return m.select("cell_id", "hotspot_count", r("tidal_heating_flux", 6), "geology_unit", "geology_encoded", r("dist_nearest_hotspot_km", 4))


@query(f"WITH {_labelled_sql()} SELECT count(*) AS n_cells, CAST(sum(has_hotspot) AS BIGINT) AS n_positive, round(avg(has_hotspot), 6) AS positive_share FROM fm")
def overview(s, d):
    return rounded(features.overview(unit_cells(s, d)))


@query(f"WITH {_power_sql()} SELECT cell_id, {_r('primary_power_gw', 4)} AS primary_power_gw FROM obs WHERE primary_power_gw >= 1000 ORDER BY obs.primary_power_gw DESC, cell_id LIMIT 45")
def viewer_points(s, d):
    return rounded(scenes.viewer_points(power_cells(s, d), 1000.0).select("cell_id", "primary_power_gw"), 4)


@query(
    f"WITH {_power_sql()}, tp AS (SELECT * FROM obs ORDER BY primary_power_gw DESC, cell_id LIMIT 10) SELECT {_r('1.035::DOUBLE * cos(radians(lat_centre)) * cos(radians(lon_centre))')} AS x, {_r('1.035::DOUBLE * sin(radians(lat_centre))')} AS y, {_r('-(1.035::DOUBLE * cos(radians(lat_centre)) * sin(radians(lon_centre)))')} AS z, "
    f"{_r('0.014 + 0.026 * (ln(1 + primary_power_gw) / greatest(ln(1 + max(primary_power_gw) OVER ()), 1.0))')} AS size, power_names AS name, lat_centre AS lat, lon_centre AS lon, {_r('primary_power_gw', 6)} AS power FROM tp"
)
def viewer_payload(s, d):
    return rounded(scenes.viewer_payload(scenes.viewer_points(power_cells(s, d), top_10=True), top_10=True))


@query(f"WITH {_power_sql()} SELECT count(*) AS visible_hotspots, (SELECT power_names FROM obs o ORDER BY o.primary_power_gw DESC, cell_id LIMIT 1) AS strongest_name, {_r('sum(sum_power_gw)', 2)} AS visible_power_gw, {_r('max(primary_power_gw)', 2)} AS strongest_power_gw, {_r('sum(CASE WHEN abs(lat_centre) >= 60 THEN sum_power_gw ELSE 0.0 END) / sum(sum_power_gw)', 2)} AS polar_fraction FROM obs")
def insights(s, d):
    return rounded(scenes.insights(scenes.power_points(power_cells(s, d))), 2)


@query(f"WITH {_power_sql()}, l AS (SELECT *, ln(1 + primary_power_gw) AS lg FROM obs) SELECT cell_id, {_r('3.2 + 10.8 * (lg - min(lg) OVER ()) / (max(lg) OVER () - min(lg) OVER ())')} AS size, {_r('lg')} AS color FROM l")
def marker_sizes(s, d):
    return rounded(scenes.markers(scenes.power_points(power_cells(s, d))).select("cell_id", "size", "color"))


_NATURAL = (
    f"0.58::DOUBLE + 0.16 * sin(1.7 * {_LAM} + 0.6 * cos({_PHI})) + 0.10 * cos(2.4 * {_PHI} - 0.3 * sin({_LAM})) + 0.06 * sin(3.0 * {_LAM} + 2.2 * {_PHI}) "
    "- (0.24 * exp(-(pow((lon_centre - 25.0) / 34.0, 2) + pow((lat_centre + 18.0) / 22.0, 2))) + 0.20 * exp(-(pow((lon_centre + 118.0) / 40.0, 2) + pow((lat_centre - 10.0) / 26.0, 2)))) "
    f"+ (0.14 * exp(-pow((lat_centre - 54.0) / 24.0, 2)) * (0.65 + 0.35 * cos(1.8 * {_LAM})) + 0.10 * exp(-pow((lat_centre + 58.0) / 25.0, 2)) * (0.65 + 0.35 * sin(1.6 * {_LAM})))"
)


@query(f"WITH {_power_sql()}, v AS (SELECT lat_centre, log_primary_power AS v, row_number() OVER (PARTITION BY lat_centre ORDER BY lon_centre) AS i FROM pw) SELECT lat_centre, count(*) AS n_values, {_r('sum(i * v)', 4)} AS placed_sum FROM v GROUP BY 1")
def intensity_raster(s, d):
    """The intensity surface as rows of a raster; each value counts by its place."""
    power = saved(power_cells(s, d))
    rows = scenes.rows_by_latitude(scenes.surface(power, "thermal_intensity", power))
    placed = F.aggregate(F.transform("values", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return rows.select("lat_centre", F.size("values").cast("long").alias("n_values"), (F.round(placed, 4) + F.lit(0.0)).alias("placed_sum"))


@query(f"WITH {PTS}, {_held_sql('pts')}, v AS (SELECT cell_id, {_NATURAL} AS s FROM held) SELECT cell_id, {_r('(s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ())')} AS surface FROM v")
def natural_surface(s, d):
    """The field over the cells that hold customers."""
    return rounded(scenes.natural_surface(held(s, d, customers(s, d))).select("cell_id", "surface"))


@query(f"WITH {_labelled_sql()} SELECT cell_id, {_r('cos(radians(lat_centre)) * cos(radians(lon_centre))')} AS x, {_r('cos(radians(lat_centre)) * sin(radians(lon_centre))')} AS y, {_r('sin(radians(lat_centre))')} AS z, CASE WHEN cell_id % 20 IN (1, 2) THEN CAST(cell_id % 20 AS DOUBLE) ELSE 16.0::DOUBLE END AS value FROM fm")
def globe(s, d):
    fm = unit_cells(s, d).withColumn("geology_encoded", (F.col("cell_id") % 20).cast("int"))
    return rounded(scenes.globe(fm, unit_filter=[1, 2]).select("cell_id", "x", "y", "z", "value"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(s, d):
    out = incremental.windowed_counts(_t(s, d, "events"), "ts", "event_type")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))
