"""Readers of point catalogues, flux grids and stored tables. CSV columns are read as text and cast with care."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loxodrome.config import Grid
from loxodrome.functions import geo
from loxodrome.functions.checks import require_columns
from loxodrome.operators.grid import base_grid, cell_of
from loxodrome.operators.neighbours import nearest_planar

# Raw column names of catalogues and what they become.
CATALOG_COLUMNS = {"Name": "name", "Longitude": "longitude", "Latitude": "latitude", "Temperature_K": "temperature", "Source": "source"}
DOWNLOAD_COLUMNS = {"Volcanic_C": "Name", "Long_E": "Longitude", "Lat": "Latitude"}
POWER_REQUIRED = ("name", "longitude", "latitude", "power_gw")
BASIS = "Davies/JIRAM 4.8 micron spectral radiance"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file is there, in whatever store the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def must_exist(spark: SparkSession, path: str, how: str = "") -> None:
    if not exists(spark, path):
        raise FileNotFoundError(f"{path} not found" + (f"; {how}" if how else ""))


def number(column: str):
    """A text column as double; what isn't a number, and NaN, is null."""
    x = F.expr(f"try_cast(`{column}` as double)")
    return F.when(~F.isnan(x), x)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    must_exist(spark, path)
    d = spark.read.option("header", True).option("encoding", "UTF-8").option("escape", '"').csv(path)
    return d.toDF(*[c.lstrip("﻿").strip() for c in d.columns])


def hotspot_catalog(spark: SparkSession, path: str, normalize_longitude: bool = True) -> DataFrame:
    """Named points; rows without coordinates go; a longitude above 180 loses a turn; others outside stay."""
    raw = read_csv(spark, path)
    d = raw.withColumnsRenamed({a: b for a, b in CATALOG_COLUMNS.items() if a in raw.columns})
    require_columns(d, ("name", "longitude", "latitude"), "catalogue")
    d = d.withColumns({c: number(c) for c in ("longitude", "latitude", "temperature") if c in d.columns}).dropna(subset=["longitude", "latitude"])
    if normalize_longitude:
        d = d.withColumn("longitude", geo.wrap_over_180("longitude"))
    return d.withColumn("provenance", F.lit(path))


def out_of_range(catalog: DataFrame) -> DataFrame:
    """The points that :func:`hotspot_catalog` keeps though they are outside the globe, for a warning."""
    return catalog.filter(~F.col("longitude").between(-180, 180) | ~F.col("latitude").between(-90, 90))


def power_catalog(spark: SparkSession, path: str, normalize_longitude: bool = True) -> DataFrame:
    """Points with positive power and full coordinates inside the globe; longitude modulo a turn, 180 to -180."""
    d = read_csv(spark, path)
    require_columns(d, POWER_REQUIRED, "power catalogue")
    d = d.withColumns({"name": F.coalesce("name", F.lit("")), **{c: number(c) for c in ("longitude", "latitude", "power_gw")}})
    d = d.dropna(subset=["longitude", "latitude", "power_gw"]).filter("power_gw > 0")
    if normalize_longitude:
        d = d.withColumn("longitude", geo.wrap_modulo("longitude"))
    d = d.filter(F.col("longitude").between(-180, 180) & F.col("latitude").between(-90, 90))
    if "power_is_estimated" not in d.columns:
        d = d.withColumn("power_is_estimated", F.lit(True))
    return d if "basis_column" in d.columns else d.withColumn("basis_column", F.lit(BASIS))


def flux_csv(spark: SparkSession, path: str) -> DataFrame:
    """A flux grid; values that aren't numbers are null, and no row goes."""
    d = read_csv(spark, path)
    require_columns(d, ("longitude", "latitude", "flux_w_m2"), "flux grid")
    return d.withColumns({c: number(c) for c in ("longitude", "latitude", "flux_w_m2")}).withColumn("provenance", F.lit(path))


def _generated(spark: SparkSession, resolution: float, flux, provenance: str) -> DataFrame:
    g = base_grid(spark, Grid(resolution)).select(F.col("lon_centre").alias("longitude"), F.col("lat_centre").alias("latitude"))
    return g.withColumn("flux_w_m2", flux).withColumn("provenance", F.lit(provenance))


def synthetic_flux(spark: SparkSession, resolution: float = 1.0) -> DataFrame:
    """The analytic proxy at cell centres."""
    c, s = F.pow(F.cos(F.radians("latitude")), 2.0), F.pow(F.sin(F.radians("latitude")), 2.0)
    return _generated(spark, resolution, F.pow(F.cos(F.radians("longitude")), 2.0) * c + 0.3 * s, "SYNTHETIC analytic proxy, not observed")


def uniform_flux(spark: SparkSession, resolution: float = 1.0) -> DataFrame:
    return _generated(spark, resolution, F.lit(1.0), "GENERATED uniform null").withColumn("model_name", F.lit("uniform"))


def align_to_grid(source: DataFrame, spark: SparkSession, resolution: float = 1.0) -> DataFrame:
    """A flux table at all cell centres: the value of the cell's own point, else of the nearest in degrees."""
    cells = base_grid(spark, Grid(resolution))
    d = nearest_planar(cells, source, "flux_w_m2")
    return d.select(F.col("lon_centre").alias("longitude"), F.col("lat_centre").alias("latitude"), "flux_w_m2")


def add_flux(cells: DataFrame, source: DataFrame, flux: str = "flux_w_m2", out: str = "tidal_heating_flux", grid: Grid = Grid()) -> DataFrame:
    """Cells with the nearest flux. A source that lies on the cells' own centres is found by an equi-join alone."""
    if flux not in source.columns:
        raise ValueError(f"flux table is missing column {flux}")
    keyed = source.withColumn("_cell", cell_of("longitude", "latitude", grid, clip=False))
    return nearest_planar(cells, keyed.drop("_cell"), flux, out)


def download_mapping(raw: DataFrame) -> DataFrame:
    """A published table's columns in the catalogue's form: unnamed points get a name, numbers are cast, rest dropped."""
    require_columns(raw, DOWNLOAD_COLUMNS, "published table")
    d = raw.withColumnsRenamed(DOWNLOAD_COLUMNS)
    d = d.withColumns({"Name": F.coalesce("Name", F.lit("Unnamed")), "Longitude": number("Longitude"), "Latitude": number("Latitude")})
    return d.select("Name", "Longitude", "Latitude").dropna(subset=["Longitude", "Latitude"])


def stored(spark: SparkSession, path: str, how: str) -> DataFrame:
    """A table that an earlier step wrote; names the step that writes it where it is missing."""
    must_exist(spark, path, f"build it with {how}")
    return spark.read.parquet(path)


def base_grid_table(spark: SparkSession, path: str) -> DataFrame:
    return stored(spark, path, "operators.grid.base_grid")


def power_grid_table(spark: SparkSession, path: str) -> DataFrame:
    return stored(spark, path, "operators.grid.assign_power")


def feature_matrix_table(spark: SparkSession, path: str) -> DataFrame:
    return stored(spark, path, "plans.features.feature_matrix")


def product_log(spark: SparkSession, path: str) -> DataFrame:
    """Instrument product logs: byte-order mark, quoted numbers, ISO times; all stay text but for numbers asked for later."""
    return read_csv(spark, path)
