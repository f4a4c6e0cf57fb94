"""The base grid, and point tables aggregated onto it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loxodrome.config import Grid
from loxodrome.functions import geo
from loxodrome.functions.checks import require_columns


def base_grid(spark: SparkSession, grid: Grid = Grid()) -> DataFrame:
    """``cell_id``, centres and edges of every cell, made from a range: nothing is read or shuffled."""
    ix, iy = F.col("id") % grid.n_lon, F.floor(F.col("id") / grid.n_lon)
    half = grid.resolution / 2.0
    cells = spark.range(grid.n_cells).select(
        F.col("id").alias("cell_id"),
        geo.centre(ix, grid.lon_min, grid.resolution).alias("lon_centre"),
        geo.centre(iy, grid.lat_min, grid.resolution).alias("lat_centre"),
    )
    edges = {f"{a}_{e}": F.col(f"{a}_centre") + s * half for a in ("lon", "lat") for e, s in (("min", -1), ("max", 1))}
    return cells.withColumns(edges)


def cell_of(lon: str | Column, lat: str | Column, grid: Grid = Grid(), clip: bool = True) -> Column:
    """The number of the cell that holds a point. Points outside go to the edge cells, or with ``clip=False`` nowhere."""
    ix = geo.floor_index(lon, grid.lon_min, grid.resolution, grid.n_lon if clip else None)
    iy = geo.floor_index(lat, grid.lat_min, grid.resolution, grid.n_lat if clip else None)
    cell = iy * grid.n_lon + ix
    return cell if clip else F.when(ix.between(0, grid.n_lon - 1) & iy.between(0, grid.n_lat - 1), cell)


def _joined_names(name: str, order: str | None) -> Column:
    """Names in the table's order, joined by semicolons; a null name as ``nan``."""
    key = F.col(order) if order else F.col(name)
    pairs = F.array_sort(F.collect_list(F.struct(key.alias("k"), F.coalesce(F.col(name).cast("string"), F.lit("nan")).alias("n"))))
    return F.array_join(F.transform(pairs, lambda p: p["n"]), ";")


def assign_points(cells: DataFrame, points: DataFrame, grid: Grid = Grid(), order: str | None = None) -> DataFrame:
    """Cells with ``hotspot_count`` (named points only), ``has_hotspot`` and ``hotspot_names``; all cells stay.

    Points are aggregated per cell before they meet the grid.
    """
    require_columns(points, ("name", "longitude", "latitude"), "points")
    per_cell = points.groupBy(cell_of("longitude", "latitude", grid).alias("cell_id")).agg(F.count("name").alias("_n"), _joined_names("name", order).alias("_names"))
    out = cells.join(per_cell, "cell_id", "left").withColumn("hotspot_count", F.coalesce("_n", F.lit(0)).cast("long"))
    out = out.withColumn("has_hotspot", (F.col("hotspot_count") > 0).cast("int")).withColumn("hotspot_names", F.coalesce("_names", F.lit("")))
    return out.drop("_n", "_names")


def assign_power(cells: DataFrame, points: DataFrame, grid: Grid = Grid(), order: str | None = None) -> DataFrame:
    """Cells with count, largest, mean and summed power of their valid points; all cells stay."""
    require_columns(points, ("name", "longitude", "latitude", "power_gw"), "power points")
    p = points.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in ("longitude", "latitude", "power_gw")})
    p = p.filter("longitude is not null and latitude is not null and power_gw > 0 and not isnan(power_gw)")
    per_cell = p.groupBy(cell_of("longitude", "latitude", grid).alias("cell_id")).agg(
        F.count(F.lit(1)).alias("power_count"),
        F.max("power_gw").alias("primary_power_gw"),
        F.avg("power_gw").alias("mean_power_gw"),
        F.sum("power_gw").alias("sum_power_gw"),
        _joined_names("name", order).alias("power_names"),
    )
    out = cells.join(per_cell, "cell_id", "left")
    fill = {"power_count": 0, "primary_power_gw": 0.0, "mean_power_gw": 0.0, "sum_power_gw": 0.0, "power_names": ""}
    return out.na.fill(fill).withColumn("log_primary_power", F.log1p("primary_power_gw"))


def unit_codes(df: DataFrame, unit: str, out: str) -> DataFrame:
    """The dictionary: each name that occurs, with its number from 0 in the order of names. Null has none.

    Names are numbered within ranges of equal beginnings, side by side, and ranges by how many names stand before them.
    """
    names = df.select(F.col(unit).alias("_name")).filter("_name is not null").distinct().withColumn("_range", F.substring(F.col("_name").cast("string"), 1, 4))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over ranges, not names
    offsets = names.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_name")) - 1
    return names.withColumn("_inside", inside).join(offsets, "_range").select("_name", (F.col("_before") + F.col("_inside")).cast("int").alias(out))


def encode_units(df: DataFrame, unit: str = "geology_unit", out: str = "geology_encoded") -> DataFrame:
    """Units numbered from 0 in the order of their names, by a join with their dictionary."""
    return df.join(unit_codes(df, unit, out), F.col(unit) == F.col("_name"), "left").drop("_name")


def onehot_units(df: DataFrame, unit: str = "geology_unit", prefix: str = "geology_") -> DataFrame:
    """A 0/1 column for each unit that occurs, in the order of names."""
    names = sorted(r[0] for r in df.select(unit).distinct().collect() if r[0] is not None)
    return df.withColumns({f"{prefix}{u}": F.when(F.col(unit) == u, 1).otherwise(0) for u in names})


def onehot_vectors(df: DataFrame, unit: str = "geology_unit", out: str = "geology") -> DataFrame:
    """One-hot codes as sparse vectors: ``<out>_index`` (null for no unit) and ``<out>_size``, the number of units.

    Names stay in their dictionary, which is joined; no name becomes a column or goes to the driver.
    """
    codes = unit_codes(df, unit, f"{out}_index")
    size = codes.agg(F.count(F.lit(1)).cast("int").alias(f"{out}_size"))  # one row
    return df.join(codes, F.col(unit) == F.col("_name"), "left").drop("_name").crossJoin(F.broadcast(size))


def normalised(values: Column, lat: Column, over) -> Column:
    """Values over their mean weighted by the cosine of latitude, within a window."""
    w = F.cos(F.radians(lat))
    return values / (F.sum(values * w).over(over) / F.sum(w).over(over))
