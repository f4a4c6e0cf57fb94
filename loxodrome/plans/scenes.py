"""Tidy tables behind maps, globes and viewers. Drawing is left to whoever reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loxodrome.functions import geo, stats
from loxodrome.operators import ranking

# Unit codes in the order of their encoding, and the code of dimmed cells.
UNIT_CODES = ("Fb", "Fd", "Fu", "Ml", "Mm", "Mu", "NoData", "PFb", "PFd", "PFu", "Pbw", "Pby", "Pl", "Prb", "Tb", "UNKNOWN")
DIMMED = 16.0
SURFACES = ("natural_io", "thermal_intensity", "geology", "model_probability")
# What each scene changes.
SCENES = {
    "Meet Io": {},
    "Not all volcanoes are equal": {},
    "The giants dominate": {"top": 10, "towers": True},
    "Poles vs equator": {"rings": True, "surface": "natural_io"},
    "What we still do not know": {"uncertainty": True},
}


def _no_data() -> F.Column:
    return F.upper(F.col("geology_unit").cast("string")).isin("UNKNOWN", "NODATA")


def natural_surface(fm: DataFrame) -> DataFrame:
    """Cells with the procedural field scaled to [0, 1]; its range comes from one aggregation."""
    d = fm.withColumn("_s", stats.natural_surface("lat_centre", "lon_centre"))
    r = d.agg(F.min("_s"), F.max("_s")).first()
    if r[0] is None:
        return d.withColumnRenamed("_s", "surface")
    return d.withColumn("surface", geo.clamp((F.col("_s") - r[0]) / max(r[1] - r[0], 1e-9), 0.0, 1.0)).drop("_s")


def surface(fm: DataFrame, mode: str = "natural_io", power: DataFrame | None = None, probability: str | None = None, uncertainty: bool = False) -> DataFrame:
    """``cell_id, lon_centre, lat_centre, surface`` of a mode; unknown modes are the natural one."""
    mode = mode if mode in SURFACES else "natural_io"
    if mode == "model_probability" and probability in fm.columns:
        d = fm.withColumn("surface", F.col(probability))
    elif mode == "thermal_intensity" and power is not None:
        d = fm.join(power.select("cell_id", F.col("log_primary_power").alias("surface")), "cell_id", "left").na.fill(0.0, ["surface"])
    elif mode == "geology":
        d = fm.withColumn("surface", F.col("geology_encoded").cast("double"))
    elif mode == "natural_io":
        d = natural_surface(fm)
        if uncertainty and "geology_unit" in fm.columns:
            d = d.withColumn("surface", F.when(_no_data(), F.col("surface") * 0.34).otherwise(F.col("surface")))
    else:
        code = F.col("geology_encoded").cast("double")
        d = fm.withColumn("surface", F.when(_no_data(), DIMMED).otherwise(code) if uncertainty and "geology_unit" in fm.columns else code)
    return d.select("cell_id", "lon_centre", "lat_centre", "surface")


def globe(fm: DataFrame, color_by: str = "io_appearance", probability: str | None = None, unit_filter: list[int] | None = None) -> DataFrame:
    """Unit-sphere points with their colour value; units outside the filter are dimmed; no probabilities means flux."""
    if color_by == "model_probability":
        value = F.col(probability) if probability in fm.columns else F.col("tidal_heating_flux")
    elif color_by == "io_appearance":
        value = F.col("geology_encoded").cast("double")
        value = F.when(F.col("geology_encoded").isin(list(unit_filter)), value).otherwise(DIMMED) if unit_filter else value
    else:
        value = F.col(color_by)
    x, y, z = geo.xyz("lon_centre", "lat_centre")
    return fm.select("cell_id", "lon_centre", "lat_centre", x.alias("x"), y.alias("y"), z.alias("z"), value.alias("value"))


def rows_by_latitude(table: DataFrame, value: str = "surface") -> DataFrame:
    """A raster in rows: for each latitude its values in order of longitude."""
    d = table.groupBy("lat_centre").agg(F.array_sort(F.collect_list(F.struct("lon_centre", value))).alias("_r"))
    return d.select("lat_centre", F.transform("_r", lambda r: r[value]).alias("values")).orderBy("lat_centre")


def power_points(power: DataFrame, least: float = 0.0, top: int | None = None) -> DataFrame:
    return ranking.top_rows(power.filter("power_count > 0"), "primary_power_gw", least, top, "cell_id")


def viewer_points(power: DataFrame, least: float = 0.0, show_all: bool = False, top_10: bool = False) -> DataFrame:
    """At most 45 points unless all are asked for; ten in the top view."""
    return power_points(power, least, 10 if top_10 else None if show_all else 45)


def markers(points: DataFrame) -> DataFrame:
    """Shown points with coordinates, size, colour and tower height."""
    one, log = Window.partitionBy(), F.log1p(F.col("primary_power_gw"))
    x, y, z = geo.xyz("lon_centre", "lat_centre", 1.03)
    height = 0.08 + 0.35 * log / F.greatest(F.log1p(F.max("primary_power_gw").over(one)), F.lit(1.0))
    return points.withColumns({"x": x, "y": y, "z": z, "size": ranking.scaled(log, 3.2, 10.8, 5.5, one), "color": log, "tower_height": height})


def viewer_payload(points: DataFrame, top_10: bool = False, default_name: str = "hot spot") -> DataFrame:
    """``x, y, z, size, name, lat, lon, power`` with y up."""
    lo, span = (0.014, 0.026) if top_10 else (0.006, 0.012)
    most = F.max("primary_power_gw").over(Window.partitionBy())
    scale = F.log1p(F.greatest(F.col("primary_power_gw"), F.lit(0.0))) / F.greatest(F.log1p(F.greatest(most, F.lit(1.0))), F.lit(1.0))
    x, y, z = geo.xyz("lon_centre", "lat_centre", 1.035, y_up=True)
    name = F.coalesce(F.nullif("power_names", F.lit("")), F.lit(default_name))
    return points.select(x.alias("x"), y.alias("y"), z.alias("z"), (lo + span * scale).alias("size"), name.alias("name"), F.col("lat_centre").alias("lat"), F.col("lon_centre").alias("lon"), F.col("primary_power_gw").alias("power"))


def insights(points: DataFrame, default_name: str = "hot spot", none: str = "none") -> DataFrame:
    """One row: what is visible, the strongest, the polar share."""
    polar = F.sum(F.when(F.abs("lat_centre") >= 60.0, F.col("sum_power_gw")).otherwise(0.0))
    best = F.max_by(F.struct("power_names", "primary_power_gw"), F.struct("primary_power_gw", -F.col("cell_id")))
    d = points.agg(F.count(F.lit(1)).alias("visible_hotspots"), F.coalesce(F.sum("sum_power_gw"), F.lit(0.0)).alias("visible_power_gw"), best.alias("b"), F.coalesce(polar, F.lit(0.0)).alias("p"))
    return d.select(
        "visible_hotspots",
        "visible_power_gw",
        F.when(F.col("visible_hotspots") == 0, F.lit(none)).otherwise(F.coalesce(F.nullif("b.power_names", F.lit("")), F.lit(default_name))).alias("strongest_name"),
        F.coalesce("b.primary_power_gw", F.lit(0.0)).alias("strongest_power_gw"),
        F.coalesce(F.col("p") / F.nullif("visible_power_gw", F.lit(0.0)), F.lit(0.0)).alias("polar_fraction"),
    )


def polar_rings(spark: SparkSession, threshold: float = 60.0) -> DataFrame:
    """Two closed circles of latitude, a point a degree."""
    d = spark.range(2 * 361).select(F.when(F.col("id") < 361, threshold).otherwise(-threshold).alias("lat"), (F.col("id") % 361 - 180.0).alias("lon"))
    x, y, z = geo.xyz("lon", "lat", 1.055)
    return d.select("lat", "lon", x.alias("x"), y.alias("y"), z.alias("z"))


def scene(fm: DataFrame, power: DataFrame, name: str = "Meet Io", least: float = 0.0, mode: str = "natural_io", top: int | None = None, uncertainty: bool = False) -> dict[str, DataFrame]:
    """All tables of a scene; unknown names are the first scene."""
    change = SCENES.get(name, {})
    points = power_points(power, least, change.get("top", top))
    out = {"surface": surface(fm, change.get("surface", mode), power, uncertainty=change.get("uncertainty", uncertainty)), "points": markers(points), "insights": insights(points)}
    if change.get("rings"):
        out["rings"] = polar_rings(fm.sparkSession)
    return out


def error_bars(enrichment: DataFrame, base_rate: float) -> DataFrame:
    """Ratios with the Wilson limits in units of the base rate, as distances from the ratio, not below 0."""
    low = F.greatest(F.col("enrichment_ratio") - F.col("wilson_lo") / base_rate, F.lit(0.0))
    high = F.greatest(F.col("wilson_hi") / base_rate - F.col("enrichment_ratio"), F.lit(0.0))
    return enrichment.select("unit", "enrichment_ratio", low.alias("err_low"), high.alias("err_high"))


def delta_class(delta: str = "delta_aic"):
    """Support classes of a model comparison."""
    return F.when(F.col(delta) < 2, "strong").when(F.col(delta) < 10, "moderate").otherwise("weak")


def survival_class(rate: str = "survival_rate"):
    return F.when(F.col(rate) >= 0.8, "stable").when(F.col(rate) >= 0.5, "mixed").otherwise("fragile")


def survival_table(stability: DataFrame, fractions) -> DataFrame:
    """Metrics by retained fraction."""
    return stability.groupBy("metric").pivot("fraction_retained", [float(f) for f in fractions]).agg(F.avg("survival_rate")).orderBy("metric")
