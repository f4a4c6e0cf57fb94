"""Rates by unit and by latitude band: enrichment, coverage, intensity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loxodrome.config import CV_BANDS, POWER_BANDS, UNOBSERVED_UNITS
from loxodrome.functions import geo, stats
from loxodrome.functions.checks import require_columns

#: What the power columns mean; a fixed text of result tables.
POWER_DEFINITION = "estimated thermal-emission proxy from Davies/JIRAM 4.8 micron spectral radiance"


def enrichment(fm: DataFrame, unit: str = "geology_unit", label: str = "has_hotspot", check: bool = True) -> DataFrame:
    """Per unit: cells, hotspot cells, expectation, ratio, Wilson limits, chi-square share and p-values; best first.

    One aggregation of the cells; the rest works on a row for each unit.
    """
    missing = [c for c in (unit, label) if c not in fm.columns]
    if missing:
        raise KeyError(f"missing columns: {', '.join(missing)}")
    per = fm.groupBy(F.coalesce(F.col(unit).cast("string"), F.lit("nan")).alias("unit")).agg(F.count(F.lit(1)).alias("n_cells"), F.sum(F.col(label).cast("long")).alias("n_hotspots"))
    if check and not fm.filter(F.col(label) > 0).limit(1).count():
        raise ValueError("no hotspots: enrichment is undefined")
    return enrichment_of_counts(per).orderBy(F.col("enrichment_ratio").desc_nulls_last(), "unit")


def enrichment_of_counts(per: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """From counts per unit (and replicate ``by``) to the enrichment table."""
    everything = Window.partitionBy(*by)
    base = F.sum("n_hotspots").over(everything) / F.sum("n_cells").over(everything)
    d = per.withColumns({"base_rate": base, "n_units": F.count(F.lit(1)).over(everything)})
    d = d.withColumn("expected_hotspots", F.col("base_rate") * F.col("n_cells"))
    low, high = stats.wilson("n_hotspots", "n_cells")
    off = F.col("n_hotspots") - F.col("expected_hotspots")
    d = d.withColumns(
        {
            "observed_rate": F.col("n_hotspots") / F.nullif("n_cells", F.lit(0)),
            "enrichment_ratio": F.col("n_hotspots") / F.nullif("expected_hotspots", F.lit(0.0)),
            "wilson_lo": low,
            "wilson_hi": high,
            "chi2_contribution": F.coalesce(off * off / F.nullif("expected_hotspots", F.lit(0.0)), F.lit(0.0)),
        }
    )
    d = d.withColumn("p_raw", stats.chi2_sf1("chi2_contribution"))
    d = d.withColumn("p_bonferroni", F.least(F.lit(1.0), F.col("p_raw") * F.col("n_units")))
    return d.withColumn("significant", F.col("p_bonferroni") < 0.05).drop("base_rate", "n_units")


def band_label(lo, hi) -> str:
    return f"{lo:+.0f}° to {hi:+.0f}°"


def _bands(df: DataFrame, bands) -> DataFrame:
    rows = [(i, b[2] if len(b) > 2 else band_label(b[0], b[1]), float(b[0]), float(b[1])) for i, b in enumerate(bands)]
    return df.sparkSession.createDataFrame(rows, "band int, lat_band string, lat_min double, lat_max double")


def coverage(fm: DataFrame, unit: str = "geology_unit", label: str = "has_hotspot", bands=CV_BANDS) -> DataFrame:
    """Per band: cells, observed cells, hotspots, rates per cell and per observed cell. Empty bands are rows too.

    Without the unit column the table is empty.
    """
    if unit not in fm.columns:
        kinds = "lat_band string, lat_min double, lat_max double, total_cells long, observed_cells long, n_hotspots long, unobserved_pct double, raw_rate double, adjusted_rate double, rate_ratio double"
        return fm.sparkSession.createDataFrame([], kinds)
    seen = ~F.trim(F.coalesce(F.col(unit).cast("string"), F.lit("None"))).isin(*UNOBSERVED_UNITS)
    per = fm.withColumn("band", geo.band_of("lat_centre", bands)).filter("band is not null").groupBy("band")
    per = per.agg(F.count(F.lit(1)).alias("total_cells"), F.sum(seen.cast("long")).alias("observed_cells"), F.sum(F.col(label).cast("long")).alias("n_hotspots"))
    d = _bands(fm, bands).join(per, "band", "left").na.fill(0, ["total_cells", "observed_cells", "n_hotspots"])
    total, observed = F.nullif("total_cells", F.lit(0)), F.nullif("observed_cells", F.lit(0))
    d = d.withColumns({"unobserved_pct": F.round(100.0 * (F.col("total_cells") - F.col("observed_cells")) / total, 2), "raw_rate": F.col("n_hotspots") / total, "adjusted_rate": F.col("n_hotspots") / observed})
    return d.withColumn("rate_ratio", F.round(F.col("adjusted_rate") / F.nullif("raw_rate", F.lit(0.0)), 3)).orderBy("band").drop("band")


_POWER_COLUMNS = ("cell_id", "lat_centre", "lon_centre", "power_count", "primary_power_gw", "mean_power_gw", "sum_power_gw")


def observed_power(cells: DataFrame) -> DataFrame:
    require_columns(cells, _POWER_COLUMNS, "power grid")
    return cells.filter("power_count > 0")


def _power_sums() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n_power_cells"),
        F.sum("power_count").alias("power_count"),
        F.sum("sum_power_gw").alias("sum_power_gw"),
        F.avg("primary_power_gw").alias("mean_primary_power_gw"),
        F.max("primary_power_gw").alias("max_primary_power_gw"),
    ]


def power_by_latitude(cells: DataFrame, bands=POWER_BANDS) -> DataFrame:
    """Intensity per labelled band with its share of all power; empty bands have null means."""
    per = observed_power(cells).withColumn("band", geo.band_of("lat_centre", bands)).groupBy("band").agg(*_power_sums())
    total = F.sum("sum_power_gw").over(Window.partitionBy())  # a row for each band; cells outside all bands count in the total
    shares = per.withColumn("fraction_total_power", F.col("sum_power_gw") / F.nullif(total, F.lit(0.0)))
    d = _bands(cells, bands).join(shares, "band", "left").na.fill(0, ["n_power_cells", "power_count", "sum_power_gw"])
    grand = F.max(F.col("fraction_total_power").isNotNull()).over(Window.partitionBy())
    d = d.withColumn("fraction_total_power", F.when(grand, F.coalesce("fraction_total_power", F.lit(0.0))))
    return d.orderBy("band").drop("band").withColumn("power_definition", F.lit(POWER_DEFINITION))


def power_by_unit(fm: DataFrame, cells: DataFrame, unit: str = "geology_unit") -> DataFrame:
    """Intensity per unit with its share; cells without a unit are the unit ``nan``."""
    if unit not in fm.columns:
        raise KeyError(f"feature matrix must contain {unit}")
    d = observed_power(cells.join(fm.select("cell_id", unit), "cell_id", "left")).groupBy(F.coalesce(F.col(unit).cast("string"), F.lit("nan")).alias(unit)).agg(*_power_sums())
    share = F.col("sum_power_gw") / F.nullif(F.sum("sum_power_gw").over(Window.partitionBy()), F.lit(0.0))
    return d.withColumn("fraction_total_power", share).withColumn("power_definition", F.lit(POWER_DEFINITION)).orderBy(F.col("sum_power_gw").desc(), unit)


def polar_sensitivity(cells: DataFrame, thresholds=(55, 60, 65)) -> DataFrame:
    """Polar against other power for several limits of latitude, all in one pass."""
    d = observed_power(cells).withColumn("polar_threshold_abs_lat", F.explode(F.array(*[F.lit(int(t)) for t in thresholds])))
    polar = F.abs("lat_centre") >= F.col("polar_threshold_abs_lat")
    pick = lambda f, c, p: f(F.when(polar if p else ~polar, F.col(c)))
    d = d.groupBy("polar_threshold_abs_lat").agg(
        pick(F.count, "cell_id", True).alias("polar_power_cells"),
        pick(F.count, "cell_id", False).alias("nonpolar_power_cells"),
        F.coalesce(pick(F.sum, "sum_power_gw", True), F.lit(0.0)).alias("polar_sum_power_gw"),
        F.coalesce(pick(F.sum, "sum_power_gw", False), F.lit(0.0)).alias("nonpolar_sum_power_gw"),
        pick(F.avg, "primary_power_gw", True).alias("polar_mean_primary_power_gw"),
        pick(F.avg, "primary_power_gw", False).alias("nonpolar_mean_primary_power_gw"),
    )
    both = F.nullif(F.col("polar_sum_power_gw") + F.col("nonpolar_sum_power_gw"), F.lit(0.0))
    return d.withColumn("polar_fraction_total_power", F.col("polar_sum_power_gw") / both).withColumn("power_definition", F.lit(POWER_DEFINITION)).orderBy("polar_threshold_abs_lat")


def outlier_sensitivity(cells: DataFrame, remove=(0, 1, 5, 10), polar: float = 60.0) -> DataFrame:
    """Polar share after the strongest cells are left out; ties go by cell number.

    Only the strongest ``max(remove)`` cells are ranked; their sums are taken off the totals.
    """
    obs = observed_power(cells)
    top = obs.orderBy(F.col("primary_power_gw").desc(), "cell_id").limit(max(1, max(remove)))
    ranked = top.select("cell_id", F.row_number().over(Window.orderBy(F.col("primary_power_gw").desc(), F.col("cell_id"))).alias("rank"))
    d = obs.join(F.broadcast(ranked), "cell_id", "left").withColumn("removed_top_n_cells", F.explode(F.array(*[F.lit(int(n)) for n in remove])))
    left = F.coalesce(F.col("rank") > F.col("removed_top_n_cells"), F.lit(True))
    far = F.abs("lat_centre") >= polar
    total = lambda c: F.coalesce(F.sum(F.when(left & c, F.col("sum_power_gw"))), F.lit(0.0))
    d = d.groupBy("removed_top_n_cells").agg(
        F.sum(left.cast("long")).alias("remaining_power_cells"),
        total(F.lit(True)).alias("sum_power_gw"),
        total(far).alias("polar_sum_power_gw"),
        total(~far).alias("nonpolar_sum_power_gw"),
        F.max(F.when(left, F.col("primary_power_gw"))).alias("max_remaining_primary_power_gw"),
    )
    share = F.col("polar_sum_power_gw") / F.nullif("sum_power_gw", F.lit(0.0))
    return d.withColumn("polar_fraction_total_power", share).withColumn("power_definition", F.lit(POWER_DEFINITION)).orderBy("removed_top_n_cells")


def power_suite(fm: DataFrame, cells: DataFrame) -> dict[str, DataFrame]:
    return {"latitude": power_by_latitude(cells), "geology": power_by_unit(fm, cells), "outlier_sensitivity": outlier_sensitivity(cells), "polar_sensitivity": polar_sensitivity(cells)}
