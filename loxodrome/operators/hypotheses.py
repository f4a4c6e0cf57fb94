"""Patterns on the grid, compared as intensities of Poisson processes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loxodrome.functions import geo, stats
from loxodrome.functions.checks import require_columns

IN_SAMPLE = "geology_insample"


def _unit_mean(df: DataFrame, columns: list[str], lat: str) -> DataFrame:
    """Columns over their means weighted by the cosine of latitude: one aggregation, a row for each column."""
    w = F.cos(F.radians(F.col(lat)))
    m = df.agg(F.sum(w).alias("_w"), *[F.sum(F.col(c) * w).alias(c) for c in columns]).first()
    if m["_w"] is None:
        return df
    if any(m[c] is None or m[c] / m["_w"] <= 0 for c in columns):
        raise ValueError("a template's area-weighted mean isn't positive")
    return df.withColumns({c: F.col(c) / F.lit(m[c] / m["_w"]) for c in columns})


def attach_patterns(cells: DataFrame, names=tuple(stats.PATTERNS), lat: str = "lat_centre", lon: str = "lon_centre", prefix: str = "tidal_template_") -> DataFrame:
    """Cells with a column for each pattern, scaled to mean 1 over the sphere."""
    require_columns(cells, (lat, lon), "grid")
    d = cells.withColumns({prefix + n: stats.pattern(n, lat, lon) for n in names})
    return _unit_mean(d, [prefix + n for n in names], lat)


def compare(fm: DataFrame, count: str = "has_hotspot", include_units: bool = True, unit: str = "geology_unit") -> DataFrame:
    """Per pattern: log-likelihood, AIC, pseudo R², likelihood ratio against the uniform one; best first.

    Every pattern's sums come from one pass over the cells; the rest is a row for each pattern.
    """
    require_columns(fm, ("lat_centre", "lon_centre", count), "feature matrix")
    prefix = "tidal_template_"
    names = list(stats.PATTERNS)
    d = attach_patterns(fm, names)
    if include_units and unit in fm.columns:
        # rates of a unit over all its cells: as many rows as units, so they join to the cells instead of a window
        rate = fm.groupBy(F.col(unit).alias("_u")).agg(F.greatest(F.avg(F.col("has_hotspot" if "has_hotspot" in fm.columns else count).cast("double")), F.lit(1e-6)).alias(prefix + IN_SAMPLE))
        d = _unit_mean(d.join(F.broadcast(rate), d[unit].eqNullSafe(rate["_u"])).drop("_u"), [prefix + IN_SAMPLE], "lat_centre")
        names.append(IN_SAMPLE)
    y = F.col(count).cast("double")
    d = d.withColumn("_area", geo.band_area("lat_centre"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("template"), (F.col("_area") * F.col(prefix + n)).alias("h")) for n in names])).alias("t")
    s = d.select(y.alias("y"), each).select("y", "t.*").groupBy("template")
    s = s.agg(F.sum("y").alias("n"), F.sum("h").alias("total"), F.sum(F.when(F.col("y") > 0, F.col("y") * F.log("h"))).alias("ylogh"))
    # sum of y log(alpha h) less the expected total, which is n at the best alpha
    ll = F.when(F.col("total") <= 0, F.lit(float("-inf"))).when(F.col("n") == 0, F.lit(0.0)).otherwise(F.coalesce("ylogh", F.lit(0.0)) + F.col("n") * F.log(F.col("n") / F.col("total")) - F.col("n"))
    one = Window.partitionBy()  # a row for each template
    s = s.withColumn("log_lik", ll).withColumn("_null", F.max(F.when(F.col("template") == "uniform", F.col("log_lik"))).over(one))
    s = s.withColumns(
        {
            "aic": 2.0 - 2.0 * F.col("log_lik"),
            "pseudo_r2": 1.0 - F.col("log_lik") / F.nullif("_null", F.lit(0.0)),
            "lr_chi2": 2.0 * (F.col("log_lik") - F.col("_null")),
        }
    )
    s = s.withColumns({"lr_p_value": stats.chi2_sf1(F.greatest(F.col("lr_chi2"), F.lit(0.0))), "delta_aic": F.col("aic") - F.min("aic").over(one)})
    return s.select("template", "log_lik", "aic", "delta_aic", "pseudo_r2", "lr_chi2", "lr_p_value").orderBy("aic", "template")
