"""Hemispheric counts with exact tests, and histograms with bootstrap limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loxodrome.config import SEED
from loxodrome.functions import special, stats
from loxodrome.operators import ranking, resample

LON_BINS, LAT_BINS = (-180.0, 180.0, 36), (-90.0, 90.0, 18)
#: The comparisons: names of both sides. A longitude of exactly -180 is on neither side of the second.
SIDES = (
    ("Sub-Jovian (|lon|<90°)", "Anti-Jovian (|lon|≥90°)"),
    ("Leading (0°<lon≤180°)", "Trailing (-180°<lon≤0°)"),
    ("Northern (lat>0°)", "Southern (lat≤0°)"),
)


def side_counts(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``comparison, n_a, n_b`` for each comparison (and group): six conditional sums in one pass."""
    lon, lat = F.col("longitude").cast("double"), F.col("latitude").cast("double")
    splits = ((F.abs(lon) < 90.0, F.abs(lon) >= 90.0), ((lon > 0.0) & (lon <= 180.0), (lon <= 0.0) & (lon > -180.0)), (lat > 0.0, lat <= 0.0))
    sums = [F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(f"_{i}{s}") for i, pair in enumerate(splits) for s, c in zip("ab", pair, strict=True)]
    rows = F.array(*[F.struct(F.lit(f"{a} vs {b}").alias("comparison"), F.col(f"_{i}a").alias("n_a"), F.col(f"_{i}b").alias("n_b")) for i, (a, b) in enumerate(SIDES)])
    return points.groupBy(*by).agg(*sums).select(*by, F.inline(rows))


def tested(counts: DataFrame) -> DataFrame:
    """Counts with totals, fractions and exact two-sided p-values; nulls where there is no point."""
    d = counts.withColumn("n_total", F.col("n_a") + F.col("n_b"))
    return d.withColumns({"fraction_a": F.col("n_a") / F.nullif("n_total", F.lit(0)), "p_binom": stats.binomial_half_p("n_a", "n_total")})


def binomial_tests(points: DataFrame) -> list[dict]:
    """The three tests as rows with exact 95 % limits and a sentence each."""
    out = []
    for r in tested(side_counts(points)).collect():  # three rows
        low, high = special.exact_interval(r["n_a"], r["n_total"])
        a, b = r["comparison"].split(" vs ")
        if not r["n_total"]:
            text = "no data"
        elif r["p_binom"] < 0.05:
            text = f"Significant asymmetry (p={r['p_binom']:.3f}): {a if r['n_a'] > r['n_b'] else b} dominant"
        else:
            text = f"No significant asymmetry (p={r['p_binom']:.3f})"
        out.append(r.asDict() | {"ci_lo": low, "ci_hi": high, "interpretation": text})
    return out


def histogram_limits(points: DataFrame, column: str, bins: tuple[float, float, int], n_boot: int, seed: int = SEED) -> DataFrame:
    """``bin, bin_centre, count, ci_lo, ci_hi``: counts with 2.5 and 97.5 percentiles over resamples of the points."""
    observed = ranking.histogram(points, column, *bins)
    if n_boot < 1:
        return observed.withColumns({"ci_lo": F.lit(None).cast("double"), "ci_hi": F.lit(None).cast("double")})
    weights = points.groupBy(ranking.bin_of(column, *bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # null: outside
    drawn = resample.multinomial(weights, "bin", "n", n_boot, seed)
    every = observed.select("bin").crossJoin(points.sparkSession.range(n_boot).withColumnRenamed("id", "rep"))  # bins by replicates
    filled = every.join(drawn, ["rep", "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    limits = ranking.quantiles_of_few(filled, ["bin"], "count", {"ci_lo": 0.025, "ci_hi": 0.975})
    return observed.join(limits, "bin", "left").orderBy("bin")


def asymmetry(points: DataFrame, n_boot: int = 1000, seed: int = SEED) -> dict:
    """Tests, both histograms, the number of points and the caveat of coverage."""
    return {
        "binomial_tests": binomial_tests(points),
        "lon_histogram": histogram_limits(points, "longitude", LON_BINS, n_boot, seed),
        "lat_histogram": histogram_limits(points, "latitude", LAT_BINS, n_boot, seed),
        "n_hotspots": points.count(),
        "coverage_caveat": "Counts follow where observers looked; asymmetries are properties of the catalogue first.",
    }
