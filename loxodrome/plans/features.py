"""The feature matrix: grid, labels, flux, units and distances, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loxodrome.config import Grid
from loxodrome.functions import stats
from loxodrome.functions.shared import saved
from loxodrome.operators import neighbours, ranking
from loxodrome.operators.grid import assign_points, base_grid, encode_units
from loxodrome.sources.tables import add_flux, synthetic_flux


def feature_matrix(spark: SparkSession, points: DataFrame, polygons: DataFrame | None = None, flux: DataFrame | None = None, grid: Grid = Grid(), unit: str = "unit_name") -> DataFrame:
    """Without polygons all units are ``UNKNOWN`` with code 0; without a flux table the analytic proxy is used."""
    d = assign_points(base_grid(spark, grid), points, grid)
    d = add_flux(d, flux if flux is not None else synthetic_flux(spark, grid.resolution), grid=grid)
    if polygons is None:
        d = d.withColumns({"geology_unit": F.lit("UNKNOWN"), "geology_encoded": F.lit(0)})
    else:
        d = encode_units(saved(neighbours.assign_polygons(d, polygons, unit)))  # read twice: for its names and for its rows
    return neighbours.distance_to_stress_maxima(neighbours.nearest_great_circle(d, points))


def null_report(df: DataFrame) -> DataFrame:
    """``column, n_null`` for all columns, in one pass."""
    r = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns])
    return r.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, df.columns)), F.array(*df.columns))).alias("column", "n_null"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, count, mean, std, min, q25, q50, q75, max`` of numeric columns, exact: one pass for all columns, quartiles by selection."""
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("_x")) for c in columns])
    long = df.select(F.inline(each))
    of = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    sums = long.groupBy("column").agg(*[f("_x").alias(n) for n, f in of.items()])
    quartiles = ranking.quantiles(long, ["column"], "_x", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")  # columns of an empty table too
    found = every.join(sums, "column", "left").join(quartiles, "column", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return found.select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Each value with its number of rows and share, the most frequent first; null is a value."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("share", F.col("count") / F.lit(max(df.count(), 1))).orderBy(F.col("count").desc(), column)


def overview(df: DataFrame, label: str = "has_hotspot") -> DataFrame:
    """Rows, positives and their share."""
    return df.agg(F.count(F.lit(1)).alias("n_cells"), F.sum(F.col(label).cast("long")).alias("n_positive"), F.avg(F.col(label).cast("double")).alias("positive_share"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """``x, y, r``: Pearson correlations of all pairs, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    r = df.agg(*[stats.correlation(a, b).alias(str(k)) for k, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(str(k)).alias("r")) for k, (a, b) in enumerate(pairs)])
    return r.select(F.inline(rows))
