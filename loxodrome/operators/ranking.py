"""Ranks, running totals, histograms and quantiles that no single task has to sort alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loxodrome.functions import stats


def running(df: DataFrame, key: str, sums: dict[str, str], buckets: int = 64, by: tuple[str, ...] = ()) -> DataFrame:
    """Totals of ``sums[column]`` over all rows (of the same ``by``) with a smaller ``key``, as columns named by the values.

    Keys must be distinct. Each group's keys are cut into ranges at quantiles of a sketch of its own, so that a group of a narrow
    range is dealt out as any other: a row's total is that of the ranges before its own plus the rows before it in its range.
    """
    own = [F.col(c).alias(f"_k_{c}") for c in by]
    sketch = F.percentile_approx(F.col(key), [i / buckets for i in range(1, buckets)], 10_000) if buckets > 1 else F.array().cast("array<double>")
    cuts = df.groupBy(*by).agg(F.array_distinct(sketch).alias("_cuts")).select(*own, "_cuts")
    met = F.lit(True)
    for c in by:
        met = met & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    d = df.join(cuts, met) if by else df.crossJoin(F.broadcast(cuts))  # without groups it is one row
    d = d.withColumn("_r", F.size(F.filter("_cuts", lambda b: b < F.col(key)))).drop("_cuts", *[f"_k_{c}" for c in by])
    total = d.groupBy(*by, "_r").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # at most as many rows as ranges
    total = total.select(*[F.col(c).alias(f"_g_{c}") for c in by], F.col("_r").alias("_g_r"), *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums])
    inside = Window.partitionBy(*by, "_r").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_r") == F.col("_g_r")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    d = d.join(total, same).withColumns({o: F.col(f"_b_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c, o in sums.items()})
    return d.drop("_r", "_g_r", *[f"_g_{c}" for c in by], *[f"_b_{c}" for c in sums])


def midranks(df: DataFrame, column: str, out: str, buckets: int = 64, by: tuple[str, ...] = ()) -> DataFrame:
    """Average ranks, from 1 (in each group); null stays null. Equal values are counted first and ranked once."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running(counts, "_v", {"_c": "_before"}, buckets, by).select(*[F.col(c).alias(f"_k_{c}") for c in by], "_v", (F.col("_before") + (F.col("_c") + 1) / 2.0).alias(out))
    same = F.col(column).cast("double") == F.col("_v")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return df.join(ranked, same, "left").drop("_v", *[f"_k_{c}" for c in by])


def spearman(df: DataFrame, x: str, y: str, buckets: int = 64, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (a group): ``n`` and the rank correlation of the rows where both are known."""
    both = df.select(*by, x, y).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = midranks(midranks(both, x, "_rx", buckets, by), y, "_ry", buckets, by)
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), stats.correlation("_rx", "_ry").alias("rho"))


def bin_of(column: str, lo: float, hi: float, bins: int) -> Column:
    """The number of the equal bin that holds a value, the last one closed; null outside."""
    width = (hi - lo) / bins
    return F.when(F.col(column).between(lo, hi), F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1)).cast("int"))


def histogram(df: DataFrame, column: str, lo: float, hi: float, bins: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts in equal bins, half-open but for the last; what lies outside is dropped, empty bins are kept."""
    width = (hi - lo) / bins
    i = bin_of(column, lo, hi, bins)
    counts = df.filter(F.col(column).between(lo, hi)).groupBy(*by, i.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    groups = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    all_bins = groups.select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = all_bins.join(counts, [*by, "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return out.withColumn("bin_centre", F.lit(lo + width / 2) + F.col("bin") * width)


def data_range_histogram(df: DataFrame, column: str, bins: int, by: tuple[str, ...] = ()) -> DataFrame:
    """As :func:`histogram`, from the least to the greatest value, with densities."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    if lo is None:
        return histogram(df, column, 0.0, 1.0, bins, by).withColumn("density", F.lit(None).cast("double"))
    hi = hi if hi > lo else lo + 1.0
    h = histogram(df, column, float(lo), float(hi), bins, by)
    return h.withColumn("density", F.col("count") / F.sum("count").over(Window.partitionBy(*by)) / ((hi - lo) / bins))


def quantiles(df: DataFrame, by: list[str], column: str, named: dict[str, float]) -> DataFrame:
    """Exact, linearly interpolated quantiles of groups, by selection; null for groups without values.

    Distinct values are counted and placed by :func:`running`, so a group of any size is spread over its ranges. Of all values
    only the two around each quantile are kept.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    sizes = df.groupBy(*by).agg(F.count(column).alias("_n")).select(*[F.col(c).alias(f"_s_{c}") for c in by], "_n")
    ranked = running(counts, "_v", {"_c": "_before"}, by=tuple(by))
    met = F.lit(True)
    for c in by:
        met = met & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    placed = ranked.join(sizes, met) if by else ranked.crossJoin(F.broadcast(sizes))  # without groups it is one row
    around = {}
    for i, q in enumerate(named.values()):
        at = F.lit(float(q)) * (F.col("_n") - 1)
        holds = lambda k: (F.col("_before") <= k) & (k < F.col("_before") + F.col("_c"))
        around |= {f"_lo{i}": F.max(F.when(holds(F.floor(at)), F.col("_v"))), f"_hi{i}": F.max(F.when(holds(F.ceil(at)), F.col("_v")))}
    found = placed.groupBy(*by).agg(*[f.alias(n) for n, f in around.items()])
    d = sizes.join(found, met, "left") if by else sizes.crossJoin(F.broadcast(found))
    part = lambda q: F.lit(float(q)) * (F.col("_n") - 1) - F.floor(F.lit(float(q)) * (F.col("_n") - 1))
    value = lambda i, q: F.col(f"_lo{i}") * (1.0 - part(q)) + F.col(f"_hi{i}") * part(q)
    return d.select(*[F.col(f"_s_{c}").alias(c) for c in by], *[value(i, q).alias(n) for i, (n, q) in enumerate(named.items())])


def quantiles_of_few(df: DataFrame, by: list[str], column: str, named: dict[str, float]) -> DataFrame:
    """As :func:`quantiles`, for groups of a bounded size, such as a figure's replicates: a group's values meet in one task."""
    return df.groupBy(*by).agg(*[F.percentile(column, q).alias(n) for n, q in named.items()])


def median_filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls and NaN become the column's exact median over all rows."""
    plain = df.withColumns({c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns})
    unknown = plain.agg(*[F.count(F.when(F.col(c).isNull(), F.lit(1))).alias(c) for c in columns]).first()
    gaps = [c for c in columns if unknown[c]]
    if not gaps:
        return plain
    medians = {c: quantiles(plain.select(c), [], c, {"m": 0.5}).first()["m"] for c in gaps}
    return plain.withColumns({c: F.coalesce(F.col(c), F.lit(medians[c]).cast("double")) for c in gaps})


def gradient(df: DataFrame, x: str, y: str, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Second-order differences on uneven points, one-sided at the ends."""
    w = Window.partitionBy(*by).orderBy(x)
    px, py, nx, ny = F.lag(x).over(w), F.lag(y).over(w), F.lead(x).over(w), F.lead(y).over(w)
    a, b = F.col(x) - px, nx - F.col(x)
    middle = (a * a * ny + (b * b - a * a) * F.col(y) - b * b * py) / (a * b * (a + b))
    value = F.when(px.isNull(), (ny - F.col(y)) / b).when(nx.isNull(), (F.col(y) - py) / a).otherwise(middle)
    return df.withColumn(out, value)


def top_rows(df: DataFrame, column: str, least: float, n: int | None, tie: str) -> DataFrame:
    """Rows at or above ``least``, the greatest first, at most ``n``."""
    out = df.filter(F.col(column) >= least).orderBy(F.col(column).desc(), F.col(tie))
    return out if n is None else out.limit(n)


def scaled(value: Column, lo: float, span: float, constant: float, over) -> Column:
    """Min-max scaling into [lo, lo + span]; ``constant`` where all values are equal."""
    low, high = F.min(value).over(over), F.max(value).over(over)
    return F.when(high <= low, F.lit(constant)).otherwise(lo + span * (value - low) / F.when(high > low, high - low).otherwise(1.0))
