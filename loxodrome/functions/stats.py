"""Statistics as Column builders, exact to double precision without any special-function library."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from loxodrome.config import RADIUS_KM
from loxodrome.functions.geo import _c


def wilson(k, n, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of a proportion, within [0, 1]; null for n = 0."""
    k, n = _c(k).cast("double"), F.nullif(_c(n).cast("double"), F.lit(0.0))
    p, zz = k / n, z * z
    mid = (p + zz / (2.0 * n)) / (1.0 + zz / n)
    half = F.lit(z) * F.sqrt(p * (1.0 - p) / n + zz / (4.0 * n * n)) / (1.0 + zz / n)
    return F.greatest(mid - half, F.lit(0.0)), F.least(mid + half, F.lit(1.0))


def correlation(x, y) -> Column:
    """Pearson's correlation of the rows where both are known, an aggregate: NaN where either is constant, null without rows."""
    x, y = (F.when(_c(x).isNotNull() & _c(y).isNotNull(), _c(v).cast("double")) for v in (x, y))
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(F.count(x) > 0, F.coalesce(r, F.lit(float("nan"))))


def chi2_sf1(x) -> Column:
    """Upper tail of chi-square with one degree of freedom, by the series of the incomplete gamma function."""
    h = _c(x) / 2.0
    step = lambda a, i: F.struct((a["t"] * h / (i + 0.5)).alias("t"), (a["s"] + a["t"] * h / (i + 0.5)).alias("s"))
    series = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(150)), lambda i: i.cast("double")), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), step, lambda a: a["s"])
    tail = 1.0 - F.exp(-h) * F.lit(2.0 / math.sqrt(math.pi)) * F.sqrt(h) * series
    return F.when(h > 36.0, F.lit(0.0)).otherwise(F.greatest(tail, F.lit(0.0)))


def binomial_half_p(k, n) -> Column:
    """Exact two-sided p of k successes in n at chance one half; null for n = 0."""
    k, n = _c(k).cast("long"), _c(n).cast("long")
    terms = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.least(k, n - k), F.lit(0).cast("long"))), lambda i: i.cast("double"))
    real = n.cast("double")
    first = F.struct((-real * math.log(2.0)).alias("l"), F.lit(0.0).alias("s"))
    add = lambda a, i: F.struct((a["l"] + F.log((real - i) / (i + 1.0))).alias("l"), (a["s"] + F.exp(a["l"])).alias("s"))
    p = F.least(F.lit(1.0), 2.0 * F.aggregate(terms, first, add, lambda a: a["s"]))
    return F.when(n > 0, F.when(2 * k == n, F.lit(1.0)).otherwise(p))


def csr_k(r, radius: float = RADIUS_KM) -> Column:
    """Ripley's K of complete spatial randomness on a sphere: the area of a cap."""
    return F.lit(2.0 * math.pi * radius * radius) * (1.0 - F.cos(_c(r) / radius))


# Closed forms of dissipation patterns over latitude (phi) and longitude (lam), in radians.
PATTERNS = {
    "asthenosphere": lambda phi, lam: F.pow(F.cos(phi), 2.0) * (1.0 + 2.0 * F.pow(F.cos(lam), 2.0)) / 3.0,
    "deep_mantle": lambda phi, lam: F.pow(F.sin(phi), 2.0) + 0.15 * F.pow(F.cos(phi), 2.0) * (1.0 + 0.3 * F.cos(2.0 * lam)),
    "magma_ocean": lambda phi, lam: F.pow(F.cos(phi), 2.0) * (1.0 + 0.3 * F.cos(2.0 * lam)),
    "uniform": lambda phi, lam: F.lit(1.0) + 0.0 * phi,
    "synthetic_proxy": lambda phi, lam: F.pow(F.cos(lam), 2.0) * F.pow(F.cos(phi), 2.0) + 0.3 * F.pow(F.sin(phi), 2.0),
}
#: More patterns may be registered here: name -> builder of (phi, lam).


def pattern(name: str, lat, lon) -> Column:
    """A pattern before scaling, at least 1e-6."""
    if name not in PATTERNS:
        raise KeyError(f"unknown template '{name}'; available: {', '.join(PATTERNS)}")
    return F.greatest(PATTERNS[name](F.radians(_c(lat)), F.radians(_c(lon))), F.lit(1e-6))


def natural_surface(lat, lon) -> Column:
    """A smooth procedural field before scaling; fixed values throughout."""
    lam, phi = F.radians(_c(lon)), F.radians(_c(lat))
    lon, lat = _c(lon), _c(lat)
    bump = lambda x, at, w: F.pow((x - at) / w, 2.0)
    waves = 0.58 + 0.16 * F.sin(1.7 * lam + 0.6 * F.cos(phi)) + 0.10 * F.cos(2.4 * phi - 0.3 * F.sin(lam)) + 0.06 * F.sin(3.0 * lam + 2.2 * phi)
    dark = 0.24 * F.exp(-(bump(lon, 25.0, 34.0) + bump(lat, -18.0, 22.0))) + 0.20 * F.exp(-(bump(lon, -118.0, 40.0) + bump(lat, 10.0, 26.0)))
    frost = 0.14 * F.exp(-bump(lat, 54.0, 24.0)) * (0.65 + 0.35 * F.cos(1.8 * lam)) + 0.10 * F.exp(-bump(lat, -58.0, 25.0)) * (0.65 + 0.35 * F.sin(1.6 * lam))
    return waves - dark + frost
