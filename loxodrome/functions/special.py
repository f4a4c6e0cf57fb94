"""Special functions for single numbers that come out of aggregations."""

from __future__ import annotations

import math


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny, c, d, f = 1e-300, 1.0, 0.0, 1.0
    for i in range(1000):
        m = i // 2
        if i == 0:
            t = 1.0
        elif i % 2 == 0:
            t = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            t = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + t * d or tiny
        c = 1 + t / c or tiny
        d = 1 / d
        f *= c * d
        if i and abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def beta_quantile(p: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_cdf(mid, a, b) < p else (lo, mid)
    return (lo + hi) / 2


def exact_interval(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Clopper-Pearson limits of a proportion."""
    if not n:
        return math.nan, math.nan
    tail = (1 - level) / 2
    return (beta_quantile(tail, k, n - k + 1) if k else 0.0), (beta_quantile(1 - tail, k + 1, n - k) if k < n else 1.0)


def correlation_p(r: float, n: int) -> float:
    """Two-sided p of a correlation under Student's t with n - 2 degrees of freedom."""
    if n < 3 or not math.isfinite(r):
        return math.nan
    if abs(r) >= 1:
        return 0.0
    t2, df = r * r * (n - 2) / (1 - r * r), n - 2
    return beta_cdf(df / (df + t2), df / 2, 0.5)
