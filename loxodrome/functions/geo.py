"""Column builders for the sphere, the grid and planar polygons. All stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loxodrome.config import RADIUS_KM


def _c(x) -> Column:
    return F.lit(float(x)) if isinstance(x, (int, float)) else (F.col(x) if isinstance(x, str) else x)


def clamp(x: Column, lo, hi) -> Column:
    return F.least(F.greatest(x, _c(lo)), _c(hi))


def haversine_km(lat1, lon1, lat2, lon2, radius: float = RADIUS_KM) -> Column:
    """Great-circle distance of points in degrees."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    s, t = F.sin((F.radians(lat2) - F.radians(lat1)) / 2.0), F.sin((F.radians(lon2) - F.radians(lon1)) / 2.0)
    a = clamp(s * s + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * t * t, 0.0, 1.0)
    return F.lit(2.0 * radius) * F.asin(F.sqrt(a))


def floor_index(x, lo: float, resolution: float, n: int | None = None) -> Column:
    """Number of the cell that holds ``x``; with ``n``, points outside go to the first or last cell."""
    i = F.floor((_c(x) - F.lit(float(lo))) / F.lit(float(resolution))).cast("long")
    return i if n is None else F.least(F.greatest(i, F.lit(0).cast("long")), F.lit(n - 1).cast("long"))


def centre(index, lo: float, resolution: float) -> Column:
    return F.lit(lo + resolution / 2.0) + _c(index).cast("double") * F.lit(float(resolution))


def band_area(lat, resolution: float = 1.0) -> Column:
    """Area of a cell up to a factor: the difference of the sines of its edges."""
    half = F.radians(F.lit(resolution / 2.0))
    return F.abs(F.sin(F.radians(_c(lat)) + half) - F.sin(F.radians(_c(lat)) - half))


def xyz(lon, lat, radius=1.0, y_up: bool = False) -> tuple[Column, Column, Column]:
    """Cartesian coordinates; z towards the north pole, or with ``y_up`` y."""
    lon, lat, r = F.radians(_c(lon)), F.radians(_c(lat)), _c(radius)
    x, side, up = r * F.cos(lat) * F.cos(lon), r * F.cos(lat) * F.sin(lon), r * F.sin(lat)
    return (x, up, -side) if y_up else (x, side, up)


def wrap_over_180(lon) -> Column:
    """Only what is above 180 moves by a turn."""
    return F.when(_c(lon) > 180.0, _c(lon) - 360.0).otherwise(_c(lon))


def wrap_modulo(lon) -> Column:
    """Into [-180, 180), for any number of turns."""
    x = _c(lon) + 180.0
    return x - F.lit(360.0) * F.floor(x / 360.0) - 180.0


def band_of(lat, bands) -> Column:
    """Number of the half-open band [lo, hi) that holds a latitude; null outside all."""
    out = None
    for i, (lo, hi, *_) in enumerate(bands):
        inside = (_c(lat) >= float(lo)) & (_c(lat) < float(hi))
        out = F.when(inside, i) if out is None else out.when(inside, i)
    return out


def ring_edges(ring: Column) -> Column:
    """A ring of points (x, y), closed or not, as array<struct<x1, y1, x2, y2>>."""
    nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, nxt, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def on_edge(x, y, edges: Column) -> Column:
    x, y = _c(x), _c(y)

    def hit(e: Column) -> Column:
        cross = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        spans = (x >= F.least(e["x1"], e["x2"])) & (x <= F.greatest(e["x1"], e["x2"])) & (y >= F.least(e["y1"], e["y2"])) & (y <= F.greatest(e["y1"], e["y2"]))
        return (cross == 0.0) & spans

    return F.exists(edges, hit)


def within(x, y, edges: Column) -> Column:
    """Even-odd rule over the edges of all rings, holes included; points on an edge are outside."""
    x, y = _c(x), _c(y)

    def flip(odd: Column, e: Column) -> Column:
        crosses = (e["y1"] > y) != (e["y2"] > y)
        return odd != (crosses & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.when(crosses, e["y2"] - e["y1"]).otherwise(1.0) + e["x1"]))

    return F.aggregate(edges, F.lit(False), flip) & ~on_edge(x, y, edges)
