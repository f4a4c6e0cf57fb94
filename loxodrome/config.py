"""Fixed parameters of the engine: the sphere, the grid, latitude bands, features and thresholds."""

from __future__ import annotations

from dataclasses import dataclass

RADIUS_KM = 1821.6


@dataclass(frozen=True)
class Grid:
    """A regular longitude-latitude grid; cells are numbered row by row from the south-west, longitude fastest."""

    resolution: float = 1.0
    lon_min: float = -180.0
    lon_max: float = 180.0
    lat_min: float = -90.0
    lat_max: float = 90.0

    @property
    def n_lon(self) -> int:
        return int((self.lon_max - self.lon_min) / self.resolution)

    @property
    def n_lat(self) -> int:
        return int((self.lat_max - self.lat_min) / self.resolution)

    @property
    def n_cells(self) -> int:
        return self.n_lon * self.n_lat


# Half-open latitude bands of spatial cross-validation.
CV_BANDS = ((-90.0, -45.0), (-45.0, 0.0), (0.0, 45.0), (45.0, 90.0))

# Labelled latitude bands of intensity summaries.
POWER_BANDS = (
    (-90.0, -60.0, "south polar"),
    (-60.0, -30.0, "south mid-latitude"),
    (-30.0, 0.0, "south low-latitude"),
    (0.0, 30.0, "north low-latitude"),
    (30.0, 60.0, "north mid-latitude"),
    (60.0, 90.0, "north polar"),
)

# Points (lat, lon) of greatest tidal stress; the last two are the poles.
STRESS_MAXIMA = ((0.0, 0.0), (0.0, 180.0), (90.0, 0.0), (-90.0, 0.0))

# Feature columns, those made from the target, those made from formulas.
FEATURES = ("tidal_heating_flux", "geology_encoded", "dist_nearest_hotspot_km", "dist_tidal_stress_max_km")
TARGET_DERIVED = ("dist_nearest_hotspot_km",)
ANALYTICAL = ("dist_tidal_stress_max_km", "tidal_heating_flux")

#: Units that count as not observed.
UNOBSERVED_UNITS = ("NoData", "UNKNOWN", "nan", "")

CORRELATION_LIMIT, COEFFICIENT_LIMIT = 0.6, 5.0
SEED = 42

#: Rows up to which the smaller side of a distance join is sent to every task; beyond, both sides are bucketed.
BROADCAST_ROWS = 20_000
