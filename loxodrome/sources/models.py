"""A registry of flux models: generated ones, and grids in files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loxodrome.sources import tables


@dataclass(frozen=True)
class FluxModel:
    description: str
    reference: str
    status: str  # available or not_available, as published, whether or not a file is there
    format: str  # csv, generated or geotiff
    path: str | None = None


REGISTRY: dict[str, FluxModel] = {
    "synthetic_proxy": FluxModel("Analytic proxy cos²(lon)·cos²(lat) + 0.3·sin²(lat), without calibration; a placeholder for development", "None: formula", "available", "csv", "data/flux/synthetic_proxy.csv"),
    "uniform": FluxModel("Spatially uniform null, flux 1 everywhere, which any structured model should beat", "None: generated", "available", "generated"),
    "M3": FluxModel("Asthenosphere-dominated dissipation with maxima at the sub- and anti-planet points of the equator", "Segatz et al. (1988), Icarus 75, 187-206", "not_available", "csv", "data/flux/M3.csv"),
    "M4": FluxModel("Deep-mantle-dominated dissipation with maxima at the poles", "Segatz et al. (1988), Icarus 75, 187-206", "not_available", "csv", "data/flux/M4.csv"),
}


def available(spark: SparkSession, registry=REGISTRY) -> list[str]:
    return [n for n, m in registry.items() if m.status == "available" and (m.path is None or tables.exists(spark, m.path))]


def listing(spark: SparkSession, registry=REGISTRY) -> DataFrame:
    rows = [(n, m.status, m.path is not None and tables.exists(spark, m.path), m.path or "(generated)", m.description[:80] + "...", m.reference[:60] + "...") for n, m in registry.items()]
    return spark.createDataFrame(rows, "name string, status string, file_exists boolean, path string, description string, reference string")


def load(spark: SparkSession, name: str, registry=REGISTRY, resolution: float = 1.0) -> DataFrame:
    """``longitude, latitude, flux_w_m2, model_name, provenance``; files but the proxy's are aligned to the grid."""
    if name not in registry:
        raise KeyError(f"unknown flux model '{name}'; known: {', '.join(registry)}")
    m = registry[name]
    if m.format == "geotiff":
        raise NotImplementedError("GeoTIFF grids aren't read; convert them to CSV")
    if m.format == "generated":
        d = tables.uniform_flux(spark, resolution)
    elif name == "synthetic_proxy":
        d = tables.flux_csv(spark, m.path)
    else:
        d = tables.align_to_grid(tables.flux_csv(spark, m.path).dropna(subset=["longitude", "latitude", "flux_w_m2"]), spark, resolution)
    return d.select("longitude", "latitude", "flux_w_m2").withColumns({"model_name": F.lit(name), "provenance": F.lit(m.path or "generated")})
