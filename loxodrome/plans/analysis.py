"""The whole analysis: every stage's table, computed from a feature matrix and two catalogues."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loxodrome.config import Grid
from loxodrome.operators import asymmetry, clustering, hypotheses, models, rates, resample
from loxodrome.operators.grid import assign_power, base_grid
from loxodrome.sources import sinks

log = logging.getLogger(__name__)


def run(fm: DataFrame, points: DataFrame, power_points: DataFrame | None = None, fast: bool = False, grid: Grid = Grid()) -> dict:
    """All stages in order; the last two, on intensity and validation, may fail without the others."""
    sims, boots, reps = (99, 200, 50) if fast else (199, 500, 100)
    fm = fm.cache()
    curves, summary = clustering.spatial_stats(points, sims=sims)
    out = {
        "leakage": models.leakage_audit(fm),
        "ablation": models.ablation(fm),
        "enrichment": rates.enrichment(fm),
        "spatial_stats": curves,
        "spatial_summary": summary,
        "asymmetry": asymmetry.asymmetry(points, boots),
        "coverage": rates.coverage(fm),
        "hypotheses": hypotheses.compare(fm),
        "stability": resample.jackknife(fm, points, replicates=reps, grid=grid),
    }

    def intensity() -> None:
        cells = assign_power(base_grid(fm.sparkSession, grid), power_points, grid).cache()
        out["power"] = rates.power_suite(fm, cells)
        out["regression"] = models.power_regression(fm, cells)

    def validation() -> None:
        out["validation"] = models.validate(fm)

    for name, stage in (("intensity", intensity), ("validation", validation)):
        if name == "intensity" and power_points is None:
            continue
        try:
            stage()
        except ValueError as e:
            log.warning("%s skipped: %s", name, e)
    return out


def headline(results: dict) -> dict:
    """The few numbers of a console summary."""
    best = results["coverage"].agg(F.max_by("lat_band", "rate_ratio").alias("b")).first()["b"]
    return {
        "suspected_leakage": [r["feature"] for r in results["leakage"].filter("suspected_leakage").collect()],
        "enriched_units": [r["unit"] for r in results["enrichment"].filter("significant").collect()],
        "clustered": results["spatial_summary"]["clustered_at_small_radii"],
        "largest_coverage_bias": best,
        "best_template": results["hypotheses"].first()["template"],
    }


def save(results: dict, folder: str) -> None:
    """Tables as CSV, curves as Parquet, nested results as JSON."""
    spark = results["enrichment"].sparkSession
    for name, value in results.items():
        if name == "spatial_stats":
            sinks.parquet(value, f"{folder}/{name}.parquet")
        elif isinstance(value, DataFrame):
            sinks.csv(value, f"{folder}/{name}.csv", single=True)
        elif isinstance(value, dict) and value and all(isinstance(v, DataFrame) for v in value.values()):
            sinks.suite(value, f"{folder}/{name}")
        else:
            sinks.json_file(spark, value, f"{folder}/{name}.json")
