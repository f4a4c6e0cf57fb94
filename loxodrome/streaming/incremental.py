"""An extension: point tables that grow. Streams keep per-cell sums, or count events in windows of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loxodrome.config import Grid
from loxodrome.operators.grid import cell_of


def cell_power(points: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """Count, largest and summed power per cell, of a stream or a table of points."""
    p = points.filter("longitude is not null and latitude is not null and power_gw > 0")
    return p.groupBy(cell_of("longitude", "latitude", grid).alias("cell_id")).agg(F.count(F.lit(1)).alias("power_count"), F.max("power_gw").alias("primary_power_gw"), F.sum("power_gw").alias("sum_power_gw"))


def start_cell_power(points: DataFrame, path: str, checkpoint: str, grid: Grid = Grid()) -> StreamingQuery:
    """Writes each micro-batch's per-cell sums under its number, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        cell_power(batch, grid).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(parts: DataFrame) -> DataFrame:
    """Per-cell sums over all batches."""
    return parts.groupBy("cell_id").agg(F.sum("power_count").alias("power_count"), F.max("primary_power_gw").alias("primary_power_gw"), F.sum("sum_power_gw").alias("sum_power_gw"))


def windowed_counts(events: DataFrame, time: str, kind: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``window_start, kind, n, total`` per tumbling window; on streams events later than ``late`` are left out."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    d = timed.withWatermark(time, late) if events.isStreaming else timed
    d = d.groupBy(F.window(time, window).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return d.select(F.col("w.start").alias("window_start"), kind, "n", "total")
