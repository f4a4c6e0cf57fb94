"""Writers. Tables stay distributed as Parquet; results of a few rows may go to one CSV or JSON file."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession


#: Rows of a table inside a JSON result; larger ones raise.
MAX_JSON_ROWS = 10_000


def parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return path


def csv(df: DataFrame, path: str, single: bool = False) -> str:
    """With a header; ``single`` for result tables that fit one task."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)
    return path


def _plain(v):
    if isinstance(v, DataFrame):
        rows = v.limit(MAX_JSON_ROWS + 1).collect()
        if len(rows) > MAX_JSON_ROWS:
            raise ValueError(f"a table of more than {MAX_JSON_ROWS} rows doesn't go into one JSON file; write it as Parquet")
        return [_plain(r.asDict(recursive=True)) for r in rows]
    if isinstance(v, dict):
        return {str(k): _plain(x) for k, x in v.items()}
    if isinstance(v, list | tuple):
        return [_plain(x) for x in v]
    if hasattr(v, "tolist"):
        return _plain(v.tolist())
    return None if isinstance(v, float) and not math.isfinite(v) else v


def json_file(spark: SparkSession, value: dict, path: str) -> str:
    """A nested result as indented JSON, written through Spark's file system; NaN becomes null."""
    return text_file(spark, json.dumps(_plain(value), indent=2, ensure_ascii=False, default=str), path)


def text_file(spark: SparkSession, text: str, path: str) -> str:
    """One file, through Spark's file system, so that it may lie wherever tables do."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    return path


def read_text(spark: SparkSession, path: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    source = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def suite(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """Each table of a suite as a CSV of its own."""
    return [csv(df, f"{folder}/{name}.csv", single=True) for name, df in tables.items()]
