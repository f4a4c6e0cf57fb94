"""Intermediate tables in the shared folder: they cut lineage, survive lost executors, and leave small plans to what follows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only a local master without one gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = f"file://{tempfile.mkdtemp(prefix='loxodrome-')}"
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def saved(df: DataFrame) -> DataFrame:
    """``df`` written once and read back. The files go when the application ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/lx-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
