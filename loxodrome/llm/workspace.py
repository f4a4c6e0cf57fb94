"""Shared scratch space: intermediate tables cut lineage and survive the loss of executors.

The folder is the one that the cluster names in ``spark.checkpoint.dir``. Only where that is unset and the master
is local (tests, a laptop) a temporary folder is made and set; on a cluster a folder must be named, as a folder
of the driver's own machine would hold a part of each table only.

An operator's folders go when the application ends; tables that nothing reads any more go by :meth:`Workspace.drop`.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
        path = f"file://{tempfile.mkdtemp(prefix='loxodrome-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Workspace:
    """A folder of its own under the shared folder. Tables written here are read back with a flat plan."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/lx-{uuid.uuid4().hex}"
        self._n = 0
        self.saved: list[DataFrame] = []
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = self._fs(path)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _fs(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lx_path = path
        self.saved.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of :meth:`save` that nothing reads any more."""
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._lx_path)
            self._fs(path).delete(path, True)
