"""Tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names. Where it is unset: a folder below the warehouse, or, when
    driver and executors are one process, a temporary one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        alone = sc.master == "local" or sc.master.startswith("local[")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomspan-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch")
        named = sc.getCheckpointDir()
    return named.rstrip("/")


class Scratch:
    """Parquet tables of one job below the shared folder. Returned DataFrames read them lazily, so they stay until
    they are dropped or the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.base)
        files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(at)
        files.deleteOnExit(at)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for name in names:
            at = hadoop(self.path(name))
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return Scratch(spark, name).path("table")
