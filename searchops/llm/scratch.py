"""Tables that cut lineage: written once to the folder every executor shares, then read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDER = "spark.checkpoint.dir"
#: Spark's setting to remove a query's shuffle files at its end: a table that is written needs them no more.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where that is unset and all runs on one machine."""
    path = spark.conf.get(_FOLDER, None) or spark.sparkContext.getConf().get(_FOLDER)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_FOLDER} to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(_FOLDER, path)
    return path.rstrip("/")


class Tables:
    """Tables of one job by name. A table that is no longer read can be removed, so disk holds one round and not all."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/searchops/{job}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def write(self, df: DataFrame, name: str) -> None:
        """Write ``df``. A lost executor costs only its running tasks; the query's shuffle files go when it has ended."""
        before = self.spark.conf.get(_CLEAN, "false")
        self.spark.conf.set(_CLEAN, "true")
        try:
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            self.spark.conf.set(_CLEAN, before)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the table read back."""
        self.write(df, name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def remove(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def keep(df: DataFrame, name: str) -> DataFrame:
    """A table of a job of its own."""
    return Tables(df.sparkSession, name).keep(df, "rows")
