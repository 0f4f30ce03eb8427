"""Datasets: scoped reading, and tables that cut a plan between rounds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scoped(rows: DataFrame, tenant: str, project: str = "") -> DataFrame:
    """Rows of a tenant, and of one project if one is named."""
    rows = rows.where(F.col("tenant_id") == tenant)
    return rows.where(F.col("project_id") == project) if project else rows


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); one of our own only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def keeper(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """A function that writes a table to the shared folder and reads it back."""
    root = shared_root(spark)

    def keep(df: DataFrame) -> DataFrame:
        path = f"{root}/searchops/round-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep


def spread(rows: DataFrame) -> DataFrame:
    """A table that lies in fewer splits than there are cores, dealt to all of them; any larger table stays where it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def append_by_day(rows: DataFrame, path: str, at: str) -> None:
    """Append rows to a ledger that is partitioned by the day of ``at``."""
    rows.withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").parquet(path)
