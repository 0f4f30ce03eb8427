"""Tables that live on from run to run in a folder: ledgers that batches add to, and keyed tables whose touched buckets are rewritten.

A batch writes under its own number and reads only what earlier numbers wrote to the end, so it can be run again after a failure.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Batches of a ledger that are merged into one.
COMPACT = 16


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _make(spark: SparkSession, path: str) -> None:
    """A folder, if it is not there."""
    fs, p = _fs(spark, path)
    fs.mkdirs(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _complete(spark: SparkSession, path: str, name: str, marker: str = "_SUCCESS") -> list[int]:
    """The numbers n of folders ``name=n`` under ``path`` that were written to the end."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    named = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n.split("=")[1]) for n in named if n.startswith(f"{name}=") and exists(spark, f"{path}/{n}/{marker}"))


class Ledger:
    """Rows that batches add, under their numbers. Whenever ``COMPACT`` batches lie side by side they are merged into one table."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def _parts(self, number: int | None) -> tuple[int, list[int]]:
        """The last merge and the batches after it, of those before ``number``."""
        before = lambda n: number is None or n < number
        base = max((n for n in _complete(self.spark, self.path, "upto") if before(n)), default=-1)
        return base, [n for n in _complete(self.spark, self.path, "batch") if n > base and before(n)]

    def last(self) -> int:
        base, batches = self._parts(None)
        return max([base, *batches])

    def read(self, number: int | None = None) -> DataFrame:
        """All rows, or those of batches before ``number``; no rows if there are none."""
        base, batches = self._parts(number)
        paths = [f"{self.path}/upto={base}"] * (base >= 0) + [f"{self.path}/batch={n}" for n in batches]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def add(self, rows: DataFrame, number: int, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
        """Write a batch. A merge keeps what ``keep`` leaves of the rows."""
        base, batches = self._parts(number)
        if len(batches) >= COMPACT:
            keep(self.read(number)).write.mode("overwrite").parquet(f"{self.path}/upto={batches[-1]}")
            for name, numbers in (("batch", batches), ("upto", [base])):
                for n in numbers:
                    remove(self.spark, f"{self.path}/{name}={n}")
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={number}")


class KeyedTable:
    """A table in buckets of its keys. A batch writes new versions of the buckets it touches, all others stay as they are; versions that
    newer ones replace are removed, but for the last one before the batch, from which it can be run again. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets

    def with_bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def batches(self) -> list[int]:
        return _complete(self.spark, self.path, "batch", "_DONE")

    def versions(self, before: int | None = None) -> dict[int, list[int]]:
        """The batches that wrote each bucket, in order."""
        found: dict[int, list[int]] = {}
        for n in self.batches():
            if before is None or n < before:
                fs, p = _fs(self.spark, f"{self.path}/batch={n}")
                for s in fs.listStatus(p):
                    if (name := s.getPath().getName()).startswith("bucket="):
                        found.setdefault(int(name.split("=")[1]), []).append(n)
        return found

    def read(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows of all or some buckets, as batches before a number left them; None if there are none."""
        paths = [f"{self.path}/batch={n[-1]}/bucket={b}" for b, n in self.versions(before).items() if buckets is None or b in buckets]
        paths = [p for p in paths if len(_fs(self.spark, p)[0].listStatus(_fs(self.spark, p)[1]))]  # a bucket can have lost all its rows
        return self.spark.read.parquet(*paths) if paths else None

    def merge(self, rows: DataFrame, step: Callable[[DataFrame | None, DataFrame], DataFrame], groups: DataFrame | None = None) -> DataFrame:
        """Fold a job's rows in as the next batch, and the table after it. A run that failed before its end left nothing that is read."""
        self.fold(rows, max(self.batches(), default=-1) + 1, step, groups)
        table = self.read()
        return rows.limit(0) if table is None else table

    def replace(self, rows: DataFrame, groups: DataFrame) -> DataFrame:
        """The table after all rows of ``groups`` (values of the keys, no others among ``rows``) have given way to ``rows``."""
        groups = groups.select(self.keys).distinct()
        step = lambda old, new: new if old is None else old.join(groups, self.keys, "left_anti").select(new.columns).unionByName(new)
        return self.merge(rows, step, groups)

    def fold(self, rows: DataFrame, number: int, step: Callable[[DataFrame | None, DataFrame], DataFrame], groups: DataFrame | None = None) -> None:
        """Replace the buckets of ``rows`` (or of ``groups``) by what ``step(their rows so far, rows)`` makes of them."""
        rows = self.with_bucket(rows).persist()
        named = rows if groups is None else self.with_bucket(groups)
        touched = [r[0] for r in named.select("bucket").distinct().collect()]  # at most ``buckets``
        if touched:
            out = self.with_bucket(step(self.read(number, touched), rows.drop("bucket")))
            at = f"{self.path}/batch={number}"
            out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(at)
            for b in touched:
                _make(self.spark, f"{at}/bucket={b}")
            _make(self.spark, f"{at}/_DONE")
        rows.unpersist()
        held = self.versions(number)
        for b, numbers in held.items():
            for n in numbers[:-1]:
                remove(self.spark, f"{self.path}/batch={n}/bucket={b}")
        in_use = {numbers[-1] for numbers in held.values()}
        for n in self.batches():
            if n < number and n not in in_use:
                remove(self.spark, f"{self.path}/batch={n}")
