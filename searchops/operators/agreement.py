"""How well an engine's scores agree with labels: rank correlation with ties, and false alarms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def centred_ranks(counts: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """g, v, r of counts(g, v, n), n rows of each distinct value of a group: the mean rank of the value, less the mean of all ranks.

    The values are dealt in ranges; each range is numbered from within, and the ranges of a group, no more than there are
    partitions, are added up before it. So no task holds a whole group. ``keep`` writes the ranges, as their numbers must not
    change between the two readings.
    """
    ranges = keep(counts.repartitionByRange("g", "v").withColumn("part", F.spark_partition_id()))
    sums = ranges.groupBy("g", "part").agg(F.sum("n").alias("n"))
    group = Window.partitionBy("g")
    earlier = F.coalesce(F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("g", "part", earlier.alias("offset"), F.sum("n").over(group).alias("total"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("g", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = ranges.withColumn("before", before).join(sums, ["g", "part"])
    return rows.select("g", "v", (F.col("offset") + F.col("before") + (F.col("n") - F.col("total")) / 2).alias("r"))


def rank_correlation(rows: DataFrame, by: list[str], x: str, y: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """by.., n, rank_correlation (Spearman's, ties with their mean rank, to six places) of the rows in which both columns are there.

    Null where a column has one value only. A null group is a group; NaN is a value above all others. Equal pairs are counted
    before anything is ranked or joined, so a tie that holds a third of all rows is as many rows as it has distinct partners.
    """
    g = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(1).alias("one"))
    pairs = keep(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(g.alias("g"), F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n")))
    ranks = lambda c: centred_ranks(pairs.groupBy("g", F.col(c).alias("v")).agg(F.sum("n").alias("n")), keep).select("g", F.col("v").alias(c), F.col("r").alias(f"r{c}"))
    met = pairs.join(ranks("x"), ["g", "x"]).join(ranks("y"), ["g", "y"])
    total = lambda c: F.sum(F.col("n") * c)
    got = met.groupBy("g").agg(F.sum("n").alias("n"), total(F.col("rx") * F.col("rx")).alias("xx"), total(F.col("ry") * F.col("ry")).alias("yy"), total(F.col("rx") * F.col("ry")).alias("xy"))
    rho = F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.round(F.col("xy") / F.sqrt("xx") / F.sqrt("yy"), 6))
    return got.select(*(F.col("g")[c].alias(c) for c in by), "n", rho.alias("rank_correlation"))


def false_positive_rate(said: DataFrame, negatives: DataFrame, keys: list[str]) -> DataFrame:
    """engine, negatives, false_positives, false_positive_rate: of the items that are known to be clean, the share of which an engine
    said otherwise. keys begin with the engine; repeated items count once, those with a null key not at all."""
    hit = said.select(*keys).distinct().withColumn("hit", F.lit(1))
    clean = negatives.select(*keys).dropna().distinct().join(hit, keys, "left")
    got = clean.groupBy(keys[0]).agg(F.count("*").alias("negatives"), F.count("hit").alias("false_positives"))
    return got.withColumn("false_positive_rate", F.round(F.col("false_positives") / F.col("negatives"), 4))
