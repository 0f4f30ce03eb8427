"""Training samples that are bounded in documents and in bytes, whatever ids repeat and however long texts are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Tables


def first_of_each(rows: DataFrame, kind: str, most: int) -> DataFrame:
    """At most ``most`` rows of (doc_id, kind), of all kinds alike many as far as there are so many; those that come first by a
    hash of the id. Kinds are counted first, so that of a frequent kind only the lowest hashes, a fifth more than are wanted,
    meet in the task that ranks them. Of more kinds than ``most`` the most frequent are taken."""
    n = rows.groupBy(kind).agg(F.count("*").alias("n")).orderBy(F.desc("n"), kind).limit(most)
    low = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    some = rows.join(F.broadcast(n), kind).withColumn("low", low)  # at most ``most`` kinds
    some = some.where(F.col("low") < (1.2 * most + 100) / F.col("n") * (1 << 40)).drop("n")
    rank = F.row_number().over(Window.partitionBy(kind).orderBy("low", "doc_id"))
    return some.withColumn("k", rank).drop("low").where(F.col("k") <= most).orderBy("k", kind).limit(most)


def texts_of(docs: DataFrame, ids: DataFrame, most_bytes: int, tables: Tables) -> DataFrame:
    """The rows of ids(doc_id, k, ..), of which there are few, with the ``text`` of their document, in their order as long as the
    texts have at most ``most_bytes`` in all. Of rows that repeat an id the smallest text stands."""
    found = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    others = [c for c in ids.columns if c != "doc_id"]
    one = tables.keep(found.groupBy("doc_id", *others).agg(F.min("text").alias("text")), "sample")
    before = F.sum(F.octet_length("text")).over(Window.orderBy("k", *[c for c in others if c != "k"], "doc_id"))
    within = one.select("doc_id", before.alias("bytes")).where(F.col("bytes") <= most_bytes)  # numbers of the few ids only
    return one.join(F.broadcast(within.select("doc_id")), "doc_id")
