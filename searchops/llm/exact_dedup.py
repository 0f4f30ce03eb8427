"""Exact dedup: a tree-merge of sorted digest runs.

Every partition sorts its (digest, doc_id) pairs into one *run*. Partitions then exchange runs in
binomial rounds: run ``i`` of a round joins run ``i >> levels``, so ``2**levels`` runs meet in a
multiway merge, until one run is left. A run is dealt over tasks by digest, never gathered whole,
and after each merge holds one entry per digest, so a text with a third of all copies is at most
one entry per run. Merged entries are verified: equal SHA-256 digests must agree in length and in
an independent 64-bit hash, or the job stops.

Defined results: a null text is the empty text; rows of equal text keep the smallest
(doc_id, row) with null ids last, so of repeated rows exactly one is kept; a table without
rows gives none; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import keep

RUN = "run long, digest binary, length long, other long, doc_id long, row long, copies long"
_RUN = pa.schema([("run", pa.int64()), ("digest", pa.binary()), *((c, pa.int64()) for c in ("length", "other", "doc_id", "row", "copies"))])
LEVELS = 4  # binomial rounds done by one multiway merge


def normalised(text):
    """The text column with each run of blanks as one space, null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, row (a number of the input row), digest, length and a second hash of each text."""
    text = normalised(F.col("text"))
    return (
        docs.select(F.col("doc_id").cast("long"), text.alias("text"))
        .select(
            "doc_id",
            F.monotonically_increasing_id().alias("row"),
            F.unhex(F.sha2("text", 256)).alias("digest"),
            F.length("text").cast("long").alias("length"),
            F.xxhash64("text").alias("other"),
        )
    )


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold rows sorted by (run, digest, doc_id) to one entry per run and digest, across batches."""
    left = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]).cast(_RUN)
        rows = rows if left is None else pa.concat_tables([left, rows])
        digest = np.frombuffer(b"".join(rows["digest"].to_pylist()), np.uint64).reshape(-1, 4)
        same = rows["run"].to_numpy()[1:] == rows["run"].to_numpy()[:-1]
        same &= (digest[1:] == digest[:-1]).all(1)
        for check in ("length", "other"):
            x = rows[check].to_numpy()
            if (same & (x[1:] != x[:-1])).any():
                raise ValueError("two texts of one digest differ")
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        copies = np.add.reduceat(rows["copies"].to_numpy(), first)
        rows = rows.take(pa.array(first)).set_column(6, _RUN.field("copies"), pa.array(copies, pa.int64()))
        left = rows.slice(rows.num_rows - 1)
        yield from rows.slice(0, rows.num_rows - 1).combine_chunks().to_batches()
    if left is not None:
        yield from left.combine_chunks().to_batches()


def tree_merge(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """One entry per digest: the smallest (doc_id, row) and the number of copies."""
    order = ["run", "digest", F.col("doc_id").asc_nulls_last(), "row"]
    runs = rows.select(
        F.spark_partition_id().cast("long").alias("run"), "digest", "length", "other", "doc_id", "row", F.lit(1).cast("long").alias("copies")
    )
    runs = keep(runs.sortWithinPartitions(*order).mapInArrow(_fold, RUN), "runs")
    last = runs.agg(F.max("run")).first()[0] or 0
    while last > 0:
        met = runs.withColumn("run", F.shiftright("run", levels)).repartition("run", "digest")
        runs = keep(met.sortWithinPartitions(*order).mapInArrow(_fold, RUN), "runs")
        last >>= levels
    return runs


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, row, keep_id, group_size, kept, text_sha256."""
    rows = keep(digests(docs), "digests")
    best = tree_merge(rows).select(
        "digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("copies").alias("group_size")
    )
    return rows.join(best, "digest").select(
        "doc_id",
        "row",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
