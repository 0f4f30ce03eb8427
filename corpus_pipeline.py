"""A corpus-cleaning pipeline: language ID, exact dedup, near dedup, decontamination, SentencePiece ids.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a DataFrame that is
written as Parquet and read again by the next. Stages drop rows by doc_id: the ids to drop are broadcast
up to a checked number and joined by shuffle beyond it. Rows without an id can't be named in
a decision and are kept; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchops.llm import crf_language, decontaminate, exact_dedup, near_dedup, sentencepiece_codec
from searchops.llm.scratch import keep

#: Ids sent to every executor at most (8 bytes each).
MAX_BROADCAST_IDS = 2_000_000


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    ids = keep(ids.select("doc_id").where("doc_id is not null").distinct(), "drop")
    return docs.join(F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids, "doc_id", "left_anti").select(docs.columns)


def _free(name: str, docs: DataFrame) -> str:
    """A column name like ``name`` that ``docs`` has not."""
    while name in docs.columns:
        name += "_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told, as they have no letter, go."""
    suffix = "_"
    while any(c.startswith("lang_") and c.endswith(suffix) for c in docs.columns):
        suffix += "_"
    return crf_language.with_language(docs, suffix=suffix).where(f"lang_shares{suffix} is not null").select(docs.columns)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays; of repeated rows one stays."""
    rows = keep(exact_dedup.exact_duplicates(docs).select("doc_id", "kept"), "decisions")
    by_id = rows.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.min("kept").alias("all_kept"))
    out = _without(docs, by_id.where("not kept"))
    repeated = by_id.where("kept and not all_kept and doc_id is not null").select("doc_id")
    if repeated.isEmpty():
        return out
    digest = _free("digest", docs)
    one = out.join(repeated, "doc_id", "left_semi").withColumn(digest, F.sha2(exact_dedup.normalised(F.col("text")), 256))
    return _without(out, repeated).unionByName(one.dropDuplicates(["doc_id", digest]).select(docs.columns))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays."""
    return _without(docs, near_dedup.near_duplicates(docs, 80).where("not kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontaminate.contaminated(docs, items))


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its ids, their number, and whether decoding them gives the text back."""
    rows = sentencepiece_codec.transcode(docs)
    return rows.select(*[c for c in docs.columns if c not in ("ids", "n_ids", "round_trip")], "ids", F.size("ids").alias("n_ids"), "round_trip")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece_ids),
]

ORACLE_SQL = None  # models and edit distances have no SQL; tests/llm/ holds the brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
