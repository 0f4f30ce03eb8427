"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    crf_language,
    decontaminate,
    exact_dedup,
    license_scan,
    near_dedup,
    periodic_runs,
    prefix_trie,
    pu_quality,
    secret_scan,
    sentencepiece_codec,
    subword_toxicity,
    token_counts,
    twins,
    url_filter,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword_toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), 85)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_places(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf_language.languages(_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents")).drop("row")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secrets(_table(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, secret_scan.KINDS), F.sha2(text("base"), 256).alias("base_sha256"), text("all").alias("spans"), "n_layers", "n_refused")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").selectExpr("cast(doc_id as bigint) doc_id", "text")
    return sentencepiece_codec.transcode(docs).select("doc_id", "ids", F.size("ids").alias("n_ids"), "round_trip")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"), conv - conv % 20, prefix_trie.shared_beginnings).drop("key")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text in which every tenth document by crc32 repeats a stretch of its own words from some place on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    rows = rows.withColumn("a", F.when(n > 0, g % n).cast("int")).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    at = lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")))
    repeated = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), at), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(planted(_table(spark, sf_dir, "documents")))
    better = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    first = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)), lambda a, b: F.when(better(b, a), b).otherwise(a))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), first.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.floor(1000 * F.col("best.length") / F.col("best.period"))
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: Host, path and verdict of the rules.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed besides the rules: the URLs of pages whose number is labelled toxic."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    toxic = _table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("page_id"))
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.verdicts(pages, rules, pages.join(toxic, "page_id", "left_semi").select("url"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_toxicity, op2_decontamination, op3_token_counts, op4_near_dedup, op5_license_scan,
        op6_language_id, op7_exact_dedup, op8_quality, op9_secret_scan, op10_sentencepiece, op11_prefix_trie, op12_periodic_runs, op13_url_filter, pipeline,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": twins.EXACT_DEDUP, "op11_prefix_trie": twins.PREFIX_TRIE, "op13_url_filter": twins.url_filter(URL_RULES)}
