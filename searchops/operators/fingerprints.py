"""Content fingerprints: 64-bit simhash over three-word shingles, distance, and the delta between crawls.

A fingerprint is made of one text in one map: nothing is exploded or shuffled for it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.batches import sliced

#: Bits of a fingerprint, words of a shingle, and the distance beyond which a page has changed.
BITS, WORDS, SAME = 64, 3, 3
TOKEN = r"([a-z0-9']+)"
_TOKENS = re.compile(TOKEN)


def _simhash(text: str, digest: Callable[[bytes], bytes]) -> str:
    """Each shingle votes with the 64 bits of its hash; a bit is set if more than half of the shingles have it."""
    w = _TOKENS.findall(text.lower())
    s = w if len(w) < WORDS else map(" ".join, zip(*(w[k:] for k in range(WORDS)), strict=False))
    votes = np.frombuffer(b"".join(digest(x.encode())[: BITS // 8] for x in s), np.uint8).reshape(-1, BITS // 8)
    return np.packbits(2 * np.unpackbits(votes, axis=1).sum(0) > len(votes)).tobytes().hex()


@F.arrow_udf(StringType())
def simhash(texts: pa.Array) -> pa.Array:
    """The fingerprint (16 hex digits) with votes of the first 64 bits of MD5; null, as a text without words, has none of the bits."""
    md5 = lambda x: hashlib.md5(x, usedforsecurity=False).digest()
    return pa.concat_arrays(list(sliced(texts, lambda s: pa.array([_simhash(t or "", md5) for t in s], pa.string()))))


@F.arrow_udf(StringType())
def simhash_blake2b(texts: pa.Array) -> pa.Array:
    """The fingerprint with votes of 8-byte BLAKE2b hashes, for comparison with stored ones; null gives null."""
    blake = lambda x: hashlib.blake2b(x, digest_size=8).digest()
    return pa.concat_arrays(list(sliced(texts, lambda s: pa.array([None if t is None else _simhash(t, blake) for t in s], pa.string()))))


def distance(a: Column, b: Column) -> Column:
    """Differing bits of two fingerprints."""
    value = lambda c: F.conv(c, 16, -10).cast("long")
    return F.bit_count(value(a).bitwiseXOR(value(b)))


def changed(old: Column, new: Column) -> Column:
    return F.coalesce(F.nullif(old, F.lit("")).isNull(), F.lit(True)) | (distance(old, new) > SAME)


def latest(snapshots: DataFrame) -> DataFrame:
    """Of snapshots(url_hash, fingerprint, fetched_at) the last fingerprint of each URL."""
    return snapshots.groupBy("url_hash").agg(F.max_by("fingerprint", F.struct("fetched_at", "fingerprint")).alias("old_fingerprint"))


def delta(pages: DataFrame, snapshots: DataFrame) -> DataFrame:
    """pages(url_hash, fingerprint, ...) with ``old_fingerprint`` and ``changed`` against the last snapshot of the URL."""
    both = pages.join(latest(snapshots), "url_hash", "left")
    return both.withColumn("changed", changed(F.col("old_fingerprint"), F.col("fingerprint")))


def new_snapshots(fetched: DataFrame, snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """Content-addressed append: the changed rows of ``fetched`` whose keys (as content hash and tenant) no snapshot has;
    one row for each key."""
    return fetched.where("changed").dropDuplicates(keys).join(snapshots.select(*keys), keys, "left_anti")


def crawl_counters(fetches: DataFrame, run: str) -> DataFrame:
    """Per run: fetched, blocked, errors, changed, unchanged of fetches(run, blocked, status, changed)."""
    ok = ~F.col("blocked") & (F.col("status") < 400)
    return fetches.groupBy(run).agg(
        F.count_if(ok).alias("fetched"),
        F.count_if("blocked").alias("blocked"),
        F.count_if(~F.col("blocked") & (F.col("status") >= 400)).alias("errors"),
        F.count_if(ok & F.col("changed")).alias("changed"),
        F.count_if(ok & ~F.col("changed")).alias("unchanged"),
    )
