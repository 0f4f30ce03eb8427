"""URL filters: a blocked Bloom filter in front of an exact hash join.

Listed are *rules* (a host with all its subdomains, and the start of a path) and *URLs* (whole canonical URLs to block). Each
becomes a key. The filter is a table of blocks of eight 32-bit words: a key sets one bit in each word of its block, Spark builds all
blocks with one ``bit_or`` by block. Its rows are bounded by ``MAX_BLOCKS``, whatever the list holds (a longer list only lets more
keys pass), so it is broadcast; a page's keys meet their block, the few that pass go to the exact join with the list, which removes
false positives. A rule's keys of a page are its host's endings and its path's starts of those lengths that the rules have.

Defined results: a null URL or one without ``://`` has an empty host and path and is allowed unless a rule or the list says otherwise;
of the rules that fit the longest wins (host and path together), of one rule with two verdicts ``block``; equal rows stay rows of
their own; a table without rows gives none; other columns than ``page_id`` and ``url`` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Tables

MAX_BLOCKS = 1 << 19  # of 32 bytes each
BITS_PER_KEY = 12
WORDS = 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, k)


def host(url: Column) -> Column:
    """What stands between ``://`` and the path, in small ASCII letters."""
    return F.translate(_part(url, 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return _part(url, 2)


def canonical(url: Column) -> Column:
    """Host without a default port, path without slashes at its end, the query's parts in order without ``utm_`` ones; no fragment."""
    parts = F.array_sort(F.filter(F.split(_part(url, 3), "&"), lambda p: (p != "") & ~p.startswith("utm_")))
    query = F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise("")
    return F.concat(F.regexp_replace(host(url), ":(80|443)$", ""), F.regexp_replace(path(url), "/+$", ""), query)


def _rule_key(host_: Column, path_: Column) -> Column:
    return F.concat(F.lit("r"), host_, path_)


def _url_key(url: Column) -> Column:
    return F.concat(F.lit("u"), canonical(url))


def _place(key: Column, blocks: int) -> list[Column]:
    """The block of a key and its bit in each word."""
    bits = F.xxhash64(F.lit(1), key)
    bit = lambda j: F.call_function("shiftleft", F.lit(1), F.shiftright(bits, 5 * j).bitwiseAND(31).cast("int"))
    return [F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), *(bit(j).alias(f"b{j}") for j in range(WORDS))]


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """block, w0 .. w7 of the blocks that hold any of keys(key)."""
    rows = keys.select(*_place(F.col("key"), blocks))
    return rows.groupBy("block").agg(*(F.bit_or(f"b{j}").alias(f"w{j}") for j in range(WORDS)))


def n_blocks(n_keys: int) -> int:
    blocks = 1
    while blocks < MAX_BLOCKS and blocks * WORDS * 32 < n_keys * BITS_PER_KEY:
        blocks *= 2
    return blocks


def possible(rows: DataFrame, blooms: DataFrame, blocks: int) -> DataFrame:
    """The rows(key, ..) whose key may be listed."""
    met = rows.select("*", *_place(F.col("key"), blocks)).join(F.broadcast(blooms), "block")  # at most MAX_BLOCKS rows
    hit = F.lit(True)
    for j in range(WORDS):
        hit = hit & (F.col(f"w{j}").bitwiseAND(F.col(f"b{j}")) != 0)
    return met.where(hit).select(rows.columns)


def _page_keys(rules: DataFrame) -> Column:
    """The keys that rules could have of a row(host, path): as many labels of the host, as many characters of the path as any rule."""
    labels = sorted(r[0] for r in rules.select(F.size(F.split("host", r"\."))).distinct().collect())  # numbers up to the longest rule
    starts = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    of_host, of_path = F.split("host", r"\."), F.col("path")
    hosts = F.transform(
        F.filter(F.array(*map(F.lit, labels)), lambda k: k <= F.size(of_host)),
        lambda k: F.array_join(F.slice(of_host, F.size(of_host) - k + 1, k), "."),
    )
    lengths = F.filter(F.array(*map(F.lit, starts)), lambda k: k <= F.length(of_path))
    return F.flatten(F.transform(hosts, lambda h: F.transform(lengths, lambda k: _rule_key(h, of_path.substr(F.lit(1), k)))))


def verdicts(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule, listed, verdict of pages(page_id, url) by rules(host, path, verdict) and listed(url) ones to block."""
    tables = Tables(pages.sparkSession, "urls")
    rules = rules.select("host", "path", "verdict").distinct()
    rule_rows = rules.select(_rule_key(F.col("host"), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"), "verdict")
    url_rows = listed.select(_url_key(F.col("url")).alias("key"), F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"))
    keys = tables.keep(rule_rows.unionByName(url_rows.distinct()), "keys")
    blocks = n_blocks(keys.count())
    blooms = tables.keep(bloom(keys, blocks), "bloom")

    url = F.col("url")
    rows = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", host(url).alias("host"), path(url).alias("path"), _url_key(url).alias("own"))
    rows = tables.keep(rows, "rows")  # so that the row numbers stand, whichever task is run again
    asked = F.array(F.col("own")) if rules.isEmpty() else F.concat(F.array("own"), _page_keys(rules))
    asked = rows.select("row", F.explode(asked).alias("key"))
    found = possible(asked, blooms, blocks).join(keys, "key")
    best = found.groupBy("row").agg(
        F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), F.col("rule").alias("rule"), F.col("verdict").alias("verdict")))).alias("best"),
        F.bool_or(F.col("rule").isNull()).alias("listed"),
    )
    is_listed = F.coalesce("listed", F.lit(False))
    return rows.join(best, "row", "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), is_listed.alias("listed"),
        F.coalesce("best.verdict", F.when(is_listed, "block").otherwise("allow")).alias("verdict"),
    )
