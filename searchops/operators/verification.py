"""Verification of changes on live pages, and what differs from the page before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields whose change is recorded.
FIELDS = ("title", "meta_description", "canonical", "h1", "robots_meta")


def _bare(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), "/+$", "")


def _wanted(name: str) -> Column:
    return F.try_element_at("expect", F.lit(name))


def canonical() -> Column:
    return _bare(F.col("canonical")) == _bare(F.coalesce(F.nullif(_wanted("canonical"), F.lit("")), F.col("final_url")))


def metadata() -> Column:
    """Every expected one of title, description and first h1 is there."""
    ok = F.lit(True)
    for name in ("title", "meta_description", "h1"):
        got = F.get("h1", 0) if name == "h1" else F.col(name)
        ok = ok & (_wanted(name).isNull() | (F.trim(F.coalesce(got, F.lit(""))) == F.trim(_wanted(name))))
    return ok


def internal_link() -> Column:
    return F.exists("internal_links", lambda u: _bare(u) == _bare(_wanted("target")))


def schema() -> Column:
    kinds = F.transform("schema_blocks", lambda b: F.lower(F.coalesce(F.get_json_object(b, "$['@type']"), F.lit(""))))
    want = F.lower(F.coalesce(_wanted("type"), F.lit("")))
    return (F.size("schema_blocks") > 0) & ((want == "") | F.array_contains(kinds, want))


def redirect() -> Column:
    return (_bare(F.col("final_url")) == _bare(_wanted("to"))) & (F.size("redirect_chain") >= 1)


def noindex_removed() -> Column:
    return ~F.coalesce(F.col("robots_meta"), F.lit("")).contains("noindex")


#: Verifiers by name; a caller may pass more.
VERIFIERS: dict[str, Callable[[], Column]] = {
    "canonical_change": canonical,
    "metadata_change": metadata,
    "internal_link_added": internal_link,
    "schema_change": schema,
    "redirect_added": redirect,
    "content_change": metadata,
    "noindex_removed": noindex_removed,
}


def verify(changes: DataFrame, live: DataFrame, verifiers: dict[str, Callable[[], Column]] = VERIFIERS, keys: tuple[str, ...] = ("url",)) -> DataFrame:
    """changes(change_id, url, verifier, expect map) with ``passed`` on the page of the URL in ``live`` (page facts); an unknown
    verifier and a page that is not there fail. Where several pages have one URL, ``keys`` of both tables name the page."""
    pages = live.select(*keys, "final_url", "title", "meta_description", "canonical", "h1", "robots_meta", "internal_links", "schema_blocks", "redirect_chain")
    rows = changes.join(pages, list(keys), "left")
    passed = F.lit(False)
    for name, rule in verifiers.items():
        passed = F.when(F.col("verifier") == name, rule()).otherwise(passed)
    seen = F.col("final_url").isNotNull()
    return rows.select("change_id", "url", "verifier", F.coalesce(seen & passed, F.lit(False)).alias("passed"), F.col("verifier").isin(*verifiers).alias("known"))


def differences(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("url",)) -> DataFrame:
    """The keys and changed: a map of the changed fields to (before, after), of pages in both tables. ``keys`` name a page: the URL,
    where no two pages have the same."""
    first = lambda name: F.get("h1", 0) if name == "h1" else F.col(name)
    side = lambda df, tag: df.select(*keys, F.struct(*(first(n).alias(n) for n in FIELDS)).alias(tag))
    both = side(before, "b").join(side(after, "a"), list(keys))
    pairs = F.array(*(F.struct(F.lit(n).alias("key"), F.struct(F.col(f"b.{n}").alias("before"), F.col(f"a.{n}").alias("after")).alias("value")) for n in FIELDS))
    return both.select(*keys, F.map_from_entries(F.filter(pairs, lambda p: ~p["value"]["before"].eqNullSafe(p["value"]["after"]))).alias("changed"))
