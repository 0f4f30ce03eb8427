"""URL columns: parts, normal form, registrable-ish domain, path, resolution of links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)"


def scheme(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 1)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, PARTS, 2))


def path(url: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(url, PARTS, 3), F.lit("")), F.lit("/"))


def normal(url: Column) -> Column:
    """scheme://host/path without trailing slashes (but "/" alone), query and fragment."""
    return F.concat(scheme(url), F.lit("://"), host(url), F.coalesce(F.nullif(F.regexp_replace(F.regexp_extract(url, PARTS, 3), "/+$", ""), F.lit("")), F.lit("/")))


def domain(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def host_name(url: Column) -> Column:
    """The host alone, without user, port and a leading "www."; what domains of brands and rivals are compared with."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host(url), "^.*@", ""), ":[0-9]*$", ""), r"^www\.", "")


def url_hash(url: Column) -> Column:
    """SHA-256 of the normal form, a question mark and the query."""
    return F.sha2(F.concat(normal(url), F.lit("?"), F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)), 256)


def same_site(a: Column, b: Column) -> Column:
    return domain(a) == domain(b)


def without_dots(url: Column) -> Column:
    """The URL without the path segments '.' and '..', as RFC 3986 takes them away."""
    segments = F.split(F.regexp_extract(url, PARTS, 3), "/")
    kept = F.aggregate(
        F.slice(segments, F.lit(2), F.size(segments)),
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.concat(done, F.array(s))),
    )
    end = F.when(F.element_at(segments, -1).isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    clean = F.concat(F.regexp_extract(url, "^([^:]*://[^/?#]*)", 1), F.lit("/"), F.array_join(kept, "/"), end, F.regexp_extract(url, r"([?#].*)$", 1))
    return F.when(F.regexp_extract(url, PARTS, 3).rlike(r"/\.\.?(/|$)"), clean).otherwise(url)


def join(link: Column, base: Column) -> Column:
    """The link as an absolute URL."""
    root = F.concat(scheme(base), F.lit("://"), F.regexp_extract(base, PARTS, 2))
    own_path = F.regexp_extract(base, PARTS, 3)
    folder = F.coalesce(F.nullif(F.regexp_replace(own_path, "[^/]*$", ""), F.lit("")), F.lit("/"))
    return without_dots(
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme(base), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(root, own_path, link))
        .when((link == "") | link.startswith("#"), F.concat(F.regexp_extract(base, "^[^#]*", 0), link))
        .otherwise(F.concat(root, folder, link))
    )


def target(link: Column, base: Column) -> Column:
    """The absolute http(s) URL of a link; null for links that lead to no page."""
    url = join(link, base)
    return F.when(~link.rlike("(?i)^(#|mailto:|tel:|javascript:|data:)") & url.rlike("(?i)^https?://"), url)


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def resolve(link: Column, base: Column) -> Column:
    """An absolute http(s) URL without fragment, or null for links that lead to no page."""
    return F.when(without_fragment(link) != "", without_fragment(target(link, base)))
