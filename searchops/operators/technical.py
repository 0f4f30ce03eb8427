"""Page facts, technical checks and link-graph checks over all sites at once.

The checks of a page are one array built in one pass over the facts; checks between pages are equi-joins on the
normal URL. In-degrees are aggregated before they are joined, so a hub page's links meet in
partial sums and not in one task. Callers with several uses of the facts write them once (sources.tables.keeper).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as hx
from ..functions import text as tx
from ..functions import urls as ux

#: Check code, category, severity.
CATALOG = (
    ("status_4xx", "indexability", "high"),
    ("status_5xx", "indexability", "critical"),
    ("noindex_on_indexable", "indexability", "high"),
    ("canonical_missing", "indexability", "medium"),
    ("canonical_not_self", "indexability", "high"),
    ("canonical_to_non200", "indexability", "high"),
    ("redirect_chain", "indexability", "medium"),
    ("soft_404", "indexability", "medium"),
    ("title_missing", "on_page", "high"),
    ("title_long", "on_page", "low"),
    ("title_short", "on_page", "low"),
    ("title_duplicate", "on_page", "medium"),
    ("meta_desc_missing", "on_page", "low"),
    ("h1_missing", "on_page", "medium"),
    ("h1_multiple", "on_page", "low"),
    ("thin_content", "on_page", "medium"),
    ("url_query_params", "urls", "low"),
    ("url_uppercase", "urls", "low"),
    ("url_too_long", "urls", "low"),
    ("faceted_nav", "urls", "medium"),
    ("img_missing_alt", "links", "low"),
    ("broken_internal_link", "links", "high"),
    ("orphan_page", "links", "medium"),
    ("schema_missing", "schema", "low"),
    ("schema_no_type", "schema", "low"),
    ("hreflang_no_self", "hreflang", "medium"),
    ("hreflang_to_non200", "hreflang", "high"),
    ("robots_no_sitemap", "crawlability", "low"),
    ("robots_unreachable", "crawlability", "high"),
    ("sitemap_empty", "crawlability", "high"),
    ("in_sitemap_not_crawlable", "crawlability", "medium"),
    ("crawled_not_in_sitemap", "crawlability", "low"),
    ("near_duplicate", "duplicates", "medium"),
    ("cwv_lcp_poor", "performance", "high"),
    ("cwv_inp_poor", "performance", "high"),
    ("cwv_cls_poor", "performance", "medium"),
    ("cwv_ttfb_poor", "performance", "medium"),
)
SEVERITIES = ("critical", "high", "medium", "low", "info")
FACET = r"[?&](color|size|sort|filter|price|brand|page|orderby)="
NOT_FOUND = r"\b(page not found|404|doesn'?t exist|no longer available)\b"
FINDING = ["site", "page_id", "check_code", "url", "url_pattern", "detail"]


def page_facts(pages: DataFrame) -> DataFrame:
    """Facts of landed pages(page_id, url, final_url, html, http_status, redirect_chain array<string>).

    Pages are read in one map as they stand (functions.html), URLs are resolved in the JVM. A null HTML gives empty facts; a null
    final_url is the requested one; a null redirect chain is none.
    """
    final = F.coalesce("final_url", "url")
    rows = pages.select("page_id", "url", final.alias("final_url"), "http_status", F.coalesce("redirect_chain", F.array().cast("array<string>")).alias("redirect_chain"), hx.parsed(F.col("html")).alias("page"))
    final = F.col("final_url")
    rows = rows.select(
        "page_id", "url", "final_url", "http_status", "redirect_chain", "page.title", F.col("page.description").alias("meta_description"), F.col("page.robots").alias("robots_meta"),
        F.coalesce(ux.join(F.nullif("page.canonical", F.lit("")), final), F.lit("")).alias("canonical"),
        F.transform("page.alternates", lambda t: F.struct(t["hreflang"].alias("hreflang"), ux.join(t["href"], final).alias("href"))).alias("hreflang"),
        "page.h1", "page.h2", "page.h3",
        F.array_compact(F.transform("page.hrefs", lambda h: ux.target(h, final))).alias("anchors"),
        F.transform("page.images", lambda i: F.struct(ux.join(i["src"], final).alias("src"), i["alt"].alias("alt"))).alias("images"),
        hx.json_objects(F.col("page.json_ld")).alias("schema_blocks"),
        "page.body_text",
    )
    own = lambda u: ux.same_site(u, final)
    return rows.select(
        "page_id", "url", "final_url", ux.normal(final).alias("norm"), ux.host(final).alias("site"), ux.path(final).alias("path"), "http_status", "redirect_chain",
        "title", "meta_description", "robots_meta", "canonical", "hreflang", "h1", "h2", "h3",
        F.array_distinct(F.transform(F.filter("anchors", own), ux.without_fragment)).alias("internal_links"),
        F.array_distinct(F.filter("anchors", lambda u: ~own(u))).alias("external_links"),
        "images", "schema_blocks", "body_text", tx.word_count(F.col("body_text")).alias("word_count"),
    )


def narrow(facts: DataFrame) -> DataFrame:
    """Facts as the checks read them: the text only of pages that are short enough for a soft 404."""
    text = F.when((F.col("word_count") > 0) & (F.col("word_count") < 30), F.col("body_text"))
    return facts.withColumn("body_text", text)


def untyped(blocks: Column) -> Column:
    """JSON-LD objects without a type."""
    return F.filter(blocks, lambda b: F.get_json_object(b, "$['@type']").isNull())


def _check(code: str, when: Column, detail: Column | None = None, pattern: Column | None = None, url: Column | None = None) -> Column:
    text = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")
    own = F.col("final_url") if url is None else url
    return F.when(when, F.struct(F.lit(code).alias("check_code"), own.alias("url"), text(pattern).alias("url_pattern"), text(detail).alias("detail")))


def page_findings(facts: DataFrame) -> DataFrame:
    """site, page_id, check_code, url, url_pattern, detail: every check that needs one page only."""
    rows = facts.fillna("", ["title", "meta_description", "robots_meta", "canonical"]).fillna(0, ["word_count"])
    url, canonical, status, title = F.col("final_url"), F.col("canonical"), F.col("http_status"), F.col("title")
    strip = lambda c: F.regexp_replace(c, "/+$", "")
    up = F.coalesce(status < 400, F.lit(True))
    live = F.coalesce(status == 200, F.lit(False))
    n_h1, words = F.size("h1"), F.col("word_count")
    soft = ((words > 0) & (words < 30) & F.coalesce(F.nullif("body_text", F.lit("")), title).rlike("(?i)" + NOT_FOUND)) | ((words == 0) & title.rlike("(?i)" + NOT_FOUND))
    no_alt = F.filter("images", lambda i: F.coalesce(i["alt"], F.lit("")) == "")
    examples = F.concat_ws(" ", F.size(no_alt).cast("string"), F.array_join(F.transform(F.slice(no_alt, 1, 5), lambda i: i["src"]), " "))
    hreflang = F.col("hreflang")
    checks = [
        _check("status_4xx", status.between(400, 499), status),
        _check("status_5xx", status >= 500, status),
        _check("redirect_chain", up & (F.size("redirect_chain") >= 2), F.size("redirect_chain"), url=F.col("url")),
        _check("noindex_on_indexable", live & F.col("robots_meta").contains("noindex"), F.col("robots_meta")),
        _check("canonical_missing", live & (canonical == "")),
        _check("canonical_not_self", live & (canonical != "") & (strip(canonical) != strip(url)), canonical),
        _check("title_missing", live & (title == "")),
        _check("title_long", live & (F.length(title) > 60), F.length(title)),
        _check("title_short", live & (title != "") & (F.length(title) < 15), F.length(title)),
        _check("meta_desc_missing", live & (F.col("meta_description") == "")),
        _check("h1_missing", live & (n_h1 < 1)),
        _check("h1_multiple", live & (n_h1 > 1), n_h1),
        _check("thin_content", live & (words > 0) & (words < 150), words),
        _check("soft_404", live & soft),
        _check("url_query_params", live & url.contains("?")),
        _check("faceted_nav", live & url.rlike("(?i)" + FACET), pattern=F.concat(F.split_part(url, F.lit("?"), F.lit(1)), F.lit("?*"))),
        _check("url_uppercase", live & F.col("path").rlike(r"\p{Lu}")),
        _check("url_too_long", live & (F.length(url) > 115), F.length(url)),
        _check("img_missing_alt", live & (F.size(no_alt) > 0), examples),
        _check("schema_missing", live & (F.size("schema_blocks") < 1)),
        _check("schema_no_type", live & (F.size(untyped(F.col("schema_blocks"))) > 0)),
        _check("hreflang_no_self", live & (F.size(hreflang) > 0) & ~F.exists(hreflang, lambda h: strip(h["href"]) == strip(url)), F.size(hreflang)),
    ]
    found = rows.select("site", "page_id", F.explode(F.array_compact(F.array(*checks))).alias("f"))
    return found.select("site", "page_id", "f.*").select(FINDING)


def internal_links(facts: DataFrame) -> DataFrame:
    """page_id, site, url, target, target_norm of links that stay on the site."""
    one = facts.select("page_id", "site", F.col("final_url").alias("url"), F.explode("internal_links").alias("target"))
    return one.withColumn("target_norm", ux.normal(F.col("target")))


def last_page_per_norm(facts: DataFrame) -> DataFrame:
    """Of pages with one normal URL the last by page_id stands for all."""
    cols = ["page_id", F.col("final_url").alias("url"), "http_status", "path", "site", "robots_meta"]
    return facts.groupBy("norm").agg(F.max_by(F.struct(*cols), "page_id").alias("p")).select("norm", "p.*")


def in_degrees(links: DataFrame) -> DataFrame:
    return links.groupBy(F.col("target_norm").alias("norm")).agg(F.count("*").alias("n_in"))


def to_non200(rows: DataFrame, target: str, pages: DataFrame) -> DataFrame:
    """Rows whose target, a URL, is the normal URL of a page that is not live, with its ``status``."""
    bad = pages.where("http_status <> 200").select(F.col("norm").alias("target_norm"), F.col("http_status").alias("status"))
    return rows.withColumn("target_norm", ux.normal(F.col(target))).join(bad, "target_norm")


def broken_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    return to_non200(links, "target", pages).select("site", "page_id", "url", "target", "status")


def canonical_to_non200(facts: DataFrame, pages: DataFrame) -> DataFrame:
    strip = lambda c: F.regexp_replace(c, "/+$", "")
    rows = facts.where("http_status = 200 and canonical <> ''").where(strip("canonical") != strip("final_url"))
    return to_non200(rows.select("site", "page_id", F.col("final_url").alias("url"), F.col("canonical").alias("target")), "target", pages)


def hreflang_to_non200(facts: DataFrame, pages: DataFrame) -> DataFrame:
    rows = facts.where("http_status = 200").select("site", "page_id", F.col("final_url").alias("url"), F.explode("hreflang").alias("h"))
    return to_non200(rows.select("site", "page_id", "url", F.col("h.href").alias("target")), "target", pages)


def orphans(pages: DataFrame, degrees: DataFrame) -> DataFrame:
    return pages.where("http_status = 200 and path <> '/'").join(degrees, "norm", "left_anti").select("site", "page_id", "url")


def groups_of_live(facts: DataFrame, key: str, first: int = 10, live_only: bool = False) -> DataFrame:
    """site, key, n_live, urls: values of ``key`` that several live pages of a site have; the first urls by page_id, of any
    status unless ``live_only``. No more than ``first`` rows of a group meet in one task."""
    rows = facts.where(F.col(key) != "").select("site", key, "page_id", F.col("final_url").alias("url"), "http_status")
    rows = rows.where("http_status = 200") if live_only else rows
    counts = rows.groupBy("site", key).agg(F.count_if(F.col("http_status") == 200).alias("n_live")).where("n_live > 1")
    rank = F.row_number().over(Window.partitionBy("site", key).orderBy("page_id"))
    urls = rows.withColumn("k", rank).where(F.col("k") <= first).groupBy("site", key).agg(F.array_sort(F.collect_list(F.struct("k", "url"))).alias("u"))
    return counts.join(urls, ["site", key]).select("site", key, "n_live", F.array_join(F.transform("u", lambda x: x["url"]), " ").alias("urls"))


def duplicate_titles(facts: DataFrame) -> DataFrame:
    return groups_of_live(facts, "title")


def near_duplicates(facts: DataFrame) -> DataFrame:
    """Groups of live pages with one fingerprint; facts(.., fingerprint)."""
    return groups_of_live(facts, "fingerprint", live_only=True)


def sitemap_findings(pages: DataFrame, sitemap: DataFrame) -> DataFrame:
    """Sitemap entries sitemap(site, url) that are not live, and live, indexable pages that their site's sitemap lacks."""
    listed = sitemap.select("site", "url", ux.normal(F.col("url")).alias("norm")).distinct()
    dead = pages.where("http_status <> 200").select("norm", "page_id", "http_status")
    dead = listed.join(dead, "norm").select("site", "page_id", F.lit("in_sitemap_not_crawlable").alias("check_code"), "url", F.lit(None).cast("string").alias("url_pattern"), F.col("http_status").cast("string").alias("detail"))
    live = pages.where("http_status = 200").where(~F.coalesce(F.col("robots_meta"), F.lit("")).contains("noindex"))
    live = live.join(listed.select("site").distinct(), "site", "left_semi").join(listed.select("norm"), "norm", "left_anti")
    none = F.lit(None).cast("string")
    return dead.unionByName(live.select("site", "page_id", F.lit("crawled_not_in_sitemap").alias("check_code"), "url", none.alias("url_pattern"), none.alias("detail")))


def site_context_findings(sites: DataFrame) -> DataFrame:
    """Checks of sites(site, origin, robots_reachable, robots_has_sitemap, n_sitemap_urls)."""
    at = lambda path: F.concat("origin", F.lit(path))
    one = lambda code, when, pattern: F.when(when, F.struct(F.lit(code).alias("check_code"), pattern.alias("url_pattern")))
    reached, named = F.col("robots_reachable"), F.col("robots_has_sitemap")
    checks = F.array_compact(F.array(
        one("robots_unreachable", ~reached, at("/robots.txt")),
        one("robots_no_sitemap", reached & ~named, at("/robots.txt")),
        one("sitemap_empty", (F.col("n_sitemap_urls") == 0) & named, at("/sitemap.xml")),
    ))
    found = sites.select("site", F.explode(checks).alias("f"))
    none = F.lit(None).cast("string")
    return found.select("site", F.lit(-1).cast("long").alias("page_id"), "f.check_code", none.alias("url"), "f.url_pattern", none.alias("detail"))


def site_findings(facts: DataFrame, sitemap: DataFrame | None = None, sites: DataFrame | None = None) -> DataFrame:
    """All findings with category, severity and key; of findings of a site with one key the first by page stays.

    ``facts`` is read several times: pass a written table. With a ``fingerprint`` column near duplicates are found too.
    """
    links, pages = internal_links(facts), last_page_per_norm(facts)
    none, site_wide = F.lit(None).cast("string"), F.lit(-1).cast("long").alias("page_id")

    def form(rows: DataFrame, code: str, url: Column, pattern: Column, detail: Column, page: Column | str = "page_id") -> DataFrame:
        return rows.select("site", page, F.lit(code).alias("check_code"), url.cast("string").alias("url"), pattern.cast("string").alias("url_pattern"), detail.cast("string").alias("detail"))

    url, to = F.col("url"), F.concat_ws(" ", "target", "status")
    more = [
        form(broken_links(links, pages), "broken_internal_link", url, none, to),
        form(canonical_to_non200(facts, pages), "canonical_to_non200", url, none, F.col("target")),
        form(hreflang_to_non200(facts, pages), "hreflang_to_non200", url, none, F.col("target")),
        form(orphans(pages, in_degrees(links)), "orphan_page", url, none, none),
        form(duplicate_titles(facts), "title_duplicate", none, F.concat(F.lit("title:"), F.left("title", F.lit(60))), F.concat_ws(" ", "n_live", "urls"), site_wide),
    ]
    if "fingerprint" in facts.columns:
        more.append(form(near_duplicates(facts), "near_duplicate", none, F.concat(F.lit("fingerprint:"), F.col("fingerprint")), F.col("urls"), site_wide))
    if sitemap is not None:
        more.append(sitemap_findings(pages, sitemap))
    if sites is not None:
        more.append(site_context_findings(sites))
    own = page_findings(facts)
    for x in more:
        own = own.unionByName(x)
    return catalogued(own)


def finding_key() -> Column:
    return F.sha2(F.concat_ws("|", "check_code", F.coalesce("url_pattern", "url", F.lit("*"))), 256)


def catalogued(found: DataFrame) -> DataFrame:
    """Keep-first by (site, key) and the catalog's category and severity."""
    catalog = F.broadcast(found.sparkSession.createDataFrame(CATALOG, "check_code string, category string, severity string"))  # constant
    keyed = found.withColumn("normalized_key", finding_key())
    first = F.min_by(F.struct("page_id", "check_code", "url", "url_pattern", "detail"), F.struct("page_id", "detail", "url", "url_pattern"))
    first = keyed.groupBy("site", "normalized_key").agg(first.alias("f")).select("site", "normalized_key", "f.*")
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return first.join(catalog, "check_code").select("site", "page_id", "check_code", "category", "severity", rank.alias("severity_rank"), "url", "url_pattern", "detail", "normalized_key")


def vitals_findings(rated: DataFrame) -> DataFrame:
    """A finding for every poor reading of rated(site, url, metric, value, rating); readings of one page and metric share a key."""
    code = F.concat(F.lit("cwv_"), F.regexp_replace("metric", "_ms$", ""), F.lit("_poor"))
    poor = rated.where("rating = 'poor'").select("site", F.lit(-1).cast("long").alias("page_id"), code.alias("check_code"), "url", F.lit(None).cast("string").alias("url_pattern"), F.col("value").cast("string").alias("detail"))
    return catalogued(poor)
