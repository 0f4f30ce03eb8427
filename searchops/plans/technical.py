"""Queries over ``pages``. The table holds bare pages, so both engines add the same head tags, a link to the page of the site
before, status and redirects, all derived from page_id; site files are derived from the sites' pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls as ux
from ..operators import content, fingerprints, opportunities, technical
from ..sources.tables import keeper, spread
from .registry import QUERIES, Query

#: Head tags, in the SQL that both engines read.
HEAD = """concat(
  CASE WHEN page_id % 4 <> 0 THEN concat('<meta name="description" content="', repeat('page words ', CAST(page_id % 17 AS INT)), '">') ELSE '' END,
  CASE WHEN page_id % 13 = 0 THEN concat('<META content=', chr(39), 'NOINDEX, follow', chr(39), ' name=robots>') ELSE '' END,
  CASE WHEN page_id % 5 = 0 THEN '' WHEN page_id % 7 = 0 THEN concat('<link rel="canonical" href="', split_part(url, '?', 1), '">') WHEN page_id % 8 = 3 THEN concat('<link rel="canonical" href="', coalesce(before, url), '">')
    ELSE concat('<link href=', chr(39), replace(url, '&', '&amp;'), chr(39), ' rel="canonical">') END,
  CASE WHEN page_id % 6 = 0 THEN concat('<link rel="alternate" hreflang="de" href="', coalesce(before, '/de/'), '">') ELSE '' END,
  CASE WHEN page_id % 12 = 0 THEN concat('<link rel="alternate" hreflang="en" href="', url, '">') ELSE '' END,
  CASE WHEN page_id % 3 = 0 THEN '<img src="/a.png" alt="x"><img data-src=b.png><IMG SRC="c.png" alt="">' ELSE '' END,
  CASE page_id % 8 WHEN 0 THEN '<script type="application/ld+json">{"@type":"Article","name":"x"}</script>'
    WHEN 1 THEN '<script type="application/ld+json">[{"@type":"Organization","name":"Acme Rings","sameAs":["https://x.example/acme"]},{"name":"untyped"}]</script>'
    WHEN 2 THEN '<script type="application/ld+json">{broken</script>' WHEN 4 THEN '<script type="application/ld+json">{"@type":"Product","offers":{"price":"3"}}</script>' ELSE '' END,
  '<h2>Sizes &amp; <b>care</b></h2>', CASE WHEN before IS NULL THEN '' ELSE concat('<a class="k" href="', replace(before, '&', '&amp;'), '#part">before</a><a href="mailto:a@b.example">m</a>') END, '</head>')"""
STATUS = "CASE WHEN page_id % 17 = 0 THEN 404 WHEN page_id % 23 = 0 THEN 503 ELSE 200 END"


def landed(spark: SparkSession, sf: str) -> DataFrame:
    """The page before is found among numbers and URLs only, so that no page's markup is sorted by host."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    before = F.lag("url").over(Window.partitionBy(ux.host(F.col("url"))).orderBy("page_id"))
    pages = spread(pages).join(pages.select("page_id", before.alias("before")), "page_id")
    chain = F.when(F.col("page_id") % 11 == 0, F.array(F.lit("301"), F.lit("302"))).otherwise(F.array().cast("array<string>"))
    html = F.replace("html", F.lit("</head>"), F.expr(HEAD))
    return pages.select("page_id", "url", F.col("url").alias("final_url"), html.alias("html"), F.expr(STATUS).alias("http_status"), chain.alias("redirect_chain"))


def facts(spark: SparkSession, sf: str) -> DataFrame:
    return technical.page_facts(landed(spark, sf))


def written_facts(spark: SparkSession, sf: str) -> DataFrame:
    """The facts as the checks read them, with fingerprints, parsed once and written."""
    return keeper(spark)(technical.narrow(facts(spark, sf).withColumn("fingerprint", fingerprints.simhash(F.col("body_text")))))


def sitemap(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", ux.host(F.col("url")).alias("site"))
    return pages.where("page_id % 3 <> 0 and length(site) % 5 <> 0").select("site", "url")


def sites(spark: SparkSession, sf: str) -> DataFrame:
    names = spark.read.parquet(f"{sf}/pages.parquet").select(ux.host(F.col("url")).alias("site")).distinct()
    n = sitemap(spark, sf).groupBy("site").agg(F.count("*").alias("n"))
    n_char = F.length("site")
    return names.join(n, "site", "left").select("site", F.concat(F.lit("https://"), "site").alias("origin"), (n_char % 7 != 0).alias("robots_reachable"), (n_char % 3 != 0).alias("robots_has_sitemap"), F.coalesce("n", F.lit(0)).alias("n_sitemap_urls"))


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


#: How the twin reads markup: by patterns that do for these tables, whose values hold no ">" and few entities.
_ATTRIBUTE = r"""(?is)\s{}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_ELEMENT = r"(?is)<{0}(?:\s[^>]*)?>(.*?)</{0}\s*>"
_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<title\b.*?</title>"
_JSON_LD = r"""(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script>"""


def sql_attr(tag: str, name: str) -> str:
    return f"trim({_unescape('concat(' + ', '.join(f'regexp_extract({tag}, {q(_ATTRIBUTE.format(name))}, {k})' for k in (1, 2, 3)) + ')')})"


def _unescape(x: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return x


def sql_tags(html: str, name: str) -> str:
    return f"regexp_extract_all({html}, '(?is)<{name}\\s[^>]*>')"


def sql_plain(x: str) -> str:
    inner = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    return f"trim(regexp_replace({_unescape(inner)}, '[ \\t\\r\\n]+', ' ', 'g'))"


def sql_texts(html: str, name: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({html}, {q(_ELEMENT.format(name))}, 1), lambda t: {sql_plain('t')}), lambda t: t <> '')"


def sql_meta(name: str) -> str:
    last = f"list_filter({sql_tags('seen', 'meta')}, lambda t: lower({sql_attr('t', 'name')}) = '{name}')[-1]"
    return f"coalesce({sql_attr(last, 'content')}, '')"


def sql_links(rel: str) -> str:
    return f"list_filter({sql_tags('seen', 'link')}, lambda t: contains(lower({sql_attr('t', 'rel')}), '{rel}'))"


PARTS = ux.PARTS
NORM = "concat(regexp_extract({0}, '" + PARTS + "', 1), '://', lower(regexp_extract({0}, '" + PARTS + "', 2)), coalesce(nullif(regexp_replace(regexp_extract({0}, '" + PARTS + "', 3), '/+$', ''), ''), '/'))"
HOST = "lower(regexp_extract({0}, '" + PARTS + "', 2))"
DOMAIN = "regexp_replace(" + HOST + ", '^www\\.', '')"
PATH = "coalesce(nullif(regexp_extract({0}, '" + PARTS + "', 3), ''), '/')"
_ROOT = "concat(regexp_extract(url, '" + PARTS + "', 1), '://', regexp_extract(url, '" + PARTS + "', 2))"
#: Links without dot segments, which the tables don't have.
JOIN = (
    "CASE WHEN regexp_matches({0}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {0} WHEN starts_with({0}, '//') THEN concat(regexp_extract(url, '" + PARTS + "', 1), ':', {0}) WHEN starts_with({0}, '/') THEN concat(" + _ROOT + ", {0}) "
    "ELSE concat(" + _ROOT + ", coalesce(nullif(regexp_replace(regexp_extract(url, '" + PARTS + "', 3), '[^/]*$', ''), ''), '/'), {0}) END"
)
FACTS_SQL = f"""
landed0 AS (SELECT *, lag(url) OVER (PARTITION BY {HOST.format("url")} ORDER BY page_id) AS before FROM pages),
landed AS (SELECT page_id, url, replace(html, '</head>', {HEAD}) AS html, {STATUS} AS http_status, CASE WHEN page_id % 11 = 0 THEN 2 ELSE 0 END AS hops FROM landed0),
facts0 AS MATERIALIZED (SELECT *, regexp_replace(html, '{_HIDDEN}', ' ', 'g') AS seen FROM landed),
facts1 AS MATERIALIZED (
  SELECT page_id, url, html, http_status, hops, {NORM.format("url")} AS norm, {HOST.format("url")} AS site, {PATH.format("url")} AS path,
    {sql_plain("regexp_extract(html, " + q(_ELEMENT.format("title")) + ", 1)")} AS title,
    {sql_meta("description")} AS meta_description, lower({sql_meta("robots")}) AS robots_meta,
    nullif({sql_attr(sql_links("canonical") + "[1]", "href")}, '') AS canonical0,
    list_transform(list_filter({sql_links("alternate")}, lambda t: {sql_attr("t", "hreflang")} <> ''), lambda t: {JOIN.format(sql_attr("t", "href"))}) AS hreflang,
    {sql_texts("seen", "h1")} AS h1, {sql_texts("seen", "h2")} AS h2, {sql_texts("seen", "h3")} AS h3,
    list_filter(list_transform({sql_tags("seen", "a")}, lambda t: nullif({sql_attr("t", "href")}, '')), lambda u: u IS NOT NULL AND NOT regexp_matches(u, '(?i)^(#|mailto:|tel:|javascript:|data:)')) AS hrefs,
    list_filter(list_transform({sql_tags("seen", "img")}, lambda t: {{'src': coalesce(nullif({sql_attr("t", "src")}, ''), {sql_attr("t", "data-src")}), 'alt': {sql_attr("t", "alt")}}}), lambda i: i.src <> '') AS images0,
    list_filter(regexp_extract_all(html, {q(_JSON_LD)}, 1), lambda s: json_valid(s)) AS json_ld,
    {sql_plain("seen")} AS body_text
  FROM facts0),
facts2 AS (SELECT *, CASE WHEN canonical0 IS NULL THEN '' ELSE {JOIN.format("canonical0")} END AS canonical, list_filter(list_transform(hrefs, lambda u: {JOIN.format("u")}), lambda u: regexp_matches(u, '(?i)^https?://')) AS anchors,
    list_transform(images0, lambda i: {{'src': {JOIN.format("i.src")}, 'alt': i.alt}}) AS images,
    flatten(list_transform(json_ld, lambda s: CASE WHEN json_type(s) = 'ARRAY' THEN json_extract(s, '$[*]') ELSE [s::JSON] END)) AS schema_blocks,
    CASE WHEN body_text = '' THEN 0 ELSE len(string_split(body_text, ' ')) END AS word_count FROM facts1),
facts AS MATERIALIZED (SELECT *, list_transform(list_filter(anchors, lambda u: {DOMAIN.format("u")} = {DOMAIN.format("url")}), lambda u: regexp_replace(u, '#.*$', '')) AS internal0,
    list_filter(anchors, lambda u: {DOMAIN.format("u")} <> {DOMAIN.format("url")}) AS external0 FROM facts2),
links AS (SELECT DISTINCT page_id, site, url, unnest(internal0) AS target FROM facts),
links2 AS (SELECT *, {NORM.format("target")} AS target_norm FROM links),
by_norm AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY norm ORDER BY page_id DESC) = 1),
degrees AS (SELECT target_norm AS norm, count(*) AS n_in FROM links2 GROUP BY 1)"""
SITES_SQL = f"""
sitemap AS (SELECT * FROM (SELECT page_id, url, {HOST.format("url")} AS site FROM pages) WHERE page_id % 3 <> 0 AND length(site) % 5 <> 0),
sites AS (SELECT site, 'https://' || site AS origin, length(site) % 7 <> 0 AS reachable, length(site) % 3 <> 0 AS named, (SELECT count(*) FROM sitemap s WHERE s.site = p.site) AS n FROM (SELECT DISTINCT {HOST.format("url")} AS site FROM pages) p)"""

_NF = technical.NOT_FOUND.replace("'", "''")
_STRIP = "rtrim({0}, '/')"
_NO_ALT = "list_filter(images, lambda i: i.alt = '')"
_UNTYPED = "len(list_filter(schema_blocks, lambda b: json_extract_string(b, '$.\"@type\"') IS NULL))"
_CHECKS = [
    ("status_4xx", "http_status BETWEEN 400 AND 499", "http_status"),
    ("status_5xx", "http_status >= 500", "http_status"),
    ("redirect_chain", "http_status < 400 AND hops >= 2", "hops"),
    ("noindex_on_indexable", "http_status = 200 AND contains(robots_meta, 'noindex')", "robots_meta"),
    ("canonical_missing", "http_status = 200 AND canonical = ''", None),
    ("canonical_not_self", "http_status = 200 AND canonical <> '' AND rtrim(canonical, '/') <> rtrim(url, '/')", "canonical"),
    ("title_missing", "http_status = 200 AND title = ''", None),
    ("title_long", "http_status = 200 AND length(title) > 60", "length(title)"),
    ("title_short", "http_status = 200 AND title <> '' AND length(title) < 15", "length(title)"),
    ("meta_desc_missing", "http_status = 200 AND meta_description = ''", None),
    ("h1_missing", "http_status = 200 AND len(h1) = 0", None),
    ("h1_multiple", "http_status = 200 AND len(h1) > 1", "len(h1)"),
    ("thin_content", "http_status = 200 AND word_count > 0 AND word_count < 150", "word_count"),
    ("soft_404", f"http_status = 200 AND ((word_count > 0 AND word_count < 30 AND regexp_matches(coalesce(nullif(body_text, ''), title), '(?i){_NF}')) OR (word_count = 0 AND regexp_matches(title, '(?i){_NF}')))", None),
    ("url_query_params", "http_status = 200 AND contains(url, '?')", None),
    ("faceted_nav", f"http_status = 200 AND regexp_matches(url, '(?i){technical.FACET}')", None),
    ("url_uppercase", r"http_status = 200 AND regexp_matches(path, '\p{Lu}')", None),
    ("url_too_long", "http_status = 200 AND length(url) > 115", "length(url)"),
    ("img_missing_alt", f"http_status = 200 AND len({_NO_ALT}) > 0", f"concat_ws(' ', len({_NO_ALT}), array_to_string(list_transform({_NO_ALT}[1:5], lambda i: i.src), ' '))"),
    ("schema_missing", "http_status = 200 AND len(schema_blocks) = 0", None),
    ("schema_no_type", f"http_status = 200 AND {_UNTYPED} > 0", None),
    ("hreflang_no_self", "http_status = 200 AND len(hreflang) > 0 AND len(list_filter(hreflang, lambda h: rtrim(h, '/') = rtrim(url, '/'))) = 0", "len(hreflang)"),
]
_PATTERN = {"faceted_nav": "split_part(url, '?', 1) || '?*'"}
_NULL = "CAST(NULL AS VARCHAR)"
_OWN_SQL = " UNION ALL ".join(f"SELECT site, page_id, '{c}' AS check_code, url, {_PATTERN.get(c, _NULL)} AS url_pattern, {f'CAST({d} AS VARCHAR)' if d else _NULL} AS detail FROM facts WHERE {w}" for c, w, d in _CHECKS)
_CATALOG_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {technical.SEVERITIES.index(c) + 1})" for a, b, c in technical.CATALOG) + ") c(check_code, category, severity, severity_rank)"


def _groups_sql(key: str, rows: str) -> str:
    return f"""(SELECT site, {key}, n_live, string_agg(url, ' ' ORDER BY page_id) AS urls FROM (
    SELECT site, {key}, page_id, url, count_if(http_status = 200) OVER (PARTITION BY site, {key}) AS n_live, row_number() OVER (PARTITION BY site, {key} ORDER BY page_id) AS k FROM {rows} WHERE {key} <> '')
  WHERE n_live > 1 AND k <= 10 GROUP BY ALL)"""


TOKENS_SQL = "regexp_extract_all(lower({0}), '" + fingerprints.TOKEN.replace("'", "''") + "', 1)"
PRINTS_SQL = (
    f"""shingled AS (SELECT page_id, unnest(CASE WHEN len(w) < 3 THEN w ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM (SELECT page_id, {TOKENS_SQL.format("body_text")} AS w FROM facts)),
hashed AS (SELECT page_id, CAST('0x' || substring(md5(s), 1, 16) AS UBIGINT) AS h FROM shingled),
voted AS (SELECT page_id, count(*) AS n, """
    + ", ".join(f"sum(CAST((h >> {b}) & 1 AS BIGINT)) AS b{b}" for b in range(64))
    + " FROM hashed GROUP BY 1),\nprints AS (SELECT page_id, lower(lpad(to_hex("
    + " + ".join(f"CASE WHEN 2 * b{b} > n THEN {1 << b}::UBIGINT ELSE 0::UBIGINT END" for b in range(64))
    + "), 16, '0')) AS fingerprint FROM voted)"
)
FINDINGS_SQL = f"""{FACTS_SQL}, {SITES_SQL}, {PRINTS_SQL}, printed AS (SELECT f.*, coalesce(fingerprint, '0000000000000000') AS fingerprint FROM facts f LEFT JOIN prints USING (page_id)),
bad AS (SELECT norm AS target_norm, http_status AS status FROM by_norm WHERE http_status <> 200),
found AS ({_OWN_SQL}
  UNION ALL SELECT site, page_id, 'broken_internal_link', url, NULL, target || ' ' || status FROM links2 JOIN bad USING (target_norm)
  UNION ALL SELECT site, page_id, 'canonical_to_non200', url, NULL, canonical FROM facts JOIN bad ON target_norm = {NORM.format("canonical")} WHERE http_status = 200 AND canonical <> '' AND rtrim(canonical, '/') <> rtrim(url, '/')
  UNION ALL SELECT site, page_id, 'hreflang_to_non200', url, NULL, h FROM (SELECT site, page_id, url, unnest(hreflang) AS h FROM facts WHERE http_status = 200) JOIN bad ON target_norm = {NORM.format("h")}
  UNION ALL SELECT site, page_id, 'orphan_page', url, NULL, NULL FROM by_norm p WHERE http_status = 200 AND path <> '/' AND NOT EXISTS (SELECT 1 FROM degrees d WHERE d.norm = p.norm)
  UNION ALL SELECT site, -1, 'title_duplicate', NULL, 'title:' || left(title, 60), n_live || ' ' || urls FROM {_groups_sql("title", "facts")}
  UNION ALL SELECT site, -1, 'near_duplicate', NULL, 'fingerprint:' || fingerprint, urls FROM {_groups_sql("fingerprint", "(SELECT * FROM printed WHERE http_status = 200)")}
  UNION ALL SELECT s.site, p.page_id, 'in_sitemap_not_crawlable', s.url, NULL, CAST(p.http_status AS VARCHAR) FROM (SELECT DISTINCT site, url FROM sitemap) s JOIN by_norm p ON p.norm = {NORM.format("s.url")} WHERE p.http_status <> 200
  UNION ALL SELECT site, page_id, 'crawled_not_in_sitemap', url, NULL, NULL FROM by_norm WHERE http_status = 200 AND NOT contains(robots_meta, 'noindex') AND site IN (SELECT site FROM sitemap) AND norm NOT IN (SELECT {NORM.format("url")} FROM sitemap)
  UNION ALL SELECT site, -1, CASE WHEN NOT reachable THEN 'robots_unreachable' ELSE 'robots_no_sitemap' END, NULL, origin || '/robots.txt', NULL FROM sites WHERE NOT reachable OR NOT named
  UNION ALL SELECT site, -1, 'sitemap_empty', NULL, origin || '/sitemap.xml', NULL FROM sites WHERE n = 0 AND named),
keyed AS (SELECT *, sha256(concat_ws('|', check_code, coalesce(url_pattern, url, '*'))) AS normalized_key FROM found),
findings AS (
  SELECT site, page_id, check_code, category, severity, severity_rank, url, url_pattern, detail, normalized_key FROM keyed JOIN {_CATALOG_SQL} USING (check_code)
  QUALIFY row_number() OVER (PARTITION BY site, normalized_key ORDER BY page_id, detail NULLS FIRST, url NULLS FIRST, url_pattern NULLS FIRST) = 1)"""


def all_findings(spark: SparkSession, sf: str, facts: DataFrame | None = None) -> DataFrame:
    return technical.site_findings(written_facts(spark, sf) if facts is None else facts, sitemap(spark, sf), sites(spark, sf))


def site_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Worst first within each site; sorted by site and rank in ranges, so no task holds all findings."""
    found = all_findings(spark, sf).withColumn("severity_rank", F.col("severity_rank").cast("int"))
    return found.repartitionByRange("site", "severity_rank", "check_code").sortWithinPartitions("site", "severity_rank", "check_code", "url")


def page_facts(spark: SparkSession, sf: str) -> DataFrame:
    size = lambda *names: [F.size(n).alias(f"n_{n}") for n in names]
    listed = lambda c: F.array_join(F.array_sort(c), " ")
    images = F.transform("images", lambda i: F.concat_ws("|", i["src"], i["alt"]))
    return facts(spark, sf).select(
        "page_id", "norm", "site", "path", "http_status", "title", "meta_description", "robots_meta", "canonical", *size("h1", "h2", "h3", "schema_blocks", "redirect_chain"),
        F.array_join(F.transform("hreflang", lambda h: h["href"]), " ").alias("hreflang"), listed(F.col("internal_links")).alias("internal"), listed(F.col("external_links")).alias("external"),
        listed(images).alias("images"), F.size(technical.untyped(F.col("schema_blocks"))).alias("n_untyped"), "word_count", F.sha2("body_text", 256).alias("body_sha256"),
    )


def url_functions(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", ux.normal(u).alias("norm"), ux.domain(u).alias("domain"), ux.path(u).alias("path"), ux.url_hash(u).alias("url_hash"))


def link_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return technical.in_degrees(technical.internal_links(facts(spark, sf)))


def broken_links(spark: SparkSession, sf: str) -> DataFrame:
    f = written_facts(spark, sf)
    return technical.broken_links(technical.internal_links(f), technical.last_page_per_norm(f))


def orphan_pages(spark: SparkSession, sf: str) -> DataFrame:
    f = written_facts(spark, sf)
    return technical.orphans(technical.last_page_per_norm(f), technical.in_degrees(technical.internal_links(f)))


def duplicate_titles(spark: SparkSession, sf: str) -> DataFrame:
    return technical.duplicate_titles(written_facts(spark, sf))


def findings_by_severity(spark: SparkSession, sf: str) -> DataFrame:
    return all_findings(spark, sf).groupBy("site", "severity").agg(F.count("*").alias("n"))


def page_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf).select("page_id", fingerprints.simhash(F.col("body_text")).alias("fingerprint"))


def second_crawl(spark: SparkSession, sf: str) -> DataFrame:
    """A crawl of the same pages, of which every third has lost the last half of its text, and every fifth is seen for the first time."""
    half = F.when(F.col("page_id") % 3 == 0, F.left("body_text", F.floor(F.length("body_text") / 2).cast("int"))).otherwise(F.col("body_text"))
    rows = facts(spark, sf).select("page_id", ux.url_hash(F.col("url")).alias("url_hash"), F.col("http_status").alias("status"), fingerprints.simhash(half).alias("fingerprint"), fingerprints.simhash(F.col("body_text")).alias("first"))
    rows = keeper(spark)(rows)
    old = rows.where("page_id % 5 <> 0").select("url_hash", F.col("first").alias("fingerprint"), F.col("page_id").alias("fetched_at"))
    return fingerprints.delta(rows.drop("first"), old)


def crawl_delta(spark: SparkSession, sf: str) -> DataFrame:
    return second_crawl(spark, sf).select("page_id", "url_hash", "fingerprint", "old_fingerprint", F.when(F.col("old_fingerprint").isNotNull(), fingerprints.distance(F.col("fingerprint"), F.col("old_fingerprint"))).alias("distance"), "changed")


def crawl_counters(spark: SparkSession, sf: str) -> DataFrame:
    rows = second_crawl(spark, sf).select((F.col("page_id") % 4).alias("run"), (F.col("page_id") % 19 == 0).alias("blocked"), "status", "changed")
    return fingerprints.crawl_counters(rows, "run")


def snapshot_append(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as fetched pages of a tenant (their source): those whose text no snapshot of the tenant holds become one."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("source").alias("tenant_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), "doc_id", (F.col("doc_id") % 6 != 0).alias("changed"))
    old = d.where("doc_id % 4 = 0")
    return fingerprints.new_snapshots(d, old, ["tenant_id", "content_hash"]).select("tenant_id", "content_hash")


def typed(spark: SparkSession, sf: str, facts: DataFrame | None = None) -> DataFrame:
    f = written_facts(spark, sf) if facts is None else facts
    rows = content.with_types(f).withColumn("updated_on", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 1000).cast("int")))
    return content.inventory(rows, technical.in_degrees(technical.internal_links(f)), F.lit("2026-06-01").cast("date"))


def content_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return typed(spark, sf)


def content_flag_counts(spark: SparkSession, sf: str) -> DataFrame:
    return typed(spark, sf).select("site", F.explode(F.split("flags", ",")).alias("flag")).where("flag <> ''").groupBy("site", "flag").agg(F.count("*").alias("n"))


def scored_opportunities(spark: SparkSession, sf: str) -> DataFrame:
    return opportunities.from_findings(all_findings(spark, sf)).select("site", "check_code", "type", "action_class", "url", "url_pattern", "score", "priority", "opportunity_key")


def crawl_frontier(spark: SparkSession, sf: str) -> DataFrame:
    """Per site the origin, then the pages of the sitemap in order, one per normal URL, three in all."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select(ux.host(F.col("url")).alias("site"), "url", F.col("page_id").alias("ordinal"))
    return content.frontier(pages, 3)


INVENTORY_SQL = f"""{FACTS_SQL},
kinds AS (SELECT *, list_transform(schema_blocks, lambda b: lower(json_extract_string(b, '$."@type"'))) AS types, len(list_filter(schema_blocks, lambda b: json_extract_string(b, '$.offers.price') IS NOT NULL)) > 0 AS has_price, len(list_distinct(internal0)) AS n_links FROM facts WHERE http_status = 200),
typed AS (SELECT f.*, coalesce(d.n_in, 0) AS links_in, date_add(DATE '2024-01-01', INTERVAL (page_id % 1000) DAY)::DATE AS updated_on, CASE
    WHEN path = '/' THEN 'home'
    WHEN list_has_any(types, ['product', 'offer']) OR regexp_matches(path, '(?i){content.PRODUCT}') OR has_price THEN 'product'
    WHEN list_has_any(types, ['collectionpage', 'itemlist']) OR regexp_matches(path, '(?i){content.CATEGORY}') THEN 'category'
    WHEN list_has_any(types, ['article', 'blogposting', 'newsarticle', 'faqpage', 'howto']) OR regexp_matches(path, '(?i){content.ARTICLE}') THEN 'article'
    WHEN word_count >= 300 AND n_links < 15 THEN 'article'
    WHEN n_links >= 20 AND word_count < 300 THEN 'category'
    WHEN word_count < 300 THEN 'landing' ELSE 'other' END AS content_type
  FROM kinds f LEFT JOIN degrees d USING (norm)),
scored AS (SELECT *, CASE content_type WHEN 'article' THEN 700 WHEN 'category' THEN 300 WHEN 'product' THEN 300 WHEN 'landing' THEN 400 ELSE 500 END AS target, len(h1) + len(h2) + len(h3) AS n_headings FROM typed),
inventory AS (SELECT page_id, site, url, content_type, word_count, links_in,
    concat_ws(',', CASE WHEN word_count > 0 AND word_count < CASE content_type WHEN 'article' THEN 300 WHEN 'product' THEN 80 WHEN 'category' THEN 50 ELSE 150 END THEN 'thin' END,
                   CASE WHEN content_type = 'article' AND date_diff('day', updated_on, DATE '2026-06-01') > 540 THEN 'outdated' END,
                   CASE WHEN links_in = 0 AND content_type IN ('article', 'product') THEN 'orphan' END) AS flags,
    CASE WHEN word_count >= target * 0.9 THEN 30 WHEN word_count >= target * 0.6 THEN 18 WHEN word_count > 0 THEN 8 ELSE 0 END
    + CASE WHEN n_headings >= 3 THEN 20 WHEN n_headings >= 1 THEN 10 ELSE 0 END
    + CASE WHEN n_links >= 5 THEN 20 WHEN n_links >= 1 THEN 10 ELSE 0 END
    + CASE WHEN len(schema_blocks) > 0 THEN 15 ELSE 0 END
    + CASE WHEN length(meta_description) BETWEEN 50 AND 160 THEN 15 WHEN length(meta_description) > 0 THEN 8 ELSE 0 END AS score FROM scored)"""
_VERDICT = "CASE WHEN score >= 70 THEN 'PASS' WHEN score >= 45 THEN 'REVISE' ELSE 'FAIL' END AS verdict"
_OPPS = "(VALUES " + ", ".join("('{}', '{}', '{}', {}, {}, {}, {})".format(*r) for r in opportunities.ISSUES) + ") m(check_code, type, action_class, business, seo, feasibility, risk)"
_CONF = "CASE severity " + " ".join(f"WHEN '{s}' THEN {c}" for s, c in opportunities.SEVERITY_CONFIDENCE.items()) + " END"
OPPORTUNITIES_SQL = f"""{FINDINGS_SQL}, s AS (
          SELECT f.site, m.type, m.action_class, f.check_code, f.page_id, f.severity_rank, f.url, f.url_pattern,
                 round(m.business * m.seo * {_CONF} * m.feasibility / greatest(0.05, least(1.0, m.risk)) * 100, 3)::DOUBLE AS score,
                 sha256(concat_ws('|', 'issue', m.type, coalesce(f.url_pattern, f.url, '*'))) AS opportunity_key
          FROM findings f JOIN {_OPPS} USING (check_code)),
        opportunities AS (SELECT *, CASE WHEN score >= 60 THEN 'P0' WHEN score >= 30 THEN 'P1' WHEN score >= 12 THEN 'P2' ELSE 'P3' END AS priority FROM s)"""
_SECOND_SQL = f"""WITH {FACTS_SQL}, {PRINTS_SQL}, halves AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN left(body_text, length(body_text) // 2) ELSE body_text END AS body_text FROM facts),
  {PRINTS_SQL.replace("shingled", "shingled2").replace("hashed", "hashed2").replace("voted", "voted2").replace("prints AS", "prints2 AS").replace("FROM facts)", "FROM halves)")},
  hashes AS (SELECT page_id, http_status AS status, sha256(norm || '?' || regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)) AS url_hash FROM facts),
  old AS (SELECT url_hash, last(coalesce(fingerprint, '0000000000000000') ORDER BY page_id) AS old_fingerprint FROM hashes LEFT JOIN prints USING (page_id) WHERE page_id % 5 <> 0 GROUP BY 1),
  second AS (SELECT page_id, url_hash, status, coalesce(fingerprint, '0000000000000000') AS fingerprint, old_fingerprint,
     CASE WHEN old_fingerprint IS NOT NULL THEN bit_count(xor(CAST('0x' || coalesce(fingerprint, '0000000000000000') AS UBIGINT)::HUGEINT, CAST('0x' || old_fingerprint AS UBIGINT)::HUGEINT)) END AS distance FROM hashes LEFT JOIN prints2 USING (page_id) LEFT JOIN old USING (url_hash))"""

QUERIES.update(
    site_findings=Query(site_findings, f"WITH {FINDINGS_SQL} SELECT * FROM findings"),
    page_facts=Query(
        page_facts,
        f"""WITH {FACTS_SQL} SELECT page_id, norm, site, path, http_status, title, meta_description, robots_meta, canonical, len(h1) AS n_h1, len(h2) AS n_h2, len(h3) AS n_h3, len(schema_blocks) AS n_schema_blocks, hops AS n_redirect_chain,
          array_to_string(hreflang, ' ') AS hreflang, array_to_string(list_sort(list_distinct(internal0)), ' ') AS internal, array_to_string(list_sort(list_distinct(external0)), ' ') AS external,
          array_to_string(list_sort(list_transform(images, lambda i: concat_ws('|', i.src, i.alt))), ' ') AS images, {_UNTYPED} AS n_untyped, word_count, sha256(body_text) AS body_sha256 FROM facts""",
    ),
    url_functions=Query(url_functions, f"SELECT page_id, {NORM.format('url')} AS norm, {DOMAIN.format('url')} AS domain, {PATH.format('url')} AS path, sha256({NORM.format('url')} || '?' || regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)) AS url_hash FROM pages"),
    link_degrees=Query(link_degrees, f"WITH {FACTS_SQL} SELECT norm, n_in FROM degrees"),
    broken_links=Query(broken_links, f"WITH {FACTS_SQL} SELECT l.site, l.page_id, l.url, l.target, p.http_status AS status FROM links2 l JOIN by_norm p ON p.norm = l.target_norm WHERE p.http_status <> 200"),
    orphan_pages=Query(orphan_pages, f"WITH {FACTS_SQL} SELECT site, page_id, url FROM by_norm p WHERE http_status = 200 AND path <> '/' AND NOT EXISTS (SELECT 1 FROM degrees d WHERE d.norm = p.norm)"),
    duplicate_titles=Query(duplicate_titles, f"WITH {FACTS_SQL} SELECT * FROM {_groups_sql('title', 'facts')}"),
    findings_by_severity=Query(findings_by_severity, f"WITH {FINDINGS_SQL} SELECT site, severity, count(*) AS n FROM findings GROUP BY ALL"),
    page_fingerprints=Query(page_fingerprints, f"WITH {FACTS_SQL}, {PRINTS_SQL} SELECT page_id, coalesce(fingerprint, '0000000000000000') AS fingerprint FROM facts LEFT JOIN prints USING (page_id)"),
    crawl_delta=Query(crawl_delta, f"{_SECOND_SQL} SELECT page_id, url_hash, fingerprint, old_fingerprint, distance, coalesce(distance > 3, true) AS changed FROM second"),
    crawl_counters=Query(
        crawl_counters,
        f"""{_SECOND_SQL}, c AS (SELECT page_id % 4 AS run, page_id % 19 = 0 AS blocked, status, coalesce(distance > 3, true) AS changed FROM second)
        SELECT run, count_if(NOT blocked AND status < 400) AS fetched, count_if(blocked) AS blocked, count_if(NOT blocked AND status >= 400) AS errors,
          count_if(NOT blocked AND status < 400 AND changed) AS changed, count_if(NOT blocked AND status < 400 AND NOT changed) AS unchanged FROM c GROUP BY 1""",
    ),
    snapshot_append=Query(
        snapshot_append,
        """WITH d AS (SELECT source AS tenant_id, sha256(coalesce(text, '')) AS content_hash, doc_id FROM documents)
        SELECT DISTINCT tenant_id, content_hash FROM d WHERE doc_id % 6 <> 0 AND (tenant_id, content_hash) NOT IN (SELECT tenant_id, content_hash FROM d WHERE doc_id % 4 = 0)""",
    ),
    content_inventory=Query(content_inventory, f"WITH {INVENTORY_SQL} SELECT *, {_VERDICT} FROM inventory"),
    content_flag_counts=Query(content_flag_counts, f"WITH {INVENTORY_SQL} SELECT site, flag, count(*) AS n FROM (SELECT site, unnest(string_split(flags, ',')) AS flag FROM inventory) WHERE flag <> '' GROUP BY ALL"),
    scored_opportunities=Query(scored_opportunities, f"WITH {OPPORTUNITIES_SQL} SELECT site, check_code, type, action_class, url, url_pattern, score, priority, opportunity_key FROM opportunities"),
    crawl_frontier=Query(
        crawl_frontier,
        f"""WITH u AS (SELECT {HOST.format("url")} AS site, url, page_id AS ordinal FROM pages UNION ALL SELECT DISTINCT {HOST.format("url")}, 'https://' || {HOST.format("url")}, -1 FROM pages),
        f AS (SELECT site, {NORM.format("url")} AS norm, min(ordinal) AS ordinal FROM u GROUP BY ALL)
        SELECT site, norm, row_number() OVER (PARTITION BY site ORDER BY ordinal, norm) AS place FROM f QUALIFY place <= 3""",
    ),
)
