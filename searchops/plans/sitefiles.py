"""Queries over robots, sitemap and llms.txt files that both engines write for the sites of ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls as ux
from ..operators import sitefiles
from ..sources.tables import keeper
from . import technical
from .registry import QUERIES, Query

#: Files of a site, in the SQL that both engines read.
ROBOTS = """concat(CASE WHEN length(site) % 2 = 0 THEN concat('# rules', chr(10), 'Disallow: /early', chr(10)) ELSE '' END,
  'User-agent: *', chr(10), CASE WHEN length(site) % 5 = 1 THEN concat('Disallow: /', chr(10), 'Crawl-delay: 2.5', chr(10)) ELSE concat('Disallow: /private', chr(10), 'Disallow:', chr(10)) END,
  CASE WHEN length(site) % 3 = 0 THEN concat('User-Agent: GPTBot # one', chr(13), chr(10), 'user-agent: CCBot', chr(10), 'disallow: /', chr(10), 'Allow: /', chr(10)) ELSE '' END,
  CASE WHEN length(site) % 4 = 0 THEN concat('User-agent: ClaudeBot', chr(10), 'Crawl-delay: x', chr(10), 'Disallow: /', chr(10), 'nonsense', chr(10)) ELSE '' END, 'Sitemap: https://', site, '/sitemap.xml')"""
LLMS = "CASE WHEN length(site) % 3 = 0 THEN NULL WHEN length(site) % 3 = 1 THEN concat(chr(10), '# Title', chr(10), '  - [a](b)') ELSE 'no title' END"
XML_HEAD = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'


#: Entries of a sitemap file, as the protocol allows no more than 50,000; a site's list is cut into files of this many.
ENTRIES = 1000


def files(spark: SparkSession, sf: str) -> DataFrame:
    """The files that a site has once."""
    return technical.sites(spark, sf).select("site", F.concat(F.lit("https://"), "site").alias("base_url"), F.expr(ROBOTS).alias("robots_txt"), F.expr(LLMS).alias("llms_txt"))


def sitemap_files(spark: SparkSession, sf: str) -> DataFrame:
    """site, base_url, sitemap_xml: the entries of a site by URL in files of ``ENTRIES``. Some sites serve a nested index or an error page in
    place of all, or leave ampersands bare; of some the first three quarters of the letters that one file of all entries would have came through.

    A URL's number and place among the letters are its own within a range of (site, url) after the sums of the ranges before: no
    task holds the list of a site.
    """
    base, n = F.concat(F.lit("https://"), "site"), F.length("site")
    entry = F.concat(F.lit("<url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url>"))
    listed = technical.sitemap(spark, sf).where("url is not null").where((n % 6 != 0) & (n % 12 != 3)).select("site", "url", entry.alias("entry"))
    placed = keeper(spark)(listed.repartitionByRange("site", "url").withColumn("part", F.spark_partition_id()))
    sums = placed.groupBy("site", "part").agg(F.count("*").alias("n"), F.sum(F.length("entry")).alias("letters"))
    before = Window.partitionBy("site").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # no more rows than there are ranges
    sums = sums.select("site", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("letters").over(before), F.lit(0)).alias("letters0"), F.sum("letters").over(Window.partitionBy("site")).alias("letters"))
    within = Window.partitionBy("site", "part").orderBy("url")
    rows = placed.join(sums, ["site", "part"])
    rows = rows.withColumns({"k": F.col("n0") + F.row_number().over(within) - 1, "end": F.col("letters0") + F.sum(F.length("entry")).over(within.rowsBetween(Window.unboundedPreceding, 0))})
    head, tail = F.lit(XML_HEAD), F.lit("</urlset>")
    came = F.floor((F.length(head) + F.col("letters") + F.length(tail)) * 3 / 4) - F.length(head)  # letters of entries
    cut = F.when(n % 6 == 1, F.left("entry", F.greatest(F.lit(0), F.length("entry") - F.greatest(F.lit(0), F.col("end") - came)).cast("int"))).otherwise(F.col("entry"))
    parts = rows.withColumns({"entry": cut, "file": F.floor(F.col("k") / ENTRIES)}).where("entry <> ''").groupBy("site", "file").agg(F.array_sort(F.collect_list(F.struct("k", "entry"))).alias("e"))
    whole = F.concat(head, F.array_join(F.transform("e", lambda x: x["entry"]), ""), F.when(n % 6 == 1, "").otherwise(tail))
    parts = parts.select("site", F.when(n % 6 == 2, F.replace(whole, F.lit("&amp;"), F.lit("&"))).otherwise(whole).alias("sitemap_xml"))
    nested = F.lit("<sitemapindex><sitemap><loc>/more.xml</loc></sitemap></sitemapindex>")
    error = F.lit("<!DOCTYPE html><html><head><title>Error</title><body><p>Not found<br>&nbsp; <a href=/>home</a>")
    broken = technical.sites(spark, sf).select("site", F.when(n % 6 == 0, nested).when(n % 12 == 3, error).alias("sitemap_xml")).where("sitemap_xml is not null")
    return parts.unionByName(broken).select("site", base.alias("base_url"), "sitemap_xml")


def robots_rules(spark: SparkSession, sf: str) -> DataFrame:
    return sitefiles.robots_lines(files(spark, sf))


def robots_sitemaps(spark: SparkSession, sf: str) -> DataFrame:
    return sitefiles.sitemaps_in_robots(files(spark, sf))


def crawler_access(spark: SparkSession, sf: str) -> DataFrame:
    return sitefiles.access(files(spark, sf))


def url_access(spark: SparkSession, sf: str) -> DataFrame:
    """Every page's path for every crawler; some sites shut out paths that pages have."""
    url = F.col("url")
    urls = spark.read.parquet(f"{sf}/pages.parquet").select(ux.host(url).alias("site"), ux.path(url).alias("path"))
    more = F.concat("robots_txt", F.lit("\nUser-agent: *\nDisallow: /none\n\nUser-agent: PerplexityBot\nDisallow: /de/\nDisallow: /en/1\nAllow: /en/12\nAllow: /de/\n"))
    return sitefiles.url_access(urls, files(spark, sf).withColumn("robots_txt", more))


def sitemap_entries(spark: SparkSession, sf: str) -> DataFrame:
    return sitefiles.sitemap_urls(sitemap_files(spark, sf))


def machine_readability(spark: SparkSession, sf: str) -> DataFrame:
    pages = technical.written_facts(spark, sf).select("site", "page_id", "schema_blocks")
    found = sitefiles.machine_readability(files(spark, sf), sitefiles.organizations(pages, F.when(F.length("site") % 2 == 0, "acme").otherwise("Other")))
    return found.select("site", F.array_join("issues", ",").alias("issues"))


LINES_SQL = rf"""files AS (SELECT DISTINCT {technical.HOST.format("url")} AS site FROM pages),
raws AS (SELECT site, unnest(list_zip(range(len(l)), l)) AS z FROM (SELECT site, regexp_split_to_array({ROBOTS}, '\r\n|[\r\n]') AS l FROM files)),
texts AS (SELECT site, z[1]::INT AS line_no, trim(regexp_replace(z[2], '#.*$', '')) AS text FROM raws),
fields AS (SELECT site, line_no, lower(trim(left(text, instr(text, ':') - 1))) AS field, trim(substring(text, instr(text, ':') + 1)) AS value FROM texts WHERE contains(text, ':')),
kept AS (SELECT *, lag(field) OVER (PARTITION BY site ORDER BY line_no) AS prior FROM fields WHERE field IN ('user-agent', 'allow', 'disallow', 'crawl-delay')),
lines AS (SELECT * FROM (SELECT site, line_no, field, value, CAST(sum(CASE WHEN field = 'user-agent' AND coalesce(prior, '') <> 'user-agent' THEN 1 ELSE 0 END) OVER (PARTITION BY site ORDER BY line_no) AS BIGINT) AS group_no FROM kept) WHERE group_no > 0)"""
ACCESS_SQL = f"""{LINES_SQL}, who AS (SELECT unnest({list(sitefiles.AI_CRAWLERS)}) AS agent),
every AS (SELECT site, agent FROM files, who),
picked AS (SELECT site, agent, coalesce((SELECT min(group_no) FROM lines l WHERE l.site = e.site AND field = 'user-agent' AND lower(value) = lower(agent)), (SELECT min(group_no) FROM lines l WHERE l.site = e.site AND field = 'user-agent' AND value = '*')) AS group_no FROM every e),
access AS (SELECT site, agent, coalesce((SELECT first(field = 'allow' ORDER BY length(value) DESC, field) FROM lines l WHERE l.site = p.site AND l.group_no = p.group_no AND field IN ('allow', 'disallow') AND value <> '' AND starts_with('/', value)), true) AS allowed,
  (SELECT last(try_cast(value AS DOUBLE) ORDER BY line_no) FROM lines l WHERE l.site = p.site AND l.group_no = p.group_no AND field = 'crawl-delay' AND try_cast(value AS DOUBLE) IS NOT NULL) AS crawl_delay FROM picked p)"""

QUERIES.update(
    robots_rules=Query(robots_rules, f"WITH {LINES_SQL} SELECT * FROM lines"),
    robots_sitemaps=Query(robots_sitemaps, f"SELECT DISTINCT {technical.HOST.format('url')} AS site, 'https://' || {technical.HOST.format('url')} || '/sitemap.xml' AS sitemap FROM pages"),
    crawler_access=Query(crawler_access, f"WITH {ACCESS_SQL} SELECT * FROM access"),
    url_access=Query(
        url_access,
        f"""WITH {LINES_SQL}, u AS (SELECT DISTINCT {technical.HOST.format("url")} AS site, {technical.PATH.format("url")} AS path FROM pages),
        e AS (SELECT site, path, agent, coalesce((SELECT min(group_no) FROM lines l WHERE l.site = u.site AND field = 'user-agent' AND lower(value) = lower(agent)), (SELECT min(group_no) FROM lines l WHERE l.site = u.site AND field = 'user-agent' AND value = '*')) AS group_no
          FROM u, (SELECT unnest({list(sitefiles.AI_CRAWLERS)}) AS agent) w)
        SELECT site, path, agent, CASE WHEN agent = 'PerplexityBot' THEN starts_with(path, '/en/12') OR NOT starts_with(path, '/en/1')
          ELSE coalesce((SELECT first(field = 'allow' ORDER BY length(value) DESC, field) FROM lines l WHERE l.site = e.site AND l.group_no = e.group_no AND field IN ('allow', 'disallow') AND value <> '' AND starts_with(path, value)), true) END AS allowed FROM e""",
    ),
    sitemap_entries=Query(
        sitemap_entries,
        f"""WITH {technical.SITES_SQL},
        whole AS (SELECT site, concat('{XML_HEAD}', string_agg(concat('<url><loc> ', replace(url, '&', '&amp;'), ' </loc></url>'), '' ORDER BY url), '</urlset>') AS xml FROM sitemap GROUP BY 1),
        served AS (SELECT site, CASE WHEN length(site) % 6 = 1 THEN left(xml, length(xml) * 3 // 4) WHEN length(site) % 6 = 2 THEN replace(xml, '&amp;', '&') ELSE xml END AS xml FROM whole WHERE length(site) % 6 <> 0 AND length(site) % 12 <> 3),
        locs AS (SELECT site, trim(unnest(regexp_extract_all(xml, '<loc>([^<]*)', 1))) AS loc FROM served)
        SELECT site, 'page' AS kind, CASE WHEN loc = '' THEN 'https://' || site WHEN regexp_matches(loc, '^https?:') THEN replace(regexp_replace(replace(loc, '&amp;', chr(1)), '&\\w*', '', 'g'), chr(1), '&') ELSE 'https://' || site || '/' || loc END AS url FROM locs
        UNION ALL SELECT site, 'sitemap', 'https://' || site || '/more.xml' FROM sites WHERE length(site) % 6 = 0""",
    ),
    machine_readability=Query(
        machine_readability,
        f"""WITH {technical.FACTS_SQL}, {ACCESS_SQL}, nodes AS (SELECT site, page_id, unnest(schema_blocks) AS b FROM facts),
        org AS (SELECT site, first(contains(lower(json_extract_string(b, '$.name')), CASE WHEN length(site) % 2 = 0 THEN 'acme' ELSE 'other' END) ORDER BY page_id) AS matches FROM nodes WHERE lower(json_extract_string(b, '$."@type"')) = 'organization' GROUP BY 1),
        blocked AS (SELECT site, string_agg('ai_crawler_blocked:' || agent, ',' ORDER BY agent) AS b FROM access WHERE NOT allowed GROUP BY 1)
        SELECT site, concat_ws(',', b, CASE WHEN matches IS NULL THEN 'no_organization_schema' WHEN NOT matches THEN 'organization_name_mismatch' END, CASE length(site) % 3 WHEN 0 THEN 'no_llms_txt' WHEN 2 THEN 'llms_txt_malformed' END) AS issues
        FROM files LEFT JOIN blocked USING (site) LEFT JOIN org USING (site)""",
    ),
)
