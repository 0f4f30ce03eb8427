"""Site files over all sites: robots rules and groups, crawler access, sitemaps, llms.txt, organization schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as ux
from ..functions.sitemaps import sitemap

#: Crawlers that feed AI answers.
AI_CRAWLERS = (
    "GPTBot", "ChatGPT-User", "OAI-SearchBot", "ClaudeBot", "Claude-Web", "anthropic-ai",
    "Google-Extended", "PerplexityBot", "CCBot", "Amazonbot", "Applebot-Extended",
)
#: Schema types of an organization.
ORGANIZATION = ("organization", "brand", "localbusiness", "corporation", "onlinebusiness")
SITEMAP_LINE = r"(?im)^\s*sitemap:\s*(\S+)"


def robots_lines(files: DataFrame) -> DataFrame:
    """site, line_no, field, value, group_no of files(site, robots_txt): user-agent, allow, disallow and crawl-delay lines.

    A user-agent line behind a directive starts a new group; directives before the first agent belong to none. One file is
    one row, so the window over its lines is bounded by it.
    """
    lines = files.select("site", F.posexplode(F.split("robots_txt", r"\r\n|[\r\n]")).alias("line_no", "raw"))
    text = F.trim(F.regexp_replace("raw", "#.*$", ""))
    at = F.instr("text", ":")
    rows = lines.select("site", "line_no", text.alias("text")).where(F.col("text").contains(":"))
    rows = rows.select("site", "line_no", F.lower(F.trim(F.left("text", at - 1))).alias("field"), F.trim(F.substring("text", at + 1, F.length("text"))).alias("value"))
    rows = rows.where(F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay"))
    w = Window.partitionBy("site").orderBy("line_no")
    agent = F.col("field") == "user-agent"
    starts = agent & (F.lag("field").over(w).isNull() | (F.lag("field").over(w) != "user-agent"))
    return rows.withColumn("starts", starts.cast("int")).withColumn("group_no", F.sum("starts").over(w)).drop("starts").where("group_no > 0")


def sitemaps_in_robots(files: DataFrame) -> DataFrame:
    return files.select("site", F.explode(F.regexp_extract_all("robots_txt", F.lit(SITEMAP_LINE), F.lit(1))).alias("sitemap"))


def _rules(files: DataFrame, agents: list[str] | tuple[str, ...]) -> DataFrame:
    """site, agent, field, value, line_no: the directives that apply to each agent.

    The first group that names the agent applies, else the first that names "*", and only that group.
    """
    lines = robots_lines(files)
    named = lines.where("field = 'user-agent'").select("site", "group_no", F.lower("value").alias("name"))
    every = F.array(*map(F.lit, agents))  # constant
    fits = F.when(F.col("name") == "*", every).otherwise(F.filter(every, lambda a: F.lower(a) == F.col("name")))
    fits = named.select("site", "group_no", "name", F.explode(fits).alias("agent"))
    own = F.min(F.when(F.col("name") != "*", F.col("group_no")))
    chosen = fits.groupBy("site", "agent").agg(F.coalesce(own, F.min("group_no")).alias("group_no"))
    return lines.where("field <> 'user-agent'").join(chosen, ["site", "group_no"])


def access(files: DataFrame, agents: list[str] | tuple[str, ...] = AI_CRAWLERS, path: str = "/") -> DataFrame:
    """site, agent, allowed, crawl_delay of every file and agent, for one path.

    The longest matching rule decides; of equal ones an allow. Without a rule, a group or a file a path is allowed.
    """
    every, rules = F.array(*map(F.lit, agents)), _rules(files, agents)
    allow = F.col("field") == "allow"
    applies = F.col("field").isin("allow", "disallow") & (F.col("value") != "") & F.lit(path).startswith(F.col("value"))
    got = rules.groupBy("site", "agent").agg(
        F.max_by(allow, F.when(applies, F.struct(F.length("value").alias("n"), allow.alias("first")))).alias("allowed"),
        F.max_by(F.expr("try_cast(value AS double)"), F.when((F.col("field") == "crawl-delay") & F.expr("try_cast(value AS double)").isNotNull(), F.col("line_no"))).alias("crawl_delay"),
    )
    pairs = files.select("site", F.explode(every).alias("agent"))
    return pairs.join(got, ["site", "agent"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))


def url_access(urls: DataFrame, files: DataFrame, agents: list[str] | tuple[str, ...] = AI_CRAWLERS) -> DataFrame:
    """site, path, agent, allowed of each of urls(site, path) for every agent, by the rules of ``access``.

    A path meets rules only as one of its own beginnings of a length that the site's rules have: an equi-join on site and beginning,
    whose longest hit decides. A hub site's paths are many rows of many keys.
    """
    rules = _rules(files, agents).where("field in ('allow', 'disallow') and value <> ''")
    rules = rules.groupBy("site", "agent", F.col("value").alias("prefix")).agg(F.bool_or(F.col("field") == "allow").alias("allow"))
    lengths = rules.groupBy("site").agg(F.collect_set(F.length("prefix")).alias("lengths"))  # no more than one file has
    urls = urls.select("site", "path").distinct()
    begins = urls.join(lengths, "site").select("site", "path", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    hits = begins.select("site", "path", F.col("path").substr(F.lit(1), F.col("n")).alias("prefix"), "n").join(rules, ["site", "prefix"])
    best = hits.groupBy("site", "path", "agent").agg(F.max_by("allow", "n").alias("allowed"))
    every = urls.select("site", "path", F.explode(F.array(*map(F.lit, agents))).alias("agent"))
    return every.join(best, ["site", "path", "agent"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))


def sitemap_urls(files: DataFrame) -> DataFrame:
    """site, kind ("page" or "sitemap"), url of files(site, base_url, sitemap_xml); a sitemap index gives nested sitemaps only.

    Files that are cut off or no good XML give what can be read of them (functions.sitemaps); none stops the job.
    """
    rows = files.select("site", "base_url", sitemap(F.col("sitemap_xml")).alias("read"))
    rows = rows.select("site", "base_url", F.when(F.col("read.is_index"), "sitemap").otherwise("page").alias("kind"), F.explode("read.locs").alias("loc"))
    return rows.select("site", "kind", ux.join(F.col("loc"), F.col("base_url")).alias("url")).where("url is not null")


def llms_txt(text: Column) -> Column:
    """null for no file; else whether it starts with a title and has a link line."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\r\n]"), lambda s: F.trim(s)), lambda s: s != "")
    titled = F.coalesce(F.get(lines, 0).startswith("# "), F.lit(False))
    return F.when(text.isNotNull(), titled & F.exists(lines, lambda s: s.startswith("- [") | s.startswith("[")))


def organizations(pages: DataFrame, brand: Column) -> DataFrame:
    """site, name_match, same_as of the first organization-like JSON-LD node of each site of pages(site, page_id, schema_blocks).

    Objects with an ``@graph`` list stand for its members; names match if either holds the other, a node without a name does not.
    """
    block = pages.select("site", "page_id", brand.alias("brand"), F.posexplode("schema_blocks").alias("i", "block"))
    graph = F.try_variant_get(F.try_parse_json("block"), "$['@graph']", "array<variant>")
    nodes = block.select("site", "page_id", "brand", "i", F.posexplode(F.coalesce(F.transform(graph, lambda v: F.to_json(v)), F.array("block"))).alias("j", "node"))
    kind = F.get_json_object("node", "$['@type']")
    kinds = F.transform(F.when(kind.startswith("["), F.from_json(kind, "array<string>")).otherwise(F.array(kind)), lambda t: F.lower(t))
    name, low = F.lower(F.trim(F.coalesce(F.get_json_object("node", "$.name"), F.lit("")))), F.lower(F.trim("brand"))
    same = F.get_json_object("node", "$.sameAs")
    found = nodes.where(F.arrays_overlap(kinds, F.array(*map(F.lit, ORGANIZATION)))).select(
        "site", F.struct("page_id", "i", "j").alias("at"), ((name != "") & (low.contains(name) | name.contains(low))).alias("name_match"), F.coalesce(~same.isin("", "[]", "{}"), F.lit(False)).alias("same_as")
    )
    return found.groupBy("site").agg(F.min_by(F.struct("name_match", "same_as"), "at").alias("o")).select("site", "o.*")


def machine_readability(files: DataFrame, organization: DataFrame) -> DataFrame:
    """site, issues of files(site, robots_txt, llms_txt): blocked crawlers, organization schema, llms.txt, in this order."""
    blocked = access(files).where("not allowed").groupBy("site").agg(F.array_sort(F.collect_list("agent")).alias("blocked"))  # at most one entry a crawler
    rows = files.select("site", llms_txt(F.col("llms_txt")).alias("formed")).join(blocked, "site", "left")
    rows = rows.join(organization.withColumn("present", F.lit(True)), "site", "left")
    none = F.array().cast("array<string>")
    issues = F.concat(
        F.transform(F.coalesce("blocked", none), lambda a: F.concat(F.lit("ai_crawler_blocked:"), a)),
        F.array_compact(F.array(
            F.when(F.col("present").isNull(), "no_organization_schema").when(~F.col("name_match"), "organization_name_mismatch"),
            F.when(F.col("present") & ~F.col("same_as"), "no_same_as_links"),
            F.when(F.col("formed").isNull(), "no_llms_txt").when(~F.col("formed"), "llms_txt_malformed"),
        )),
    )
    return rows.select("site", issues.alias("issues"))
