"""The chain of jobs that events start: a finished crawl is checked, its content sorted and its links made a graph; issues become
opportunities, and opportunities of the first two priorities plans.

Each consumer runs its job once for all sites (payloads) of a pass and replaces these sites' rows in a table of its own, so an event that
comes twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import content, graph, opportunities, planning, technical
from ..sources.kept import KeyedTable
from .events import Consumers

RESULTS = ("findings", "content", "nodes", "edges", "opportunities", "plans")


class CrawlChain:
    """The consumers over written facts(site, .., updated_on), sitemap(site, url), sites and evidence(url, evidence_id) tables.

    ``now`` is the day of the run, ``own_types`` the opportunity types (an array) that a site lets run alone.
    """

    def __init__(self, facts: DataFrame, sitemap: DataFrame, sites: DataFrame, evidence: DataFrame, folder: str, now: Column, own_types: Column):
        self.facts, self.sitemap, self.sites, self.evidence, self.now, self.own_types = facts, sitemap, sites, evidence, now, own_types
        self.tables = {name: KeyedTable(facts.sparkSession, f"{folder}/{name}", ["site"], 16) for name in RESULTS}

    def consumers(self) -> Consumers:
        c = Consumers()
        c.register("technical", "crawl.completed", self.technical)
        c.register("content", "crawl.completed", self.content)
        c.register("graph", "crawl.completed", self.graph)
        c.register("opportunities", "seo.issue.detected", self.opportunities)
        c.register("plans", "opportunity.created", self.plans)
        return c

    def _write(self, name: str, rows: DataFrame, events: DataFrame, emits: str | None = None) -> DataFrame:
        """Replace the rows of the events' sites; an event goes on as ``emits`` if its site has any."""
        sites = events.select(F.col("payload").alias("site"))
        table = self.tables[name].replace(rows, sites)
        done = events.select("event_id", "payload", F.lit(True).alias("ok"))
        if emits is None:
            return done.drop("payload")
        some = table.select(F.col("site").alias("payload"), F.lit(emits).alias("emits")).distinct()
        return done.join(some, "payload", "left").drop("payload")

    def _of(self, table: DataFrame, events: DataFrame) -> DataFrame:
        return table.join(events.select(F.col("payload").alias("site")).distinct(), "site", "left_semi")

    def _read(self, name: str, events: DataFrame) -> DataFrame | None:
        table = self.tables[name].read()
        return None if table is None else self._of(table, events)

    def technical(self, events: DataFrame) -> DataFrame:
        if events.isEmpty():
            return events.select("event_id", F.lit(True).alias("ok"))
        found = technical.site_findings(self._of(self.facts, events), self._of(self.sitemap, events), self._of(self.sites, events))
        return self._write("findings", found, events, "seo.issue.detected")

    def content(self, events: DataFrame) -> DataFrame:
        if events.isEmpty():
            return events.select("event_id", F.lit(True).alias("ok"))
        facts = self._of(self.facts, events)
        items = content.inventory(content.with_types(facts), technical.in_degrees(technical.internal_links(facts)), self.now)
        return self._write("content", items, events)

    def graph(self, events: DataFrame) -> DataFrame:
        if events.isEmpty():
            return events.select("event_id", F.lit(True).alias("ok"))
        live = self._of(self.facts, events).where("http_status = 200")
        page = lambda site, url: graph.node_id(site, F.lit("Page"), tx.content_hash(url))
        rows = live.select(F.col("site").alias("project_id"), F.lit("Page").alias("type"), tx.content_hash(F.col("final_url")).alias("ref_id"), F.col("final_url").alias("label"), F.col("page_id").alias("ordinal"))
        nodes = graph.nodes(rows)
        links = live.select("site", "page_id", F.col("final_url").alias("url"), F.explode("internal_links").alias("to"))
        edges = graph.edges(links.select(page(F.col("site"), F.col("url")).alias("src"), page(F.col("site"), F.col("to")).alias("dst"), F.lit("links_to").alias("relation"), F.lit(1.0).alias("weight"), F.lit(None).cast("int").alias("position"), F.col("page_id").alias("ordinal")), nodes)
        site_of = nodes.select(F.col("id").alias("src"), F.col("project_id").alias("site"))
        self._write("nodes", nodes.withColumnRenamed("project_id", "site"), events)
        return self._write("edges", edges.join(site_of, "src"), events)

    def opportunities(self, events: DataFrame) -> DataFrame:
        if events.isEmpty() or (found := self._read("findings", events)) is None:
            return events.select("event_id", F.lit(True).alias("ok"))
        rows = opportunities.with_evidence(opportunities.from_findings(found), self.evidence).where("evidence_id is not null")
        rows = opportunities.folded(rows.withColumn("ordinal", F.struct(F.col("severity_rank").cast("int").alias("severity_rank"), "check_code", "page_id")))
        return self._write("opportunities", rows, events, "opportunity.created")

    def plans(self, events: DataFrame) -> DataFrame:
        if events.isEmpty() or (found := self._read("opportunities", events)) is None:
            return events.select("event_id", F.lit(True).alias("ok"))
        rows = found.where("priority in ('P0', 'P1')").withColumn("id", F.concat_ws("|", "site", "opportunity_key"))
        plans = planning.draft_plans(rows, self.own_types).withColumn("site", F.split_part("id", F.lit("|"), F.lit(1)))
        return self._write("plans", plans, events)
