"""Queries over ``events`` and ``orders`` read as streams of files."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as ux
from ..operators import fingerprints, metrics
from ..sources.tables import shared_root
from ..streaming import chain, events
from . import actions, technical
from .registry import QUERIES, Query
from .technical import PRINTS_SQL


def _folder(spark: SparkSession) -> str:
    """A folder of this run; a job that goes on from run to run names one of its own."""
    return f"{shared_root(spark)}/searchops/stream-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of files: a stream's path may be a file only where it is a pattern."""
    schema = spark.read.parquet(f"{sf}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{table}.parque[t]")


def _folded(stream: DataFrame, folder: str, keys: list[str], arriving: Callable[[DataFrame], DataFrame], step: Callable[[DataFrame | None, DataFrame], DataFrame]) -> DataFrame:
    """The folded table; one without rows if none ever came."""
    got = events.folded_table(stream, folder, keys, arriving, step)
    return step(None, arriving(stream.sparkSession.createDataFrame([], stream.schema))) if got is None else got


def event_stream_hours(spark: SparkSession, sf: str) -> DataFrame:
    return events.hourly_counts(_stream(spark, sf, "events"), _folder(spark)).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


def consumers() -> events.Consumers:
    """An audit that takes every event, a ledger that fails for good on every 50th and once on every 20th, and a chain: a signup
    is an issue, an issue an opportunity."""
    c = events.Consumers()
    n = F.pmod(F.col("event_id"), F.lit(50))
    for kind in ("view", "click", "purchase", "signup", "error"):
        c.register("audit", kind, lambda rows: rows.select("event_id", F.lit(True).alias("ok")))
    flaky = ~((n == 0) | ((F.pmod(F.col("event_id"), F.lit(20)) == 1) & (F.col("attempts") == 0)))
    c.register("ledger", "purchase", lambda rows: rows.select("event_id", flaky.alias("ok")))
    c.register("issues", "signup", lambda rows: rows.select("event_id", F.lit(True).alias("ok"), F.lit("seo.issue.detected").alias("emits")))
    c.register("opportunities", "seo.issue.detected", lambda rows: rows.select("event_id", F.lit(True).alias("ok"), F.lit("opportunity.created").alias("emits")))
    c.register("plans", "opportunity.created", lambda rows: rows.select("event_id", F.lit(True).alias("ok")))
    return c


def event_relay(spark: SparkSession, sf: str) -> DataFrame:
    """All open events a pass: the number of passes is that of the chain's tries, not of the events."""
    stream = _stream(spark, sf, "events").select("event_id", "event_type", F.col("ts").alias("created_at"))
    return events.relay(stream, _folder(spark), consumers(), limit=None)


def event_relay_counts(spark: SparkSession, sf: str) -> DataFrame:
    return event_relay(spark, sf).groupBy("event_type", "consumer", "outcome").agg(F.count("*").alias("n"), F.max("attempts").alias("most_attempts"))


def event_relay_passes(spark: SparkSession, sf: str) -> DataFrame:
    return events.relay_counters(event_relay(spark, sf)).withColumn("pass", F.col("pass").cast("long"))


def metric_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Events a day and type as metric rows that arrive and replace what is there."""
    keys = ["series", "day"]

    def arriving(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("value"))

    def step(table: DataFrame | None, new: DataFrame) -> DataFrame:
        return new if table is None else metrics.upsert(table, new, keys).drop("state")

    return _folded(_stream(spark, sf, "events"), _folder(spark), keys, arriving, step)


def page_states(table: DataFrame | None, new: DataFrame) -> DataFrame:
    """url_hash, fingerprint, changes: the last fingerprint of each URL, and how often it was new or changed."""
    if table is None:
        return new.withColumn("changes", F.lit(1))
    both = new.join(table.withColumnRenamed("fingerprint", "old"), "url_hash", "full_outer")
    moved = F.col("fingerprint").isNotNull() & fingerprints.changed(F.col("old"), F.col("fingerprint"))
    return both.select("url_hash", F.when(moved, F.col("fingerprint")).otherwise(F.col("old")).alias("fingerprint"), (F.coalesce("changes", F.lit(0)) + moved.cast("int")).alias("changes"))


def arriving_pages(rows: DataFrame) -> DataFrame:
    """The last text of each document that arrives; its fingerprint is made in the same map."""
    one = rows.select(F.col("doc_id").alias("url_hash"), fingerprints.simhash(F.col("text")).alias("fingerprint"))
    return one.groupBy("url_hash").agg(F.max("fingerprint").alias("fingerprint"))


def crawl_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as arriving pages: the last fingerprint of each is kept, with the number of times it changed."""
    return _folded(_stream(spark, sf, "documents"), _folder(spark), ["url_hash"], arriving_pages, page_states)


def event_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Every site's crawl is finished; how many rows the jobs that follow have made of it."""
    facts = technical.written_facts(spark, sf).withColumn("updated_on", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 1000).cast("int")))
    own = F.when(F.length("site") % 2 == 0, F.array(F.lit("fix_canonical"))).otherwise(F.array(F.lit("add_schema")))
    jobs = chain.CrawlChain(facts, technical.sitemap(spark, sf), technical.sites(spark, sf), actions.evidence(spark, sf), _folder(spark), F.lit("2026-06-01").cast("date"), own)
    site = ux.host(F.col("url"))
    crawls = _stream(spark, sf, "pages").select(F.xxhash64(site).alias("event_id"), F.lit("crawl.completed").alias("event_type"), F.lit("2026-03-01").cast("timestamp").alias("created_at"), site.alias("payload"))
    ended = events.relay(crawls, _folder(spark), jobs.consumers(), limit=None)
    out = ended.where("consumer in ('technical', 'content', 'graph', 'opportunities')").groupBy(F.col("payload").alias("site")).agg(F.count_if(F.col("outcome") == "ok").alias("n_ok"))
    for name in ("findings", "content", "nodes", "opportunities", "plans"):
        table = jobs.tables[name].read()
        n = (out.select("site").limit(0) if table is None else table).groupBy("site").agg(F.count("*").alias(f"n_{name}"))
        out = out.join(n, "site", "left")
    return out.na.fill(0)


QUERIES.update(
    event_stream_hours=Query(event_stream_hours, "SELECT date_trunc('hour', ts) AS hour, event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1, 2"),
    event_relay_counts=Query(
        event_relay_counts,
        """WITH e AS (SELECT DISTINCT event_id, event_type FROM events), p AS (SELECT event_id FROM e WHERE event_type = 'purchase'), s AS (SELECT count(*) AS n FROM e WHERE event_type = 'signup')
        SELECT * FROM (SELECT event_type, 'audit' AS consumer, 'ok' AS outcome, count(*) AS n, 0 AS most_attempts FROM e GROUP BY 1
        UNION ALL SELECT 'purchase', 'ledger', 'ok', count(*), coalesce(max(CASE WHEN event_id % 20 = 1 THEN 1 ELSE 0 END), 0) FROM p WHERE event_id % 50 <> 0
        UNION ALL SELECT 'purchase', 'ledger', 'failed', CAST(count_if(event_id % 50 = 0) * 4 + count_if(event_id % 50 <> 0 AND event_id % 20 = 1) AS BIGINT), CASE WHEN count_if(event_id % 50 = 0) > 0 THEN 4 ELSE 1 END FROM p
        UNION ALL SELECT 'purchase', 'ledger', 'dead_letter', count(*), 5 FROM p WHERE event_id % 50 = 0
        UNION ALL SELECT 'signup', 'issues', 'ok', n, 0 FROM s UNION ALL SELECT 'seo.issue.detected', 'opportunities', 'ok', n, 0 FROM s UNION ALL SELECT 'opportunity.created', 'plans', 'ok', n, 0 FROM s) WHERE n > 0""",
    ),
    event_relay_passes=Query(
        event_relay_passes,
        """WITH e AS (SELECT DISTINCT event_id, event_type FROM events), tries AS (
          SELECT 0 AS pass, event_id, 'ok' AS outcome FROM e UNION ALL SELECT 0, event_id, 'ok' FROM e WHERE event_type = 'signup'
          UNION ALL SELECT CAST(i AS INT), event_id, CASE WHEN event_id % 50 = 0 THEN CASE WHEN i = 4 THEN 'dead_letter' ELSE 'failed' END WHEN event_id % 20 = 1 AND i = 0 THEN 'failed' ELSE 'ok' END
            FROM e, range(5) r(i) WHERE event_type = 'purchase' AND i <= CASE WHEN event_id % 50 = 0 THEN 4 WHEN event_id % 20 = 1 THEN 1 ELSE 0 END
          UNION ALL SELECT CAST(i AS INT), event_id, 'ok' FROM e, range(1, 3) r(i) WHERE event_type = 'signup')
        SELECT CAST(pass AS BIGINT) AS pass, count(DISTINCT event_id) AS scanned, count_if(outcome = 'ok') AS delivered, count_if(outcome <> 'ok') AS failed, count_if(outcome = 'dead_letter') AS dead_lettered FROM tries GROUP BY 1""",
    ),
    metric_stream=Query(metric_stream, "SELECT event_type AS series, CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1, 2"),
    crawl_stream=Query(
        crawl_stream,
        "WITH facts AS (SELECT doc_id AS page_id, text AS body_text FROM documents), "
        + PRINTS_SQL
        + " SELECT page_id AS url_hash, coalesce(fingerprint, '0000000000000000') AS fingerprint, 1 AS changes FROM facts LEFT JOIN prints USING (page_id)",
    ),
    event_chain=Query(
        event_chain,
        f"""WITH {technical.OPPORTUNITIES_SQL}, {technical.INVENTORY_SQL.split(technical.FACTS_SQL + ",", 1)[1]}, {actions.EVIDENCE_SQL},
        made AS (SELECT site, opportunity_key, last(priority ORDER BY severity_rank, check_code, page_id) AS priority FROM opportunities WHERE url IN (SELECT url FROM evidence) GROUP BY ALL),
        f AS (SELECT site, count(*) AS n FROM findings GROUP BY 1), c AS (SELECT site, count(*) AS n FROM inventory GROUP BY 1), n AS (SELECT site, count(DISTINCT url) AS n FROM facts WHERE http_status = 200 GROUP BY 1),
        o AS (SELECT site, count(*) AS n, count_if(priority IN ('P0', 'P1')) AS p FROM made GROUP BY 1)
        SELECT site, 3 + CASE WHEN f.n > 0 THEN 1 ELSE 0 END AS n_ok, coalesce(f.n, 0) AS n_findings, coalesce(c.n, 0) AS n_content, coalesce(n.n, 0) AS n_nodes, coalesce(o.n, 0) AS n_opportunities, coalesce(o.p, 0) AS n_plans
        FROM (SELECT DISTINCT site FROM facts) LEFT JOIN f USING (site) LEFT JOIN c USING (site) LEFT JOIN n USING (site) LEFT JOIN o USING (site)""",
    ),
)
