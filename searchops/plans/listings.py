"""Queries that list and report what the other queries make, and the ledgers they append to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import content, graph, keywords, opportunities, reports
from ..sources.tables import append_by_day, keeper, shared_root
from . import actions, analytics, lifecycle
from .registry import QUERIES, Query


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def issue_listing(spark: SparkSession, sf: str) -> DataFrame:
    return reports.open_issues(lifecycle.issue_lifecycle(spark, sf), severity="O").select("o_custkey", "o_orderpriority", "status", "seen_count")


def newest_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    return reports.newest(analytics.metric_anomalies(spark, sf).select("series", "day", "direction", "magnitude_pct"), "day", 20, "series")


def loop_summary(spark: SparkSession, sf: str) -> DataFrame:
    one, _ = actions.of_this_run(spark, sf)
    plans = actions.drafts(one).select(F.split_part("id", F.lit("|"), F.lit(1)).alias("site"), "requires_approval")
    return reports.loop_summary(plans, opportunities.upsert(actions.known(spark, one), one))


def cluster_overview(spark: SparkSession, sf: str) -> DataFrame:
    """Parts' names as clusters of their wordings, the largest 20 by volume, size and name, and how many keywords there are."""
    t = analytics.terms(spark, sf).select("term", "volume", F.regexp_extract("term", "(cold|hot|red|blue|green|small|large|[a-z]+) [a-z]+ [a-z]+$", 1).alias("seed"))
    seed = t.groupBy("seed").agg(F.min("term").alias("first"))
    members = keeper(spark)(t.join(seed, "seed").select("term", "volume", F.col("first").alias("seed")))
    first = keywords.intents(analytics.terms(spark, sf)).where("rank = 1").select("term", "intent")
    rows = keywords.cluster_rollup(members, first).withColumn("intents", F.array_join("intents", ","))
    n = members.agg(F.count("*").alias("n_keywords"))
    return rows.orderBy(F.desc("volume_sum"), F.desc("size"), "name").limit(20).crossJoin(F.broadcast(n))  # one row


def executive_report(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of one project: the last month's orders, its priority opportunities, the newest orders as changes, AI visibility."""
    project = F.lit("p").alias("project")
    report = analytics.period_report(spark, sf)
    metrics = report.groupBy("series").agg(F.max_by(F.struct("current", "prior", "change_pct", "arrow"), "month").alias("m")).select(project, "series", "m.*")
    best = actions.best_opportunities(spark, sf).select(project, F.lit("P1").alias("priority"), F.lit("fix").alias("type"), F.left("opportunity_key", F.lit(20)).alias("title"), "score")
    changes = _t(spark, sf, "orders").select(project, F.col("o_orderkey").cast("string").alias("target"), F.col("o_orderstatus").alias("state"), (F.col("o_orderkey") % 2 == 0).alias("verified"), F.to_date("o_orderdate").alias("applied_at"))
    visible = analytics.ai_visibility(spark, sf).groupBy("provider").agg(F.floor(F.max("score")).cast("double").alias("score")).select(project, "provider", "score")
    return reports.executive_sections(metrics, best, changes, visible).drop("project")


def oldest_unpublished(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "events").where("event_id % 3 <> 0").orderBy("ts", "event_id").limit(100).select("event_id", "ts", "event_type")


def opportunity_plans(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as plans of their order, the newest first."""
    lines = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", F.to_date("l_shipdate").alias("created_on"))
    orders = _t(spark, sf, "orders").select("o_orderkey").hint("merge")  # a broadcast is chosen by the file's size, and its rows take far more memory
    rows = lines.join(orders, "o_orderkey", "left_semi")  # dealt by order, as the ranks are
    return reports.ranked(rows, "o_orderkey", [F.desc("created_on"), "l_linenumber", "l_partkey"])


def content_item_upsert(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").select("source", F.sha2(F.col("doc_id").cast("string"), 256).alias("url_hash"), "doc_id", "n_chars")
    old = d.where("doc_id % 3 <> 1").select("source", "url_hash", (F.col("n_chars") - 1).alias("n_chars"))
    new = d.where("doc_id % 2 = 0").select("source", "url_hash", F.when(F.col("doc_id") % 4 == 0, F.col("n_chars")).alias("n_chars"))
    return content.upsert_items(old, new, ["source", "url_hash"])


def usage_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Events appended to a ledger by day in two runs, counted by partition."""
    path = f"{shared_root(spark)}/searchops/ledger-{uuid.uuid4().hex}"
    e = _t(spark, sf, "events").select("event_id", "ts", "value")
    for run in (0, 1):
        append_by_day(e.where(F.col("event_id") % 2 == run), path, "ts")
    return spark.read.parquet(path).groupBy("day").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 2).alias("cost"))


def graph_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return graph.lookup(actions.knowledge(spark, sf)[0], "p", "Topic", "cold-widget")


def redacted_known(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a token of their own that is known, and a short one that is no secret."""
    token = F.md5(F.col("doc_id").cast("string"))
    d = _t(spark, sf, "documents").select("doc_id", F.concat_ws(" ", "text", token, F.lit("short")).alias("text"), F.array(token, F.lit("short")).alias("known"))
    out = d.withColumn("redacted", tx.redact(F.col("text"), F.col("known")))
    return out.select("doc_id", F.sha2("redacted", 256).alias("redacted_sha256"), tx.is_clean(F.col("text"), F.col("known")).alias("was_clean"), tx.is_clean(F.col("redacted"), F.col("known")).alias("is_clean"))


_ISSUES = lifecycle.QUERIES["issue_lifecycle"].sql
_ANOMALIES = QUERIES["metric_anomalies"].sql
_LINES = "string_agg({line}, chr(10) ORDER BY {order}) || chr(10)"


def _table(headers: list[str], cells: list[str], order: str, rows: str) -> str:
    head = "'| " + " | ".join(headers) + " |' || chr(10) || '|" + "|".join("---" for _ in headers) + "|' || chr(10) || "
    return "SELECT " + head + _LINES.format(line="'| ' || concat_ws(' | ', " + ", ".join(cells) + ") || ' |'", order=order) + f" AS markdown FROM {rows}"


_SIGN = "CASE arrow WHEN 'up' THEN '▲' WHEN 'down' THEN '▼' ELSE '▬' END"
_EXECUTIVE = f"""WITH report AS ({QUERIES["period_report"].sql}), best AS ({QUERIES["best_opportunities"].sql}), seen AS ({QUERIES["ai_visibility"].sql}),
  m AS (SELECT * FROM report QUALIFY row_number() OVER (PARTITION BY series ORDER BY month DESC) = 1),
  o AS (SELECT left(opportunity_key, 20) AS title, score FROM best ORDER BY score DESC, title LIMIT 15),
  c AS (SELECT o_orderkey::VARCHAR AS target, o_orderstatus AS state, o_orderkey % 2 = 0 AS verified, CAST(o_orderdate AS DATE) AS applied_at FROM orders ORDER BY applied_at DESC, target LIMIT 15),
  v AS (SELECT provider, floor(max(score)) AS score FROM seen GROUP BY 1)
  SELECT 'performance' AS section, * FROM ({_table(["Metric", "Current", "Prior", "Change"], ["series", "printf('%.1f', current)", "printf('%.1f', prior)", f"{_SIGN} || printf(' %+.1f%%', change_pct)"], "series", "m")})
  UNION ALL SELECT 'opportunities', * FROM ({_table(["Priority", "Type", "Title", "Score"], ["'P1'", "'fix'", "title", "printf('%.0f', score)"], "score DESC, title", "o")}) WHERE markdown IS NOT NULL
  UNION ALL SELECT 'changes', * FROM ({_table(["Target", "State", "Verified", "Applied"], ["target", "state", "CASE WHEN verified THEN '✓' ELSE '—' END", "applied_at::VARCHAR"], "applied_at DESC, target", "c")})
  UNION ALL SELECT 'ai_visibility', * FROM ({_table(["Provider", "Visibility score (0-100)"], ["provider", "printf('%.1f', score)"], "provider", "v")})"""

QUERIES.update(
    issue_listing=Query(issue_listing, f"SELECT o_custkey, o_orderpriority, status, seen_count FROM ({_ISSUES}) WHERE status IN ('open', 'regressed') AND severity = 'O'"),
    newest_anomalies=Query(newest_anomalies, f"SELECT series, day, direction, magnitude_pct FROM ({_ANOMALIES}) ORDER BY day DESC, series LIMIT 20"),
    loop_summary=Query(
        loop_summary,
        f"""WITH plans AS ({QUERIES["plan_drafts"].sql}), opps AS ({QUERIES["opportunity_upsert"].sql}),
        p AS (SELECT split_part(id, '|', 1) AS site, count_if(requires_approval) AS awaiting_approval FROM plans GROUP BY 1), o AS (SELECT site, count_if(priority IN ('P0', 'P1') AND status IN ('detected', 'planned', 'awaiting_approval')) AS priority_open FROM opps GROUP BY 1)
        SELECT site, coalesce(awaiting_approval, 0) AS awaiting_approval, coalesce(priority_open, 0) AS priority_open FROM p FULL OUTER JOIN o USING (site)""",
    ),
    cluster_overview=Query(
        cluster_overview,
        f"""WITH {analytics.TERMS_SQL}, intents AS ({QUERIES["keyword_intents"].sql}), f AS (SELECT term, intent FROM intents WHERE rank = 1),
        s AS (SELECT term, volume, min(term) OVER (PARTITION BY regexp_extract(term, '(cold|hot|red|blue|green|small|large|[a-z]+) [a-z]+ [a-z]+$', 1)) AS name FROM terms),
        g AS (SELECT name, count(*) AS size, sum(volume)::BIGINT AS volume_sum, array_to_string(list_sort(list(DISTINCT intent)), ',') AS intents, max(CASE WHEN term = name THEN intent END) AS primary_intent FROM s JOIN f USING (term) GROUP BY 1)
        SELECT name, left(regexp_replace(trim(lower(name)), '\\s+', '-', 'g'), 120) AS slug, size, volume_sum, intents, primary_intent, (SELECT count(*) FROM terms) AS n_keywords FROM g ORDER BY volume_sum DESC, size DESC, name LIMIT 20""",
    ),
    executive_report=Query(executive_report, _EXECUTIVE),
    oldest_unpublished=Query(oldest_unpublished, "SELECT event_id, ts, event_type FROM events WHERE event_id % 3 <> 0 ORDER BY ts, event_id LIMIT 100"),
    opportunity_plans=Query(
        opportunity_plans,
        "SELECT l_orderkey AS o_orderkey, l_linenumber, l_partkey, CAST(l_shipdate AS DATE) AS created_on, row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_shipdate AS DATE) DESC, l_linenumber, l_partkey) AS place FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)",
    ),
    content_item_upsert=Query(
        content_item_upsert,
        """SELECT source, sha256(doc_id::VARCHAR) AS url_hash, CASE WHEN doc_id % 4 = 0 THEN n_chars WHEN doc_id % 3 <> 1 THEN n_chars - 1 END AS n_chars, CASE WHEN doc_id % 3 = 1 THEN 'new' WHEN doc_id % 2 = 0 THEN 'updated' ELSE 'kept' END AS state
        FROM documents WHERE doc_id % 3 <> 1 OR doc_id % 2 = 0""",
    ),
    usage_ledger=Query(usage_ledger, "SELECT CAST(ts AS DATE) AS day, count(*) AS calls, round(sum(value), 2) AS cost FROM events GROUP BY 1"),
    graph_lookup=Query(graph_lookup, f"WITH {actions.GRAPH_SQL} SELECT * FROM nodes WHERE type = 'Topic' AND ref_id = 'cold-widget'"),
    redacted_known=Query(redacted_known, "SELECT doc_id, sha256(concat_ws(' ', text, '«REDACTED»', 'short')) AS redacted_sha256, false AS was_clean, true AS is_clean FROM documents"),
)
