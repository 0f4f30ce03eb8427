"""Queries over orders, lineitem, part, events, documents and labels as issues, checks, evidence and vitals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import content, lifecycle
from .registry import QUERIES, Query


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def issue_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """Orders before 1998 are the known issues of a customer and priority, later ones a new run's findings."""
    keys = ["o_custkey", "o_orderpriority"]
    o = _t(spark, sf, "orders").select(*keys, "o_orderkey", "o_orderstatus", F.to_date("o_orderdate").alias("day"))
    status = F.when(F.max_by("o_orderstatus", F.struct("day", "o_orderkey")) == "F", "resolved").otherwise("open")
    own = [F.max("o_orderstatus").alias("severity"), F.max("o_orderkey").cast("string").alias("detail")]
    old = o.where("day < date '1998-01-01'").groupBy(*keys).agg(status.alias("status"), *own, F.min("day").alias("first_seen"), F.max("day").alias("last_seen"), F.count("*").alias("seen_count"))
    seen = o.where("day >= date '1998-01-01'").groupBy(*keys).agg(*own, F.max("day").alias("seen_on"))
    return lifecycle.upsert_issues(old, seen, keys)


def evidence_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as fetched evidence of two kinds, of which every fifth is known."""
    kind = F.when(F.col("doc_id") % 2 == 0, "crawl_page").otherwise("serp")
    rows = _t(spark, sf, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), kind.alias("kind"), "doc_id")
    return lifecycle.evidence_rows(rows, rows.where("doc_id % 5 = 0")).select("content_hash", "kind")


def change_verification(spark: SparkSession, sf: str) -> DataFrame:
    changes = _t(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    checks = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", "l_partkey", "l_returnflag").alias("place"), "l_returnflag")
    return lifecycle.with_first_verification(changes, checks, "o_orderkey", "place", "l_returnflag")


def evidence_gate(spark: SparkSession, sf: str) -> DataFrame:
    returned = _t(spark, sf, "lineitem").where("l_returnflag = 'R' and l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    return lifecycle.evidence_gate(_t(spark, sf, "part").select("p_partkey", "p_type"), returned, "p_partkey")


def judge_cross_check(spark: SparkSession, sf: str) -> DataFrame:
    rule = (100 - F.least(F.lit(100), F.regexp_count("text", F.lit(r"(!!|\|)")) * 5)).alias("rule_score")
    rows = _t(spark, sf, "documents").select("doc_id", rule).join(_t(spark, sf, "labels").select("doc_id", (F.col("quality") * 100).alias("model_score")), "doc_id", "left")
    return rows.withColumn("score", lifecycle.cross_checked(F.col("rule_score"), F.col("model_score")))


#: Landed rows of orders as the SQL of both engines writes them: domain, keyword, dates and score as text.
LANDED = {
    "domain": "CASE WHEN o_orderkey % 5 = 0 THEN 'no domain' WHEN o_orderkey % 3 = 0 THEN 'https://shop.example.com/' ELSE 'example.com' END",
    "keyword": "CASE WHEN o_orderkey % 7 = 0 THEN ' ' WHEN o_orderkey % 11 = 0 THEN repeat('long ', 50) ELSE o_orderpriority END",
    "start_on": "CASE WHEN o_orderkey % 13 = 0 THEN 'yesterday' ELSE '2024-03-01' END",
    "end_on": "CASE WHEN o_orderkey % 17 = 0 THEN '2024-02-29' WHEN o_orderkey % 19 = 0 THEN '2026-03-01' ELSE '2024-12-31' END",
    "score": "CASE WHEN o_orderkey % 23 = 0 THEN 'high' ELSE CAST(o_orderkey % 130 AS STRING) END",
}


def row_validation(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "orders").select("o_orderkey", *(F.expr(x).alias(n) for n, x in LANDED.items()))
    good, bad = lifecycle.split_valid(rows, lifecycle.validity(*map(F.col, LANDED)))
    return good.select(F.lit("").alias("reasons")).unionByName(bad.select("reasons")).groupBy("reasons").agg(F.count("*").alias("n"))


def vitals_ratings(spark: SparkSession, sf: str) -> DataFrame:
    means = _t(spark, sf, "events").groupBy("user_id").agg(*(F.round(F.avg(F.when(F.col("event_type") == kind, F.col("value") * scale)), 6).alias(name) for kind, name, scale in SCALES))
    tall = means.unpivot("user_id", [name for _, name, _ in SCALES], "metric", "value")
    return lifecycle.rate_vitals(tall)


#: Stand-ins: event type, metric, factor.
SCALES = (("view", "lcp_ms", 60.0), ("click", "inp_ms", 8.0), ("error", "cls", 0.004), ("signup", "ttfb_ms", 25.0))


def fingerprint_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that occur more than once, with their first ten documents; no more than ten rows of a group meet in one task."""
    d = _t(spark, sf, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("fingerprint"), "doc_id")
    n = d.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1")
    first = content.first_per_group(d, "fingerprint", "doc_id", 10, "place").groupBy("fingerprint").agg(F.array_join(F.array_sort(F.collect_list("doc_id")), ",").alias("first_ids"))
    return n.join(first, "fingerprint")


def report_sections(spark: SparkSession, sf: str) -> DataFrame:
    """The 15 dearest orders of each priority, as the report lists the best of each section."""
    o = _t(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice", F.struct(-F.col("o_totalprice"), "o_orderkey").alias("by"))
    return content.first_per_group(o, "o_orderpriority", "by", 15, "place").drop("by")


QUERIES.update(
    issue_lifecycle=Query(
        issue_lifecycle,
        """WITH o AS (SELECT o_custkey, o_orderpriority, o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) AS day FROM orders),
        old AS (SELECT o_custkey, o_orderpriority, min(day) AS first_seen, max(day) AS last_seen, count(*) AS c, max(o_orderstatus) AS sev, max(o_orderkey)::VARCHAR AS det,
                  CASE WHEN last(o_orderstatus ORDER BY day, o_orderkey) = 'F' THEN 'resolved' ELSE 'open' END AS s FROM o WHERE day < DATE '1998-01-01' GROUP BY ALL),
        seen AS (SELECT o_custkey, o_orderpriority, max(day) AS seen_on, max(o_orderstatus) AS new_sev, max(o_orderkey)::VARCHAR AS new_det FROM o WHERE day >= DATE '1998-01-01' GROUP BY ALL)
        SELECT o_custkey, o_orderpriority, CASE WHEN s IS NULL THEN 'open' WHEN seen_on IS NOT NULL AND s = 'resolved' THEN 'regressed' ELSE s END AS status, CASE WHEN seen_on IS NOT NULL THEN new_sev ELSE sev END AS severity, CASE WHEN seen_on IS NOT NULL THEN new_det ELSE det END AS detail,
          coalesce(first_seen, seen_on) AS first_seen, coalesce(seen_on, last_seen) AS last_seen, coalesce(c, 0) + CASE WHEN seen_on IS NULL THEN 0 ELSE 1 END AS seen_count
        FROM old FULL OUTER JOIN seen USING (o_custkey, o_orderpriority)""",
    ),
    evidence_rows=Query(
        evidence_rows,
        """WITH e AS (SELECT sha256(coalesce(text, '')) AS content_hash, CASE WHEN doc_id % 2 = 0 THEN 'crawl_page' ELSE 'serp' END AS kind, doc_id FROM documents)
        SELECT content_hash, kind FROM e GROUP BY ALL HAVING count_if(doc_id % 5 = 0) = 0""",
    ),
    change_verification=Query(
        change_verification,
        """WITH f AS (SELECT l_orderkey AS o_orderkey, first(l_returnflag ORDER BY l_linenumber, l_partkey, l_returnflag) AS first_result, count(*) AS n_checks FROM lineitem GROUP BY 1)
        SELECT o_orderkey, o_orderstatus, first_result, coalesce(n_checks, 0) AS n_checks FROM orders LEFT JOIN f USING (o_orderkey)""",
    ),
    evidence_gate=Query(evidence_gate, "SELECT p_partkey, p_type, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45) AS accepted FROM part"),
    judge_cross_check=Query(
        judge_cross_check,
        r"""WITH r AS (SELECT doc_id, 100 - least(100, 5 * len(regexp_extract_all(text, '(!!|\|)'))) AS rule_score, quality * 100 AS model_score FROM documents LEFT JOIN labels USING (doc_id))
        SELECT *, CASE WHEN model_score IS NULL OR abs(model_score - rule_score) > 30 THEN rule_score ELSE model_score END AS score FROM r""",
    ),
    row_validation=Query(
        row_validation,
        f"""WITH r AS (SELECT {", ".join(f"{x} AS {n}" for n, x in LANDED.items())} FROM orders), d AS (SELECT *, try_cast(CASE WHEN regexp_matches(start_on, '^\\d{{4}}-\\d\\d-\\d\\d$') THEN start_on END AS DATE) AS a, try_cast(end_on AS DATE) AS b FROM r)
        SELECT concat_ws(',', CASE WHEN NOT regexp_matches(trim(trim(domain), '/'), '{lifecycle.DOMAIN}') THEN 'domain' END, CASE WHEN NOT length(trim(keyword)) BETWEEN 1 AND 200 THEN 'keyword' END,
          CASE WHEN NOT coalesce(date_diff('day', a, b) BETWEEN 0 AND 370, false) THEN 'date_range' END, CASE WHEN NOT coalesce(try_cast(score AS DOUBLE) BETWEEN 0 AND 100, false) THEN 'score' END) AS reasons, count(*) AS n FROM d GROUP BY 1""",
    ),
    vitals_ratings=Query(
        vitals_ratings,
        "WITH m AS (" + " UNION ALL ".join(f"SELECT user_id, '{name}' AS metric, round(avg(value * CAST({scale} AS DOUBLE)) FILTER (event_type = '{kind}'), 6) AS value, {good} AS good, {poor} AS poor FROM events GROUP BY user_id" for (kind, name, scale), (_, good, poor) in zip(SCALES, lifecycle.VITALS, strict=True)) + ") "
        "SELECT user_id, metric, value, CASE WHEN value <= good THEN 'good' WHEN value <= poor THEN 'needs_improvement' WHEN value IS NOT NULL THEN 'poor' END AS rating FROM m",
    ),
    fingerprint_groups=Query(
        fingerprint_groups,
        """WITH d AS (SELECT sha256(coalesce(text, '')) AS fingerprint, doc_id, row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) AS place FROM documents)
        SELECT fingerprint, count(*) AS n, string_agg(doc_id, ',' ORDER BY doc_id) FILTER (place <= 10) AS first_ids FROM d GROUP BY 1 HAVING count(*) > 1""",
    ),
    report_sections=Query(
        report_sections,
        "SELECT o_orderpriority, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 15",
    ),
)
