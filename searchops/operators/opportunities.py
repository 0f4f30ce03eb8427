"""Opportunities: findings and content signals mapped to actions, scored, keyed, gated by evidence, upserted and listed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Check code, opportunity type, action class, business impact, search impact, feasibility, risk.
ISSUES = (
    ("status_5xx", "fix_technical_issue", "HIGH_RISK_WRITE", 0.9, 0.9, 0.4, 0.5),
    ("status_4xx", "fix_technical_issue", "LOW_RISK_WRITE", 0.7, 0.7, 0.6, 0.3),
    ("noindex_on_indexable", "fix_technical_issue", "LOW_RISK_WRITE", 0.8, 0.9, 0.8, 0.2),
    ("canonical_not_self", "fix_canonical", "LOW_RISK_WRITE", 0.7, 0.8, 0.8, 0.2),
    ("canonical_missing", "fix_canonical", "LOW_RISK_WRITE", 0.5, 0.6, 0.9, 0.15),
    ("redirect_chain", "fix_technical_issue", "LOW_RISK_WRITE", 0.4, 0.5, 0.7, 0.25),
    ("title_missing", "fix_technical_issue", "LOW_RISK_WRITE", 0.6, 0.7, 0.9, 0.1),
    ("meta_desc_missing", "fix_technical_issue", "LOW_RISK_WRITE", 0.3, 0.4, 0.95, 0.1),
    ("h1_missing", "fix_technical_issue", "LOW_RISK_WRITE", 0.4, 0.5, 0.9, 0.1),
    ("schema_missing", "add_schema", "LOW_RISK_WRITE", 0.4, 0.5, 0.7, 0.2),
    ("img_missing_alt", "fix_technical_issue", "LOW_RISK_WRITE", 0.2, 0.3, 0.95, 0.05),
    ("broken_internal_link", "fix_technical_issue", "LOW_RISK_WRITE", 0.5, 0.6, 0.85, 0.15),
    ("orphan_page", "add_internal_links", "LOW_RISK_WRITE", 0.6, 0.7, 0.7, 0.2),
    ("thin_content", "improve_thin_content", "HIGH_RISK_WRITE", 0.6, 0.7, 0.4, 0.3),
    ("near_duplicate", "consolidate_cannibalization", "HIGH_RISK_WRITE", 0.6, 0.7, 0.4, 0.4),
    ("hreflang_no_self", "fix_technical_issue", "LOW_RISK_WRITE", 0.5, 0.6, 0.8, 0.2),
)
SEVERITY_CONFIDENCE = {"critical": 0.95, "high": 0.9, "medium": 0.8, "low": 0.65, "info": 0.5}


def priority_score(business: Column, seo: Column, confidence: Column, feasibility: Column, risk: Column) -> Column:
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return F.round(unit(business) * unit(seo) * unit(confidence) * unit(feasibility) / F.greatest(F.lit(0.05), F.least(F.lit(1.0), risk)) * 100, 3)


def bucket(score: Column) -> Column:
    return F.when(score >= 60, "P0").when(score >= 30, "P1").when(score >= 12, "P2").otherwise("P3")


def from_findings(findings: DataFrame) -> DataFrame:
    """One opportunity per finding whose check is mapped."""
    spark = findings.sparkSession
    issues = spark.createDataFrame(ISSUES, "check_code string, type string, action_class string, business double, seo double, feasibility double, risk double")
    confidence = spark.createDataFrame(list(SEVERITY_CONFIDENCE.items()), "severity string, confidence double")
    rows = findings.join(F.broadcast(issues), "check_code").join(F.broadcast(confidence), "severity")
    score = priority_score(*map(F.col, ("business", "seo", "confidence", "feasibility", "risk")))
    key = F.sha2(F.concat_ws("|", F.lit("issue"), "type", F.coalesce("url_pattern", "url", F.lit("*"))), 256)
    out = rows.select("type", "action_class", "check_code", "site", "page_id", "severity_rank", "url", "url_pattern", score.alias("score"), key.alias("opportunity_key"))
    return out.withColumn("priority", bucket(F.col("score")))


#: Business, search, confidence, feasibility and risk of the two content detections.
CANNIBALIZED = (0.6, 0.7, 0.75, 0.4, 0.4)
THIN = (0.5, 0.6, 0.8, 0.4, 0.3)


def from_content(groups: DataFrame, thin: DataFrame) -> DataFrame:
    """Opportunities of cannibalized keywords groups(site, keyword, n) and thin pages thin(site, url)."""
    none = F.lit(None).cast("string")

    def form(rows: DataFrame, kind: str, values: tuple[float, ...], key: Column, url: Column, pattern: Column, title: Column) -> DataFrame:
        score = priority_score(*map(F.lit, values))
        out = rows.select("site", F.lit(kind).alias("type"), F.lit("HIGH_RISK_WRITE").alias("action_class"), url.alias("url"), pattern.alias("url_pattern"), title.alias("title"), score.alias("score"), key.alias("opportunity_key"))
        return out.withColumn("priority", bucket(F.col("score")))

    word, url = F.col("keyword"), F.col("url")
    title = F.concat(F.col("n").cast("string"), F.lit(" pages competing for '"), word, F.lit("'"))
    one = form(groups, "consolidate_cannibalization", CANNIBALIZED, F.sha2(F.concat_ws("|", F.lit("cannibalization"), word), 256), none, F.concat(F.lit("keyword:"), word), title)
    return one.unionByName(form(thin, "improve_thin_content", THIN, F.sha2(F.concat_ws("|", F.lit("thin"), url), 256), url, none, F.concat(F.lit("Thin content: "), url)))


def with_evidence(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Findings with the ``evidence_id`` of their page, from evidence(url, evidence_id); the smallest of several."""
    return findings.join(evidence.groupBy("url").agg(F.min("evidence_id").alias("evidence_id")), "url", "left")


def folded(detected: DataFrame) -> DataFrame:
    """One row per (site, opportunity_key) of detected(.., ordinal): fixed fields of the first, score and priority of the
    last, and how many there were."""
    fixed = [c for c in ("type", "action_class", "url", "url_pattern") if c in detected.columns]
    return detected.groupBy("site", "opportunity_key").agg(
        F.min_by(F.struct(*fixed), "ordinal").alias("f"), F.max_by(F.struct("score", "priority"), "ordinal").alias("l"), F.count("*").alias("times")
    ).select("site", "opportunity_key", "f.*", "l.*", "times")


def upsert(old: DataFrame, detected: DataFrame) -> DataFrame:
    """old(site, opportunity_key, status, score, priority, first_seen, last_seen, seen_count) after a run that detected
    detected(site, opportunity_key, score, priority, times, seen_on): score and priority are those of the run, completed and
    failed ones are detected again. A key that a run meets several times counts each time."""
    new = detected.select("site", "opportunity_key", F.col("score").alias("new_score"), F.col("priority").alias("new_priority"), "times", "seen_on")
    rows = old.join(new, ["site", "opportunity_key"], "full_outer")
    again = F.col("seen_on").isNotNull()
    status = F.when(F.col("status").isNull() | (again & F.col("status").isin("completed", "failed")), "detected").otherwise(F.col("status"))
    return rows.select(
        "site", "opportunity_key", status.alias("status"), F.coalesce("new_score", "score").alias("score"), F.coalesce("new_priority", "priority").alias("priority"),
        F.coalesce("first_seen", "seen_on").alias("first_seen"), F.coalesce("seen_on", "last_seen").alias("last_seen"), (F.coalesce("seen_count", F.lit(0)) + F.coalesce("times", F.lit(0))).alias("seen_count"),
        F.when(F.col("status").isNull(), "created").when(again, "updated").otherwise("kept").alias("state"),
    )


def summary(upserted: DataFrame, rejected: DataFrame) -> DataFrame:
    """Per site the opportunities of this run by priority, created, updated and rejected for want of evidence."""
    counts = upserted.where("state <> 'kept'").groupBy("site").agg(
        *(F.count_if(F.col("priority") == p).alias(p.lower()) for p in ("P0", "P1", "P2", "P3")), F.count_if(F.col("state") == "created").alias("created"), F.count_if(F.col("state") == "updated").alias("updated")
    )
    lost = rejected.groupBy("site").agg(F.count("*").alias("rejected"))
    return counts.join(lost, "site", "full_outer").na.fill(0)


def listed(rows: DataFrame, limit: int, project: str | None = None, priority: str | None = None, status: str | None = None) -> DataFrame:
    """The best rows by falling score that meet the filters named; a top-k, so no task sorts all."""
    for column, value in (("site", project), ("priority", priority), ("status", status)):
        rows = rows.where(F.col(column) == value) if value else rows
    return rows.orderBy(F.desc("score"), "site", "opportunity_key").limit(limit)


def awaiting_plans(rows: DataFrame) -> DataFrame:
    return rows.where("status = 'detected' and priority in ('P0', 'P1')")
