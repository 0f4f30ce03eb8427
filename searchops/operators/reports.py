"""Listings and Markdown reports from rows; every figure comes from a table, and sections are cut before they are joined to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .technical import SEVERITIES

#: Rows of a report's sections.
BEST, CHANGES, PER_SEVERITY = 15, 15, 30
NOTHING = "_(none)_\n"


def newest(rows: DataFrame, at: str, limit: int, tie: str) -> DataFrame:
    """The newest rows; a top-k."""
    return rows.orderBy(F.desc(at), tie).limit(limit)


def table(rows: DataFrame, group: str, headers: list[str], cells: list[Column], order: Column) -> DataFrame:
    """group, markdown: one Markdown table for each group; cut the groups to a section's rows before."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(c.cast("string"), F.lit("")) for c in cells)), F.lit(" |"))
    head = "| " + " | ".join(headers) + " |\n|" + "|".join("---" for _ in headers) + "|\n"
    got = rows.select(group, order.alias("by"), line.alias("line")).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("by", "line"))).alias("l"))
    return got.select(group, F.concat(F.lit(head), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("markdown"))


def first_rows(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def technical_report(issues: DataFrame) -> DataFrame:
    """site, n_issues, counts, markdown of open issues(site, severity, check_code, url, url_pattern): totals by severity in order,
    and a table of the first rows of each severity."""
    counts = issues.groupBy("site").agg(F.count("*").alias("n_issues"), *(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))
    text = F.concat_ws(", ", *(F.concat(F.col(s).cast("string"), F.lit(f" {s}")) for s in SEVERITIES))
    place = F.coalesce("url", "url_pattern", F.lit("*"))
    few = first_rows(issues, ["site", "severity"], ["check_code", place], PER_SEVERITY).withColumn("key", F.concat_ws("\t", "site", "severity"))
    tables = table(few, "key", ["Check", "URL / pattern"], [F.col("check_code"), F.left(place, F.lit(50))], F.struct("place"))
    tables = tables.select(F.split_part("key", F.lit("\t"), F.lit(1)).alias("site"), F.split_part("key", F.lit("\t"), F.lit(2)).alias("severity"), "markdown")
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    parts = tables.groupBy("site").agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "severity", "markdown"))).alias("p"))
    body = F.array_join(F.transform("p", lambda x: F.concat(F.lit("## "), F.initcap(x["severity"]), F.lit("\n"), x["markdown"])), "\n")
    rows = counts.withColumn("counts", text).join(parts.select("site", body.alias("body")), "site", "left")
    head = F.concat(F.lit("**"), F.col("n_issues").cast("string"), F.lit(" open issues** — "), "counts", F.lit("\n"))
    return rows.select("site", "n_issues", "counts", F.concat_ws("\n", head, "body").alias("markdown"))


def executive_sections(metrics: DataFrame, opportunities: DataFrame, changes: DataFrame, visibility: DataFrame) -> DataFrame:
    """project, section, markdown of metrics(project, series, current, prior, change_pct, arrow), opportunities(project, priority,
    type, title, score), changes(project, target, state, verified, applied_at) and visibility(project, provider, score)."""
    signs = F.when(F.col("arrow") == "up", "▲").when(F.col("arrow") == "down", "▼").otherwise("▬")
    one = lambda df, section: df.select("project", F.lit(section).alias("section"), "markdown")
    performance = table(metrics, "project", ["Metric", "Current", "Prior", "Change"], [F.col("series"), F.format_string("%.1f", "current"), F.format_string("%.1f", "prior"), F.format_string("%s %+.1f%%", signs, "change_pct")], F.struct("series"))
    best = first_rows(opportunities.where("priority in ('P0', 'P1')"), ["project"], [F.desc("score"), "title"], BEST)
    best = table(best, "project", ["Priority", "Type", "Title", "Score"], [F.col("priority"), F.col("type"), F.left("title", F.lit(60)), F.format_string("%.0f", "score")], F.struct("place"))
    recent = first_rows(changes, ["project"], [F.desc("applied_at"), "target"], CHANGES)
    recent = table(recent, "project", ["Target", "State", "Verified", "Applied"], [F.left("target", F.lit(50)), F.col("state"), F.when(F.col("verified"), "✓").otherwise("—"), F.left(F.col("applied_at").cast("string"), F.lit(10))], F.struct("place"))
    seen = table(visibility, "project", ["Provider", "Visibility score (0-100)"], [F.col("provider"), F.format_string("%.1f", "score")], F.struct("provider"))
    out = one(performance, "performance")
    for df, name in ((best, "opportunities"), (recent, "changes"), (seen, "ai_visibility")):
        out = out.unionByName(one(df, name))
    return out


def open_issues(issues: DataFrame, severity: str | None = None, project: str | None = None) -> DataFrame:
    """Issues that are open or have come back, of one severity and project if these are named."""
    rows = issues.where(F.col("status").isin("open", "regressed"))
    rows = rows if severity is None else rows.where(F.col("severity") == severity)
    return rows if project is None else rows.where(F.col("project_id") == project)


def loop_summary(plans: DataFrame, opportunities: DataFrame) -> DataFrame:
    """Per site the plans that wait for approval and the priority opportunities that are open."""
    waiting = plans.groupBy("site").agg(F.count_if("requires_approval").alias("awaiting_approval"))
    n = F.count_if(F.col("priority").isin("P0", "P1") & F.col("status").isin("detected", "planned", "awaiting_approval"))
    return waiting.join(opportunities.groupBy("site").agg(n.alias("priority_open")), "site", "full_outer").na.fill(0)


def ranked(rows: DataFrame, key: str, order: list, n: int | None = None) -> DataFrame:
    """Rows of each key in order, with their ``place``; the first ``n`` if that is given."""
    out = rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return out if n is None else out.where(F.col("place") <= n)
