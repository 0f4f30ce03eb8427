"""Rows that live on from run to run: issues, verifications, gates, validation, ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metric, highest good value, lowest poor value.
VITALS = (("lcp_ms", 2500.0, 4000.0), ("inp_ms", 200.0, 500.0), ("cls", 0.1, 0.25), ("ttfb_ms", 800.0, 1800.0))
#: Points by which a model's score may differ from the rule's.
MOST_APART = 30


def upsert_issues(old: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Issues old(keys, status, severity, detail, first_seen, last_seen, seen_count) after a run that saw
    seen(keys, severity, detail, seen_on), one row a key.

    A new issue is open; one seen again counts up with the severity and detail of the run, and if it was resolved it has
    regressed; others stay as they are.
    """
    rows = old.join(seen.withColumnsRenamed({"severity": "new_severity", "detail": "new_detail"}), keys, "full_outer")
    new, again = F.col("status").isNull(), F.col("seen_on").isNotNull()
    status = F.when(new, "open").when(again & (F.col("status") == "resolved"), "regressed").otherwise(F.col("status"))
    count = F.coalesce("seen_count", F.lit(0)) + again.cast("long")
    fresh = [F.when(again, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("severity", "detail")]
    return rows.select(*keys, status.alias("status"), *fresh, F.coalesce("first_seen", "seen_on").alias("first_seen"), F.coalesce("seen_on", "last_seen").alias("last_seen"), count.alias("seen_count"))


def evidence_rows(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Evidence by (content_hash, kind) that ``known`` lacks, one row each."""
    return rows.dropDuplicates(["content_hash", "kind"]).join(known.select("content_hash", "kind"), ["content_hash", "kind"], "left_anti")


def new_links(links: DataFrame, known: DataFrame) -> DataFrame:
    """Links (evidence_id, subject_type, subject_id) that are not there yet."""
    keys = ["evidence_id", "subject_type", "subject_id"]
    return links.select(*keys).distinct().join(known.select(*keys), keys, "left_anti")


#: Form of a domain, letters of a keyword, days of a range, range of a score.
DOMAIN = r"^(https?://)?([a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}(/[^\s]*)?$"
KEYWORD_LETTERS, RANGE_DAYS, SCORE = 200, 370, (0.0, 100.0)


def validity(domain: Column, keyword: Column, start: Column, end: Column, score: Column) -> dict[str, Column]:
    """The rules for landed rows by name; dates and score are text, as they come."""
    a, b = F.try_to_date(start, "yyyy-MM-dd"), F.try_to_date(end, "yyyy-MM-dd")
    return {
        "domain": F.regexp_replace(F.trim(domain), "^/+|/+$", "").rlike(DOMAIN),
        "keyword": F.length(F.trim(keyword)).between(1, KEYWORD_LETTERS),
        "date_range": F.datediff(b, a).between(0, RANGE_DAYS),
        "score": score.try_cast("double").between(*SCORE),
    }


def split_valid(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the quarantined ones with their ``reasons``."""
    marked = rows.withColumn("reasons", reasons(**rules))
    return marked.where("reasons = ''").drop("reasons"), marked.where("reasons <> ''")


def with_first_verification(changes: DataFrame, checks: DataFrame, key: str, order: str, result: str) -> DataFrame:
    """Each change with the result of its first check; checks are reduced to one row a change before the join."""
    first = checks.groupBy(key).agg(F.min_by(result, order).alias("first_result"), F.count("*").alias("n_checks"))
    return changes.join(first, key, "left").withColumn("n_checks", F.coalesce("n_checks", F.lit(0)))


def evidence_gate(opportunities: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Opportunities with ``accepted``: whether any evidence names them."""
    return opportunities.join(evidence.groupBy(key).agg(F.lit(True).alias("accepted")), key, "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def cross_checked(rule: Column, model: Column) -> Column:
    """The model's score, or the rule's where the model has none or lies too far off."""
    return F.when(model.isNull() | (F.abs(model - rule) > MOST_APART), rule).otherwise(model)


def reasons(**checks: Column) -> Column:
    """Names of failed checks, joined by commas; a check that is null has failed."""
    return F.concat_ws(",", *(F.when(~F.coalesce(c, F.lit(False)), name) for name, c in checks.items()))


def rate_vitals(rows: DataFrame) -> DataFrame:
    """rows(metric, value, ...) with a rating; null for values that were not measured."""
    limits = rows.sparkSession.createDataFrame(VITALS, "metric string, good double, poor double")
    v = F.col("value")
    rating = F.when(v <= F.col("good"), "good").when(v <= F.col("poor"), "needs_improvement").when(v.isNotNull(), "poor")
    return rows.join(F.broadcast(limits), "metric").withColumn("rating", rating).drop("good", "poor")


def prf(counts: DataFrame) -> DataFrame:
    """precision, recall and f1 of rows(tp, fp, fn); 0 where there is nothing to divide by."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(share(2 * p * r, p + r), 4)})


def confusion(predictions: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """engine, tp, fp, fn of predictions(engine, item, label) against the ledger of the same form: a full outer join by engine, item
    and label."""
    both = predictions.select(*keys).distinct().withColumn("said", F.lit(True)).join(ledger.select(*keys).distinct().withColumn("expected", F.lit(True)), keys, "full_outer")
    count = lambda *c: F.count_if(F.expr(" and ".join(c)))
    return both.groupBy(keys[0]).agg(count("said", "expected").alias("tp"), count("said", "expected is null").alias("fp"), count("said is null", "expected").alias("fn"))


def judged(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """scores(engine, metric, value) against thresholds(engine, metric, bound, lower_is_better); null without a threshold."""
    ok = F.when(F.col("lower_is_better"), F.col("value") <= F.col("bound")).otherwise(F.col("value") >= F.col("bound"))
    return scores.join(thresholds, ["engine", "metric"], "left").withColumn("passed", ok).drop("lower_is_better")


#: Engine, metric, bound, whether less is better.
THRESHOLDS = (
    ("technical_engine", "precision", 0.90, False), ("technical_engine", "recall", 0.85, False), ("intent_classifier", "precision", 0.85, False),
    ("opportunity_scoring", "rank_correlation", 0.70, False), ("citation_parser", "precision", 0.80, False), ("anomaly_detector", "false_positive_rate", 0.10, True),
    ("execution_safety", "guardrail_trip_rate", 1.00, False),
)
#: Ceilings of tokens of a call, cost of a run and of a tenant's month.
CALL_TOKENS, RUN_COST, MONTH_COST = 180_000, 5.0, 300.0


def usage(calls: DataFrame, keys: list[str], ceiling: float) -> DataFrame:
    """Tokens and cost of calls(.., input_tokens, output_tokens, cost_usd) by key, and whether the cost is over the ceiling."""
    got = calls.groupBy(*keys).agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"))
    return got.withColumn("over_budget", F.col("cost_usd") > ceiling)
