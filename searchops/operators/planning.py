"""Evidence confidence, plans for opportunities, approval, guardrails, judging of drafts and opportunity weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Deductions from the confidence by age in days: more than this many days, points.
AGE_PENALTY = ((365, 0.20), (90, 0.10), (30, 0.05))
#: Confidence of at least, label.
LABELS = ((0.90, "HIGH"), (0.70, "MEDIUM"))

#: Source, base confidence, first-hand.
SOURCES = (
    ("gsc", 0.99, True), ("ga4", 0.99, True), ("pagespeed", 0.95, True), ("crux", 0.95, True), ("serpapi", 0.93, True),
    ("dataforseo", 0.95, True), ("ahrefs", 0.95, True), ("semrush", 0.95, True), ("crawl", 0.98, True), ("rendered_dom", 0.97, True),
    ("ai_response", 0.85, True), ("llm", 0.80, False), ("heuristic", 0.85, False), ("estimate", 0.60, False), ("unknown", 0.10, False),
)
#: Opportunity type, tool, action class, rollback, verifier, objective.
RECIPES = (
    ("fix_canonical", "modify_metadata", "LOW_RISK_WRITE", "native", "canonical_change", "Set a self-referencing canonical on {url}"),
    ("fix_technical_issue", "modify_metadata", "LOW_RISK_WRITE", "native", "metadata_change", "Correct the flagged element on {url}"),
    ("add_schema", "modify_metadata", "LOW_RISK_WRITE", "native", "schema_change", "Add valid JSON-LD schema to {url}"),
    ("add_internal_links", "modify_metadata", "LOW_RISK_WRITE", "native", "internal_link_added", "Add a contextual internal link to {url}"),
    ("improve_thin_content", "create_content", "HIGH_RISK_WRITE", "native", "content_change", "Expand thin content on {url}"),
    ("consolidate_cannibalization", "update_cms", "HIGH_RISK_WRITE", "compensating", "redirect_added", "Consolidate competing pages for {url_pattern} and 301 the duplicates"),
)
#: Types that may ever run without approval, and the classes that never may.
AUTONOMOUS = ("fix_canonical", "add_schema", "fix_technical_issue", "add_internal_links")
HIGH_RISK = ("HIGH_RISK_WRITE", "IRREVERSIBLE_EXTERNAL_ACTION")
#: Loops and pages of one change beyond which a person must look.
LOOP_CAP, MASS_CHANGE = 25, 50


def rated_evidence(rows: DataFrame) -> DataFrame:
    """rows(source, age_days, cross_checked, partial) with confidence, label and first_hand; other sources count as unknown."""
    known = rows.sparkSession.createDataFrame(SOURCES, "source string, base double, first_hand boolean")
    both = rows.join(F.broadcast(known), "source", "left")  # constant
    base = F.coalesce("base", F.lit(dict((n, b) for n, b, _ in SOURCES)["unknown"]))
    both = both.withColumn("confidence", confidence(base, F.col("age_days"), F.col("cross_checked"), F.col("partial")))
    return both.withColumns({"label": confidence_label(F.col("confidence")), "first_hand": F.coalesce("first_hand", F.lit(False))}).drop("base")


def approval(action_class: Column, mode: Column, on_allow_list: Column, eval_ok: Column) -> Column:
    """auto, needs_human or blocked."""
    return (
        F.when(action_class == "READ_ONLY", "auto")
        .when(mode == "read_only", "blocked")
        .when((mode == "autonomous") & (action_class == "LOW_RISK_WRITE") & on_allow_list & eval_ok, "auto")
        .otherwise("needs_human")
    )


def guardrail(action_class: Column, approved: Column, on_allow_list: Column, pages: Column, loops: Column, duplicate: Column, lease_held: Column) -> Column:
    """The first guardrail that stops a change; null if none does."""
    return first_reason(
        loop_cap=loops > LOOP_CAP,
        duplicate_action=duplicate,
        lease_not_held=~lease_held,
        high_risk_unapproved=action_class.isin(*HIGH_RISK) & ~approved,
        never_autonomous=action_class == "IRREVERSIBLE_EXTERNAL_ACTION",
        not_on_allow_list=(action_class == "LOW_RISK_WRITE") & ~approved & ~on_allow_list,
        mass_change=(pages > MASS_CHANGE) & ~approved,
    )


def draft_plans(opportunities: DataFrame, own_types: Column) -> DataFrame:
    """A plan of one step for opportunities(id, type, url, url_pattern); ``own_types`` are the types (an array) that the tenant
    lets run alone. Types without a recipe are unresolved and need a person."""
    recipes = opportunities.sparkSession.createDataFrame(RECIPES, "type string, tool string, step_class string, rollback string, verifier string, objective string")
    rows = opportunities.withColumn("alone", own_types).join(F.broadcast(recipes), "type", "left")  # constant
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    either = lambda a, b: F.coalesce(F.nullif(blank(a), F.lit("")), blank(b))
    alone = F.array_contains("alone", F.col("type")) & F.col("type").isin(*AUTONOMOUS) & (F.col("step_class") == "LOW_RISK_WRITE")
    alone = F.coalesce(alone, F.lit(False))
    objective = F.replace(F.replace("objective", F.lit("{url}"), either("url", "url_pattern")), F.lit("{url_pattern}"), either("url_pattern", "url"))
    key = F.substring(F.sha2(F.concat_ws("|", F.lit("step"), F.col("id").cast("string"), "tool", either("url", "url_pattern")), 256), 1, 40)
    return rows.select(
        "id", "type", "tool", F.coalesce("step_class", F.lit("HIGH_RISK_WRITE")).alias("max_action_class"), (~alone).alias("requires_approval"),
        F.when(F.col("tool").isNotNull(), F.when(alone, "auto").otherwise("approval_required")).alias("permission"), objective.alias("objective"), "verifier", "rollback",
        F.when(F.col("tool").isNotNull(), key).alias("idempotency_key"), F.col("tool").isNull().alias("unresolved"),
    )


def confidence(base: Column, age_days: Column, cross_checked: Column, partial: Column) -> Column:
    """Base of the source less the age penalty; a second source adds .04 up to .99, partial data costs .15."""
    penalty = F.lit(0.0)
    for days, points in reversed(AGE_PENALTY):
        penalty = F.when(age_days > days, points).otherwise(penalty)
    c = base - penalty
    c = F.when(cross_checked, F.least(F.lit(0.99), c + 0.04)).otherwise(c)
    c = F.when(partial, c - 0.15).otherwise(c)
    return F.round(F.greatest(F.lit(0.01), F.least(F.lit(0.99), c)), 3)


def confidence_label(value: Column) -> Column:
    out = F.lit("LOW")
    for least, name in reversed(LABELS):
        out = F.when(value >= least, name).otherwise(out)
    return out


def first_reason(**rules: Column) -> Column:
    """The name of the first rule, in the order given, that applies; null where none does."""
    return F.coalesce(*(F.when(applies, name) for name, applies in rules.items()))


def weight_folds(outcomes: DataFrame, key: str, order: list[str], delta: str, low: float = 0.3, high: float = 2.0) -> DataFrame:
    """Per key the weight after all steps, from 1.0, clamped to [low, high] after every step, and the number of steps.

    A step x -> clamp(x + d) is a clamp again, x -> least(b, greatest(a, x + s)), and such functions compose to one. So
    each (key, day) is folded by itself and the days' functions are folded after that: no task holds a key's whole history.
    """
    steps = outcomes.select(key, F.col(order[0]).alias("_day"), F.struct(*order[1:], F.col(delta).cast("double").alias("s")).alias("step"))
    then = lambda f, s, a, b: F.struct((f["s"] + s).alias("s"), F.least(b, F.greatest(a, f["a"] + s)).alias("a"), F.least(b, F.greatest(a, f["b"] + s)).alias("b"))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(low).alias("a"), F.lit(high).alias("b"))
    day = F.aggregate(F.array_sort(F.collect_list("step")), start, lambda f, x: then(f, x["s"], F.lit(low), F.lit(high)))
    days = steps.groupBy(key, "_day").agg(day.alias("f"), F.count("*").alias("n"))
    all_days = F.array_sort(F.collect_list(F.struct("_day", "f")))
    folded = F.aggregate(all_days, start, lambda f, x: then(f, x["f"]["s"], x["f"]["a"], x["f"]["b"]))
    out = days.groupBy(key).agg(folded.alias("f"), F.sum("n").alias("steps"))
    return out.select(key, F.round(F.least(F.col("f.b"), F.greatest(F.col("f.a"), 1.0 + F.col("f.s"))), 3).alias("weight"), "steps")


def revise_loop(drafts: DataFrame, key: str, attempt: str, verdict: str, most: int = 3) -> DataFrame:
    """Per key the attempt that ends the loop: the first whose verdict is not REVISE, or else the last of the first ``most``."""
    some = drafts.where(F.col(attempt) <= most)
    first = F.min_by(F.struct(attempt, verdict), F.when(F.col(verdict) != "REVISE", F.col(attempt)))
    last = F.max_by(F.struct(attempt, verdict), attempt)
    return some.groupBy(key).agg(F.coalesce(first, last).alias("e")).select(key, f"e.{attempt}", f"e.{verdict}")
