"""Queries over lineitem, orders, events, documents and labels as evidence, changes, experiments and drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import planning
from .registry import QUERIES, Query


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Day on which the age of evidence is taken.
TODAY = "1998-12-01"
AUTONOMOUS = ("view", "click")


def evidence_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as evidence, of all sources and one unknown in turn; returned lines are partial, large ones cross-checked."""
    names = [n for n, *_ in planning.SOURCES] + ["other"]
    source = F.element_at(F.array(*map(F.lit, names)), (F.col("l_orderkey") % len(names) + 1).cast("int"))
    age = F.datediff(F.lit(TODAY).cast("date"), F.to_date("l_shipdate"))
    rows = _t(spark, sf, "lineitem").select(source.alias("source"), age.alias("age_days"), (F.col("l_quantity") >= 40).alias("cross_checked"), (F.col("l_returnflag") == "R").alias("partial"))
    return planning.rated_evidence(rows).groupBy("source", "first_hand", "confidence", "label").agg(F.count("*").alias("n"))


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    """Events as proposed changes; the kind stands for the opportunity type, the user for class and mode."""
    k = F.col("user_id") % 4
    action = F.when(k == 0, "READ_ONLY").when(k == 1, "LOW_RISK_WRITE").when(k == 2, "HIGH_RISK_WRITE").otherwise("IRREVERSIBLE_EXTERNAL_ACTION")
    mode = F.when(F.col("user_id") % 3 == 0, "read_only").when(F.col("user_id") % 3 == 1, "assisted").otherwise("autonomous")
    return _t(spark, sf, "events").select("event_id", "event_type", "value", action.alias("action_class"), mode.alias("mode"))


_CHANGES_SQL = """c AS (SELECT event_id, event_type, value, CASE user_id % 4 WHEN 0 THEN 'READ_ONLY' WHEN 1 THEN 'LOW_RISK_WRITE' WHEN 2 THEN 'HIGH_RISK_WRITE' ELSE 'IRREVERSIBLE_EXTERNAL_ACTION' END AS action_class,
    CASE user_id % 3 WHEN 0 THEN 'read_only' WHEN 1 THEN 'assisted' ELSE 'autonomous' END AS mode FROM events)"""


def approval_decisions(spark: SparkSession, sf: str) -> DataFrame:
    decision = planning.approval(F.col("action_class"), F.col("mode"), F.col("event_type").isin(*AUTONOMOUS), F.col("value") > 20)
    return _changes(spark, sf).groupBy("event_type", "mode", "action_class", decision.alias("decision")).agg(F.count("*").alias("n"))


def guardrail_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """The first guardrail that stops each change; an even event is approved, the value is the number of pages."""
    k = F.col("event_id")
    reason = planning.guardrail(F.col("action_class"), k % 2 == 0, F.col("event_type").isin(*AUTONOMOUS), F.col("value"), k % 29, k % 31 == 0, k % 37 != 0)
    return _changes(spark, sf).groupBy("event_type", reason.alias("reason")).agg(F.count("*").alias("n"))


def opportunity_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as concluded experiments of their priority: finished ones succeed, pending ones regress."""
    delta = F.when(F.col("o_orderstatus") == "F", 0.1).when(F.col("o_orderstatus") == "P", -0.15).otherwise(0.0)
    rows = _t(spark, sf, "orders").select("o_orderpriority", F.to_date("o_orderdate").alias("day"), "o_orderkey", delta.alias("delta"))
    return planning.weight_folds(rows, "o_orderpriority", ["day", "o_orderkey"], "delta")


def revise_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as the attempts at an order's draft, judged by their return flag."""
    verdict = F.when(F.col("l_returnflag") == "A", "PASS").when(F.col("l_returnflag") == "R", "FAIL").otherwise("REVISE")
    rows = _t(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(verdict).alias("verdict"))
    return planning.revise_loop(rows, "l_orderkey", "l_linenumber", "verdict")


_NAMED = [(n, c, first) for n, c, first in planning.SOURCES] + [("other", 0.1, False)]
_AT = f"l_orderkey % {len(_NAMED)} + 1"
_NAMES = ", ".join(f"'{n}'" for n in AUTONOMOUS)

QUERIES.update(
    evidence_confidence=Query(
        evidence_confidence,
        f"""WITH a AS (SELECT {[n for n, *_ in _NAMED]}[{_AT}] AS source, {[f for *_, f in _NAMED]}[{_AT}] AS first_hand, [{", ".join(f"{c}::DOUBLE" for _, c, _ in _NAMED)}][{_AT}]
            - CASE WHEN d > 365 THEN 0.20::DOUBLE WHEN d > 90 THEN 0.10::DOUBLE WHEN d > 30 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS c, l_quantity >= 40 AS crossed, l_returnflag = 'R' AS part
            FROM (SELECT *, date_diff('day', CAST(l_shipdate AS DATE), DATE '{TODAY}') AS d FROM lineitem)),
        b AS (SELECT source, first_hand, CASE WHEN crossed THEN least(0.99::DOUBLE, c + 0.04::DOUBLE) ELSE c END AS c, part FROM a),
        v AS (SELECT source, first_hand, round(greatest(0.01::DOUBLE, least(0.99::DOUBLE, CASE WHEN part THEN c - 0.15::DOUBLE ELSE c END)), 3) AS confidence FROM b)
        SELECT source, first_hand, confidence, CASE WHEN confidence >= 0.90::DOUBLE THEN 'HIGH' WHEN confidence >= 0.70::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END AS label, count(*) AS n FROM v GROUP BY ALL""",
    ),
    approval_decisions=Query(
        approval_decisions,
        f"""WITH {_CHANGES_SQL} SELECT event_type, mode, action_class, CASE WHEN action_class = 'READ_ONLY' THEN 'auto' WHEN mode = 'read_only' THEN 'blocked'
          WHEN action_class = 'LOW_RISK_WRITE' AND mode = 'autonomous' AND event_type IN ({_NAMES}) AND value > 20 THEN 'auto' ELSE 'needs_human' END AS decision, count(*) AS n FROM c GROUP BY ALL""",
    ),
    guardrail_reasons=Query(
        guardrail_reasons,
        f"""WITH {_CHANGES_SQL} SELECT event_type, CASE WHEN event_id % 29 > 25 THEN 'loop_cap' WHEN event_id % 31 = 0 THEN 'duplicate_action' WHEN event_id % 37 = 0 THEN 'lease_not_held'
          WHEN action_class IN ('HIGH_RISK_WRITE', 'IRREVERSIBLE_EXTERNAL_ACTION') AND event_id % 2 <> 0 THEN 'high_risk_unapproved'
          WHEN action_class = 'IRREVERSIBLE_EXTERNAL_ACTION' THEN 'never_autonomous' WHEN action_class = 'LOW_RISK_WRITE' AND event_id % 2 <> 0 AND event_type NOT IN ({_NAMES}) THEN 'not_on_allow_list'
          WHEN value > 50 AND event_id % 2 <> 0 THEN 'mass_change' END AS reason, count(*) AS n FROM c GROUP BY ALL""",
    ),
    opportunity_weights=Query(
        opportunity_weights,
        """WITH o AS (SELECT o_orderpriority, list(CASE o_orderstatus WHEN 'F' THEN 0.1::DOUBLE WHEN 'P' THEN -0.15::DOUBLE ELSE 0.0::DOUBLE END ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS d FROM orders GROUP BY 1)
        SELECT o_orderpriority, round(list_reduce(list_prepend(1.0::DOUBLE, d), lambda w, x: least(2.0::DOUBLE, greatest(0.3::DOUBLE, w + x))), 3) AS weight, len(d) AS steps FROM o""",
    ),
    revise_outcomes=Query(
        revise_outcomes,
        """WITH a AS (SELECT l_orderkey, l_linenumber, min(CASE l_returnflag WHEN 'A' THEN 'PASS' WHEN 'R' THEN 'FAIL' ELSE 'REVISE' END) AS verdict FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL)
        SELECT l_orderkey, l_linenumber, verdict FROM a
        QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY verdict = 'REVISE', CASE WHEN verdict = 'REVISE' THEN -l_linenumber ELSE l_linenumber END) = 1""",
    ),
)
