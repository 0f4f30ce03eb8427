"""Daily metrics: seasonal anomalies, upsert, period report, experiment verdicts and what is learned from them."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of an experiment that a metric needs (others: 21), and the effect in percent that is never more than noise.
MIN_DAYS = {"position": 14, "clicks": 28, "impressions": 21, "organic_sessions": 28, "conversions": 42, "revenue": 42}
DEFAULT_DAYS, NOISE_FLOOR = 21, 3.0
#: Known search updates, which confound experiments.
UPDATES = ((datetime.date(2026, 3, 5), datetime.date(2026, 3, 20), "March 2026 core update"), (datetime.date(2026, 6, 10), datetime.date(2026, 6, 25), "June 2026 core update"))
#: What to look at when a metric is out of line.
CHECKLIST = ("gsc", "rankings", "indexation", "deployment_history", "crawl_errors")
#: Days of a bucket in which points and the windows of experiments meet.
BUCKET_DAYS = 32
WINDOW_DAYS, MIN_Z, MIN_PERCENT = 28, 2.5, 15.0


def anomalies(points: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Hits of ``points`` that are not among known(series, day): drops and spikes of points(series, day, value), one value a day: against the same weekday of the last 28 days where
    there are three such days, else against all of them. One shuffle by series."""
    day = F.unix_date("day")
    rows = points.withColumn("n_day", day).withColumn("weekday", F.pmod(day, F.lit(7)))
    last = lambda *keys: Window.partitionBy(*keys).orderBy("n_day").rangeBetween(-WINDOW_DAYS, -1)
    same, every = last("series", "weekday"), last("series")
    for name, w in (("same", same), ("every", every)):
        rows = rows.withColumn(f"n_{name}", F.count("value").over(w)).withColumn(f"mean_{name}", F.avg("value").over(w)).withColumn(f"sd_{name}", F.stddev_pop("value").over(w))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("series").orderBy("n_day")))
    use = F.col("n_same") >= 3
    pick = lambda c: F.when(use, F.col(f"{c}_same")).otherwise(F.col(f"{c}_every"))
    rows = rows.withColumns({"n": pick("n"), "baseline": pick("mean"), "sd": F.coalesce(F.nullif(pick("sd"), F.lit(0.0)), F.lit(1e-9))})
    z = (F.col("value") - F.col("baseline")) / F.col("sd")
    percent = F.when(F.col("baseline") != 0, (F.col("value") - F.col("baseline")) / F.col("baseline") * 100).otherwise(0.0)
    rows = rows.withColumns({"z": z, "percent": percent}).where(F.col("place") > 4).where(F.col("n") >= 3)
    hits = rows.where((F.abs("z") >= MIN_Z) & (F.abs("percent") >= MIN_PERCENT))
    hits = hits if known is None else hits.join(known.select("series", "day"), ["series", "day"], "left_anti")
    return hits.select("series", "day", F.when(F.col("value") < F.col("baseline"), "drop").otherwise("spike").alias("direction"), F.col("value").alias("observed"), F.round("baseline", 4).alias("baseline"), F.round("percent", 2).alias("magnitude_pct"), F.round("z", 3).alias("z_score"))


def investigations(hits: DataFrame, checklist: tuple[str, ...] = CHECKLIST) -> DataFrame:
    """New anomalies as open cases, each with what is to be looked at."""
    return hits.withColumns({"status": F.lit("open"), "checklist": F.array(*map(F.lit, checklist))})


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New values replace old ones of the same key; ``state`` tells new, updated and kept rows."""
    o, n = old.withColumnRenamed("value", "old_value"), new.withColumnRenamed("value", "new_value")
    state = F.when(F.col("old_value").isNull(), "new").when(F.col("new_value").isNull(), "kept").otherwise("updated")
    return o.join(n, keys, "full_outer").select(*keys, F.coalesce("new_value", "old_value").alias("value"), state.alias("state"))


def period_report(points: DataFrame) -> DataFrame:
    """Each month against the month before, with the change in percent and an arrow."""
    months = points.groupBy("series", F.trunc("day", "month").alias("month")).agg(F.sum("value").alias("current"))
    prior = months.select("series", F.add_months("month", 1).cast("date").alias("month"), F.col("current").alias("prior"))
    both = months.join(prior, ["series", "month"])
    change = F.when(F.col("prior") != 0, (F.col("current") - F.col("prior")) / F.col("prior") * 100).otherwise(0.0)
    both = both.withColumn("change_pct", F.round(change, 4))
    return both.withColumn("arrow", F.when(F.col("change_pct") > 1, "up").when(F.col("change_pct") < -1, "down").otherwise("flat"))


def min_days(metric: Column) -> Column:
    out = F.lit(DEFAULT_DAYS)
    for name, days in MIN_DAYS.items():
        out = F.when(metric == name, days).otherwise(out)
    return out


def confounders(start: Column, days: Column, tracking_changed: Column, updates: tuple = UPDATES) -> Column:
    """Names of what overlaps [start, start + days]."""
    end = F.date_add(start, days)
    names = [F.when(tracking_changed, "tracking changed")]
    names += [F.when((F.lit(a) <= end) & (F.lit(b) >= start), F.lit(name)) for a, b, name in updates]
    return F.array_compact(F.array(*names))


def rounded(value: Column, places: int) -> Column:
    """Rounded half away from zero as the double stands; what is below zero keeps its sign where it rounds to zero."""
    near = F.round(value * 10.0**places) / 10.0**places
    return F.when((near == 0) & value.cast("string").startswith("-"), F.lit(-0.0)).otherwise(near)


def experiment_verdicts(points: DataFrame, experiments: DataFrame, updates: tuple = UPDATES) -> DataFrame:
    """The verdict of each experiment(experiment_id, series, control_series, metric, baseline_start, baseline_end, start, days,
    tracking_changed) on points(series, day, value).

    The effect is the change of the mean in percent, of either sign better for a position that falls; with a control series
    its change is taken off. An effect within the noise of the baseline, and of 3 % at least, is neutral; a confounder or too
    short a window makes it inconclusive. No points or a zero mean give no effect. Points meet only experiments that read days of
    their ``BUCKET_DAYS``, however many experiments and days a series has.
    """
    arm = lambda series, control: experiments.select("experiment_id", F.col(series).alias("series"), F.lit(control).alias("control"), "baseline_start", "baseline_end", "start", "days")
    arms = arm("series", False).unionByName(arm("control_series", True).where("series is not null"))
    day, place = F.col("day"), lambda c: F.floor(F.unix_date(c) / BUCKET_DAYS)
    none = F.array().cast("array<bigint>")
    span = lambda a, b: F.coalesce(F.when(a <= b, F.sequence(place(a), place(b))), none)
    places = F.concat(span(F.col("baseline_start"), F.col("baseline_end")), span(F.col("start"), F.date_add("start", F.col("days"))))
    arms = arms.withColumn("bucket", F.explode(F.array_distinct(places)))
    rows = points.withColumn("bucket", place(day)).join(arms, ["series", "bucket"])
    rows = rows.withColumn("before", day.between(F.col("baseline_start"), F.col("baseline_end"))).where(F.col("before") | day.between(F.col("start"), F.date_add("start", F.col("days"))))
    of = lambda control, before: F.when((F.col("control") == control) & (F.col("before") == before), F.col("value"))
    got = rows.groupBy("experiment_id").agg(
        F.avg(of(False, True)).alias("b"), F.avg(of(False, False)).alias("t"), F.stddev_pop(of(False, True)).alias("sd"), F.count(of(False, True)).alias("n"),
        F.avg(of(True, True)).alias("cb"), F.avg(of(True, False)).alias("ct"),
    )
    rows = experiments.join(got, "experiment_id", "left")
    sign = F.when(F.col("metric") == "position", -1.0).otherwise(1.0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    change = lambda b, t: F.when(zero(b) != 0, (zero(t) - zero(b)) / zero(b) * 100 * sign).otherwise(0.0)
    controlled = F.col("cb").isNotNull() & F.col("ct").isNotNull()
    rows = rows.withColumns({"effect": change("b", "t") + 0.0, "controlled": controlled, "adjusted": F.when(controlled, change("b", "t") - change("cb", "ct"))})
    noise = F.when((F.col("n") >= 3) & (zero("b") != 0), F.col("sd") / F.col("b") * 100).otherwise(0.0)
    rows = rows.withColumns({"noise": noise, "confounders": confounders(F.col("start"), F.col("days"), F.col("tracking_changed"), updates), "window_ok": F.col("days") >= min_days(F.col("metric"))})
    signal, clear = F.coalesce("adjusted", "effect"), (F.size("confounders") == 0) & F.col("window_ok")
    verdict = F.when(~clear, "inconclusive").when(F.abs(signal) <= F.greatest("noise", F.lit(NOISE_FLOOR)), "neutral").when(signal > 0, "success").otherwise("regression")
    rows = rows.withColumn("verdict", verdict)
    decided = F.col("verdict").isin("success", "regression")
    sure = F.when(F.col("verdict") == "inconclusive", 0.3).when(decided & F.col("controlled"), 0.8).otherwise(0.6)
    return rows.select(
        "experiment_id", "metric", rounded(F.col("effect"), 2).alias("effect_pct"), rounded(F.col("adjusted"), 2).alias("control_adjusted_pct"), rounded(F.col("noise"), 2).alias("noise_band_pct"), "window_ok", "confounders",
        F.when(F.col("controlled"), "difference-in-differences").otherwise("before/after").alias("method"), "verdict", sure.alias("confidence"), (decided & F.col("controlled")).alias("causal_language_allowed"),
    )


def learnings(verdicts: DataFrame, kind: str) -> DataFrame:
    """What each verdict teaches about opportunities of type ``kind`` (a column): a step of the weight and a statement."""
    sure = F.col("confidence") >= 0.7
    delta = F.when((F.col("verdict") == "success") & sure, 0.1).when((F.col("verdict") == "regression") & sure, -0.15).otherwise(0.0)
    how = F.when(F.col("causal_language_allowed"), "caused").otherwise("associated with")
    control = F.when(F.col("method") == "difference-in-differences", "controlled").otherwise("before/after only")
    text = F.format_string("%s: %s (%s %+.1f%% on %s; %s)", F.col(kind), F.col("verdict"), how, rounded(F.col("effect_pct"), 1), F.col("metric"), control)
    return verdicts.select("experiment_id", F.col(kind).alias("opportunity_type"), "verdict", "confidence", delta.alias("weight_delta"), text.alias("statement"))
