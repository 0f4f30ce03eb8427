"""Experiments and points meet by buckets of days."""

import datetime
import random

from searchops.operators import metrics


def test_points_meet_experiments_of_their_days_only(spark):
    rnd, first = random.Random(4), datetime.date(2020, 1, 1)
    day = lambda n: first + datetime.timedelta(n)
    values = {n: rnd.uniform(50, 150) for n in range(1500) if rnd.random() < 0.95}
    points = spark.createDataFrame([("s", day(n), v) for n, v in values.items()], "series string, day date, value double")
    rows = []
    for i in range(300):
        a = rnd.randrange(-20, 1450)
        b = a + rnd.randrange(-2, 90)
        c = rnd.choice([a + 3, b + 1, b + 200])  # windows that overlap, touch and lie apart
        rows.append((str(i), "s", None, "users", day(a), day(b), day(c), rnd.randrange(0, 70), False))
    schema = "experiment_id string, series string, control_series string, metric string, baseline_start date, baseline_end date, start date, days int, tracking_changed boolean"
    out = metrics.experiment_verdicts(points, spark.createDataFrame(rows, schema))
    got = {r.experiment_id: r.effect_pct for r in out.collect()}
    mean = lambda days: sum(days) / len(days) if days else 0.0
    for i, _, _, _, a, b, c, n, _ in rows:
        before = [v for d, v in values.items() if a <= day(d) <= b]
        # a day of both windows counts as one of the baseline
        after = [v for d, v in values.items() if c <= day(d) <= c + datetime.timedelta(n) and not a <= day(d) <= b]
        want = (mean(after) - mean(before)) / mean(before) * 100 if mean(before) else 0.0
        assert abs(got[i] - want) < 0.0051, i
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert any("Join Inner" in line and "bucket" in line for line in plan.splitlines())
