"""Rank correlation and false alarms against pandas, and the check of objects by field."""

import random

import pandas as pd
from pyspark.sql import functions as F

from searchops.functions import text as tx
from searchops.operators import agreement, keywords, payloads
from searchops.sources.tables import keeper


def test_rank_correlation_with_ties(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), 7 if r.random() < 0.35 else r.randrange(40), r.choice([None, *range(25)])) for _ in range(3000)]
    rows += [("one", 1, 5), ("flat", 1, 1), ("flat", 2, 1), ("up", 1, 1), ("up", 2, 5), ("up", 3, 9), ("down", 1, 2), ("down", 2, 1)]
    table = spark.createDataFrame(rows, "kind string, x int, y int").withColumns({"g": F.lit(1), "n": F.lit(2), "part": F.lit(3)})
    got = {r.kind: (r.n, r.rank_correlation) for r in agreement.rank_correlation(table, ["kind"], "x", "y", keeper(spark)).collect()}
    frame = pd.DataFrame(rows, columns=["kind", "x", "y"]).dropna(subset=["x", "y"])
    for kind, of in frame.fillna({"kind": ""}).groupby("kind"):
        n, rho = got.pop(kind or None)
        want = of.x.rank().corr(of.y.rank())
        assert n == len(of)
        assert rho is None if pd.isna(want) else abs(rho - want) < 2e-6
    assert not got
    assert agreement.rank_correlation(table.limit(0), ["kind"], "x", "y", keeper(spark)).count() == 0
    whole = agreement.rank_correlation(table, [], "x", "y", keeper(spark)).first()
    assert abs(whole.rank_correlation - frame.x.rank().corr(frame.y.rank())) < 2e-6


def test_no_window_holds_a_group(spark):
    """The numbering within ranges is by range; what is added up over a group is one row a range."""
    table = spark.range(1000).select(F.lit("g").alias("kind"), F.col("id").alias("x"), (-F.col("id")).alias("y"))
    seen = []

    def keep(df):
        kept = keeper(spark)(df)
        seen.append(kept)
        return kept

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert agreement.rank_correlation(table, ["kind"], "x", "y", keep).first().rank_correlation == -1.0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ranges = [t for t in seen if "part" in t.columns]
    assert [t.select("part").distinct().count() > 1 for t in ranges] == [True, True]


def test_false_positive_rate(spark):
    said = spark.createDataFrame([("e", 1), ("e", 1), ("e", 2), ("f", 9)], "engine string, item int")
    clean = spark.createDataFrame([("e", 1), ("e", 3), ("e", 3), ("e", 4), ("e", None), ("f", 1)], "engine string, item int")
    got = agreement.false_positive_rate(said, clean, ["engine", "item"]).orderBy("engine").collect()
    assert [tuple(r) for r in got] == [("e", 3, 1, 0.3333), ("f", 1, 0, 0.0)]


def test_objects_are_checked_by_field(spark):
    fields = {"name": "string", "n": "integer", "share": "number?", "ok": "boolean?", "tags": "array?", "more": "object?"}
    cases = [
        ('so: {"name": "a", "n": 1} done', None),
        ('{"name": "a", "n": 1, "share": 0.5, "ok": true, "tags": [], "more": {"x": 1}, "else": 2}', None),
        ('{"name": "a", "n": 1, "share": null, "tags": null}', None),
        ('{"name": null, "n": 1.5}', "name: missing, n: not integer"),
        ('{"name": 5, "n": "1", "ok": "true", "tags": {}}', "name: not string, n: not integer, ok: not boolean, tags: not array"),
        ("{}", "name: missing, n: missing"),
        ('{"name": "a", "n": ', "no object"), ("none", "no object"), ("", "no object"), (None, "no object"),
    ]
    got = spark.createDataFrame(cases, "t string, want string").select("t", "want", tx.rejection(F.col("t"), fields).alias("got")).collect()
    assert [(r.t, r.got) for r in got] == cases


def test_overview_lists_the_largest_cluster_first(spark):
    rows = [("b", 2, 10), ("a", 2, 10), ("c", 3, 10), ("d", 1, 50)]
    got = keywords.overview(spark.createDataFrame(rows, "name string, size long, volume_sum long")).collect()
    assert [(r.name, r.n_keywords) for r in got] == [("d", 8), ("c", 8), ("a", 8), ("b", 8)]


def test_payloads_of_unknown_and_broken_providers(spark):
    rows = [(1, "search", '{"organic_results":[{"link":"u"}],"people_also_ask":[{"question":"q"}]}'), (2, "tasks", '{"tasks":[{"result":[{"items":[{"type":"organic","url":"v"}]}]}]}'), (3, "other", "{}"), (4, "tasks", "broken"), (5, None, None)]
    df = spark.createDataFrame(rows, "run_id long, provider string, payload string").withColumn("title", F.lit("clash"))
    assert sorted((r.provider, r.run_id, r.position, r.url) for r in payloads.provider_results(df).collect()) == [("search", 1, 1, "u"), ("tasks", 2, 1, "v")]
    assert [tuple(r) for r in payloads.provider_questions(df).select("provider", "run_id", "question").collect()] == [("search", 1, "q")]
