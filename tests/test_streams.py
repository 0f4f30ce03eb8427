"""Streams over folders of files: restarts, empty input, long chains, repeated ids, and what a batch writes."""

import datetime

import pytest
from pyspark.sql import functions as F

from searchops.plans import streams
from searchops.sources import kept
from searchops.streaming import events

EVENT = "event_id long, ts timestamp, event_type string"


def at(day, hour=1):
    return datetime.datetime(2026, 1, day, hour)


@pytest.fixture
def land(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def add(name, rows, schema=EVENT):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    add.stream = lambda schema=EVENT: spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    add.folder = f"file://{tmp_path}"
    return add


def test_counts_once_across_days_batches_and_restarts(spark, land, monkeypatch):
    monkeypatch.setattr(kept, "COMPACT", 2)
    count = lambda **k: {(r.hour.day, r.hour.hour, r.n) for r in events.hourly_counts(land.stream(), f"{land.folder}/hours", **k).collect()}
    assert count() == set() == count()
    land("a", [(1, at(1), "view"), (2, at(1), "view"), (1, at(2), "view")])
    assert count() == {(1, 1, 2)} == count()
    land("b", [(2, at(5), "view"), (3, at(2), "view")])
    assert count() == {(1, 1, 2), (2, 1, 1)}
    for k in range(5):  # merges on the way
        land(f"c{k}", [(1, at(3), "view"), (10 + k, at(3), "view")])
        assert count() == {(1, 1, 2), (2, 1, 1), (3, 1, k + 1)}
    assert len(list(kept._complete(spark, f"{land.folder}/hours/ids", "batch"))) <= 3


def test_ids_beyond_the_horizon_are_forgotten(spark, land, monkeypatch):
    monkeypatch.setattr(kept, "COMPACT", 1)
    count = lambda: sum(r.n for r in events.hourly_counts(land.stream(), f"{land.folder}/hours", horizon_days=7).collect())
    for k, (day, want) in enumerate(((1, 1), (20, 2), (21, 3), (1, 4), (21, 4))):
        land(f"e{k}", [({1: 1, 20: 2, 21: 3}[day], at(day), "view")])
        assert count() == want


def chain(fails):
    """Consumers a to d, each of which fails a number of times before it passes the event on."""
    c = events.Consumers()
    for k, name in enumerate("abcd"):
        c.register(name, f"t{k}", lambda rows, k=k: rows.select("event_id", (F.col("attempts") >= fails).alias("ok"), F.lit(f"t{k + 1}").alias("emits")))
    c.register("audit", "t3", lambda rows: rows.select("event_id", F.lit(True).alias("ok")).where("false"))  # says nothing: fails
    return c


def test_relay_runs_to_the_end(spark, land):
    stream = lambda: land.stream().withColumnRenamed("ts", "created_at")
    ends = lambda limit, fails=4: {(r.consumer, r.outcome, r.n) for r in events.relay(stream(), f"{land.folder}/relay", chain(fails), limit).groupBy("consumer", "outcome").agg(F.count("*").alias("n")).collect()}
    assert ends(None) == set()
    land("a", [(1, at(1), "t0"), (2, at(2), "t0"), (1, at(3), "t0"), (9, at(1), "nobody")])
    want = {(c, o, 2 * n) for c in "abcd" for o, n in (("ok", 1), ("failed", 4))} | {("audit", "failed", 8), ("audit", "dead_letter", 2)}
    assert ends(None) == want == ends(None)
    land("b", [(3, at(1), "t0"), (2, at(5), "t0")])
    assert ends(1, 0) == {(c, "ok", 3) for c in "abcd"} | {(c, "failed", 8) for c in "abcd"} | {("audit", "failed", 12), ("audit", "dead_letter", 3)}


def test_passes_take_the_oldest_events(spark, land):
    c = events.Consumers()
    c.register("all", "view", lambda rows: rows.select("event_id", F.lit(True).alias("ok")))
    land("a", [(k, at(28 - k), "view") for k in range(7)] + [(100, None, "view")])
    out = events.relay(land.stream().withColumnRenamed("ts", "created_at"), f"{land.folder}/relay", c, limit=3)
    assert [[r.event_id for r in out.where(F.col("pass") == p).orderBy("event_id").collect()] for p in range(3)] == [[5, 6, 100], [2, 3, 4], [0, 1]]
    counters = {r["pass"]: r for r in events.relay_counters(out).collect()}
    assert [(counters[p].scanned, counters[p].delivered, counters[p].failed) for p in range(3)] == [(3, 3, 0), (3, 3, 0), (2, 2, 0)]


PAGE = "doc_id long, text string"


def test_keyed_tables_restart_and_write_what_they_touch(spark, land, tmp_path):
    run = lambda: events.folded_table(land.stream(PAGE), f"{land.folder}/crawl", ["url_hash"], streams.arriving_pages, streams.page_states)
    assert run() is None
    text = lambda k, v: f"page {k} says {v} " * 20
    land("a", [(k, text(k, "one")) for k in range(200)], PAGE)
    first = {r.url_hash: (r.fingerprint, r.changes) for r in run().collect()}
    assert len(first) == 200 and {n for _, n in first.values()} == {1}
    assert {r.url_hash: (r.fingerprint, r.changes) for r in run().collect()} == first  # nothing new
    size = lambda: sum(f.stat().st_size for f in (tmp_path / "crawl/table").rglob("*.parquet"))
    before = size()
    land("b", [(7, "wholly other words now stand on this page " * 9), (500, text(500, "new"))], PAGE)
    second = {r.url_hash: (r.fingerprint, r.changes) for r in run().collect()}
    assert second[7][1] == 2 and second[500][1] == 1 and {k: v for k, v in second.items() if k not in (7, 500)} == {k: v for k, v in first.items() if k != 7}
    assert len(list((tmp_path / "crawl/table/batch=1").glob("bucket=*"))) <= 2 and size() - before < before / 5
    land("c", [(8, text(8, "one"))], PAGE)
    assert run().count() == 201
    assert not any((tmp_path / "crawl/table/batch=0" / b.name).exists() for b in (tmp_path / "crawl/table/batch=1").glob("bucket=*"))  # replaced versions are gone


def test_keyed_table_equals_the_batch_form(spark, land):
    table = kept.KeyedTable(spark, f"{land.folder}/t", ["k"], 8)
    step = lambda old, new: new if old is None else old.unionByName(new).groupBy("k").agg(F.sum("n").alias("n"))
    rows = [spark.range(50 * b, 50 * b + 120).selectExpr("id % 90 k", "1L n").groupBy("k").agg(F.sum("n").alias("n")) for b in range(4)]
    for b, r in enumerate(rows):
        table.fold(r, b, step)
        if b == 2:
            table.fold(r, b, step)  # the batch runs again after a failure
    want = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]).groupBy("k").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, table.read().select("k", "n").collect())) == sorted(map(tuple, want.collect()))


def test_merge_sinks_touch_only_their_buckets_and_survive_a_failed_write(spark, land, tmp_path):
    from searchops.operators import metrics

    keys = ["series", "day"]
    rows = lambda df: {(r.series, r.day.day): r.value for r in df.collect()}
    points = lambda n, value: spark.range(n).selectExpr(f"concat('s', id % 50) series", "date_add(date'2026-01-01', cast(id div 50 as int)) day", f"{value}D value")
    step = lambda old, new: new if old is None else metrics.upsert(old, new, keys).drop("state")
    table = kept.KeyedTable(spark, f"{land.folder}/metrics", keys, 16)
    first = rows(table.merge(points(1000, 1.0), step))
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "metrics").rglob("*.parquet")}
    new = points(1000, 2.0).where("series = 's3' and day = date'2026-01-05'")

    def fails(old, new):
        return step(old, new).withColumn("value", F.when(F.col("series") == "s3", F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("value")))

    with pytest.raises(Exception, match="lost"):
        table.merge(new, fails)
    assert rows(table.read()) == first
    assert rows(table.merge(new, step)) == {**first, ("s3", 5): 2.0}
    assert {f: f.stat().st_mtime_ns for f in files} == files and len(list((tmp_path / "metrics/batch=1").glob("bucket=*"))) == 1
    by_site = kept.KeyedTable(spark, f"{land.folder}/sites", ["site"], 4)
    rows_of = lambda *r: spark.createDataFrame(r, "site string, x long")
    sites = lambda *names: spark.createDataFrame([(n,) for n in names], "site string")
    by_site.replace(rows_of(("a", 1), ("a", 2), ("b", 1)), sites("a", "b"))
    got = by_site.replace(rows_of(("a", 3), ("c", 1)), sites("a", "c"))
    assert sorted((r.site, r.x) for r in got.collect()) == [("a", 3), ("b", 1), ("c", 1)]
    got = by_site.replace(rows_of(("a", 3)).limit(0), sites("a", "nobody"))  # a group that has no rows any more
    assert sorted((r.site, r.x) for r in got.collect()) == [("b", 1), ("c", 1)]
