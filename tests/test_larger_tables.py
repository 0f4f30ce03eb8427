"""Queries on tables as they come at larger sizes: folders of files, pages with one URL, sites with very many pages."""

import decimal

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from searchops.functions import batches, html
from searchops.operators import fingerprints, serp
from searchops.plans import registry, streams
from searchops.plans import sitefiles as site_plans

SF = "/root/testdata/sf0.001"


def equal_to_sql(spark, name, sf, tables):
    q = registry.load()[name]
    duck = duckdb.connect()
    for t in tables:
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet/*.parquet')")
    want, got = duck.sql(q.sql), q.spark(spark, str(sf))
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    plain = lambda r: tuple(float(v) if isinstance(v, decimal.Decimal) else v for v in r)
    rows = sorted(map(tuple, got.select(cols).collect()), key=str)
    assert rows == sorted(map(plain, want.select(*cols).fetchall()), key=str)
    return rows


def test_streams_read_a_folder_of_files(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert equal_to_sql(spark, "crawl_stream", tmp_path, ["documents"])


def test_streams_of_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    got = streams.crawl_stream(spark, str(tmp_path))
    assert got.columns == ["url_hash", "fingerprint", "changes"] and got.isEmpty()


@pytest.fixture
def twin_urls(spark, tmp_path):
    """Pages of which every two have one URL."""
    p = spark.read.parquet(f"{SF}/pages.parquet")
    urls = p.select((F.col("page_id") + F.col("page_id") % 2).alias("k"), "page_id").join(p.select(F.col("page_id").alias("k"), F.col("url").alias("u")), "k")
    p.join(urls, "page_id").withColumn("url", F.col("u")).select(p.columns).write.parquet(f"{tmp_path}/pages.parquet")
    return tmp_path


def test_changes_of_pages_with_one_url(spark, twin_urls):
    rows = equal_to_sql(spark, "change_assertions", twin_urls, ["pages"])
    assert len({r[0] for r in rows}) == len(rows)


def test_differences_of_pages_with_one_url(spark, twin_urls):
    n = spark.read.parquet(f"{twin_urls}/pages.parquet").count()
    assert len(equal_to_sql(spark, "page_differences", twin_urls, ["pages"])) == n


def test_small_losses_keep_their_sign(spark, tmp_path):
    """A fall of 0.02 % is written -0.0 %, as the SQL writes it, and so is one of 0.002 %."""
    days = "explode(sequence(date '1997-12-01', date '1998-12-31')) AS day"
    spark.sql(f"SELECT {days}").selectExpr("day", "explode(sequence(1, CASE WHEN day = date '1998-03-03' THEN 199 WHEN day = date '1998-08-03' THEN 1999 WHEN month(day) IN (7, 8) THEN 2000 ELSE 200 END)) AS i").selectExpr(
        "'1-URGENT' AS o_orderpriority", "cast(day AS timestamp) AS o_orderdate", "i AS o_orderkey"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    rows = equal_to_sql(spark, "experiment_learnings", tmp_path, ["orders"])
    assert sum("-0.0%" in str(r) for r in rows) >= 2


def test_pages_are_read_in_slices():
    """No more than a slice of a batch is held as Python objects; order and nulls stay."""
    texts = ["<title>" + str(k) + "</title>" + "x" * (k % 7 * 100_000) if k % 5 else None for k in range(700)]
    parts = list(html.parsed.func(iter([pa.array(texts), pa.array([], pa.string())])))
    assert max(map(len, parts)) <= batches.ROWS and len(parts) > 100
    assert [p["title"] for part in parts for p in part.to_pylist()] == [str(k) if k % 5 else "" for k in range(700)]
    seen = []
    assert sum(map(len, batches.sliced(pa.array(texts), lambda s: seen.append(sum(len(t or "") for t in s)) or pa.array(s)))) == 700
    assert max(seen) <= batches.BYTES
    assert fingerprints.simhash.func(pa.array(texts)).to_pylist()[:2] == ["0" * 16, fingerprints.simhash.func(pa.array(texts[1:2])).to_pylist()[0]]


def test_sitemaps_of_sites_with_many_pages(spark, tmp_path):
    """No file holds more than its share of a site's entries, also where a site's list is cut off or has bare ampersands."""
    host = F.element_at(F.array(*(F.lit(f"www.shop{'x' * k}.example.com") for k in (1, 6, 11))), (F.floor(F.col("id") / 3) % 3 + 1).cast("int"))
    url = F.concat(F.lit("https://"), host, F.lit("/en/"), F.col("id"), F.lit("?page=2&ref=x"))
    spark.range(12000).select(F.col("id").alias("page_id"), url.alias("url"), F.lit("").alias("html")).write.parquet(f"{tmp_path}/pages.parquet")
    assert len(equal_to_sql(spark, "sitemap_entries", tmp_path, ["pages"])) > 7000
    files = site_plans.sitemap_files(spark, str(tmp_path)).select(F.size(F.split("sitemap_xml", "<loc>")).alias("n")).agg(F.max("n"), F.count("*")).first()
    assert files[0] <= site_plans.ENTRIES + 1 and files[1] > 6


def test_topics_are_counted_in_their_run(spark, capsys):
    """Nothing groups or ranks the phrases of many runs; ties stand by first place, and what occurs once is no topic."""
    words = ["zeta", "beta", "zeta", "beta", "once"] + [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(25)] * 3
    rows = spark.createDataFrame([(1, 1, None, " ".join(words)), (2, 1, "solo", None)], "run_id long, position int, title string, snippet string")
    got = serp.topics(rows)
    got.explain()
    assert "Window" not in capsys.readouterr().out
    first = sorted(map(tuple, got.select("rank", "phrase", "n").collect()))
    assert len(first) == serp.ENTITIES and first[0] == (1, "waa", 3) and [r[0] for r in first] == list(range(1, 21))
    few = serp.first_topics.func(pa.array([["b", "a", "a", "b", "c"], None, []])).to_pylist()
    assert few == [[{"phrase": "b", "n": 2, "rank": 1}, {"phrase": "a", "n": 2, "rank": 2}], [], []]


def test_plans_of_orders_do_not_broadcast_orders(spark, tmp_path):
    for name in ("orders", "lineitem"):
        rows = spark.read.parquet(f"{SF}/{name}.parquet")
        (rows.unionByName(rows.where("o_orderkey % 3 = 0")) if name == "orders" else rows).write.parquet(f"{tmp_path}/{name}.parquet")
    plan = registry.load()["opportunity_plans"].spark(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan
    equal_to_sql(spark, "opportunity_plans", tmp_path, ["orders", "lineitem"])
