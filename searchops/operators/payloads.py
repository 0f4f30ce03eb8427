"""Landed provider payloads (JSON text) as rows: search results, search metrics, page speed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Block of a search payload and the feature that it is.
FEATURES = (("inline_videos", "video"), ("inline_images", "image_pack"), ("top_stories", "top_stories"), ("local_results", "local_pack"), ("shopping_results", "shopping"))
#: Our metric and its name in the sessions report.
SESSION_METRICS = (("organic_sessions", "sessions"), ("conversions", "conversions"), ("revenue", "totalRevenue"), ("users", "totalUsers"), ("bounce_rate", "bounceRate"))
SEARCH_METRICS = ("clicks", "impressions", "ctr", "position")
#: Our vital, its field metric and factor, its lab audit (interaction delay has none).
VITALS = (
    ("lcp_ms", "LARGEST_CONTENTFUL_PAINT_MS", 1.0, "largest-contentful-paint"),
    ("inp_ms", "INTERACTION_TO_NEXT_PAINT", 1.0, None),
    ("cls", "CUMULATIVE_LAYOUT_SHIFT_SCORE", 0.01, "cumulative-layout-shift"),
    ("ttfb_ms", "EXPERIMENTAL_TIME_TO_FIRST_BYTE", 1.0, "server-response-time"),
)
_TITLES = "array<struct<title:string>>"
_SEARCH = f"""struct<organic_results:array<struct<position:int,link:string,title:string,snippet:string>>, related_questions:array<struct<question:string>>, people_also_ask:array<struct<question:string>>,
  {", ".join(f"{k}:{_TITLES}" for k, _ in FEATURES)}, related_searches:array<struct<query:string>>,
  ai_overview:struct<text_blocks:array<struct<type:string,snippet:string,list:array<struct<title:string,snippet:string>>>>, references:array<struct<title:string,link:string>>, page_token:string>>"""
_TASKS = "struct<tasks:array<struct<result:array<struct<items:array<struct<type:string,rank_absolute:int,url:string,title:string,description:string,items:array<struct<title:string>>>>>>>>>"


def _or(value: Column | str, default: str = "") -> Column:
    return F.coalesce(value, F.lit(default))


def search_results(payloads: DataFrame) -> DataFrame:
    """run_id, position, url, title, snippet of payloads(run_id, payload); a result without a position has its place."""
    rows = payloads.select("run_id", F.posexplode(F.from_json("payload", _SEARCH)["organic_results"]).alias("i", "r"))
    return rows.select("run_id", F.coalesce("r.position", F.col("i") + 1).alias("position"), _or("r.link").alias("url"), _or("r.title").alias("title"), _or("r.snippet").alias("snippet"))


def search_features(payloads: DataFrame) -> DataFrame:
    """run_id, type, items, text, cited_urls of every feature: snippet, questions, blocks and the AI overview, whose text joins its
    blocks and list entries and which cites the links of its references."""
    p = payloads.select("run_id", "payload", F.from_json("payload", _SEARCH).alias("p"))
    none = F.array().cast("array<string>")
    one = lambda kind, there, items=none, text=None, cited=none: F.when(
        there, F.struct(F.lit(kind).alias("type"), F.coalesce(items, none).alias("items"), (F.lit(None).cast("string") if text is None else text).alias("text"), F.coalesce(cited, none).alias("cited_urls"))
    )
    asked = F.when(F.size("p.related_questions") > 0, F.col("p.related_questions")).otherwise(F.col("p.people_also_ask"))
    raw = lambda key: F.get_json_object("payload", f"$.{key}")
    there = lambda key: raw(key).isNotNull() & ~raw(key).isin("", "[]", "{}", "null", "false", "0")
    titles = lambda key: F.transform(F.col(f"p.{key}"), lambda x: _or(x["title"]))
    entry = lambda x: F.trim(F.concat_ws(" ", _or(x["title"]), _or(x["snippet"])))
    block = lambda b: F.when(b["type"] == "list", F.array_join(F.transform(F.coalesce(b["list"], F.array().cast("array<struct<title:string,snippet:string>>")), entry), " ")).otherwise(_or(b["snippet"]))
    overview = F.col("p.ai_overview")
    text = F.trim(F.array_join(F.transform(F.coalesce(overview["text_blocks"], F.array().cast("array<struct<type:string,snippet:string,list:array<struct<title:string,snippet:string>>>>")), block), " "))
    cited = F.filter(F.transform(overview["references"], lambda r: r["link"]), lambda u: _or(u) != "")
    features = F.array_compact(F.array(
        one("featured_snippet", there("answer_box")),
        one("people_also_ask", F.size(asked) > 0, F.transform(asked, lambda q: _or(q["question"]))),
        *(one(kind, there(key), titles(key)) for key, kind in FEATURES),
        one("ai_overview", there("ai_overview"), F.transform(overview["references"], lambda r: _or(r["title"])), text, cited),
    ))
    return p.select("run_id", F.posexplode(features).alias("ordinal", "f")).select("run_id", "ordinal", "f.*")


def related_searches(payloads: DataFrame) -> DataFrame:
    rows = payloads.select("run_id", F.posexplode(F.from_json("payload", _SEARCH)["related_searches"]).alias("ordinal", "r"))
    return rows.select("run_id", "ordinal", _or("r.query").alias("query"))


def task_results(payloads: DataFrame) -> DataFrame:
    """Organic results of the second payload shape: items of the first result of the first task."""
    items = F.get(F.get(F.from_json("payload", _TASKS)["tasks"], 0)["result"], 0)["items"]
    rows = payloads.select("run_id", F.posexplode(F.filter(items, lambda x: x["type"] == "organic")).alias("i", "r"))
    return rows.select("run_id", F.coalesce("r.rank_absolute", F.col("i") + 1).alias("position"), _or("r.url").alias("url"), _or("r.title").alias("title"), _or("r.description").alias("snippet"))


def task_questions(payloads: DataFrame) -> DataFrame:
    items = F.get(F.get(F.from_json("payload", _TASKS)["tasks"], 0)["result"], 0)["items"]
    rows = payloads.select("run_id", F.explode(F.filter(items, lambda x: x["type"] == "people_also_ask")).alias("r"))
    return rows.select("run_id", F.explode("r.items").alias("q")).select("run_id", _or("q.title").alias("question"))


def search_metrics(payloads: DataFrame, wanted: tuple[str, ...] = SEARCH_METRICS) -> DataFrame:
    """project_id, metric, day, value, source of payloads(project_id, payload) of the search console: one row a metric that is there."""
    schema = f"struct<rows:array<struct<keys:array<string>,{','.join(f'{m}:double' for m in SEARCH_METRICS)}>>>"
    rows = payloads.select("project_id", F.explode(F.from_json("payload", schema)["rows"]).alias("r"))
    rows = rows.select("project_id", F.to_date(F.get("r.keys", 0)).alias("day"), *(F.col(f"r.{m}").alias(m) for m in wanted))
    tall = rows.unpivot(["project_id", "day"], list(wanted), "metric", "value").where("value is not null")
    return tall.select("project_id", "metric", "day", "value", F.lit("gsc").alias("source"))


def session_metrics(payloads: DataFrame) -> DataFrame:
    """As search_metrics, of session reports: a header of metric names and rows of a date and values."""
    value = "array<struct<value:string>>"
    p = payloads.select("project_id", F.from_json("payload", f"struct<metricHeaders:array<struct<name:string>>,rows:array<struct<dimensionValues:{value},metricValues:{value}>>>").alias("p"))
    rows = p.select("project_id", F.col("p.metricHeaders.name").alias("names"), F.explode("p.rows").alias("r"))
    pairs = F.arrays_zip(F.col("names"), F.col("r.metricValues.value").alias("text"))
    rows = rows.select("project_id", F.to_date(F.get("r.dimensionValues.value", 0), "yyyyMMdd").alias("day"), F.explode(pairs).alias("m"))
    ours = rows.sparkSession.createDataFrame(SESSION_METRICS, "metric string, names string")
    rows = rows.select("project_id", "day", "m.names", F.expr("try_cast(m.text AS double)").alias("value")).join(F.broadcast(ours), "names")  # constant
    return rows.where("value is not null").select("project_id", "metric", "day", "value", F.lit("ga4").alias("source"))


def vitals(payloads: DataFrame) -> DataFrame:
    """url, strategy, source ("field" or "lab"), lcp_ms, inp_ms, cls, ttfb_ms of page-speed payloads(url, strategy, payload)."""
    number = lambda path: F.get_json_object("payload", path).try_cast("double")
    there = lambda path: ~_or(F.get_json_object("payload", path)).isin("", "{}")
    field = [(number(f"$.loadingExperience.metrics.{name}.percentile") * factor).alias(v) for v, name, factor, _ in VITALS]
    lab = [(F.lit(None).cast("double") if audit is None else number(f"$.lighthouseResult.audits.{audit}.numericValue")).alias(v) for v, _, _, audit in VITALS]
    one = lambda source, path, columns: F.when(there(path), F.struct(F.lit(source).alias("source"), *columns))
    rows = payloads.select("url", "strategy", F.explode(F.array_compact(F.array(one("field", "$.loadingExperience.metrics", field), one("lab", "$.lighthouseResult.audits", lab)))).alias("v"))
    return rows.select("url", "strategy", "v.*")


def reading_fingerprint(rows: DataFrame) -> DataFrame:
    """vitals rows with the SHA-256 of their readings, by which the same reading is taken once; a null reads "None"."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    return rows.withColumn("content_hash", F.sha2(F.concat_ws("|", *map(text, ("url", "strategy", "source", *(v for v, *_ in VITALS)))), 256))


def asked_questions(payloads: DataFrame) -> DataFrame:
    """run_id, question of the first payload shape; related questions stand before those that people also ask."""
    p = F.from_json("payload", _SEARCH)
    asked = F.when(F.size(p["related_questions"]) > 0, p["related_questions"]).otherwise(p["people_also_ask"])
    return payloads.select("run_id", F.explode(asked).alias("q")).select("run_id", _or("q.question").alias("question"))


#: What each provider's payloads are read by; callers may give others of the same two forms.
PROVIDERS = {"search": (search_results, asked_questions), "tasks": (task_results, task_questions)}


def provider_results(payloads: DataFrame, providers: dict = PROVIDERS) -> DataFrame:
    """provider, run_id, position, url, title, snippet of payloads(run_id, provider, payload), each read in its provider's shape;
    payloads of a provider that is not known give nothing."""
    return _by_provider(payloads, providers, 0)


def provider_questions(payloads: DataFrame, providers: dict = PROVIDERS) -> DataFrame:
    return _by_provider(payloads, providers, 1)


def _by_provider(payloads: DataFrame, providers: dict, part: int) -> DataFrame:
    rows = [read[part](payloads.where(F.col("provider") == name)).withColumn("provider", F.lit(name)) for name, read in providers.items()]
    return reduce(DataFrame.unionByName, rows)
