"""Queries on search payloads made from ``pages`` and ``conversations``, metric payloads from ``orders`` and ``events``, and keyword tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls as ux
from ..operators import keywords, lifecycle, payloads, serp, technical
from ..sources.tables import keeper
from .analytics import TERMS_SQL, terms
from .analytics import _INTENT as INTENT_SQL
from .registry import QUERIES, Query
from .technical import DOMAIN, HOST


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def search_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """A payload for each conversation: its turns are the results, with the page of the same number as link; user turns are asked
    questions and related searches, the third turn stands in an AI overview."""
    pages = _t(spark, sf, "pages").agg(F.max("page_id").alias("n"))
    c = _t(spark, sf, "conversations").crossJoin(F.broadcast(pages))  # one row
    c = c.withColumn("page_id", F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.col("n") + 1)).join(_t(spark, sf, "pages").select("page_id", "url"), "page_id")
    result = F.struct("turn", F.when(F.col("turn") % 3 != 0, F.col("turn") + 1).alias("position"), F.col("url").alias("link"), F.left("text", F.lit(40)).alias("title"), F.col("text").alias("snippet"))
    question = F.when(F.col("role") == "user", F.struct("turn", F.concat(F.left("text", F.lit(20)), F.when(F.col("turn") % 4 == 0, "?").otherwise("")).alias("question")))
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(result)).alias("r"), F.array_sort(F.collect_list(question)).alias("q"))
    overview = F.struct(F.array(
        F.struct(F.lit("paragraph").alias("type"), F.get("r", 0)["snippet"].alias("snippet")),
        F.struct(F.lit("paragraph").alias("type"), F.lit("end").alias("snippet")),
    ).alias("text_blocks"), F.array(F.struct(F.lit("source").alias("title"), F.get("r", 0)["link"].alias("link"))).alias("references"))
    payload = F.to_json(F.struct(
        F.transform("r", lambda x: x.dropFields("turn")).alias("organic_results"),
        F.transform("q", lambda x: x.dropFields("turn")).alias("related_questions"),
        F.transform("q", lambda x: F.struct(x["question"].alias("query"))).alias("related_searches"),
        F.when(F.col("conv_id") % 2 == 0, F.struct(F.lit("a").alias("answer"))).alias("answer_box"),
        F.when(F.col("conv_id") % 3 == 0, F.array(F.struct(F.lit("v").alias("title")))).alias("inline_videos"),
        F.when(F.col("conv_id") % 5 == 0, F.struct(F.lit(1).alias("more"))).alias("local_results"),
        F.when(F.col("conv_id") % 4 == 0, overview).alias("ai_overview"),
    ))
    return rows.select(F.col("conv_id").alias("run_id"), payload.alias("payload"))


def landed(spark: SparkSession, sf: str) -> DataFrame:
    return keeper(spark)(search_payloads(spark, sf))


RESULTS_SQL = """src AS (SELECT conv_id AS run_id, turn, role, text, url FROM conversations c JOIN pages p ON p.page_id = (c.conv_id * 7 + c.turn) % (SELECT max(page_id) + 1 FROM pages)),
results AS (SELECT run_id, CAST(CASE WHEN turn % 3 <> 0 THEN turn + 1 ELSE place END AS INT) AS position, url, left(text, 40) AS title, text AS snippet, turn FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY turn) AS place FROM src)),
asked AS (SELECT run_id, turn, left(text, 20) || CASE WHEN turn % 4 = 0 THEN '?' ELSE '' END AS question FROM src WHERE role = 'user')"""


def search_results(spark: SparkSession, sf: str) -> DataFrame:
    return payloads.search_results(search_payloads(spark, sf))


def provider_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Every second run's payload as the other provider sends it."""
    one = landed(spark, sf).withColumn("provider", F.when(F.col("run_id") % 2 == 0, "search").otherwise("tasks"))
    odd, even = one.where("run_id % 2 = 1"), one.where("run_id % 2 = 0")
    item = "struct<type:string,rank_absolute:int,url:string,title:string,description:string,items:array<struct<title:string>>>"
    got = odd.select("run_id", "provider", F.from_json("payload", "struct<organic_results:array<struct<position:int,link:string,title:string,snippet:string>>,related_questions:array<struct<question:string>>>").alias("p"))
    none = F.lit(None).cast("string")
    organic = F.transform("p.organic_results", lambda r, i: F.struct(F.lit("organic").alias("type"), F.coalesce(r["position"], i + 1).alias("rank_absolute"), r["link"].alias("url"), r["title"].alias("title"), r["snippet"].alias("description"), F.lit(None).cast("array<struct<title:string>>").alias("items")))
    asked = F.struct(F.lit("people_also_ask").alias("type"), F.lit(None).cast("int").alias("rank_absolute"), none.alias("url"), none.alias("title"), none.alias("description"), F.transform("p.related_questions", lambda q: F.struct(q["question"].alias("title"))).alias("items"))
    items = F.concat(organic.cast(f"array<{item}>"), F.array(asked).cast(f"array<{item}>"))
    tasks = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(items.alias("items"))).alias("result"))).alias("tasks")))
    return got.select("run_id", "provider", tasks.alias("payload")).unionByName(even.select("run_id", "provider", "payload"))


def provider_results(spark: SparkSession, sf: str) -> DataFrame:
    return payloads.provider_results(provider_payloads(spark, sf))


def provider_questions(spark: SparkSession, sf: str) -> DataFrame:
    return payloads.provider_questions(provider_payloads(spark, sf))


def search_features(spark: SparkSession, sf: str) -> DataFrame:
    f = payloads.search_features(search_payloads(spark, sf))
    return f.select("run_id", "type", F.array_join("items", "|").alias("items"), F.coalesce("text", F.lit("")).alias("text"), F.array_join("cited_urls", "|").alias("cited_urls"))


def _params(results: DataFrame) -> DataFrame:
    d = ux.domain(F.col("url"))
    return results.groupBy("run_id").agg(F.min(d).alias("own_domain"), F.array(F.max(d)).alias("competitor_domains"))


def first_positions(spark: SparkSession, sf: str) -> DataFrame:
    r = payloads.search_results(landed(spark, sf))
    got = serp.positions(serp.first_positions(serp.tagged(r, _params(r))))
    rivals = F.array_join(F.transform(F.array_sort(F.map_entries("competitor_positions")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), "|")
    return got.select("run_id", F.array_join("top_domains", "|").alias("top_domains"), "own_position", rivals.alias("rivals"))


def topic_mining(spark: SparkSession, sf: str) -> DataFrame:
    return serp.topics(payloads.search_results(search_payloads(spark, sf)))


def search_questions(spark: SparkSession, sf: str) -> DataFrame:
    p = landed(spark, sf)
    return serp.questions(payloads.search_features(p), payloads.related_searches(p))


def content_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Topics of a run that its first result lacks."""
    r = payloads.search_results(landed(spark, sf))
    pages = r.groupBy("run_id").agg(F.min_by("snippet", F.struct("position", "snippet")).alias("page_text"))
    return serp.content_gap(serp.topics(r), pages)


def content_briefs(spark: SparkSession, sf: str) -> DataFrame:
    p = landed(spark, sf)
    r = payloads.search_results(p)
    runs = p.select("run_id", F.concat(F.lit("term "), F.col("run_id").cast("string")).alias("keyword"), (F.col("run_id") % 5 * 900).cast("int").alias("competitor_words"))
    b = serp.briefs(runs, serp.topics(r), serp.questions(payloads.search_features(p), payloads.related_searches(p)), serp.first_positions(serp.tagged(r, _params(r))))
    return b.select("run_id", "keyword", "target_word_count", *(F.array_join(c, "|").alias(c) for c in ("headings", "questions", "entities", "competitor_urls")))


def ai_overviews(spark: SparkSession, sf: str) -> DataFrame:
    return serp.ai_overviews(payloads.search_features(search_payloads(spark, sf)))


def _metric_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """A search console payload a priority: orders a day as clicks, and their mean price, where it is high, as position."""
    o = _t(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("project_id"), F.to_date("o_orderdate").alias("day")).agg(F.count("*").cast("double").alias("clicks"), F.max("o_totalprice").cast("double").alias("p"))
    row = F.struct(F.array(F.col("day").cast("string")).alias("keys"), "clicks", F.when(F.col("p") > 200000, F.col("p")).alias("position"))
    return o.groupBy("project_id").agg(F.to_json(F.struct(F.collect_list(row).alias("rows"))).alias("payload"))


def console_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return payloads.search_metrics(_metric_payloads(spark, sf))


def session_metrics(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events").groupBy("event_type", F.date_format("ts", "yyyyMMdd").alias("d")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("v"))
    v = lambda c: F.struct(F.col(c).cast("string").alias("value"))
    row = F.struct(F.array(v("d")).alias("dimensionValues"), F.array(v("n"), v("n"), v("v")).alias("metricValues"))
    head = F.array(*(F.struct(F.lit(h).alias("name")) for h in ("sessions", "unknown", "totalRevenue")))
    p = e.groupBy(F.col("event_type").alias("project_id")).agg(F.to_json(F.struct(head.alias("metricHeaders"), F.collect_list(row).alias("rows"))).alias("payload"))
    return payloads.session_metrics(p)


def _vitals(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "pages")
    k = F.col("page_id")
    number = lambda c: F.struct(c.alias("percentile"))
    value = lambda c: F.struct(c.cast("double").alias("numericValue"))
    field = F.struct(number(k * 37 % 6000).alias("LARGEST_CONTENTFUL_PAINT_MS"), number(k * 11 % 700).alias("INTERACTION_TO_NEXT_PAINT"), number(k * 3 % 40).alias("CUMULATIVE_LAYOUT_SHIFT_SCORE"))
    lab = F.struct(value(k * 53 % 6000).alias("largest-contentful-paint"), value(k * 17 % 2500).alias("server-response-time"))
    payload = F.to_json(F.struct(F.when(k % 4 != 0, F.struct(field.alias("metrics"))).alias("loadingExperience"), F.struct(lab.alias("audits")).alias("lighthouseResult")))
    return payloads.vitals(p.select("url", F.lit("mobile").alias("strategy"), payload.alias("payload")))


def vitals_readings(spark: SparkSession, sf: str) -> DataFrame:
    return payloads.reading_fingerprint(_vitals(spark, sf)).drop("content_hash")


def vitals_findings(spark: SparkSession, sf: str) -> DataFrame:
    tall = _vitals(spark, sf).unpivot(["url", "strategy", "source"], [v for v, *_ in payloads.VITALS], "metric", "value")
    rated = lifecycle.rate_vitals(tall).withColumn("site", ux.host(F.col("url")))
    return technical.vitals_findings(rated).select("site", "check_code", "severity", "url", "normalized_key")


def new_keywords(spark: SparkSession, sf: str) -> DataFrame:
    t = _t(spark, sf, "part").select(F.col("p_brand").alias("project_id"), F.col("p_partkey").alias("ordinal"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat("p_name", F.lit("!"))).alias("term"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("volume"))
    known = t.where("ordinal % 9 = 0").select("project_id", tx.keyword(F.col("term")).alias("normalized"))
    return keywords.new_keywords(t, known)


def keyword_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Rounds of the greedy clustering, and the clusters they give; tests/ compare the members with the sequential form."""
    keep = keeper(spark)
    t = keep(terms(spark, sf).select("term", "volume", tx.tokens(F.col("term")).alias("tokens")))
    members = keywords.clusters(t, keep).join(t.select("term", "volume"), "term")
    first = keywords.intents(terms(spark, sf)).where("rank = 1").select("term", "intent")
    return keywords.cluster_rollup(members, first).withColumn("intents", F.array_join("intents", ","))


def keyword_overview(spark: SparkSession, sf: str) -> DataFrame:
    """All clusters of the greedy clustering, the largest first, with the number of keywords."""
    return keywords.overview(keyword_clusters(spark, sf))


def replaced_intents(spark: SparkSession, sf: str) -> DataFrame:
    """Intents of all terms are there; those of terms about a widget are written anew with their rank only."""
    every = keywords.intents(terms(spark, sf)).select("term", "rank", "intent")
    new = every.where("term like '%widget%' and rank = 1")
    return keywords.replaced(every, new, "term")


_PHRASES = "list_filter(regexp_extract_all(lower(corpus), '" + serp.WORD.replace("'", "''") + "', 1), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in serp.STOP) + "))"
TOPICS_SQL = f"""corpus AS (SELECT run_id, string_agg(title || ' ' || snippet, ' ' ORDER BY position, title || ' ' || snippet) AS corpus, count(*) AS results FROM results GROUP BY 1),
worded AS (SELECT run_id, results, {_PHRASES} AS w FROM corpus),
placed AS (SELECT run_id, results, list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END) AS p FROM worded),
flat AS (SELECT run_id, results, unnest(p) AS phrase, unnest(range(len(p))) AS spot FROM placed),
topics AS (SELECT run_id, phrase, n, round(n / greatest(1, results), 3) AS weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n DESC, spot) AS rank FROM (SELECT run_id, results, phrase, count(*) AS n, min(spot) AS spot FROM flat GROUP BY ALL)) WHERE rank <= 20 AND n >= 2)"""
FIRSTS_SQL = f"""firsts AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY position, domain) AS rank FROM (SELECT run_id, {DOMAIN.format("url")} AS domain, min(position) AS position FROM results GROUP BY ALL))"""
QUESTIONS_SQL = """questions AS (SELECT run_id, question, rank FROM (SELECT run_id, question, row_number() OVER (PARTITION BY run_id ORDER BY part, turn) AS rank FROM (SELECT run_id, 0 AS part, turn, question FROM asked UNION ALL SELECT run_id, 1, turn, question FROM asked WHERE question LIKE '%?')) WHERE rank <= 15)"""
_POOR = " UNION ALL ".join(f"SELECT url, '{code}' AS check_code, '{sev}' AS severity FROM v WHERE {col} > {limit}" for code, sev, col, limit in (("cwv_lcp_poor", "high", "lcp_ms", 4000), ("cwv_inp_poor", "high", "inp_ms", 500), ("cwv_cls_poor", "medium", "cls", 0.25), ("cwv_ttfb_poor", "medium", "ttfb_ms", 1800)))
VITALS_SQL = """v AS (SELECT url, 'mobile' AS strategy, 'field' AS source, (page_id * 37 % 6000)::DOUBLE AS lcp_ms, (page_id * 11 % 700)::DOUBLE AS inp_ms, (page_id * 3 % 40)::DOUBLE * 0.01::DOUBLE AS cls, NULL::DOUBLE AS ttfb_ms FROM pages WHERE page_id % 4 <> 0
  UNION ALL SELECT url, 'mobile', 'lab', (page_id * 53 % 6000)::DOUBLE, NULL, NULL, (page_id * 17 % 2500)::DOUBLE FROM pages)"""

QUERIES.update(
    search_results=Query(search_results, f"WITH {RESULTS_SQL} SELECT run_id, position, url, title, snippet FROM results"),
    provider_results=Query(provider_results, f"WITH {RESULTS_SQL} SELECT if(run_id % 2 = 0, 'search', 'tasks') AS provider, run_id, position, url, title, snippet FROM results"),
    provider_questions=Query(provider_questions, f"WITH {RESULTS_SQL} SELECT if(run_id % 2 = 0, 'search', 'tasks') AS provider, run_id, question FROM asked"),
    search_features=Query(
        search_features,
        f"""WITH {RESULTS_SQL}, first AS (SELECT * FROM src QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY turn) = 1)
        SELECT DISTINCT run_id, 'featured_snippet' AS type, '' AS items, '' AS text, '' AS cited_urls FROM src WHERE run_id % 2 = 0
        UNION ALL SELECT run_id, 'people_also_ask', string_agg(question, '|' ORDER BY turn), '', '' FROM asked GROUP BY 1
        UNION ALL SELECT DISTINCT run_id, 'video', 'v', '', '' FROM src WHERE run_id % 3 = 0 UNION ALL SELECT DISTINCT run_id, 'local_pack', '', '', '' FROM src WHERE run_id % 5 = 0
        UNION ALL SELECT run_id, 'ai_overview', 'source', trim(text || ' end'), url FROM first WHERE run_id % 4 = 0""",
    ),
    first_positions=Query(
        first_positions,
        f"""WITH {RESULTS_SQL}, {FIRSTS_SQL} SELECT run_id, string_agg(domain, '|' ORDER BY rank) FILTER (rank <= 10) AS top_domains, min(position) FILTER (domain = lo) AS own_position, string_agg(domain || '=' || position, '|') FILTER (domain = hi) AS rivals
        FROM (SELECT *, min(domain) OVER (PARTITION BY run_id) AS lo, max(domain) OVER (PARTITION BY run_id) AS hi FROM firsts) GROUP BY 1""",
    ),
    topic_mining=Query(topic_mining, f"WITH {RESULTS_SQL}, {TOPICS_SQL} SELECT * FROM topics"),
    search_questions=Query(search_questions, f"WITH {RESULTS_SQL}, {QUESTIONS_SQL} SELECT * FROM questions"),
    content_gaps=Query(content_gaps),
    content_briefs=Query(
        content_briefs,
        f"""WITH {RESULTS_SQL}, {TOPICS_SQL}, {FIRSTS_SQL}, {QUESTIONS_SQL}, runs AS (SELECT DISTINCT run_id FROM src),
        t AS (SELECT run_id, string_agg(phrase, '|' ORDER BY rank) FILTER (rank <= 15) AS entities, string_agg(array_to_string(list_transform(string_split(phrase, ' '), lambda w: upper(w[1]) || w[2:]), ' '), '|' ORDER BY rank) FILTER (rank <= 8) AS heads FROM topics GROUP BY 1)
        SELECT run_id, 'term ' || run_id AS keyword, greatest(500, least(3000, CASE WHEN run_id % 5 = 0 THEN 900 ELSE run_id % 5 * 900 END))::INT AS target_word_count, coalesce(heads, 'What is term ' || run_id || '?') AS headings,
          coalesce((SELECT string_agg(question, '|' ORDER BY rank) FROM questions q WHERE q.run_id = r.run_id AND rank <= 10), '') AS questions, coalesce(entities, '') AS entities,
          coalesce((SELECT string_agg('https://' || domain || '/', '|' ORDER BY rank) FROM firsts f WHERE f.run_id = r.run_id AND rank <= 5), '') AS competitor_urls FROM runs r LEFT JOIN t USING (run_id)""",
    ),
    ai_overviews=Query(ai_overviews, f"WITH {RESULTS_SQL} SELECT run_id, 'google_ai_overview' AS provider, trim(text || ' end') AS text FROM src WHERE run_id % 4 = 0 QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY turn) = 1"),
    console_metrics=Query(
        console_metrics,
        """WITH o AS (SELECT o_orderpriority AS project_id, CAST(o_orderdate AS DATE) AS day, CAST(count(*) AS DOUBLE) AS clicks, max(o_totalprice)::DOUBLE AS p FROM orders GROUP BY ALL)
        SELECT project_id, 'clicks' AS metric, day, clicks AS value, 'gsc' AS source FROM o UNION ALL SELECT project_id, 'position', day, p, 'gsc' FROM o WHERE p > 200000""",
    ),
    session_metrics=Query(
        session_metrics,
        """WITH e AS (SELECT event_type AS project_id, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY ALL)
        SELECT project_id, 'organic_sessions' AS metric, day, CAST(n AS DOUBLE) AS value, 'ga4' AS source FROM e UNION ALL SELECT project_id, 'revenue', day, v, 'ga4' FROM e""",
    ),
    vitals_readings=Query(vitals_readings, f"WITH {VITALS_SQL} SELECT * FROM v"),
    vitals_findings=Query(vitals_findings, f"WITH {VITALS_SQL} SELECT DISTINCT {HOST.format('url')} AS site, check_code, severity, url, sha256(check_code || '|' || url) AS normalized_key FROM ({_POOR})"),
    new_keywords=Query(
        new_keywords,
        r"""WITH t AS (SELECT p_brand AS project_id, p_partkey AS ordinal, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name || '!' END AS term, CASE WHEN p_size > 10 THEN p_size END AS volume FROM part),
        n AS (SELECT *, trim(regexp_replace(regexp_replace(lower(term), '[^a-z0-9_ ''-]', ' ', 'g'), ' +', ' ', 'g')) AS normalized FROM t)
        SELECT project_id, normalized, term, volume, volume IS NULL AS volume_estimated FROM n WHERE (project_id, normalized) NOT IN (SELECT project_id, normalized FROM n WHERE ordinal % 9 = 0)
        QUALIFY row_number() OVER (PARTITION BY project_id, normalized ORDER BY ordinal, term) = 1""",
    ),
    keyword_clusters=Query(keyword_clusters),
    keyword_overview=Query(keyword_overview),
    replaced_intents=Query(
        replaced_intents,
        f"""WITH {TERMS_SQL}, s AS (SELECT term, ' ' || lower(trim(term)) || ' ' AS s FROM terms), l AS ({" UNION ALL ".join(f"SELECT term, {i} AS place, '{k}' AS intent, CAST({x} AS DOUBLE) AS confidence FROM s" for i, k, x in INTENT_SQL)}),
        t AS (SELECT *, max(confidence) OVER (PARTITION BY term) AS top FROM l),
        r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY confidence DESC, place) AS rank FROM t WHERE confidence >= 0.35 AND confidence >= 0.6 * top),
        every AS (SELECT term, rank, intent FROM r WHERE rank <= 3 UNION ALL SELECT term, 1, 'informational' FROM terms WHERE term NOT IN (SELECT term FROM r))
        SELECT * FROM every WHERE NOT term LIKE '%widget%' OR rank = 1""",
    ),
)
