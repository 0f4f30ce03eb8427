"""Queries over orders, events, part, lineitem, conversations, documents and labels."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import agreement, content, graph, keywords, lifecycle, metrics, visibility
from ..sources.kept import KeyedTable
from ..sources.tables import keeper, scoped, shared_root
from .registry import QUERIES, Query


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """Orders a day by priority."""
    o = _t(spark, sf, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("day")).agg(F.count("*").cast("double").alias("value"))


DAILY_SQL = "daily AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS day, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY ALL)"


def metric_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    """Hits that are not among those known, which are all of March."""
    d = keeper(spark)(daily(spark, sf))
    known = d.where("month(day) = 3").select("series", "day")
    return metrics.anomalies(d, known)


def anomaly_cases(spark: SparkSession, sf: str) -> DataFrame:
    cases = metrics.investigations(metric_anomalies(spark, sf))
    return cases.select("series", "day", "direction", "magnitude_pct", "status", F.explode("checklist").alias("step"))


def scoped_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their priority as tenant and their status as project: what one tenant sees of all projects and of one."""
    o = _t(spark, sf, "orders").select(F.col("o_orderpriority").alias("tenant_id"), F.col("o_orderstatus").alias("project_id"), "o_orderkey")
    every, one = scoped(o, "1-URGENT"), scoped(o, "1-URGENT", "F")
    return every.withColumn("of", F.lit("tenant")).unionByName(one.withColumn("of", F.lit("project")))


def metric_upsert(spark: SparkSession, sf: str) -> DataFrame:
    d = daily(spark, sf)
    old = d.where("day < date '1999-01-01'")
    new = d.where("day >= date '1998-07-01'").withColumn("value", F.col("value") * 2)
    return metrics.upsert(old, new, ["series", "day"])


def metric_merge(spark: SparkSession, sf: str) -> DataFrame:
    """The same days as a table that lives on: an old state, then a run of which every bucket holds only what it touches."""
    d, keys = daily(spark, sf), ["series", "day"]
    table = KeyedTable(spark, f"{shared_root(spark)}/searchops/metrics-{uuid.uuid4().hex}", keys)
    step = lambda old, new: new if old is None else metrics.upsert(old, new, keys).drop("state")
    table.merge(d.where("day < date '1999-01-01'"), step)
    return table.merge(d.where("day >= date '1998-07-01'").withColumn("value", F.col("value") * 2), step).select(*keys, "value")


def period_report(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.period_report(daily(spark, sf))


#: Updates of the time of the orders, for the experiments.
UPDATES = ((datetime.date(1998, 3, 5), datetime.date(1998, 3, 20), "an update"),)


def experiments(spark: SparkSession, sf: str) -> DataFrame:
    """One experiment a priority and month of 1998, of four metrics in turn; those of even months have another priority as control."""
    series = daily(spark, sf).select("series").distinct()
    m, months = F.col("m"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("m")
    start = F.make_date(F.lit(1998), m, F.lit(1))
    metric = F.element_at(F.array(*map(F.lit, ("clicks", "position", "users", "revenue"))), m % 4 + 1)
    control = F.when(m % 2 == 0, F.when(F.col("series") == "1-URGENT", "2-HIGH").otherwise("1-URGENT"))
    return series.select("series", months).select(
        F.concat_ws("/", "series", "m").alias("experiment_id"), "series", control.alias("control_series"), metric.alias("metric"),
        F.date_sub(start, 28).alias("baseline_start"), F.date_sub(start, 1).alias("baseline_end"), start.alias("start"), F.when(m % 5 == 0, 10).otherwise(28).alias("days"), (m % 7 == 0).alias("tracking_changed"),
    )


def experiment_effects(spark: SparkSession, sf: str) -> DataFrame:
    keep = keeper(spark)
    out = metrics.experiment_verdicts(keep(daily(spark, sf)), experiments(spark, sf), UPDATES)
    return out.withColumn("confounders", F.array_join("confounders", ","))


def experiment_learnings(spark: SparkSession, sf: str) -> DataFrame:
    keep = keeper(spark)
    v = metrics.experiment_verdicts(keep(daily(spark, sf)), experiments(spark, sf), UPDATES)
    return metrics.learnings(v.withColumn("kind", F.split_part("experiment_id", F.lit("/"), F.lit(1))), "kind")


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns as answers of two providers in four weeks, some of which cite pages."""
    c = _t(spark, sf, "conversations").where("role = 'assistant'")
    day = F.date_add(F.lit("2026-01-01").cast("date"), (F.col("conv_id") % 28).cast("int"))
    return c.select("conv_id", "turn", F.when(F.col("conv_id") % 7 != 0, F.pmod("conv_id", F.lit(7))).alias("cluster"), F.concat(F.lit("p"), F.col("turn") % 2).alias("provider"), tx.monday(day).alias("week"), F.expr(ANSWER).alias("text"))


ANSWER = "concat(text, CASE WHEN conv_id % 3 = 0 THEN ' see https://www.example.com/a). and https://rival.org/x, https://rival.org/y' ELSE '' END)"
BRAND, RIVALS, RIVAL_DOMAINS = "than", ["the", "que", "der", "les"], ["www.rival.org"]


def cited(spark: SparkSession, sf: str) -> DataFrame:
    return visibility.citations(answers(spark, sf), BRAND, "example.com", RIVALS, RIVAL_DOMAINS)


def ai_citations(spark: SparkSession, sf: str) -> DataFrame:
    return cited(spark, sf).select("conv_id", "turn", "brand_mentioned", "brand_position", F.array_join("competitors", ",").alias("competitors"), F.size("cited").alias("n_cited"), "own_url_cited", "sentiment")


#: A brand and a rival of a project, by the number of its region.
WORDS, FOES = ["than", "ment", "lich", "ando", "no such"], ["que", "keit", "tion", "der", ""]


def project_citations(spark: SparkSession, sf: str) -> DataFrame:
    """The answers dealt to six projects, of which five have brands, all in one job."""
    at = F.col("r_regionkey").cast("int") + 1
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), at)
    brands = _t(spark, sf, "region").select(
        F.col("r_regionkey").cast("long").alias("project_id"), pick(WORDS).alias("brand"), F.when(at % 2 == 1, "www.example.com").otherwise("other.org").alias("own_domain"),
        F.array(pick(FOES), F.lit("les")).alias("competitor_names"), F.when(at > 2, F.array(F.lit("www.rival.org"))).alias("competitor_domains"),
    )
    rows = answers(spark, sf).select("conv_id", "turn", (F.col("conv_id") % 6).alias("project_id"), "text")
    return visibility.project_citations(rows, brands).select("conv_id", "turn", "project_id", "brand_mentioned", "brand_position", F.array_join("competitors", ",").alias("competitors"), F.size("cited").alias("n_cited"), "own_url_cited")


def ai_visibility(spark: SparkSession, sf: str) -> DataFrame:
    return visibility.scores(cited(spark, sf), ["cluster", "provider", "week"])


def weekly_visibility(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of which those of the first provider are known with a score of nothing, and are written again."""
    new = keeper(spark)(ai_visibility(spark, sf).select("cluster", "provider", "week", "score"))
    old = new.where("provider = 'p0'").withColumn("score", F.lit(0.0)).unionByName(new.where("provider = 'p0'").withColumn("week", F.date_sub("week", 70)))
    return visibility.upsert_weekly(old, new)


def prompt_params(spark: SparkSession, sf: str) -> DataFrame:
    """A cluster for each type of part: its names are the keywords, its brands the competitors."""
    p = _t(spark, sf, "part").groupBy("p_type").agg(F.array_sort(F.collect_set("p_name")).alias("names"), F.array_sort(F.collect_set("p_brand")).alias("brands"))
    return p.select(F.col("p_type").alias("cluster_id"), F.lit("Acme").alias("brand"), F.lower("p_type").alias("category"), F.slice("names", 1, 3).alias("seed_keywords"), F.slice("brands", 1, 6).alias("competitor_names"))


def prompt_library(spark: SparkSession, sf: str) -> DataFrame:
    return visibility.prompt_library(prompt_params(spark, sf))


def prompt_battery(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts that are new, for two providers; what a comparison asks is known."""
    library = keeper(spark)(prompt_library(spark, sf))
    known = library.where("kind = 'comparison'").select("kind", F.sha2("text", 256).alias("text_hash"))
    return visibility.battery(visibility.new_prompts(library.select("kind", "text"), known), ["gemini", "perplexity"])


def terms(spark: SparkSession, sf: str) -> DataFrame:
    """Search terms with volumes: a part's name and type with a wording that varies by part."""
    p = _t(spark, sf, "part")
    words = F.element_at(F.array(*map(F.lit, WORDINGS)), (F.col("p_partkey") % len(WORDINGS) + 1).cast("int"))
    li = _t(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").cast("long").alias("q"))
    t = p.join(li, "p_partkey", "left").select(F.trim(F.concat_ws(" ", words, "p_name", F.lower("p_type"))).alias("term"), F.coalesce("q", F.lit(0)).alias("volume"))
    return t.groupBy("term").agg(F.sum("volume").alias("volume"))


WORDINGS = ["buy", "best", "how to order", "what is", "", "why", "compare", "latest news", "images of"]
TERMS_SQL = (
    "terms AS (SELECT term, CAST(sum(volume) AS BIGINT) AS volume FROM (SELECT trim(concat_ws(' ', [" + ", ".join(f"'{w}'" for w in WORDINGS) + f"][p_partkey % {len(WORDINGS)} + 1], p_name, lower(p_type))) AS term, coalesce(q, 0) AS volume "
    "FROM part LEFT JOIN (SELECT l_partkey AS p_partkey, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1) USING (p_partkey)) GROUP BY 1)"
)


def keyword_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return terms(spark, sf).select("term", "volume", F.array_join(tx.tokens(F.col("term")), " ").alias("tokens"))


def keyword_intents(spark: SparkSession, sf: str) -> DataFrame:
    return keywords.intents(terms(spark, sf))


def similar_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return keywords.similar_pairs(terms(spark, sf).select("term", tx.tokens(F.col("term")).alias("tokens")))


def bought_together(spark: SparkSession, sf: str, least: int = 0) -> DataFrame:
    """Edges from each part of an order, bought in a quantity of ``least`` or more, to the part on its next line."""
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    nxt = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    return li.where(F.col("l_quantity") >= least).join(nxt, ["l_orderkey", "l_linenumber"]).where("l_partkey <> dst").select(F.col("l_partkey").alias("src"), "dst").distinct()


EDGES_SQL = "edges AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey)"


def follows(spark: SparkSession, sf: str) -> DataFrame:
    """Edges from a part to the part of the next number that is bought with it, so that many parts have few links."""
    return bought_together(spark, sf).where("dst > src and dst - src <= 40")


def graph_traversal(spark: SparkSession, sf: str) -> DataFrame:
    keep = keeper(spark)
    starts = _t(spark, sf, "part").groupBy("p_type").agg(F.max_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("start")).select("start")
    return graph.traverse(keep(bought_together(spark, sf)), starts, 3, keep)


def link_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    covers = _t(spark, sf, "part").select(F.col("p_partkey").alias("src"), F.concat_ws("/", "p_name", "p_type").alias("dst"))
    return graph.recommendation_texts(graph.link_recommendations(keeper(spark)(follows(spark, sf)), covers, 50))


def topic_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Names of parts as topics that parts cover, and types as topics that none does."""
    p = _t(spark, sf, "part")
    covers = p.select(F.col("p_partkey").alias("src"), F.col("p_name").alias("dst"))
    return graph.topic_coverage(covers, p.select(F.explode(F.array("p_name", "p_type")).alias("topic")).distinct())


def least_covered_topics(spark: SparkSession, sf: str) -> DataFrame:
    return graph.least_covered(topic_coverage(spark, sf), 30)


def token_budget(spark: SparkSession, sf: str) -> DataFrame:
    n = F.sum(tx.approx_tokens(F.col("text")))
    return _t(spark, sf, "conversations").groupBy("conv_id").agg(n.alias("tokens"), F.count("*").alias("messages")).withColumn("over_cap", F.col("tokens") > lifecycle.CALL_TOKENS)


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations as calls of a model: the conversation is the run, its number modulo 3 the tenant."""
    n = tx.approx_tokens(F.col("text"))
    return _t(spark, sf, "conversations").select(
        F.col("conv_id").alias("run"), (F.col("conv_id") % 3).alias("tenant"), F.make_date(F.lit(2026), (F.col("conv_id") % 4 + 1).cast("int"), F.lit(1)).alias("month"),
        F.when(F.col("role") == "user", n).otherwise(0).alias("input_tokens"), F.when(F.col("role") == "user", 0).otherwise(n).alias("output_tokens"), (n * 0.01).alias("cost_usd"),
    )


def usage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Usage by run and by tenant and month, against the ceiling of each."""
    c = keeper(spark)(calls(spark, sf))
    cols = ["calls", "input_tokens", "output_tokens", "cost_usd", "over_budget"]
    run = lifecycle.usage(c, ["run"], lifecycle.RUN_COST).select(F.concat(F.lit("run "), "run").alias("of"), *cols)
    return run.unionByName(lifecycle.usage(c, ["tenant", "month"], lifecycle.MONTH_COST).select(F.concat_ws(" ", F.lit("tenant"), "tenant", "month").alias("of"), *cols))


def label_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """A rule's label of each document's quality against the labelled ones; both verdicts against the thresholds of two engines."""
    bad = F.regexp_count("text", F.lit(r"(!!|\|)")) >= 20
    said = _t(spark, sf, "documents").where(bad).select(F.lit("technical_engine").alias("engine"), "doc_id")
    true = _t(spark, sf, "labels").where("quality = 0").select(F.lit("technical_engine").alias("engine"), "doc_id")
    got = lifecycle.prf(lifecycle.confusion(said, true, ["engine", "doc_id"]))
    tall = got.unpivot(["engine", "tp", "fp", "fn"], ["precision", "recall", "f1"], "metric", "value")
    bounds = spark.createDataFrame(lifecycle.THRESHOLDS, "engine string, metric string, bound double, lower_is_better boolean")
    return lifecycle.judged(tall, bounds)


def rank_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Of lines by return flag: do their prices rank as their quantities do, of which there are few distinct ones?"""
    return agreement.rank_correlation(_t(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice", keeper(spark))


def engine_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """The thresholds of rank correlation and of false alarms: lines' prices as scores of an order by quantity; a rule that flags
    documents, on those that are labelled good."""
    lines = _t(spark, sf, "lineitem").select(F.lit("opportunity_scoring").alias("engine"), "l_quantity", "l_extendedprice")
    rho = agreement.rank_correlation(lines, ["engine"], "l_quantity", "l_extendedprice", keeper(spark)).select("engine", F.lit("rank_correlation").alias("metric"), F.round("rank_correlation", 4).alias("value"))
    engine = F.lit("anomaly_detector").alias("engine")
    said = _t(spark, sf, "documents").where(F.regexp_count("text", F.lit("!!")) >= 1).select(engine, "doc_id")
    clean = _t(spark, sf, "labels").where("quality = 1").select(engine, "doc_id")
    alarms = agreement.false_positive_rate(said, clean, ["engine", "doc_id"]).select("engine", F.lit("false_positive_rate").alias("metric"), F.col("false_positive_rate").alias("value"))
    bounds = spark.createDataFrame(lifecycle.THRESHOLDS, "engine string, metric string, bound double, lower_is_better boolean")
    return lifecycle.judged(rho.unionByName(alarms), bounds)


def redacted_documents(spark: SparkSession, sf: str) -> DataFrame:
    key = F.concat(F.lit("ghp_"), F.substring(F.md5(F.col("doc_id").cast("string")), 1, 24), F.lit(" npg_"), F.substring(F.md5("source"), 1, 14))
    text = F.concat_ws(" ", "text", key)
    return _t(spark, sf, "documents").select("doc_id", F.sha2(tx.redact(text), 256).alias("redacted_sha256"), tx.has_credential(F.col("text")).alias("had_credential"))


def cannibalized_keywords(spark: SparkSession, sf: str) -> DataFrame:
    rows = content.cannibalization(_t(spark, sf, "part").withColumn("page", F.lpad(F.col("p_partkey").cast("string"), 9, "0")), ["p_brand"], "p_name", "page")
    return rows.select("p_brand", "keyword", "n", F.array_join("urls", ",").alias("pages"))


_RHO = (
    "lines AS (SELECT {0} AS g, l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL), "
    "ranked AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2 AS ry FROM lines)"
)
_CHANGE = "CASE WHEN coalesce({0}, 0) <> 0 THEN (coalesce({1}, 0) - {0}) / {0} * 100 * sign ELSE 0 END"
_EXPERIMENTS = f"""{DAILY_SQL}, x AS (SELECT series || '/' || m AS experiment_id, series, CASE WHEN m % 2 = 0 THEN CASE WHEN series = '1-URGENT' THEN '2-HIGH' ELSE '1-URGENT' END END AS control, ['clicks', 'position', 'users', 'revenue'][m % 4 + 1] AS metric,
    make_date(1998, m::INT, 1) AS start, CASE WHEN m % 5 = 0 THEN 10 ELSE 28 END AS days, m % 7 = 0 AS moved FROM (SELECT DISTINCT series FROM daily), range(1, 13) r(m)),
  g AS (SELECT experiment_id, avg(value) FILTER (d.series = x.series AND day < start) AS b, avg(value) FILTER (d.series = x.series AND day >= start) AS t, stddev_pop(value) FILTER (d.series = x.series AND day < start) AS sd, count(value) FILTER (d.series = x.series AND day < start) AS n,
    avg(value) FILTER (d.series = x.control AND day < start) AS cb, avg(value) FILTER (d.series = x.control AND day >= start) AS ct FROM x JOIN daily d ON d.series IN (x.series, x.control) AND day BETWEEN start - 28 AND start + days GROUP BY 1),
  e AS (SELECT *, CASE WHEN metric = 'position' THEN -1.0 ELSE 1.0 END AS sign, cb IS NOT NULL AND ct IS NOT NULL AS controlled FROM x LEFT JOIN g USING (experiment_id)),
  f AS (SELECT *, {_CHANGE.format("b", "t")} + 0.0 AS effect, CASE WHEN controlled THEN {_CHANGE.format("b", "t")} - {_CHANGE.format("cb", "ct")} END AS adjusted, CASE WHEN n >= 3 AND b <> 0 THEN sd / b * 100 ELSE 0 END AS noise,
    concat_ws(',', CASE WHEN moved THEN 'tracking changed' END, CASE WHEN DATE '1998-03-05' <= start + days AND DATE '1998-03-20' >= start THEN 'an update' END) AS confounders,
    days >= CASE metric WHEN 'position' THEN 14 WHEN 'clicks' THEN 28 WHEN 'revenue' THEN 42 ELSE 21 END AS window_ok FROM e),
  h AS (SELECT *, CASE WHEN confounders <> '' OR NOT window_ok THEN 'inconclusive' WHEN abs(coalesce(adjusted, effect)) <= greatest(noise, 3) THEN 'neutral' WHEN coalesce(adjusted, effect) > 0 THEN 'success' ELSE 'regression' END AS verdict FROM f),
  v AS (SELECT experiment_id, metric, round(effect, 2) AS effect_pct, round(adjusted, 2) AS control_adjusted_pct, round(noise, 2) AS noise_band_pct, window_ok, confounders, CASE WHEN controlled THEN 'difference-in-differences' ELSE 'before/after' END AS method, verdict,
    CASE WHEN verdict = 'inconclusive' THEN 0.3 WHEN verdict <> 'neutral' AND controlled THEN 0.8 ELSE 0.6 END AS confidence, verdict IN ('success', 'regression') AND controlled AS causal_language_allowed FROM h)"""
_W28 = "RANGE BETWEEN INTERVAL 28 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING"
_INTENT = [(i, k, "greatest(" + ", ".join(f"CASE WHEN contains(s, '{m}') THEN {w} ELSE 0.0 END" for m, w in marks.items()) + (", CASE WHEN regexp_matches(trim(lower(term)), '" + keywords.QUESTION + "') THEN 0.7 ELSE 0.0 END" if k == "question" else "") + ")") for i, (k, marks) in enumerate(keywords.MARKERS)]
_TOKENS = r"""list_sort(list_filter(list_distinct(list_transform(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(term), '[^a-z0-9_ ''-]', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda w: length(w) >= 2),
  lambda w: CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN left(w, length(w) - 3) || 'y' WHEN length(w) > 4 AND regexp_matches(w, '(s|x|z|ch|sh)es$') THEN left(w, length(w) - 2)
  WHEN length(w) > 3 AND w LIKE '%s' AND NOT regexp_matches(w, '(ss|us|is)$') THEN left(w, length(w) - 1) ELSE w END)), lambda w: w NOT IN (""" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + ")))"
_CITE = f"""cite0 AS (SELECT conv_id, turn, CASE WHEN conv_id % 7 <> 0 THEN conv_id % 7 END AS cluster, 'p' || turn % 2 AS provider, CAST(date_trunc('week', DATE '2026-01-01' + CAST(conv_id % 28 AS INT)) AS DATE) AS week, {ANSWER} AS text FROM conversations WHERE role = 'assistant'),
 cite AS (SELECT *, instr(lower(text), '{BRAND}') AS spot, contains(text, 'rival.org') AS by_domain,
   list_filter([{", ".join(f"CASE WHEN contains(lower(text), '{r}') THEN '{r}' END" for r in RIVALS)}], lambda x: x IS NOT NULL) AS named,
   list_distinct(list_transform(regexp_extract_all(text, '(https?://[^\\s)\\]}}>"'']+)', 1), lambda u: regexp_replace(u, '[.,);]+$', ''))) AS cited FROM cite0),
 cites AS (SELECT *, CASE WHEN by_domain THEN list_append(named, 'rival.org') ELSE named END AS rivals, spot > 0 AS brand_mentioned, CASE WHEN spot > 0 THEN length(left(text, spot - 1)) - length(replace(left(text, spot - 1), chr(10), '')) + 1 END AS brand_position,
   len(list_filter(cited, lambda u: regexp_matches(u, '^https?://(www\\.)?example\\.com([/?#]|$)'))) > 0 AS own_url_cited,
   CASE WHEN spot = 0 THEN 'neutral' WHEN regexp_matches(substring(lower(text), greatest(1, spot - 160), spot + 160 - greatest(1, spot - 160)), '{visibility.NEGATIVE}') THEN 'negative'
        WHEN regexp_matches(substring(lower(text), greatest(1, spot - 160), spot + 160 - greatest(1, spot - 160)), '{visibility.POSITIVE}') THEN 'positive' ELSE 'neutral' END AS sentiment FROM cite),
 grouped AS (SELECT cluster, provider, week, count(*) AS n, count_if(brand_mentioned) AS k, count_if(own_url_cited) / count(*) AS own, avg(brand_position) AS pos,
            (count_if(sentiment = 'positive') - count_if(sentiment = 'negative')) / count(*) AS tone, sum(len(rivals)) AS r FROM cites GROUP BY ALL),
 shares AS (SELECT *, CASE WHEN r + k > 0 THEN r / (r + k) ELSE 0 END AS share FROM grouped),
 scored AS (SELECT cluster, provider, week, n AS prompts_run, round(k / n, 4) AS mention_rate, round(own, 4) AS own_citation_rate, round(pos, 2) AS avg_brand_position, round(share, 4) AS competitor_share,
          round(greatest(0, least(100, (0.45 * k / n + 0.30 * own + 0.15 * coalesce(greatest(0, (5 - pos) / 5), 0) + 0.10 * greatest(0, tone)) * 100 * (1 - 0.3 * share))), 2) AS score FROM shares)"""
_PROMPT_ROWS = " UNION ALL ".join(
    f"SELECT cluster_id, {part} AS part, i, {k} AS k, '{kind}' AS kind, replace(replace('{text}', '{{{slot}}}', x), '{{brand}}', 'Acme') AS text FROM {slot}s"
    for part, slot in enumerate(("brand", "category", "keyword", "competitor"))
    for k, (kind, text) in enumerate((kind, text) for kind, p, text in visibility.TEMPLATES if p == slot)
)
_PROMPTS = f"""params AS (SELECT p_type AS cluster_id, list_sort(list_distinct(list(p_name)))[1:3] AS names, list_sort(list_distinct(list(p_brand)))[1:6] AS brands FROM part GROUP BY 1),
 brands AS (SELECT cluster_id, 0 AS i, 'Acme' AS x FROM params), categorys AS (SELECT cluster_id, 0 AS i, lower(cluster_id) AS x FROM params),
 keywords AS (SELECT cluster_id, unnest(range(len(names))) AS i, unnest(names) AS x FROM params), competitors AS (SELECT cluster_id, unnest(range(len(brands))) AS i, unnest(brands) AS x FROM params),
 made AS ({_PROMPT_ROWS}), once AS (SELECT * FROM made QUALIFY row_number() OVER (PARTITION BY cluster_id, lower(text) ORDER BY part, i, k) = 1),
 library AS (SELECT cluster_id, kind, text, rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY part, i, k) AS rank FROM once) WHERE rank <= 50)"""
_REDACT = "concat_ws(' ', text, concat('ghp_', substring(md5(CAST(doc_id AS VARCHAR)), 1, 24), ' npg_', substring(md5(source), 1, 14)))"
for _p in tx.CREDENTIALS:
    _REDACT = f"regexp_replace({_REDACT}, '{_p}', '{tx.PLACEHOLDER}', 'g')"

ANOMALIES_SQL = f"""WITH {DAILY_SQL}, w AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day) AS place,
            count(value) OVER s AS n_s, avg(value) OVER s AS m_s, stddev_pop(value) OVER s AS d_s, count(value) OVER e AS n_e, avg(value) OVER e AS m_e, stddev_pop(value) OVER e AS d_e
          FROM daily WINDOW s AS (PARTITION BY series, dayofweek(day) ORDER BY day {_W28}), e AS (PARTITION BY series ORDER BY day {_W28})),
        p AS (SELECT *, CASE WHEN n_s >= 3 THEN n_s ELSE n_e END AS n, CASE WHEN n_s >= 3 THEN m_s ELSE m_e END AS m, coalesce(nullif(CASE WHEN n_s >= 3 THEN d_s ELSE d_e END, 0), 1e-9) AS sd FROM w)
        SELECT series, day, CASE WHEN value < m THEN 'drop' ELSE 'spike' END AS direction, value AS observed, round(m, 4) AS baseline, round((value - m) / m * 100, 2) AS magnitude_pct, round((value - m) / sd, 3) AS z_score
        FROM p WHERE place > 4 AND n >= 3 AND abs((value - m) / sd) >= 2.5 AND abs((value - m) / m * 100) >= 15 AND month(day) <> 3"""

QUERIES.update(
    metric_anomalies=Query(metric_anomalies, ANOMALIES_SQL),
    anomaly_cases=Query(
        anomaly_cases,
        f"SELECT series, day, direction, magnitude_pct, 'open' AS status, unnest(['gsc', 'rankings', 'indexation', 'deployment_history', 'crawl_errors']) AS step FROM ({ANOMALIES_SQL})",
    ),
    scoped_orders=Query(
        scoped_orders,
        "SELECT o_orderpriority AS tenant_id, o_orderstatus AS project_id, o_orderkey, unnest(CASE WHEN o_orderstatus = 'F' THEN ['tenant', 'project'] ELSE ['tenant'] END) AS of FROM orders WHERE o_orderpriority = '1-URGENT'",
    ),
    metric_upsert=Query(
        metric_upsert,
        f"""WITH {DAILY_SQL}, o AS (SELECT * FROM daily WHERE day < DATE '1999-01-01'), n AS (SELECT series, day, value * 2 AS value FROM daily WHERE day >= DATE '1998-07-01')
        SELECT series, day, coalesce(n.value, o.value) AS value, CASE WHEN o.value IS NULL THEN 'new' WHEN n.value IS NULL THEN 'kept' ELSE 'updated' END AS state FROM o FULL OUTER JOIN n USING (series, day)""",
    ),
    metric_merge=Query(metric_merge, f"WITH {DAILY_SQL} SELECT series, day, CASE WHEN day >= DATE '1998-07-01' THEN value * 2 ELSE value END AS value FROM daily"),
    period_report=Query(
        period_report,
        f"""WITH {DAILY_SQL}, m AS (SELECT series, CAST(date_trunc('month', day) AS DATE) AS month, sum(value) AS current FROM daily GROUP BY ALL),
        b AS (SELECT m.series, m.month, m.current, p.current AS prior, round(CASE WHEN p.current <> 0 THEN (m.current - p.current) / p.current * 100 ELSE 0 END, 4) AS change_pct
              FROM m JOIN m p ON p.series = m.series AND CAST(p.month + INTERVAL 1 MONTH AS DATE) = m.month)
        SELECT *, CASE WHEN change_pct > 1 THEN 'up' WHEN change_pct < -1 THEN 'down' ELSE 'flat' END AS arrow FROM b""",
    ),
    experiment_effects=Query(experiment_effects, f"WITH {_EXPERIMENTS} SELECT experiment_id, metric, effect_pct, control_adjusted_pct, noise_band_pct, window_ok, confounders, method, verdict, confidence, causal_language_allowed FROM v"),
    experiment_learnings=Query(
        experiment_learnings,
        f"""WITH {_EXPERIMENTS} SELECT experiment_id, split_part(experiment_id, '/', 1) AS opportunity_type, verdict, confidence, CASE WHEN confidence < 0.7 THEN 0.0 WHEN verdict = 'success' THEN 0.1 WHEN verdict = 'regression' THEN -0.15 ELSE 0.0 END AS weight_delta,
          printf('%s: %s (%s %+.1f%% on %s; %s)', split_part(experiment_id, '/', 1), verdict, CASE WHEN causal_language_allowed THEN 'caused' ELSE 'associated with' END, round(effect_pct, 1), metric, CASE WHEN method LIKE 'diff%' THEN 'controlled' ELSE 'before/after only' END) AS statement FROM v""",
    ),
    ai_citations=Query(ai_citations, f"WITH {_CITE} SELECT conv_id, turn, brand_mentioned, brand_position, array_to_string(rivals, ',') AS competitors, len(cited) AS n_cited, own_url_cited, sentiment FROM cites"),
    project_citations=Query(
        project_citations,
        f"""WITH a AS (SELECT conv_id, turn, conv_id % 6 AS project_id, {ANSWER} AS text FROM conversations WHERE role = 'assistant'),
        b AS (SELECT r_regionkey AS project_id, {WORDS}[r_regionkey + 1] AS brand, {FOES}[r_regionkey + 1] AS foe FROM region),
        c AS (SELECT *, coalesce(instr(lower(text), brand), 0) AS spot, list_distinct(list_transform(regexp_extract_all(text, '(https?://[^\\s)\\]}}>"'']+)', 1), lambda u: regexp_replace(u, '[.,);]+$', ''))) AS cited FROM a LEFT JOIN b USING (project_id))
        SELECT conv_id, turn, project_id, spot > 0 AS brand_mentioned, CASE WHEN spot > 0 THEN length(left(text, spot - 1)) - length(replace(left(text, spot - 1), chr(10), '')) + 1 END AS brand_position,
          concat_ws(',', CASE WHEN foe <> '' AND contains(lower(text), foe) THEN foe END, CASE WHEN brand IS NOT NULL AND contains(lower(text), 'les') THEN 'les' END, CASE WHEN project_id BETWEEN 2 AND 4 AND contains(text, 'rival.org') THEN 'rival.org' END) AS competitors,
          len(cited) AS n_cited, project_id IN (0, 2, 4) AND contains(text, 'www.example.com/a') AS own_url_cited FROM c""",
    ),
    ai_visibility=Query(ai_visibility, f"WITH {_CITE} SELECT * FROM scored"),
    weekly_visibility=Query(weekly_visibility, f"WITH {_CITE} SELECT cluster, provider, week, score FROM scored UNION ALL SELECT cluster, provider, week - 70, score FROM scored s WHERE provider = 'p0' AND NOT EXISTS (SELECT 1 FROM scored n WHERE n.cluster IS NOT DISTINCT FROM s.cluster AND n.provider = s.provider AND n.week = s.week - 70)"),
    prompt_library=Query(prompt_library, f"WITH {_PROMPTS} SELECT * FROM library"),
    prompt_battery=Query(prompt_battery, f"WITH {_PROMPTS}, n AS (SELECT DISTINCT kind, text FROM library WHERE kind <> 'comparison') SELECT kind, text, sha256(text) AS text_hash, provider FROM n, (SELECT unnest(['gemini', 'perplexity']) AS provider)"),
    keyword_tokens=Query(keyword_tokens, f"WITH {TERMS_SQL} SELECT term, volume, array_to_string({_TOKENS}, ' ') AS tokens FROM terms"),
    keyword_intents=Query(
        keyword_intents,
        f"""WITH {TERMS_SQL}, s AS (SELECT term, ' ' || lower(trim(term)) || ' ' AS s FROM terms), l AS ({" UNION ALL ".join(f"SELECT term, {i} AS place, '{k}' AS intent, CAST({x} AS DOUBLE) AS confidence FROM s" for i, k, x in _INTENT)}),
        t AS (SELECT *, max(confidence) OVER (PARTITION BY term) AS top FROM l),
        r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY confidence DESC, place) AS rank FROM t WHERE confidence >= 0.35 AND confidence >= 0.6 * top)
        SELECT term, rank, intent, round(least(0.99, confidence), 3) AS confidence FROM r WHERE rank <= 3 UNION ALL SELECT term, 1, 'informational', 0.5 FROM terms WHERE term NOT IN (SELECT term FROM r)""",
    ),
    similar_keywords=Query(
        similar_keywords,
        f"""WITH {TERMS_SQL}, t AS (SELECT term, {_TOKENS} AS k FROM terms)
        SELECT a.term AS a, b.term AS b FROM t a JOIN t b ON a.term < b.term WHERE len(a.k) > 0 AND len(b.k) > 0
          AND len(list_intersect(a.k, b.k)) >= 0.45 * (len(a.k) + len(b.k) - len(list_intersect(a.k, b.k)))""",
    ),
    graph_traversal=Query(
        graph_traversal,
        f"""WITH RECURSIVE {EDGES_SQL}, walk AS (SELECT p_partkey AS start, p_partkey AS node, 0 AS depth FROM part QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey DESC) = 1
          UNION SELECT w.start, e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.depth < 3)
        SELECT start, node, min(depth) AS depth FROM walk WHERE node <> start GROUP BY ALL""",
    ),
    link_recommendations=Query(
        link_recommendations,
        f"""WITH {EDGES_SQL}, l AS (SELECT * FROM edges WHERE dst > src AND dst - src <= 40), d AS (SELECT dst AS node, count(*) AS n_in FROM l GROUP BY 1),
        p AS (SELECT p_partkey AS node, concat_ws('/', p_name, p_type) AS topic, coalesce(n_in, 0) AS n_in FROM part LEFT JOIN d ON d.node = p_partkey)
        SELECT source, target, lower(topic) AS anchor, printf('''%s'' is an authority page on %s; ''%s'' covers the same topic but has at most one internal link.', source::VARCHAR, topic, target::VARCHAR) AS reason, 0.6 AS confidence FROM (SELECT s.node AS source, w.node AS target, w.topic FROM p w JOIN p s ON s.topic = w.topic AND s.node <> w.node WHERE w.n_in <= 1 AND s.n_in >= 2
          AND NOT EXISTS (SELECT 1 FROM l WHERE l.src = s.node AND l.dst = w.node) ORDER BY target, source, topic LIMIT 50)""",
    ),
    topic_coverage=Query(topic_coverage, "SELECT topic, count(DISTINCT p_partkey) AS n_pages, count(DISTINCT p_partkey) = 0 AS weak FROM (SELECT p_name AS topic, p_partkey FROM part UNION ALL SELECT DISTINCT p_type, NULL FROM part) GROUP BY 1"),
    least_covered_topics=Query(
        least_covered_topics, "SELECT topic, count(DISTINCT p_partkey) AS n_pages, count(DISTINCT p_partkey) = 0 AS weak FROM (SELECT p_name AS topic, p_partkey FROM part UNION ALL SELECT DISTINCT p_type, NULL FROM part) GROUP BY 1 ORDER BY n_pages, topic LIMIT 30"
    ),
    token_budget=Query(token_budget, "SELECT conv_id, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS tokens, count(*) AS messages, sum(greatest(1, length(text) // 4)) > 180000 AS over_cap FROM conversations GROUP BY 1"),
    usage_rollup=Query(
        usage_rollup,
        """WITH c AS (SELECT conv_id, make_date(2026, (conv_id % 4 + 1)::INT, 1) AS month, role, greatest(1, length(text) // 4) AS n FROM conversations),
        u AS (SELECT 'run ' || conv_id AS of, n, role, 5.0::DOUBLE AS most FROM c UNION ALL SELECT 'tenant ' || conv_id % 3 || ' ' || month, n, role, 300.0 FROM c)
        SELECT of, count(*) AS calls, sum(CASE WHEN role = 'user' THEN n ELSE 0 END)::BIGINT AS input_tokens, sum(CASE WHEN role = 'user' THEN 0 ELSE n END)::BIGINT AS output_tokens, round(sum(n * 0.01::DOUBLE), 4) AS cost_usd, round(sum(n * 0.01::DOUBLE), 4) > max(most) AS over_budget FROM u GROUP BY 1""",
    ),
    label_evaluation=Query(
        label_evaluation,
        r"""WITH s AS (SELECT DISTINCT doc_id FROM documents WHERE len(regexp_extract_all(text, '(!!|\|)')) >= 20), t AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0),
        g AS (SELECT (SELECT count(*) FROM s JOIN t USING (doc_id)) AS tp, (SELECT count(*) FROM s WHERE doc_id NOT IN (SELECT doc_id FROM t)) AS fp, (SELECT count(*) FROM t WHERE doc_id NOT IN (SELECT doc_id FROM s)) AS fn),
        p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM g)
        SELECT 'technical_engine' AS engine, tp, fp, fn, 'precision' AS metric, round(p, 4) AS value, 0.9 AS bound, round(p, 4) >= 0.9 AS passed FROM p UNION ALL SELECT 'technical_engine', tp, fp, fn, 'recall', round(r, 4), 0.85, round(r, 4) >= 0.85 FROM p
        UNION ALL SELECT 'technical_engine', tp, fp, fn, 'f1', CASE WHEN p + r > 0 THEN round(2 * p * r / (p + r), 4) ELSE 0 END, NULL, NULL FROM p""",
    ),
    rank_agreement=Query(rank_agreement, f"WITH {_RHO.format('l_returnflag')} SELECT g AS l_returnflag, count(*) AS n, round(corr(rx, ry), 6) AS rank_correlation FROM ranked GROUP BY g"),
    engine_verdicts=Query(
        engine_verdicts,
        f"""WITH {_RHO.format("1")}, a AS (SELECT count(*) AS n, count_if(doc_id IN (SELECT doc_id FROM documents WHERE contains(text, '!!'))) AS k FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1))
        SELECT 'opportunity_scoring' AS engine, 'rank_correlation' AS metric, round(corr(rx, ry), 4) AS value, 0.7 AS bound, round(corr(rx, ry), 4) >= 0.7 AS passed FROM ranked
        UNION ALL SELECT 'anomaly_detector', 'false_positive_rate', round(k / n, 4), 0.1, round(k / n, 4) <= 0.1 FROM a""",
    ),
    redacted_documents=Query(redacted_documents, f"SELECT doc_id, sha256({_REDACT}) AS redacted_sha256, regexp_matches(text, '{'|'.join(tx.CREDENTIALS)}') AS had_credential FROM documents"),
    cannibalized_keywords=Query(
        cannibalized_keywords,
        "SELECT p_brand, keyword, n, string_agg(page, ',' ORDER BY page) AS pages FROM (SELECT p_brand, lower(trim(p_name)) AS keyword, lpad(p_partkey::VARCHAR, 9, '0') AS page, count(*) OVER (PARTITION BY p_brand, lower(trim(p_name))) AS n, "
        "row_number() OVER (PARTITION BY p_brand, lower(trim(p_name)) ORDER BY lpad(p_partkey::VARCHAR, 9, '0')) AS k FROM part) WHERE n > 1 AND k <= 10 GROUP BY ALL",
    ),
)
