"""Search result analysis over many runs: domains, positions, topics, questions, content gaps, briefs."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..functions import text as tx
from ..functions import urls as ux
from ..functions.batches import ROWS

#: Words that are no topic of a result, the form of a word, and what a run keeps at most.
STOP = ("with", "your", "from", "this", "that", "have", "will", "what", "when", "which", "guide", "best", "how", "and", "the", "for", "you", "are", "our", "can", "get", "top", "vs")
WORD = r"([a-z][a-z'-]{2,})"
DOMAINS, QUESTIONS, ENTITIES, TOPICS, LEAST = 10, 15, 20, 12, 2


def phrases(text: Column) -> Column:
    """Words of three letters or more that are no stop words, then the pairs of neighbours among them."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1)), lambda w: ~w.isin(*STOP))
    n = F.size(words) - 1
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(n, F.lit(0))), F.slice(words, F.lit(2), F.greatest(n, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, F.when(n > 0, pairs).otherwise(F.array().cast("array<string>")))


def tagged(results: DataFrame, params: DataFrame) -> DataFrame:
    """results(run_id, position, url, ..) with domain, is_own, is_competitor by params(run_id, own_domain, competitor_domains)."""
    bare = lambda c: F.regexp_replace(c, r"^www\.", "")
    rivals = F.transform(F.coalesce("competitor_domains", F.array().cast("array<string>")), bare)
    rows = results.join(params.select("run_id", bare("own_domain").alias("own"), rivals.alias("rivals")), "run_id", "left")
    rows = rows.withColumn("domain", ux.host_name(F.col("url")))
    return rows.withColumns({"is_own": F.coalesce(F.col("domain") == F.col("own"), F.lit(False)), "is_competitor": F.coalesce(F.array_contains("rivals", F.col("domain")), F.lit(False))}).drop("own", "rivals")


def first_positions(tagged_results: DataFrame) -> DataFrame:
    """run_id, domain, position, rank, is_own, is_competitor: the first position of each domain, ranked within the run."""
    rows = tagged_results.where("domain <> ''").groupBy("run_id", "domain").agg(F.min("position").alias("position"), F.max("is_own").alias("is_own"), F.max("is_competitor").alias("is_competitor"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy("position", "domain")))


def positions(firsts: DataFrame) -> DataFrame:
    """Per run the first domains, the own position and those of competitors; at most a page of domains a run."""
    top = F.array_sort(F.collect_list(F.when(F.col("rank") <= DOMAINS, F.struct("rank", "domain"))))
    rivals = F.array_sort(F.collect_list(F.when(F.col("is_competitor"), F.struct("domain", "position"))))
    got = firsts.groupBy("run_id").agg(F.transform(top, lambda x: x["domain"]).alias("top_domains"), F.min(F.when(F.col("is_own"), F.col("position"))).alias("own_position"), F.map_from_entries(rivals).alias("competitor_positions"))
    return got


_TOPIC = pa.struct([("phrase", pa.string()), ("n", pa.int64()), ("rank", pa.int32())])


def _first_topics(runs: list[list[str] | None]) -> pa.Array:
    """Of each run's phrases the most frequent; those of one count stand in the order in which they first came."""
    found = [[(w, n, k) for k, (w, n) in enumerate(Counter(r or ()).most_common(ENTITIES), 1) if n >= LEAST] for r in runs]
    return pa.array([[{"phrase": w, "n": n, "rank": k} for w, n, k in r] for r in found], pa.list_(_TOPIC))


@F.arrow_udf(from_arrow_schema(pa.schema([("t", pa.list_(_TOPIC))]))["t"].dataType)
def first_topics(phrase_lists: pa.Array) -> pa.Array:
    """phrase, n and rank of the topics of each list of phrases."""
    return pa.concat_arrays([_first_topics(phrase_lists.slice(k, ROWS).to_pylist()) for k in range(0, max(1, len(phrase_lists)), ROWS)])


def topics(results: DataFrame) -> DataFrame:
    """run_id, phrase, n, weight, rank: the phrases of titles and snippets by count, ties by first place, the first ENTITIES of
    these that occur LEAST times; weight is the count by results. A run's texts are one row, a page of results, and its phrases are counted
    in that row: no task groups or sorts the phrases of many runs."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")))
    runs = results.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("position", text.alias("t")))).alias("all"), F.count("*").alias("results"))
    rows = runs.select("run_id", "results", first_topics(phrases(F.array_join(F.transform("all", lambda x: x["t"]), " "))).alias("topics"))
    rows = rows.select("run_id", "results", F.inline("topics"))
    return rows.select("run_id", "phrase", "n", F.round(F.col("n") / F.greatest(F.lit(1), "results"), 3).alias("weight"), "rank")


def questions(features: DataFrame, related: DataFrame) -> DataFrame:
    """run_id, question, rank: what people also ask, then related searches that end in a question mark; QUESTIONS at most."""
    asked = features.where("type = 'people_also_ask'").select("run_id", F.lit(0).alias("part"), "ordinal", F.posexplode("items").alias("i", "question"))
    more = related.where("query like '%?'").select("run_id", F.lit(1).alias("part"), "ordinal", F.lit(0).alias("i"), F.col("query").alias("question"))
    rows = asked.unionByName(more).withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy("part", "ordinal", "i")))
    return rows.where(F.col("rank") <= QUESTIONS).select("run_id", "question", "rank")


def content_gap(found: DataFrame, pages: DataFrame) -> DataFrame:
    """run_id, phrase, rank: common topics none of whose words the run's page pages(run_id, page_text) has."""
    common = found.where(F.col("rank") <= TOPICS)
    rows = common.join(pages.select("run_id", tx.tokens(F.col("page_text")).alias("have")), "run_id")
    return rows.where(~F.arrays_overlap(F.split("phrase", " "), "have")).select("run_id", "phrase", "rank")


def ai_overviews(features: DataFrame) -> DataFrame:
    """run_id, provider, text: the first AI overview of each run that has a text, as an answer to be read for citations."""
    rows = features.where("type = 'ai_overview' and text <> ''").groupBy("run_id").agg(F.min_by("text", "ordinal").alias("text"))
    return rows.select("run_id", F.lit("google_ai_overview").alias("provider"), "text")


def briefs(runs: DataFrame, found: DataFrame, asked: DataFrame, firsts: DataFrame) -> DataFrame:
    """A brief for each runs(run_id, keyword, competitor_words): length, headings, questions, entities and rivals' pages."""
    listed = lambda df, most, value: df.where(F.col("rank") <= most).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col(value).alias("v")))).alias("x")).select("run_id", F.transform("x", lambda e: e["v"]).alias(value))
    none = F.array().cast("array<string>")
    rows = runs.join(listed(found, 15, "phrase"), "run_id", "left").join(listed(asked, 10, "question"), "run_id", "left").join(listed(firsts, 5, "domain"), "run_id", "left")
    words = F.coalesce(F.nullif("competitor_words", F.lit(0)), F.lit(900))
    heads = F.transform(F.slice(F.coalesce("phrase", none), 1, 8), lambda p: F.initcap(p))
    return rows.select(
        "run_id", "keyword", F.greatest(F.lit(500), F.least(F.lit(3000), words)).alias("target_word_count"),
        F.when(F.size(heads) > 0, heads).otherwise(F.array(F.concat(F.lit("What is "), "keyword", F.lit("?")))).alias("headings"),
        F.coalesce("question", none).alias("questions"), F.coalesce("phrase", none).alias("entities"), F.transform(F.coalesce("domain", none), lambda d: F.concat(F.lit("https://"), d, F.lit("/"))).alias("competitor_urls"),
    )
