"""AI answers: citations of a brand, its competitors and sources; visibility scores by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as ux

URL = r"(https?://[^\s)\]}>\"']+)"
#: Words that tell the tone around a mention.
NEGATIVE = r"\b(avoid|scam|poor|worst|disappoint|overpriced|not recommended|beware)\b"
POSITIVE = r"\b(best|excellent|recommended|top choice|great|trusted|high quality|leading)\b"


def citations(answers: DataFrame, brand: str, own_domain: str, competitors: list[str], competitor_domains: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """One row per answers(answer_id, text) for one brand: mention, its paragraph, competitors by name and then by cited domain, cited
    URLs, own citation, tone. A null text cites nothing."""
    texts = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    return _cited(answers, F.lit(brand), F.lit(own_domain), texts(competitors), texts(competitor_domains))


def project_citations(answers: DataFrame, brands: DataFrame) -> DataFrame:
    """The same of answers(project_id, answer_id, text) of many projects in one job, each with the names and domains of its own
    project: brands(project_id, brand, own_domain, competitor_names, competitor_domains), one row a project.

    An answer is compared with its project's names only. A project that has no brands mentions nothing; empty names are no names.
    """
    own = {c: f"_{c}" for c in ("brand", "own_domain", "competitor_names", "competitor_domains")}
    rows = answers.join(brands.select("project_id", *own).withColumnsRenamed(own), "project_id", "left")
    none = F.array().cast("array<string>")
    text, texts = (lambda c: F.coalesce(F.col(own[c]), F.lit(""))), (lambda c: F.array_compact(F.coalesce(F.col(own[c]), none)))
    return _cited(rows, text("brand"), text("own_domain"), texts("competitor_names"), texts("competitor_domains")).drop(*own.values())


def _cited(answers: DataFrame, brand: Column, own_domain: Column, names: Column, domains: Column) -> DataFrame:
    bare = lambda d: F.regexp_replace(d, r"^www\.", "")
    rows = answers.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_low", F.lower("text")).withColumn("_name", F.lower(brand))
    low, name = F.col("_low"), F.col("_name")
    rivals = F.filter(names, lambda c: (c != "") & low.contains(F.lower(c)) & (F.lower(c) != name))
    cited = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(URL), F.lit(1)), lambda u: F.regexp_replace(u, r"[.,);]+$", "")))
    rows = rows.withColumns({"_rivals": rivals, "_cited": cited, "_at": F.when(name != "", F.position(name, low)).otherwise(0)})
    at, first = F.col("_at"), F.greatest(F.lit(1), F.col("_at") - 160)
    around = F.substring(low, first, at + 160 - first)
    known = F.transform(domains, bare)
    by_domain = F.array_distinct(F.filter(F.transform("_cited", ux.host_name), lambda d: F.array_contains(known, d) & ~F.array_contains(F.transform("_rivals", lambda r: F.lower(r)), d)))
    return rows.select(
        *(c for c in answers.columns if c != "text"),
        (at > 0).alias("brand_mentioned"),
        F.when(at > 0, F.regexp_count(F.substring(low, F.lit(1), at - 1), F.lit("\n")) + 1).alias("brand_position"),
        F.concat("_rivals", by_domain).alias("competitors"),
        F.col("_cited").alias("cited"),
        F.exists("_cited", lambda u: (ux.host_name(u) == bare(own_domain)) & (own_domain != "")).alias("own_url_cited"),
        F.when(at > 0, F.when(around.rlike(NEGATIVE), "negative").when(around.rlike(POSITIVE), "positive")).alias("tone"),
    ).withColumn("sentiment", F.coalesce("tone", F.lit("neutral"))).drop("tone")


def scores(cites: DataFrame, group: list[str]) -> DataFrame:
    """Visibility 0 to 100 of each group (as cluster, provider and week) with its parts."""
    n = F.count("*")
    rate = lambda c: F.count_if(c) / n
    got = cites.groupBy(*group).agg(
        n.alias("prompts_run"),
        F.count_if("brand_mentioned").alias("mentions"),
        rate("own_url_cited").alias("own_rate"),
        F.avg("brand_position").alias("avg_position"),
        ((F.count_if(F.col("sentiment") == "positive") - F.count_if(F.col("sentiment") == "negative")) / n).alias("tone"),
        F.sum(F.size("competitors")).alias("rivals"),
    )
    mention = F.col("mentions") / F.col("prompts_run")
    bonus = F.coalesce(F.greatest(F.lit(0.0), (5 - F.col("avg_position")) / 5), F.lit(0.0))
    share = F.when(F.col("rivals") + F.col("mentions") > 0, F.col("rivals") / (F.col("rivals") + F.col("mentions"))).otherwise(0.0)
    raw = (0.45 * mention + 0.30 * F.col("own_rate") + 0.15 * bonus + 0.10 * F.greatest(F.lit(0.0), F.col("tone"))) * 100 * (1 - 0.3 * share)
    return got.select(*group, "prompts_run", F.round(mention, 4).alias("mention_rate"), F.round("own_rate", 4).alias("own_citation_rate"), F.round("avg_position", 2).alias("avg_brand_position"), F.round(share, 4).alias("competitor_share"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 2).alias("score"))


#: Prompt kind, the table its slot is filled from, text. The order is that of the library.
TEMPLATES = (
    ("brand", "brand", "What is {brand}?"), ("brand", "brand", "Is {brand} a good company?"), ("brand", "brand", "{brand} reviews"), ("brand", "brand", "What do people say about {brand}?"),
    ("category", "category", "best {category}"), ("category", "category", "top {category} brands"), ("category", "category", "leading {category} companies"),
    ("problem", "category", "how to choose {category}"), ("problem", "category", "what to look for when buying {category}"), ("problem", "category", "common mistakes when buying {category}"),
    ("industry", "category", "top {category} companies"), ("industry", "category", "leading brands in {category}"), ("buying", "category", "where to buy {category}"),
    ("product", "keyword", "best {keyword}"), ("product", "keyword", "top {keyword} recommendations"), ("product", "keyword", "{keyword} reviews"), ("buying", "keyword", "best place to buy {keyword}"),
    ("comparison", "competitor", "{brand} vs {competitor}"), ("comparison", "competitor", "{competitor} vs {brand}"), ("competitor", "competitor", "{competitor} reviews"),
    ("competitor", "competitor", "is {competitor} good"), ("competitor", "competitor", "{competitor} alternatives"),
)
MAX_PROMPTS = 50


def prompt_library(params: DataFrame, most: int = MAX_PROMPTS) -> DataFrame:
    """cluster_id, kind, text, rank of params(cluster_id, brand, category, seed_keywords, competitor_names): the templates filled
    in order, of texts alike but for case the first, ``most`` a cluster. Each cluster's battery is made from its own row."""
    parts = {"brand": F.array("brand"), "category": F.array("category"), "keyword": F.col("seed_keywords"), "competitor": F.col("competitor_names")}
    full = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")

    def filled(at: int, part: str) -> Column:
        mine = [(kind, text) for kind, p, text in TEMPLATES if p == part]
        text = lambda t, x: F.trim(F.replace(F.replace(F.lit(t), F.lit(f"{{{part}}}"), x), F.lit("{brand}"), F.col("brand")))
        row = lambda x, i: F.array(*(F.struct(F.lit(at).alias("part"), i.alias("i"), F.lit(k).alias("k"), F.lit(kind).alias("kind"), text(t, x).alias("text")) for k, (kind, t) in enumerate(mine)))
        return F.flatten(F.transform(full(parts[part]), row))

    made = [filled(at, part) for at, part in enumerate(parts)]
    rows = params.select("cluster_id", F.explode(F.concat(*made)).alias("p"))
    once = rows.groupBy("cluster_id", F.lower("p.text").alias("low")).agg(F.min("p").alias("p"))
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy("p"))
    return once.withColumn("rank", rank).where(F.col("rank") <= most).select("cluster_id", "p.kind", "p.text", "rank")


def new_prompts(library: DataFrame, known: DataFrame) -> DataFrame:
    """Prompts of the library that known(kind, text_hash) lacks."""
    return library.withColumn("text_hash", F.sha2("text", 256)).dropDuplicates(["kind", "text_hash"]).join(known.select("kind", "text_hash"), ["kind", "text_hash"], "left_anti")


def battery(prompts: DataFrame, providers: list[str]) -> DataFrame:
    """Every prompt for every provider."""
    return prompts.select("*", F.explode(F.array(*map(F.lit, providers))).alias("provider"))


def upsert_weekly(old: DataFrame, new: DataFrame) -> DataFrame:
    """Scores by (cluster, provider, week); new ones replace old ones, and no cluster equals no cluster."""
    keys = ["cluster", "provider", "week"]
    gone = old.alias("o").join(new.select(*keys).distinct().alias("n"), [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "left_anti")
    return gone.unionByName(new)
