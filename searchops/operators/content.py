"""Content: inventory of live pages, flags, quality scores of pages and drafts, rubric, cannibalization, crawl frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls as ux

#: Path patterns of page types, and the schema types that tell one.
PRODUCT = "/(product|products|p|item|shop)/"
CATEGORY = "/(category|categories|collection|collections|c|shop|catalog)(/|$)"
ARTICLE = "/(blog|article|articles|news|guide|guides|post|posts|resources)/"
PRODUCT_TYPES, CATEGORY_TYPES = ("product", "offer"), ("collectionpage", "itemlist")
ARTICLE_TYPES = ("article", "blogposting", "newsarticle", "faqpage", "howto")
#: Words that a page of a type should have, below which it is thin, and days after which an article is outdated.
TARGET_WORDS = {"article": 700, "category": 300, "product": 300, "landing": 400}
THIN_WORDS = {"article": 300, "product": 80, "category": 50}
STALE_DAYS = 540
#: Headings and links of a Markdown draft.
H2 = r"(?m)^##\s+.+$"
LINK = r"\[[^\]]+\]\((/[^)]+|https?://[^)]+)\)"


def _by_type(values: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for kind, n in values.items():
        out = F.when(F.col("content_type") == kind, n).otherwise(out)
    return out


def _steps(x: Column, *at: tuple[float, int]) -> Column:
    """Points of the first bound that ``x`` reaches, or 0."""
    return F.coalesce(*(F.when(x >= low, points) for low, points in at), F.lit(0))


def verdict(score: Column) -> Column:
    return F.when(score >= 70, "PASS").when(score >= 45, "REVISE").otherwise("FAIL")


def with_types(facts: DataFrame) -> DataFrame:
    """Facts with the lower-cased types of their JSON-LD objects and whether one has a price."""
    kinds = F.transform("schema_blocks", lambda b: F.lower(F.get_json_object(b, "$['@type']")))
    return facts.withColumn("schema_types", kinds).withColumn("has_price", F.exists("schema_blocks", lambda b: F.get_json_object(b, "$.offers.price").isNotNull()))


def content_type() -> Column:
    path, words, n_links = F.col("path"), F.col("word_count"), F.size("internal_links")
    has = lambda kinds: F.coalesce(F.arrays_overlap("schema_types", F.array(*map(F.lit, kinds))), F.lit(False))
    return (
        F.when(path == "/", "home")
        .when(has(PRODUCT_TYPES) | path.rlike("(?i)" + PRODUCT) | F.col("has_price"), "product")
        .when(has(CATEGORY_TYPES) | path.rlike("(?i)" + CATEGORY), "category")
        .when(has(ARTICLE_TYPES) | path.rlike("(?i)" + ARTICLE) | ((words >= 300) & (n_links < 15)), "article")
        .when((n_links >= 20) & (words < 300), "category")
        .otherwise(F.when(words < 300, "landing").otherwise("other"))
    )


def page_score() -> Column:
    """0 to 100 for words, structure, links, schema and meta description."""
    words, target = F.col("word_count"), _by_type(TARGET_WORDS, 500)
    n_headings = F.size("h1") + F.size("h2") + F.size("h3")
    n_meta = F.length(F.coalesce("meta_description", F.lit("")))
    score = F.when(words >= target * 0.9, 30).when(words >= target * 0.6, 18).when(words > 0, 8).otherwise(0)
    score = score + _steps(n_headings, (3, 20), (1, 10)) + _steps(F.size("internal_links"), (5, 20), (1, 10))
    return score + F.when(F.size("schema_blocks") > 0, 15).otherwise(0) + F.when(n_meta.between(50, 160), 15).when(n_meta > 0, 8).otherwise(0)


def content_flags(now: Column) -> Column:
    words, kind = F.col("word_count"), F.col("content_type")
    return F.concat_ws(
        ",",
        F.when((words > 0) & (words < _by_type(THIN_WORDS, 150)), "thin"),
        F.when((kind == "article") & (F.datediff(now, "updated_on") > STALE_DAYS), "outdated"),
        F.when((F.col("links_in") == 0) & kind.isin("article", "product"), "orphan"),
    )


def inventory(facts: DataFrame, degrees: DataFrame, now: Column) -> DataFrame:
    """Type, flags, score 0-100 and verdict of every live page of facts(.., schema_types, has_price, updated_on)."""
    rows = facts.where("http_status = 200").join(degrees, "norm", "left").withColumn("links_in", F.coalesce("n_in", F.lit(0)))
    rows = rows.withColumn("content_type", content_type())
    out = rows.select("page_id", "site", F.col("final_url").alias("url"), "content_type", "word_count", "links_in", content_flags(now).alias("flags"), page_score().alias("score"))
    return out.withColumn("verdict", verdict(F.col("score")))


def scored_drafts(drafts: DataFrame) -> DataFrame:
    """drafts(text, keyword, target_words, expected_headings) with their points, score, verdict and rubric dimensions."""
    low = F.lower(F.coalesce("text", F.lit("")))
    key = F.lower(F.coalesce("keyword", F.lit("")))
    words = F.size(F.filter(F.split(low, r"\s+"), lambda w: w != ""))
    rows = drafts.withColumns({"low": low, "key": key, "words": words})
    found = (F.col("key") != "") & F.col("low").contains(F.col("key"))
    covered = F.size(F.filter(F.coalesce("expected_headings", F.array().cast("array<string>")), lambda h: F.contains(F.col("low"), F.lower(h))))
    rows = rows.withColumns({
        "word_points": F.when(F.col("words") >= F.col("target_words") * 0.9, 20).when(F.col("words") >= F.col("target_words") * 0.6, 12).otherwise(5),
        "opening_points": F.when(found & F.left("low", F.lit(500)).contains(F.col("key")), 15).when(found, 8).otherwise(0),
        "covers_points": covered * 5,
        "n_h2": F.regexp_count(F.coalesce("text", F.lit("")), F.lit(H2)),
        "n_links": F.regexp_count(F.coalesce("text", F.lit("")), F.lit(LINK)),
        "n_mentions": F.when(found, tx.occurrences(F.col("low"), F.col("key"))).otherwise(0),
    })
    total = F.col("word_points") + F.col("opening_points") + F.col("covers_points") + _steps(F.col("n_h2"), (3, 15), (1, 8)) + _steps(F.col("n_links"), (3, 15), (1, 7))
    rows = rows.withColumn("score", F.least(F.lit(100), total + F.least(F.lit(10), F.col("n_mentions") * 2)))
    return rows.withColumns({
        "verdict": verdict(F.col("score")),
        "coverage": F.col("word_points") + F.col("covers_points"),
        "structure": F.col("n_h2") * 3,
        "keyword_alignment": F.col("opening_points") + F.col("n_mentions"),
        "linking": F.col("n_links") * 3,
        "depth": F.least(F.lit(20.0), F.col("score") / 5),
    }).drop("low", "key", "words")


DIMENSIONS = ("coverage", "structure", "keyword_alignment", "linking", "depth")


def weakest_dimensions(n: int = 2) -> Column:
    """Names of the ``n`` lowest rubric dimensions of a scored draft; ties in the order of the rubric."""
    ranked = F.array_sort(F.array(*(F.struct(F.col(d).cast("double").alias("v"), F.lit(i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(DIMENSIONS))))
    return F.transform(F.slice(ranked, 1, n), lambda x: x["d"])


def cannibalization(rows: DataFrame, group: list[str], keyword: str, url: str, first: int = 10) -> DataFrame:
    """Keywords (lower case, trimmed) that several pages of a group have as their primary one: count and the first urls.
    Pages of a keyword are counted before the shuffle and at most ``first`` of them meet in one task."""
    pages = rows.where(F.trim(keyword) != "").select(*group, F.lower(F.trim(keyword)).alias("keyword"), F.col(url).alias("url"))
    counts = pages.groupBy(*group, "keyword").agg(F.count("*").alias("n")).where("n > 1")
    rank = F.row_number().over(Window.partitionBy(*group, "keyword").orderBy("url"))
    some = pages.withColumn("k", rank).where(F.col("k") <= first).groupBy(*group, "keyword").agg(F.array_sort(F.collect_list("url")).alias("urls"))
    return counts.join(some, [*group, "keyword"])


def first_per_group(rows: DataFrame, group: str, order: str, n: int, name: str) -> DataFrame:
    """The first n rows of each group; Spark cuts each partition to n rows a group before the shuffle."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col(name) <= n)


def frontier(sitemap: DataFrame, most: int) -> DataFrame:
    """site, norm, place: the origin of each site, then the urls of sitemap(site, url, ordinal) as they come, one per normal
    URL, at most ``most`` a site."""
    origin = sitemap.select("site").distinct().select("site", F.concat(F.lit("https://"), "site").alias("url"), F.lit(-1).cast("long").alias("ordinal"))
    every = sitemap.select("site", "url", F.col("ordinal").cast("long").alias("ordinal")).unionByName(origin)
    once = every.groupBy("site", ux.normal(F.col("url")).alias("norm")).agg(F.min("ordinal").alias("ordinal"))
    return first_per_group(once.withColumn("by", F.struct("ordinal", "norm")), "site", "by", most, "place").select("site", "norm", "place")


def upsert_items(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` in place of those of ``old`` with the same keys, with ``state``; a null in ``new`` keeps what was there."""
    others = [c for c in new.columns if c not in keys]
    n = new.select(*keys, *(F.col(c).alias(f"new_{c}") for c in others), F.lit(True).alias("is_new"))
    both = old.withColumn("is_old", F.lit(True)).join(n, keys, "full_outer")
    state = F.when(F.col("is_old").isNull(), "new").when(F.col("is_new").isNull(), "kept").otherwise("updated")
    return both.select(*keys, *(F.coalesce(f"new_{c}", c).alias(c) for c in others), state.alias("state"))
