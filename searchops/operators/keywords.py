"""Keywords: tokens, intents, similar pairs, volume-seeded clusters, and the keyword, intent and cluster tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: Intent, then marker and weight. Their order breaks ties.
MARKERS = (
    ("transactional", {"buy": 1.0, "cheap": 0.8, "price": 0.9, "cost": 0.7, "for sale": 1.0, "deal": 0.7, "discount": 0.8, "coupon": 0.9, "order": 0.8, "shop": 0.6, "purchase": 1.0, "under $": 0.9}),
    ("commercial", {"best": 0.9, "top": 0.7, "review": 0.9, "reviews": 0.9, "rated": 0.7, "brands": 0.7, "alternative": 0.8, "alternatives": 0.8, "recommended": 0.7, " for ": 0.3}),
    ("comparison", {" vs ": 1.0, " vs. ": 1.0, "compare": 0.9, "comparison": 0.9, "difference between": 0.9}),
    ("navigational", {"login": 1.0, "log in": 1.0, "sign in": 1.0, "official": 0.8, "website": 0.5, "portal": 0.7}),
    ("local", {"near me": 1.0, "in ": 0.2, "nearby": 0.9, "directions": 0.8, "store hours": 0.9, "open now": 0.9}),
    ("how_to", {"how to": 1.0, "how do": 0.9, "how can": 0.8, "steps to": 0.8, "guide to": 0.6, "tutorial": 0.9}),
    ("definitional", {"what is": 1.0, "what are": 0.9, "meaning": 0.9, "definition": 1.0, "means": 0.6}),
    ("question", {"why": 0.8, "who": 0.6, "when": 0.6, "where": 0.6, "which": 0.6, "can you": 0.7, "should i": 0.8, "?": 0.9}),
    ("video", {"video": 0.95, "watch video": 0.9, "youtube": 1.0, "trailer": 0.9, "footage": 0.85}),
    ("visual", {"images": 0.9, "photos": 0.8, "pictures": 0.8, "wallpaper": 0.9, "logo": 0.7, "chart": 0.6}),
    ("news", {"news": 0.9, "latest": 0.7, "update": 0.5, "today": 0.5, "breaking": 0.9, "2026": 0.4}),
)
QUESTION = r"^(how|what|why|who|when|where|which|can|does|do|is|are|should)\b"
LEAST, SHARE_OF_TOP, MOST = 0.35, 0.6, 3
SIMILAR = 0.45


def intents(terms: DataFrame) -> DataFrame:
    """term, rank, intent, confidence: at most three intents of each term(term), the strongest first."""
    spaced = F.concat(F.lit(" "), F.lower(F.trim("term")), F.lit(" "))

    def strength(label: str, marks: dict[str, float]) -> Column:
        best = F.greatest(*(F.when(spaced.contains(m), w).otherwise(0.0) for m, w in marks.items()))
        if label == "question":
            best = F.greatest(best, F.when(F.lower(F.trim("term")).rlike(QUESTION), 0.7).otherwise(0.0))
        return best

    scored = F.array(*(F.struct((-strength(k, m)).alias("minus"), F.lit(i).alias("place"), F.lit(k).alias("intent")) for i, (k, m) in enumerate(MARKERS)))
    ranked = terms.select("term", F.array_sort(scored).alias("s"))
    top = F.element_at("s", 1)["minus"]
    good = F.filter("s", lambda x: (-x["minus"] >= LEAST) & (-x["minus"] >= -top * SHARE_OF_TOP))
    none = F.array(F.struct(F.lit(-0.5).alias("minus"), F.lit(99).alias("place"), F.lit("informational").alias("intent")))
    rows = ranked.select("term", F.posexplode(F.when(F.size(good) > 0, F.slice(good, 1, MOST)).otherwise(none)).alias("k", "x"))
    return rows.select("term", (F.col("k") + 1).alias("rank"), "x.intent", F.round(F.least(F.lit(0.99), -F.col("x.minus")), 3).alias("confidence"))


def similar_pairs(terms: DataFrame) -> DataFrame:
    """a, b (a before b): terms(term, tokens) whose token sets have Jaccard 0.45 or more.

    Tokens are ordered by rarity. A pair must share one of each side's ``n - ceil(0.45 n) + 1`` rarest tokens, so only
    these are joined, and of each term with its number of tokens and its prefix alone: the join drops pairs whose sizes differ
    too much, whose tokens behind the common one are too few, and all meetings of a pair but that at its first common prefix token, so
    nothing is emitted twice. Token sets come back to the pairs that are left. A frequent token stands in the prefix of a term
    only if all its tokens are frequent, or it is short.
    """
    one = terms.select("term", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    df = one.groupBy("token").agg(F.count("*").alias("df"))
    ordered = one.join(df, "token").groupBy("term", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("o"))
    prefix = F.slice(F.transform("o", lambda x: x["token"]), F.lit(1), (F.col("n") - F.ceil(F.col("n") * SIMILAR) + 1).cast("int"))
    keys = ordered.select("term", "n", prefix.alias("prefix")).select("*", F.posexplode("prefix").alias("at", "token"))
    side = lambda x: keys.select("token", F.col("term").alias(x), F.col("n").alias(f"n{x}"), F.col("at").alias(f"at{x}"), F.col("prefix").alias(f"p{x}"))
    met = side("a").join(side("b"), "token").where("a < b").where(F.least("na", "nb") >= SIMILAR * F.greatest("na", "nb"))
    first = ~F.arrays_overlap(F.slice("pa", F.lit(1), F.col("ata")), F.slice("pb", F.lit(1), F.col("atb")))
    need = F.ceil((F.col("na") + F.col("nb")) * SIMILAR / (1 + SIMILAR) - 1e-9)
    left = F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb"))
    met = met.where(first & (left >= need)).select("a", "b")
    own = terms.select("term", "tokens")
    met = met.join(own.toDF("a", "ta"), "a").join(own.toDF("b", "tb"), "b")
    return met.where(F.size(F.array_intersect("ta", "tb")) / F.size(F.array_union("ta", "tb")) >= SIMILAR).select("a", "b")


def clusters(terms: DataFrame, keep) -> DataFrame:
    """term, seed of terms(term, tokens, volume): greedy by falling volume, in rounds.

    A term is a seed once all better-ranked neighbours are members; a term next to a better-ranked seed joins the best such
    seed. ``keep`` writes a table and reads it back, which cuts the plan between rounds.
    """
    pairs = similar_pairs(terms)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rank = lambda c: F.struct((-F.col(f"volume_{c}")).alias("v"), F.col(c).alias("t"))
    volume = terms.select("term", "volume")
    edges = both.join(volume.toDF("a", "volume_a"), "a").join(volume.toDF("b", "volume_b"), "b")
    edges = keep(edges.where(rank("b") < rank("a")).select("a", "b", (-F.col("volume_b")).alias("v")))  # b is better ranked
    state = keep(terms.select("term", F.lit(None).cast("string").alias("seed")))
    while True:
        best = edges.join(state.select(F.col("term").alias("b"), F.col("seed").alias("seed_b")), "b")
        best = best.groupBy("a").agg(
            F.min(F.when(F.col("seed_b") == F.col("b"), F.struct("v", "b"))).alias("s"),
            F.count_if(F.col("seed_b").isNull()).alias("undecided"),
            F.min(F.when(F.col("seed_b").isNull(), F.struct("v", "b"))).alias("u"),
        )
        now = state.join(best.withColumnRenamed("a", "term"), "term", "left")
        sure = F.col("s").isNotNull() & (F.col("u").isNull() | (F.col("s") < F.col("u")))
        alone = F.coalesce("undecided", F.lit(0)) == 0
        seed = F.when(F.col("seed").isNotNull(), F.col("seed")).when(sure, F.col("s.b")).when(F.col("s").isNull() & alone, F.col("term"))
        state = keep(now.select("term", seed.alias("seed")))
        if state.where("seed is null").isEmpty():
            return state


def new_keywords(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows(project_id, ordinal, term, volume) as keywords by (project, normal form) that ``known`` lacks: the first spelling
    stands, with its volume, which is estimated if it is not given."""
    named = rows.withColumn("normalized", tx.keyword(F.col("term")))
    first = named.groupBy("project_id", "normalized").agg(F.min_by(F.struct("term", "volume"), F.struct("ordinal", "term")).alias("f")).select("project_id", "normalized", "f.*")
    return first.join(known.select("project_id", "normalized"), ["project_id", "normalized"], "left_anti").withColumn("volume_estimated", F.col("volume").isNull())


def cluster_rollup(members: DataFrame, first_intents: DataFrame) -> DataFrame:
    """Clusters of members(term, seed, volume), the largest volume first: name, slug, size, volume, intents of all terms (first
    one each) and that of the seed, from first_intents(term, intent)."""
    rows = members.join(first_intents, "term", "left").withColumn("intent", F.coalesce("intent", F.lit("informational")))
    got = rows.groupBy("seed").agg(
        F.count("*").alias("size"), F.sum(F.coalesce("volume", F.lit(0))).alias("volume_sum"), F.array_sort(F.collect_set("intent")).alias("intents"), F.max(F.when(F.col("term") == F.col("seed"), F.col("intent"))).alias("primary_intent")
    )
    return got.select(F.col("seed").alias("name"), tx.slug(F.col("seed")).alias("slug"), "size", "volume_sum", "intents", "primary_intent")


def overview(clusters: DataFrame) -> DataFrame:
    """Clusters by falling volume, then size, then name, each with the number of keywords in all clusters."""
    total = clusters.agg(F.sum("size").alias("n_keywords"))
    return clusters.join(F.broadcast(total)).orderBy(F.desc("volume_sum"), F.desc("size"), "name")  # one row


def replaced(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """A replace-all sink: the rows of every key in ``rows`` take the place of the table's."""
    keep = table.join(rows.select(key).distinct(), key, "left_anti")
    return keep.unionByName(rows)
