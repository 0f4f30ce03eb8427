"""Knowledge graph: node and edge tables, lookup, neighbours, bounded traversal by frontier joins, search, recommendations, coverage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stems import stems

#: Fixed values of the text rank: the weight of a word, the sum of 1 / k squared, and words so far apart that they count nothing.
WEIGHT = 0.1
SQUARES = 1.64493406685
FARTHEST = 100


def node_id(project: Column, kind: Column, ref: Column) -> Column:
    return F.sha2(F.concat_ws("|", project, kind, ref), 256)


def nodes(rows: DataFrame) -> DataFrame:
    """One node for each (project_id, type, ref_id) of rows(project_id, type, ref_id, label, ordinal); the last label stands."""
    got = rows.groupBy("project_id", "type", "ref_id").agg(F.max_by("label", F.struct("ordinal", "label")).alias("label"))
    return got.select(node_id(F.col("project_id"), F.col("type"), F.col("ref_id")).alias("id"), "project_id", "type", "ref_id", "label")


def edges(rows: DataFrame, known: DataFrame) -> DataFrame:
    """One edge for each (src, dst, relation) of rows(src, dst, relation, weight, position, ordinal) that joins two known nodes, not
    a node with itself; the last weight and position stand. A position is null but for "ranks_for"."""
    last = F.max_by(F.struct("weight", "position"), F.struct("ordinal", "position", "weight"))
    got = rows.where("src <> dst").groupBy("src", "dst", "relation").agg(last.alias("last")).select("src", "dst", "relation", "last.*")
    ids = known.select("id")
    return got.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "relation", "weight", "position")


def counters(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """kind, name, n: nodes by type and edges by relation."""
    n = node_table.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "name", "n")
    return n.unionByName(edge_table.groupBy(F.col("relation").alias("name")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "name", "n"))


def lookup(node_table: DataFrame, project: str, kind: str, ref: str) -> DataFrame:
    return node_table.where((F.col("project_id") == project) & (F.col("type") == kind) & (F.col("ref_id") == ref))


def neighbours(node_table: DataFrame, edge_table: DataFrame, of: DataFrame, relation: str | None = None, out: bool = True) -> DataFrame:
    """id, neighbour, type, label of the nodes that edges of a relation (any if none is named) lead to, or come from."""
    here, there = ("src", "dst") if out else ("dst", "src")
    rows = edge_table if relation is None else edge_table.where(F.col("relation") == relation)
    rows = rows.join(of.select(F.col("id").alias(here)).distinct(), here).select(F.col(here).alias("id"), F.col(there).alias("neighbour"))
    return rows.distinct().join(node_table.select(F.col("id").alias("neighbour"), "type", "label"), "neighbour").select("id", "neighbour", "type", "label")


def trigrams(text: Column) -> Column:
    """Distinct three-letter pieces of the lower-cased words, each with two spaces in front and one behind."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    pieces = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(pieces))


def text_rank(asked: Column, label: Column) -> Column:
    """Rank of the stems of a label (in their places, null for words left out) for the distinct stems asked for, from 0 to 1.

    One stem: its occurrences, the k-th with weight 1 / k squared. More: each two places of different stems count the more the
    nearer they stand, as 1 - prod(1 - w); a label need not have all stems, but two of them.
    """
    at = F.filter(F.transform(label, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(asked, x["w"]))
    n = F.size(at)
    once = F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda s, k: s + WEIGHT / (k * k)) / SQUARES).otherwise(0.0)
    near = lambda a, b: 1 - WEIGHT * F.sqrt(1 / (1.005 + 0.05 * F.exp((b["i"] - a["i"]) / 1.5 - 2)))
    left = lambda s, a: F.aggregate(F.filter(at, lambda b: (b["i"] > a["i"]) & (b["i"] - a["i"] <= FARTHEST) & (b["w"] != a["w"])), s, lambda t, b: t * near(a, b))
    return F.when(F.size(asked) == 1, once).when(F.size(asked) > 1, 1 - F.aggregate(at, F.lit(1.0), left)).otherwise(0.0)


def search_candidates(node_table: DataFrame, queries: DataFrame, kind: str | None = None) -> DataFrame:
    """Pairs of a query and a node that meet in the index, each with all that its score needs; a pair comes once for each half.

    The index has the trigrams and stems of the labels. Of a query, trigrams are looked up from the rarest on: with the i-th
    of m as the first that both have, m - i is the most they can share, and 11 * shared > n_label + n_query is what a
    similarity over 0.1 needs. This one condition cuts the frequent trigrams of the query, labels that are too long and late
    places; so a frequent trigram meets short labels only. Of its stems only the rarest is looked up, as all must be there.
    """
    scope = ["project_id"] if "project_id" in queries.columns else []
    rows = node_table if kind is None else node_table.where(F.col("type") == kind)
    labels = rows.select(*scope, "id", "type", "label", trigrams(F.coalesce("label", F.lit(""))).alias("lt"), stems(F.concat_ws(" ", "label", "type")).alias("ls"))
    tagged = lambda tag, pieces: F.transform(F.array_distinct(F.array_compact(pieces)), lambda x: F.concat(F.lit(tag), x))
    index = labels.select("*", F.explode(F.concat(tagged("t", F.col("lt")), tagged("s", F.col("ls")))).alias("key"))
    asked = queries.where("query is not null").select(*scope, "query").distinct().select(*scope, "query", trigrams(F.col("query")).alias("qt"), F.array_distinct(F.array_compact(stems(F.col("query")))).alias("qs"))
    often = index.groupBy(*scope, "key").agg(F.count("*").alias("n"))
    keyed = asked.select(*scope, "query", "qs", F.size("qt").alias("nq"), F.explode(F.concat(tagged("t", F.col("qt")), tagged("s", F.col("qs")))).alias("key"))
    # keys that no label has can't be shared; what is left comes rarest first
    keys = keyed.join(often, [*scope, "key"]).groupBy(*scope, "query").agg(F.first("qs").alias("qs"), F.first("nq").alias("nq"), F.array_sort(F.collect_list(F.struct("n", "key"))).alias("keys"))
    of = lambda tag: F.transform(F.filter("keys", lambda k: k["key"].startswith(tag)), lambda k: F.substring(k["key"], 2, 1 << 20))
    keys = keys.withColumns({"p": of("t"), "s": of("s")})
    first = F.transform("p", lambda x, i: F.struct(F.concat(F.lit("t"), x).alias("key"), i.alias("i")))
    whole = F.when((F.size("qs") > 0) & (F.size("s") == F.size("qs")), F.array(F.struct(F.concat(F.lit("s"), F.get("s", 0)).alias("key"), F.lit(-1).alias("i")))).otherwise(F.array().cast("array<struct<key:string,i:int>>"))
    probes = keys.select(*scope, "query", "qs", "nq", "p", F.inline(F.concat(first, whole)))
    n = F.size("lt") + F.col("nq")
    may = (F.col("i") < 0) | ((n < 11 * (F.size("p") - F.col("i"))) & (F.col("nq") < 10 * F.size("lt")) & (F.size("lt") < 10 * F.col("nq")))
    return index.join(probes, [*scope, "key"]).where(may)


def search(node_table: DataFrame, queries: DataFrame, limit: int = 20, kind: str | None = None) -> DataFrame:
    """query, id, label, similarity, text_rank, score, rank: the best nodes of each queries(query) by the sum of trigram similarity
    and text rank (the label and its type, English stems); found are those with a similarity over 0.1 or with all stems.

    With a column ``project_id`` in queries, each finds only nodes of its project. Null queries find nothing. Ties go by id. A
    text that many nodes have is scored once, and only its first ``limit`` nodes can be among a query's first; a hot key's
    rows are split by adaptive execution; the first ``limit`` of a query are cut in each task before they meet.
    """
    scope = ["project_id"] if "project_id" in queries.columns else []
    rows = node_table.select(*scope, "id", "type", "label") if kind is None else node_table.where(F.col("type") == kind).select(*scope, "id", "type", "label")
    met = search_candidates(rows.groupBy(*scope, "type", "label").agg(F.min("id").alias("id")), queries)
    both = F.array_intersect("p", "lt")
    n = F.size("lt") + F.col("nq")
    near = 11 * F.size(both) > n
    # found by its first common trigram, or by its stems if it is not near enough
    once = F.when(F.col("i") < 0, ~near & (F.size(F.array_except("qs", "ls")) == 0)).otherwise(near & (F.col("key") == F.concat(F.lit("t"), F.get(both, 0))))
    met = met.where(once).select(*scope, "query", "id", "type", "label", (F.size(both) / (n - F.size(both))).alias("similarity"), text_rank(F.col("qs"), F.col("ls")).alias("text_rank"))
    met = met.withColumn("score", F.round(F.col("similarity") + F.col("text_rank"), 6))
    rank = F.row_number().over(Window.partitionBy(*scope, "query").orderBy(F.desc("score"), "id"))
    best = met.withColumn("rank", rank).where(F.col("rank") <= limit).drop("id", "rank")
    place = F.row_number().over(Window.partitionBy(*scope, "type", "label").orderBy("id"))
    held = rows.withColumn("place", place).where(F.col("place") <= limit).drop("place")
    b, h = best.alias("b"), held.alias("h")
    same = F.expr(" AND ".join(f"b.{c} <=> h.{c}" for c in [*scope, "type", "label"]))
    met = b.join(h, same).select(*(f"b.{c}" for c in scope), "b.query", "h.id", "b.label", "b.similarity", "b.text_rank", "b.score").withColumn("rank", rank).where(F.col("rank") <= limit)
    return met.select(*scope, "query", "id", "label", F.round("similarity", 6).alias("similarity"), F.round("text_rank", 6).alias("text_rank"), "score", "rank")


def orphan_pages(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """Page nodes that no link leads to."""
    linked = edge_table.where("relation = 'links_to'").select(F.col("dst").alias("id"))
    return node_table.where("type = 'Page'").join(linked, "id", "left_anti")


def content_topics(items: DataFrame, topics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node rows and edge rows of items(project_id, url, topic_id, ordinal) that cover one of topics(project_id, topic_id, slug, name):
    the page, whether or not it was crawled, the topic, and "covers" between them. Items of no known topic give nothing."""
    got = items.join(topics, ["project_id", "topic_id"])
    ref = F.sha2("url", 256)
    page = got.select("project_id", F.lit("Page").alias("type"), ref.alias("ref_id"), F.col("url").alias("label"), "ordinal")
    topic = got.select("project_id", F.lit("Topic").alias("type"), F.col("slug").alias("ref_id"), F.col("name").alias("label"), "ordinal")
    src, dst = node_id(F.col("project_id"), F.lit("Page"), ref), node_id(F.col("project_id"), F.lit("Topic"), F.col("slug"))
    edge = got.select(src.alias("src"), dst.alias("dst"), F.lit("covers").alias("relation"), F.lit(1.0).alias("weight"), F.lit(None).cast("int").alias("position"), "ordinal")
    return page.unionByName(topic), edge


def traverse(edges: DataFrame, starts: DataFrame, max_depth: int, keep: Callable[[DataFrame], DataFrame], relation: str | None = None) -> DataFrame:
    """start, node, depth: the least depth at which each start(start) reaches a node over edges(src, dst).

    One join per level with nodes already seen taken out, so paths never multiply.
    """
    edges = edges if relation is None else edges.where(F.col("relation") == relation)
    seen = keep(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")))
    front = seen
    for depth in range(1, max_depth + 1):
        step = front.join(edges, front["node"] == edges["src"]).select("start", F.col("dst").alias("node")).distinct()
        front = keep(step.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def link_recommendations(links: DataFrame, covers: DataFrame, limit: int) -> DataFrame:
    """target, source, topic in order, ``limit`` in all: a weak page (one link in at most), a strong one (two at least), both of
    which cover the topic, with no link from source to target yet.

    Of a topic only so many strong pages can matter to a target as the limit and the links it already has, which are one at
    most; so each topic keeps its first ``limit`` + 2 strong pages (one may be the target itself), and the first targets are
    chosen before they are paired. No topic makes all its pairs.
    """
    degree = links.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"))
    pages = covers.select(F.col("src").alias("node"), F.col("dst").alias("topic")).join(degree, "node", "left").fillna(0, ["n_in"])
    weak = pages.where("n_in <= 1").select(F.col("node").alias("target"), "topic")
    strong = pages.where("n_in >= 2").select(F.col("node").alias("source"), "topic").distinct()
    first = F.row_number().over(Window.partitionBy("topic").orderBy("source"))
    strong = strong.withColumn("k", first).where(F.col("k") <= limit + 2).drop("k")
    # a target whose topic has three strong pages has a recommendation for sure; of the others all are tried
    rich = strong.groupBy("topic").agg(F.count("*").alias("n"))
    weak = weak.distinct().join(rich, "topic")
    sure = weak.where("n >= 3").select("target").distinct().orderBy("target").limit(limit)
    chosen = weak.where("n < 3").unionByName(weak.where("n >= 3").join(F.broadcast(sure), "target", "left_semi"))  # at most ``limit`` rows
    found = chosen.drop("n").join(strong, "topic").where("target <> source")
    have = links.select(F.col("src").alias("source"), F.col("dst").alias("target")).distinct()
    return found.join(have, ["source", "target"], "left_anti").select("source", "target", "topic").distinct().orderBy("target", "source", "topic").limit(limit)


def recommendation_texts(found: DataFrame) -> DataFrame:
    """Recommendations with anchor and reason in words."""
    reason = F.format_string("'%s' is an authority page on %s; '%s' covers the same topic but has at most one internal link.", "source", "topic", "target")
    return found.select("source", "target", F.lower("topic").alias("anchor"), reason.alias("reason"), F.lit(0.6).alias("confidence"))


def topic_coverage(covers: DataFrame, topics: DataFrame) -> DataFrame:
    """topic, n_pages, weak: the number of covering nodes of each topics(topic); those with the fewest matter most."""
    n = covers.groupBy(F.col("dst").alias("topic")).agg(F.count_distinct("src").alias("n_pages"))
    return topics.join(n, "topic", "left").fillna(0, ["n_pages"]).withColumn("weak", F.col("n_pages") == 0)


def least_covered(coverage: DataFrame, limit: int) -> DataFrame:
    """The topics with the fewest covering pages, fewest first; a top-k, so no task sorts all."""
    return coverage.orderBy("n_pages", "topic").limit(limit)
