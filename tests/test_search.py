"""Search over node labels against brute force, stems and ranks against known values."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from searchops.functions.stems import STOP_WORDS, stem
from searchops.operators import graph


def pieces(text):
    return {("  " + w + " ")[i : i + 3] for w in re.findall(r"[^\W_]+", text.lower()) for i in range(len(w) + 1)}


def lexemes(text):
    return [None if w in STOP_WORDS else stem(w) for w in re.findall(r"[^\W_]+", text.lower())]


def rank_of(asked, label):
    at = [(w, i) for i, w in enumerate(label) if w in asked]
    if len(asked) == 1:
        return sum(0.1 / (k * k) for k in range(1, len(at) + 1)) / 1.64493406685
    left = 1.0
    for x, (w, i) in enumerate(at):
        for v, j in at[x + 1 :]:
            if v != w and j - i <= 100:
                left *= 1 - 0.1 * math.sqrt(1 / (1.005 + 0.05 * math.exp((j - i) / 1.5 - 2)))
    return 1 - left if asked else 0.0


def brute(nodes, queries, limit):
    out = []
    for project, q in set(queries):
        if q is None:
            continue
        qt, qs, found = pieces(q), {s for s in lexemes(q) if s}, []
        for project_id, kind, ident, label in nodes:
            if project_id != project:
                continue
            lt, ls = pieces(label or ""), lexemes(f"{label or ''} {kind}")
            n = len(qt & lt)
            s = n / len(qt | lt) if qt | lt else 0.0
            if s > 0.1 or (qs and qs <= set(ls)):
                r = rank_of(qs, ls)
                found.append((-round(s + r, 6), ident, q, label, round(s, 6), round(r, 6)))
        out += [(project, q, i, label, s, r, k) for k, (_, i, q, label, s, r) in enumerate(sorted(found)[:limit], 1)]
    return sorted(out, key=str)


WORDS = "engagement ring rings ringing gold golden diamond diamonds the of in jewelry jewellery care caring cleaned cleaning how vs münchen ring2 a".split()


@pytest.fixture(scope="module")
def labels():
    r = random.Random(5)
    rows = [(r.choice("pq"), r.choice(["Topic", "Page"]), f"n{i:04d}", " ".join(r.choices(WORDS, k=r.randrange(1, 9)))) for i in range(400)]
    rows += [("p", "Page", f"hot{i:03d}", "ring ring ring") for i in range(150)]  # one label a third of all
    return rows + [("p", "Page", "z0", ""), ("p", "Page", "z1", None), ("q", "Topic", "z2", "... !"), ("p", "Page", "z3", "ring " + " ".join(f"w{i}" for i in range(300)) + " gold")]


def test_search_equals_brute_force(spark, labels):
    r = random.Random(6)
    asked = [(p, " ".join(r.choices(WORDS, k=r.randrange(1, 5)))) for p in "pq" for _ in range(40)] + [("p", ""), ("q", None), ("p", "the of"), ("p", "zzzz"), ("p", "topic"), ("p", "page"), ("p", "gold gold"), ("p", "ring"), ("p", "ring"), ("r", "ring")]
    nodes = spark.createDataFrame(labels, "project_id string, type string, id string, label string").withColumn("key", F.lit("clash"))
    queries = spark.createDataFrame(asked, "project_id string, query string").withColumn("n", F.lit(1))
    got = graph.search(nodes, queries, 7).collect()
    assert sorted(((g.project_id, g.query, g.id, g.label, round(g.similarity, 6), round(g.text_rank, 6), g["rank"]) for g in got), key=str) == brute(labels, asked, 7)
    everything = graph.search(nodes, queries, 10_000).count()
    assert everything == len(brute(labels, asked, 10_000))


def test_search_tries_few_of_the_pairs(spark):
    """A frequent trigram meets no label that is too long for it."""
    long = " ".join(f"term{i}" for i in range(40))
    nodes = spark.createDataFrame([("p", "Page", f"n{i}", f"{long} x{i}") for i in range(300)] + [("p", "Page", "short", "term1")], "project_id string, type string, id string, label string")
    queries = spark.createDataFrame([("term1 zebra",)], "query string")
    assert graph.search_candidates(nodes, queries).where("i >= 0").select("id").distinct().collect() == [("short",)]
    assert [r.id for r in graph.search(nodes, queries).collect()] == ["short"]


def test_known_ranks_and_stems(spark):
    rank = lambda q, d: spark.range(1).select(graph.text_rank(F.array(*map(F.lit, q)), F.array(*map(F.lit, d)))).first()[0]
    assert round(rank(["a"], ["a", "b"]), 7) == 0.0607927
    assert round(rank(["a", "b"], ["a", "b"]), 7) == 0.0991032
    assert rank(["a", "b"], ["a", "a"]) == 0.0
    for word, want in {"running": "run", "hoping": "hope", "hopping": "hop", "communities": "communiti", "generically": "generic", "happily": "happili", "ties": "tie", "knives": "knive", "consolatory": "consolatori", "skies": "sky", "proceeds": "proceed", "gas": "gas", "ünder": "ünder", "by": "by"}.items():
        assert stem(word) == want


def test_no_labels_and_no_queries(spark):
    nodes = spark.createDataFrame([("p", "Page", "n", "ring")], "project_id string, type string, id string, label string")
    queries = spark.createDataFrame([("ring",)], "query string")
    assert graph.search(nodes.limit(0), queries).count() == graph.search(nodes, queries.limit(0)).count() == 0
    assert [r.id for r in graph.search(nodes, queries).collect()] == ["n"]


def test_covers_edges_and_orphans(spark):
    items = spark.createDataFrame([("p", "u1", 1, 0), ("p", "u2", 1, 1), ("p", "u1", 1, 2), ("p", "u3", None, 3), ("q", "u1", 1, 4), ("p", "u4", 9, 5)], "project_id string, url string, topic_id long, ordinal long")
    topics = spark.createDataFrame([("p", 1, "rings", "Rings")], "project_id string, topic_id long, slug string, name string")
    rows, covers = graph.content_topics(items, topics)
    nodes = graph.nodes(rows)
    assert sorted((r.type, r.label) for r in nodes.collect()) == [("Page", "u1"), ("Page", "u2"), ("Topic", "Rings")]
    page = {r.label: r.id for r in nodes.collect()}
    links = spark.createDataFrame([(page["u1"], page["u2"], "links_to", 1.0, None, 0), (page["u1"], page["u1"], "links_to", 1.0, None, 0)], "src string, dst string, relation string, weight double, position int, ordinal long")
    edges = graph.edges(covers.unionByName(links), nodes)
    assert sorted((r.src, r.relation) for r in edges.collect()) == sorted([(page["u1"], "covers"), (page["u2"], "covers"), (page["u1"], "links_to")])
    assert [r.label for r in graph.orphan_pages(nodes, edges).collect()] == ["u1"]
