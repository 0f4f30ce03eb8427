"""MinHash near-dedup with min-max hashing, confirmed on full shingle sets.

* A document's set holds the hashes of its distinct five-word shingles. Documents of equal sets form
  one *class*; only the class with its smallest doc_id goes on.
* Min-max hashing: under each of ``PERMUTATIONS`` hash functions both the minimum and the maximum
  are kept, so 96 evaluations give 192 signature values, cut into bands of as many rows as keep the share of pairs at the
  threshold that meet in no band under ``LOSS`` (7 rows at 0.85: 3e-5, 6 rows at 0.8: 6e-5).
* Classes that share a band are compared with the band's smallest set ``r`` only (a star, not all
  pairs). That loses no link: with |r| <= |y|, a class ``x`` that is not linked to ``r`` can reach the
  wanted overlap with ``y`` only through shingles outside ``r``, at least
  ``k = need(x, r) - |x & r|`` of them. So members meet again in groups keyed by (r, shingle outside r),
  of which each indexes all but the ``k - 1`` that are most frequent in the star, and each such group is a star around its own
  smallest set, or, where these are at most ``SMALL_PAIRS``, compared in all pairs of different components (both ways
  are exact; the number only chooses the cheaper one). The rank of the centre grows with every round, so the rounds end.
* Links become components by alternating large-star and small-star steps after every round. Members that are
  one component already need no further comparison: only groups, stars and pairs with several components go on.
* A hot group is never one task: centres and counts are pre-aggregated, written, and joined to the members as plain
  tables, which adaptive execution broadcasts or splits. Tables of a round are removed when the next one has its own.

Defined results: a null or blank text has an empty set and is linked with nothing; fewer than five
words make one shingle; null ids are linked to nothing and are their own (null) component; rows that repeat a doc_id are
one document, to which the links of all its texts belong; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .scratch import Tables
from .textkernel import frugal, mix, shingle_sets

PERMUTATIONS, LOSS = 96, 1e-4
WORDS = 5
SET = ["n_shingles", "one", "two"]
#: From the second round on, members outside a group's largest component meet all others if these are so many pairs at most.
SMALL_PAIRS = 128 * 128
#: A member carries so many of its earlier groups at most, by which a pair that meets again is told.
EARLIER = 64
#: Ids of candidate classes are sent to every executor up to this many (8 bytes each), else joined by shuffle.
MAX_BROADCAST_IDS = 2_000_000

_rng = np.random.default_rng(20)
_MULTIPLIERS = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_ORDER = _rng.permutation(2 * PERMUTATIONS)
_SALTS = _rng.integers(1, 1 << 63, 2 * PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_OTHER = np.uint64(0xD6E8FEB86659FD93)


def min_max_signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the set under each hash function: 2 * PERMUTATIONS values."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint32).max, np.uint32)
    high = np.zeros(PERMUTATIONS, np.uint32)
    for i in range(0, len(shingles), 4096):
        h = ((shingles[i : i + 4096, None] * _MULTIPLIERS) >> np.uint64(32)).astype(np.uint32)
        np.minimum(low, h.min(0), out=low)
        np.maximum(high, h.max(0), out=high)
    return np.concatenate([low, high])


def band_rows(percent: int) -> int:
    """The most rows of a band with which a pair at the threshold meets in no band with a probability of at most LOSS."""
    lost = lambda rows: (1 - (percent / 100) ** rows) ** (2 * PERMUTATIONS // rows)
    return max((rows for rows in range(1, 17) if lost(rows) <= LOSS), default=1)


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    n = len(signature) // rows
    values = signature[_ORDER][: n * rows].astype(np.uint64) * _SALTS[: n * rows]
    return mix(values.reshape(n, rows).sum(1)).view(np.int64)


def _digest(s: np.ndarray) -> tuple[int, int, int]:
    """Size and two hashes of a whole set: equal sets are told by these."""
    return (len(s), int(s.sum().view(np.int64)), int(mix(s * _OTHER).sum().view(np.int64))) if len(s) else (0, 0, 0)


def _ragged(lists: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int64), *lists]))


def _sketches(rows: int):
    """A map from doc_id and text to doc_id, size, both hashes and the bands of ``rows`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, lists = [], []
            for s in shingle_sets(batch["text"], WORDS):
                digests.append(_digest(s))
                lists.append(band_keys(min_max_signature(s), rows) if len(s) else np.zeros(0, np.int64))
            columns = [pa.array([d[k] for d in digests], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns, _ragged(lists)], ["doc_id", *SET, "bands"])

    return frugal(run)


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A map from text, class and the class's digest to class and set; other texts of the same doc_id go."""
    for batch in batches:
        wanted = zip(*(batch[c].to_pylist() for c in SET), strict=True)
        own = [(i, s.view(np.int64)) for i, (s, d) in enumerate(zip(shingle_sets(batch["text"], WORDS), wanted, strict=True)) if _digest(s) == d]
        yield pa.RecordBatch.from_arrays([batch["class"].take(pa.array([i for i, _ in own], pa.int64())), _ragged([s for _, s in own])], ["class", "shingles"])


def _few(rows: DataFrame) -> DataFrame:
    """``rows`` of a written table, to be broadcast if their number, which is checked first, is small."""
    return F.broadcast(rows) if rows.count() <= MAX_BROADCAST_IDS else rows


def _sets_of(docs: DataFrame, met: DataFrame, tables: Tables) -> DataFrame:
    """(class, shingles) of each row of ``met``. No set is shuffled, unless rows repeat a doc_id and its text."""
    texts = docs.join(_few(met), "doc_id").select("class", *SET, "text")
    sets = tables.keep(texts.mapInArrow(frugal(_whole_sets), "class long, shingles array<long>"), "sets")
    if sets.count() == met.count():
        return sets
    once = tables.keep(sets.dropDuplicates(["class"]), "sets-once")
    tables.remove("sets")
    return once


def components(links: DataFrame) -> DataFrame:
    """(node, component) for nodes of ``links(u, v)``; the component is its smallest node.

    Alternates large-star and small-star steps until the edges no longer change; the edges stay a
    table and every step is an aggregation and a join on the node.
    """
    tables = Tables(links.sparkSession, "links")
    edges = tables.keep(links.select("u", "v").where("u <> v").distinct(), "0")
    seen = None
    for step in itertools.count(1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select("u", "v", "m")
        small = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = tables.keep(small.select("e.u", "e.v").where("u <> v").distinct(), f"{step}")
        tables.remove(f"{step - 1}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        seen = now


def _apart(column: str) -> Column:
    return (F.min(column) != F.max(column)).alias("apart")


def _pairs_of(buckets: DataFrame, tested: DataFrame | None, tables: Tables, i: int) -> DataFrame:
    """(r, class, star) to compare in round ``i``: every member of a bucket with its centre, or in a small bucket all pairs
    of different components; pairs of ``tested`` rounds are not tested again in the same role."""
    if tested is None:
        centre = tables.keep(buckets.groupBy("bucket").agg(F.min(F.struct("size", "class"))["class"].alias("r")), f"centre-{i}")
        return buckets.join(centre, "bucket").where("r <> class").select("r", "class", F.lit(True).alias("star")).distinct()
    parts = buckets.groupBy("bucket", "component").agg(F.min(F.struct("size", "class")).alias("first"), F.count("*").alias("n"))
    centre = parts.groupBy("bucket").agg(F.min("first")["class"].alias("r"), F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("n"))
    small = (F.col("n") - F.col("main.n")) * F.col("n") <= SMALL_PAIRS
    centre = tables.keep(centre.select("bucket", "r", F.col("main.component").alias("main"), small.alias("small")), f"centre-{i}")
    met = buckets.join(centre, "bucket")
    star = met.where("not small and r <> class").select("r", "class", F.lit(True).alias("star")).distinct()
    star = star.join(tested.where("star").select("r", "class"), ["r", "class"], "left_anti")
    some = met.where("small")
    other = some.select("bucket", F.struct("size", "class").alias("x"), "component", "earlier")
    mine = some.where("component <> main").select("bucket", F.struct("size", "class").alias("y"), F.col("component").alias("own"), F.col("earlier").alias("own_earlier"))
    first = ~F.arrays_overlap("earlier", "own_earlier")  # members of a star pair at the first group in which both are
    each = mine.join(other, "bucket").where("own <> component").where(first).select(F.least("x", "y")["class"].alias("r"), F.greatest("x", "y")["class"].alias("class")).distinct()
    each = each.join(tested.select("r", "class"), ["r", "class"], "left_anti").withColumn("star", F.lit(False))
    return star.unionByName(each).groupBy("r", "class").agg(F.max("star").alias("star"))


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Whether each pair is linked, and of star pairs the shingles outside the centre and how many of these to index.

    If the pairs are few, only the sets of their members are shuffled, each once, and a centre's set once a pair.
    """
    few = _few(pairs)
    own = sets if few is pairs else sets.join(F.broadcast(pairs.select("class").distinct()), "class", "left_semi")
    pairs = sets.select(F.col("class").alias("r"), F.col("shingles").alias("rs")).join(few, "r")
    pairs = pairs.join(own.select("class", F.col("shingles").alias("xs")), "class")
    nr, nx, common, need = (F.col(c) for c in ("nr", "nx", "common", "need"))
    tested = pairs.select("r", "class", "star", F.size("rs").alias("nr"), F.size("xs").alias("nx"), F.array_except("xs", "rs").alias("outside"))
    tested = tested.withColumn("common", nx - F.size("outside")).withColumn("need", F.ceil((nr + nx) * percent / (100 + percent)))
    indexed = F.greatest(F.lit(0), F.size("outside") - F.greatest(F.lit(1), need - common) + 1)
    outside = F.when(F.col("star"), F.col("outside")).otherwise(F.array().cast("array<bigint>"))
    linked = common * 100 >= (nr + nx - common) * percent
    return tested.select("r", "class", nx.alias("size"), "star", linked.alias("linked"), indexed.cast("int").alias("indexed"), outside.alias("outside"))


def _next_buckets(tested: DataFrame, labels: DataFrame, tables: Tables, i: int) -> DataFrame:
    """Members of stars of several components, by the shingles outside the centre that several components share."""
    members = tested.where("star").join(labels.withColumnRenamed("node", "class"), "class", "left")
    members = members.withColumn("component", F.coalesce("component", "class")).withColumn("new", F.col("round") == i)
    open_stars = members.groupBy("r").agg(F.max("new").alias("any_new"), _apart("component")).where("any_new and apart").select("r")
    open_stars = tables.keep(open_stars, f"open-{i}")
    members = members.join(open_stars, "r", "left_semi").select("r", "class", "size", "component", "new", "indexed", "outside")
    members = tables.keep(members, f"members-{i}")
    key = lambda s: F.xxhash64("r", s)
    keys = members.select("r", "class", "component", F.explode(F.transform("outside", key)).alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.count("*").cast("int").alias("n"), _apart("component")).where("apart").drop("apart")
    shared = tables.keep(shared, f"shared-{i}")
    own = keys.join(shared, "bucket").groupBy("r", "class").agg(F.array_sort(F.collect_list(F.struct("n", "bucket"))).alias("s"))
    own = own.join(members.withColumn("n_outside", F.size("outside")).drop("outside"), ["r", "class"])
    settled = F.col("n_outside") - F.size("s")  # shingles of one component only come first
    own = own.withColumn("b", F.transform(F.slice("s", F.lit(1), F.greatest(F.lit(0), F.col("indexed") - settled)), lambda x: x["bucket"]))
    again = own.select("r", "class", "size", "component", "new", F.posexplode("b").alias("at", "bucket"))
    again = tables.keep(again, f"again-{i}")
    who = F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("who")  # tells groups of the same members
    live = again.groupBy("bucket").agg(F.count("*").alias("n"), F.max("new").alias("any_new"), _apart("component"), who)
    live = tables.keep(live.where("any_new and apart").groupBy("n", "who").agg(F.min("bucket").alias("bucket")).select("bucket"), f"live-{i}")
    member = again.join(live, "bucket", "left_semi").groupBy("r", "class", "size", "component").agg(F.array_sort(F.collect_list(F.struct("at", "bucket"))).alias("b"))
    member = member.select("class", "size", "component", F.transform("b", lambda x: x["bucket"]).alias("b"))
    member = member.select("class", "size", "component", "b", F.posexplode("b").alias("at", "bucket"))
    earlier = F.slice("b", F.greatest(F.lit(1), F.col("at") - EARLIER + 1), F.least("at", F.lit(EARLIER)))  # of the groups that are left
    buckets = tables.keep(member.select("bucket", "class", "size", "component", earlier.alias("earlier")), f"buckets-{i + 1}")
    tables.remove(*(f"{x}-{i}" for x in ("open", "members", "shared", "again", "live")))
    return buckets


def _merged(labels: DataFrame | None, links: DataFrame, tables: Tables, name: str) -> DataFrame:
    """The labels (node, component) after more links: only components that new links join are solved again."""
    if labels is None:
        return tables.keep(components(links), f"labels-{name}")
    for end in ("u", "v"):
        own = labels.select(F.col("node").alias(end), F.col("component").alias("own"))
        links = links.join(own, end, "left").withColumn(end, F.coalesce("own", end)).drop("own")
    joined = components(tables.keep(links.where("u <> v").distinct(), f"ends-{name}"))
    joined = tables.keep(joined, f"joined-{name}")
    moved = labels.join(joined.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    return tables.keep(moved.select("node", F.coalesce("to", "component").alias("component")).unionByName(joined), f"labels-{name}")


def _labels(buckets: DataFrame, sets: DataFrame, links: DataFrame, percent: int, tables: Tables) -> DataFrame:
    """(node, component) over ``links`` and all links between the buckets' members; see the module's text."""
    tested, labels = None, _merged(None, links, tables, "repeated")
    for i in itertools.count():
        pairs = tables.keep(_pairs_of(buckets, tested, tables, i), f"pairs-{i}")
        tables.remove(f"centre-{i}", f"buckets-{i}")
        new = _compared(pairs, sets, percent)
        tables.write(new, f"tested/round={i}")  # one folder for all rounds, so that plans do not grow with them
        tables.remove(f"pairs-{i}")
        tested = tables.spark.read.schema(StructType([*new.schema, StructField("round", IntegerType())])).parquet(tables.path("tested"))
        links = tested.where("linked").where(F.col("round") == i).select(F.least("r", "class").alias("u"), F.greatest("r", "class").alias("v"))
        labels = _merged(labels, links, tables, f"{i}")
        buckets = _next_buckets(tested, labels, tables, i)
        if buckets.isEmpty():
            return labels


def _repeated_ids(rows: DataFrame, classes: DataFrame, tables: Tables) -> DataFrame:
    """Links (u, v) between the classes of rows that repeat a doc_id with different sets."""
    key = F.struct(*SET)
    ids = rows.groupBy("doc_id").agg((F.min(key) != F.max(key)).alias("several")).where("several").select("doc_id")
    ids = tables.keep(ids, "repeated")
    mine = rows.join(ids, "doc_id", "left_semi").select("doc_id", *SET).distinct().join(classes.select(*SET, "class"), SET)
    mine = tables.keep(mine.select("doc_id", "class"), "of-repeated")
    return mine.join(mine.groupBy("doc_id").agg(F.min("class").alias("u")), "doc_id").select("u", F.col("class").alias("v")).where("u <> v")


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |intersection| >= percent * |union| of their shingle sets.
    """
    tables = Tables(docs.sparkSession, "near-dedup")
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sketches = docs.mapInArrow(_sketches(band_rows(percent)), "doc_id long, n_shingles long, one long, two long, bands array<long>")
    sketches = tables.keep(sketches, "sketches")
    classes = sketches.where("n_shingles > 0 and doc_id is not null").groupBy(*SET).agg(F.min(F.struct("doc_id", "bands")).alias("first"))
    classes = classes.select(*SET, "first.doc_id", "first.bands", F.monotonically_increasing_id().alias("class"))
    banded = tables.keep(classes, "banded")  # from here on the numbers of the classes are fixed
    rows = tables.keep(sketches.drop("bands"), "rows")
    tables.remove("sketches")  # bands are most of it
    named = rows.where("n_shingles > 0 and doc_id is not null")
    members = banded.select("class", F.col("n_shingles").alias("size"), F.posexplode("bands").alias("band", "key"))
    members = members.select(F.xxhash64("band", "key").alias("bucket"), "class", "size")
    shared = tables.keep(members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "shared")
    buckets = members.join(_few(shared), "bucket", "left_semi").withColumn("component", F.col("class"))
    buckets = tables.keep(buckets, "buckets-0")
    classes = tables.keep(banded.drop("bands"), "classes")
    tables.remove("banded", "shared")
    met = buckets.select("class").distinct().join(classes.select("class", "doc_id", *SET), "class")
    met = tables.keep(met, "candidates")
    sets = _sets_of(docs, met, tables)
    labels = _labels(buckets, sets, _repeated_ids(named, classes, tables), percent, tables)
    own = classes.select("class", "doc_id", *SET).join(labels.withColumnRenamed("node", "class"), "class", "left")
    own = tables.keep(own.select("doc_id", *SET, F.coalesce("component", "class").alias("component")), "labels")
    least = own.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    own = tables.keep(own.join(least, "component").select(*SET, "component_id"), "components")
    tables.remove("candidates", "sets", "sets-once", "tested", "classes", "repeated", "of-repeated", "labels")
    out = rows.select("doc_id", *SET).join(own, SET, "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
