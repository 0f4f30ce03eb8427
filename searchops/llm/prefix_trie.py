"""Conversation prefix trie: subtree totals by time-forward processing.

Every conversation is a sequence of turns; every distinct sequence of first turns is a node of a trie. Nodes are named by a chain of
SHA-256 digests, so equal beginnings meet without being compared. Tasks stream sorted turns and emit one row per turn; a group-by
with partial sums makes the nodes, so a beginning that a third of all conversations share is one row per task before the shuffle.

Subtree totals are passed from children to parents in reverse level order. With n rows, a node is *heavy* if it has more than
sqrt(n) conversations; there are at most sqrt(n) heavy nodes, and they are the top of the trie. What hangs below it are the *shards*, of at
most sqrt(n) conversations each: a conversation's shard is its first light node. Spark sorts the nodes of shards externally, deepest
first; a task reads them in this order, and each node sends its totals to its parent through a priority queue that is ordered alike
and spills sorted runs to the folder Spark spills to itself. The totals of shard roots, summed by parent first, then go through the heavy
nodes the same way.

The conversations that end in a node are hashed in order: Spark sorts (node, conversation) in ranges, tasks join the ids of a range,
and a second task hashes these pieces one after the other, so neither holds the ids of a node.

Defined results: turns are ordered by number (nulls first), then by the digest of role and text; a null role or text is empty; rows
without ``conv_id`` belong to no conversation and are not read; repeated rows are turns of their own; a conversation of very many turns
is streamed with constant state; without conversations there is only the root, without members; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import os
import pickle
import tempfile
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Tables

ROOT = hashlib.sha256(b"").digest()
QUEUE_ENTRIES = 1 << 18  # messages in memory before a run is spilled
IDS = 1 << 16  # ids joined into one piece

STEPS = "key binary, parent binary, depth long, n_words long, conv_id long, ends boolean"
_STEPS = pa.schema([("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("n_words", pa.int64()), ("conv_id", pa.int64()), ("ends", pa.bool_())])
TOTALS = "key binary, parent binary, root boolean, n_children long, n_leaves long, saved_tokens long"
_TOTALS = pa.schema([("key", pa.binary()), ("parent", pa.binary()), ("root", pa.bool_()), *((c, pa.int64()) for c in ("n_children", "n_leaves", "saved_tokens"))])


def turn_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest and n_words of each turn; texts go no further."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), digest.alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words")
    )


def own_turns(group: int, conv: int, head: list) -> tuple[list, int]:
    """A conversation as it stands: no turns from another one, none of its own left out."""
    return [], 0


def shared_beginnings(group: int, conv: int, head: list) -> tuple[list, int]:
    """The first crc32(conv) % 4 turns come from the conversation that names the group."""
    h = 0 if conv == group else zlib.crc32(str(conv).encode()) % 4
    return head[:h], h


HEAD = 3  # turns of the group's first conversation that are kept at hand


def _stepper(rebuild: Callable[[int, int, list], tuple[list, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From turns in the order of (group, conversation, turn): a row for the root and each node on each conversation's path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = conv = None
        head: list = []
        rows: list = []
        last: list = []  # the row that may be the conversation's end
        skip = seen = 0
        for batch in batches:
            for g, c, digest, n_words in zip(*(batch.column(k).to_pylist() for k in ("grp", "conv_id", "digest", "n_words")), strict=True):
                if g != group:
                    group, conv, head = g, None, []
                if c != conv:
                    if last:
                        rows.append((*last, True))
                    conv, seen = c, 0
                    last = [ROOT, None, 0, 0, c]
                    shared, skip = rebuild(g, c, head)
                    for turn in shared:
                        rows.append((*last, False))
                        last = _next(last, *turn)
                if c == g and seen < HEAD:
                    head.append((digest, n_words))
                if seen >= skip:
                    rows.append((*last, False))
                    last = _next(last, digest, n_words)
                seen += 1
            if len(rows) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _STEPS, strict=True)], schema=_STEPS)
                rows = []
        if last:
            rows.append((*last, True))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _STEPS, strict=True)], schema=_STEPS)

    return run


def _next(row: list, digest: bytes, n_words: int) -> list:
    return [hashlib.sha256(row[0] + digest).digest(), row[0], row[2] + 1, n_words, row[4]]


class SpillingQueue:
    """A priority queue of (time, payload): what doesn't fit in memory is written out as sorted runs that are read back in order.

    The file has no name and ends with the task; it lies where Spark's own sorts of this executor spill.
    """

    def __init__(self, entries: int = QUEUE_ENTRIES):
        self.entries, self.heap, self.runs, self.number = entries, [], [], 0

    def push(self, time: Any, payload: tuple) -> None:
        heapq.heappush(self.heap, (time, payload))
        if len(self.heap) > self.entries:
            self._spill()

    def _spill(self) -> None:
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        file = tempfile.TemporaryFile(dir=folder if folder and os.path.isdir(folder) else None)
        self.heap.sort()
        for a in range(0, len(self.heap), 1024):
            pickle.dump(self.heap[a : a + 1024], file)
        file.seek(0)
        self.heap = []
        run = self._read(file)
        self.number += 1
        heapq.heappush(self.runs, (next(run), self.number, run))

    @staticmethod
    def _read(file: Any) -> Iterator[tuple]:
        with file:
            while True:
                try:
                    yield from pickle.load(file)
                except EOFError:
                    return

    def pop_at(self, time: Any) -> Iterator[tuple]:
        """All payloads for ``time``, which is the least time that is left."""
        while self.heap and self.heap[0][0] == time:
            yield heapq.heappop(self.heap)[1]
        while self.runs and self.runs[0][0][0] == time:
            (_, payload), number, run = self.runs[0]
            yield payload
            following = next(run, None)
            if following is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (following, number, run))


def _time_forward(entries: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Totals of nodes that arrive deepest first, by key within a level. Messages from children in other shards are columns of the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillingQueue(entries)
        for batch in batches:
            out = []
            for r in zip(*(batch.column(c).to_pylist() for c in ("depth", "key", "parent", "root", "n_convs", "n_words", "n_children", "n_leaves", "saved_tokens")), strict=True):
                depth, key, parent, root, n_convs, n_words, children, leaves, saved = r
                for c, n, s in queue.pop_at((-depth, key)):
                    children, leaves, saved = children + c, leaves + n, saved + s
                leaves = leaves if children else 1
                saved += (n_convs - 1) * n_words
                if not root:
                    queue.push((1 - depth, parent), (1, leaves, saved))
                out.append((key, parent, root, children, leaves, saved))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _TOTALS, strict=True)], schema=_TOTALS)

    return run


def _totals(nodes: DataFrame, shard: Column, tasks: int, entries: int) -> DataFrame:
    """Totals of nodes(key, parent, depth, root, n_convs, n_words, messages ..), whole shards together in a task."""
    dealt = nodes.repartition(tasks, shard).sortWithinPartitions(F.desc("depth"), "key")
    return dealt.select("depth", "key", "parent", "root", "n_convs", "n_words", "n_children", "n_leaves", "saved_tokens").mapInArrow(_time_forward(entries), TOTALS)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, conv_id) in order: the ids of a node joined, in pieces."""
    key, first, ids, out = None, 0, [], []
    schema = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
    for batch in batches:
        for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if k != key or len(ids) >= IDS:
                if ids:
                    out.append((key, first, ",".join(ids)))
                key, first, ids = k, c, []
            ids.append(str(c))
        if len(out) > 4096:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = []
    if ids:
        out.append((key, first, ",".join(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From pieces in order: one SHA-256 per node, fed piece by piece."""
    key = sha = None
    for batch in batches:
        out = []
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if k == key:
                sha.update(b"," + ids.encode())
                continue
            if key is not None:
                out.append((key, sha.hexdigest()))
            key, sha = k, hashlib.sha256(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.binary(), pa.string()), strict=True)], ["key", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])], ["key", "ends_sha256"])


def _end_hashes(ends: DataFrame) -> DataFrame:
    """key, ends_sha256 of the conversations that end in a node, in the order of their ids."""
    pieces = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_pieces, "key binary, first long, ids string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(_hashed, "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, group: Column | None = None, rebuild: Callable = own_turns, entries: int = QUEUE_ENTRIES) -> DataFrame:
    """One row per node: key, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    With ``group`` (a column of the id of the conversation that a conversation borrows from) ``rebuild`` gives the turns that stand
    in front, out of the group's first ``HEAD`` turns, and how many of the own turns they replace.
    """
    spark = conversations.sparkSession
    tables = Tables(spark, "trie")
    turns = turn_digests(conversations).withColumn("grp", F.col("conv_id") if group is None else group)
    in_order = turns.repartition("grp").sortWithinPartitions("grp", F.col("conv_id") != F.col("grp"), "conv_id", F.col("turn").asc_nulls_first(), "digest")
    steps = tables.keep(in_order.select("grp", "conv_id", "digest", "n_words").mapInArrow(_stepper(rebuild), STEPS), "steps")
    nodes = tables.keep(
        steps.groupBy("key").agg(
            F.first("parent", True).alias("parent"), F.max("depth").alias("depth"), F.max("n_words").alias("n_words"),
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
        ), "nodes"
    )
    if nodes.isEmpty():
        empty = spark.range(1).select(F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"), *(F.lit(0).cast("long").alias(c) for c in ("depth", "n_words")))
        nodes = empty.withColumn("conv_id", F.lit(None).cast("long")).withColumn("n_convs", F.lit(0).cast("long"))

    bound = max(16, math.isqrt(steps.count()))
    heavy = tables.keep(nodes.where(F.col("n_convs") > bound), "heavy")  # at most rows / bound of them, so they can be broadcast
    heavy_keys = F.broadcast(heavy.select("key"))
    light = nodes.join(heavy_keys, "key", "left_anti")
    shards = steps.join(heavy_keys, "key", "left_anti").groupBy("conv_id").agg(F.min_by("key", "depth").alias("shard"))
    none = [F.lit(0).cast("long").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]
    light = light.join(shards, "conv_id", "left").select("*", (F.coalesce("shard", "key") == F.col("key")).alias("root"), *none)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    low = tables.keep(_totals(light, F.coalesce("shard", "key"), tasks, entries), "low")

    sent = low.where("root and parent is not null").groupBy("parent").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    met = heavy.join(sent.withColumnRenamed("parent", "key"), "key", "left").na.fill(0, ["n_children", "n_leaves", "saved_tokens"])
    high = _totals(met.withColumn("root", F.col("parent").isNull()), F.lit(0), 1, entries)  # at most sqrt(rows) nodes

    totals = low.unionByName(high).drop("parent", "root")
    ends = _end_hashes(steps.where("ends").select("key", "conv_id"))
    above = heavy.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    of_heavy = nodes.join(F.broadcast(above), "parent")
    of_light = nodes.join(F.broadcast(above.select("parent")), "parent", "left_anti")
    of_light = of_light.join(nodes.join(heavy_keys, "key", "left_anti").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent", "left")
    named = of_heavy.unionByName(of_light)
    return (
        named.join(totals, "key").join(ends, "key", "left")
        .select("key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(ROOT.hex())).alias("ends_sha256"))
    )
