"""Benchmark decontamination by CGK embeddings, bit-sampling LSH and exact edit verification.

Texts and items are sequences of words (lower-cased on A-Z). An item leaks into a document when some span of
the document is within ``floor(MAX_EDIT * n)`` word edits of the item's ``n`` words.

* Items fall into size classes; class (W, s) has windows of ``W`` words on a grid of step ``s`` over every whole
  text, and its items are indexed by their windows at every offset, head to tail. Any ``W + s - 1`` words of an
  item that stand in a text hold a whole grid window, wherever in the item they are.
* CGK: a walk reads the window's words; after each step it moves on by a random bit that depends on step
  and word. Word edits become Hamming distance between walks, as walks of both sides join again.
* Repeated bit sampling: a table keys a window by ``SAMPLES`` steps of one walk. With a share
  ``AGREE`` of steps equal, ``ceil(log(1 - RECALL) / log(1 - AGREE ** SAMPLES))`` tables reach the recall.
* Every candidate is verified exactly: the least edit distance of the whole item to any span around
  the place; the surroundings that overlap are searched as one.

The items are sent to the tasks in blocks of at most ``BLOCK_BYTES`` of text; all documents pass each block in a map,
without shuffle, so no source, passage or group of copies can gather anywhere.

Defined results: null or empty texts and items match nothing; repeated documents or items each give
their pairs; null ids are carried; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import LOWER, NOT_SPACE, frugal, mix, slices, span_hashes, spans

MAX_EDIT = 0.2
RECALL, AGREE, SAMPLES, WALKS = 0.95, 0.7, 4, 4
TABLES = math.ceil(math.log(1 - RECALL) / math.log(1 - AGREE**SAMPLES))
BLOCK_BYTES = 12 << 20  # the index takes about 20 to 30 times as much
#: Item sizes from which a class holds; below the first, each size is a class of its own.
SIZES = (12, 24, 48)

_rng = np.random.default_rng(7)
_WALK = _rng.integers(1, 1 << 63, WALKS, dtype=np.uint64) | np.uint64(1)
_KEY = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def size_class(n: int) -> tuple[int, int]:
    """Window size and grid step for items of n words."""
    n = max((s for s in SIZES if s <= n), default=n)
    w = max(1, n // 2 if n < SIZES[1] else n // 3)  # short enough to stand between the edits
    return w, max(1, w // 2)


def sampled_steps(w: int) -> list[tuple[int, np.ndarray]]:
    """For each table its walk and the sorted steps that it looks at, of 2 * w steps (at most 64)."""
    rng = np.random.default_rng(w)
    steps = min(64, 2 * w)
    return [(t % WALKS, np.sort(rng.choice(steps, min(SAMPLES, steps), replace=False))) for t in range(TABLES)]


def window_keys(words: np.ndarray, starts: np.ndarray, w: int) -> np.ndarray:
    """Keys of the windows ``words[p:p + w]`` in each table: an array of (tables, windows)."""
    keys = np.zeros((TABLES, len(starts)), np.uint64)
    tables = sampled_steps(w)
    for walk in range(WALKS):
        mine = [(t, steps) for t, (k, steps) in enumerate(tables) if k == walk]
        bits = mix(words * _WALK[walk])
        at, last = starts.copy(), starts + w - 1
        for j in range(max((int(s[-1]) for _, s in mine), default=-1) + 1):
            seen = [t for t, s in mine if j in s]
            if seen:
                symbol = words[at]
                for t in seen:
                    keys[t] = (keys[t] + symbol) * _KEY[t]
            at += ((bits[at] >> np.uint64(j)) & np.uint64(1)).astype(np.int64)
            np.minimum(at, last, out=at)
    return mix(keys)


def span_distance(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Least edit distance of ``item`` to any span of ``region``, and the (first smallest) end of such a span."""
    row = np.zeros(len(region) + 1, np.int64)
    places = np.arange(len(region) + 1)
    for k, word in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = k
        new[1:] = np.minimum(row[:-1] + (region != word), row[1:] + 1)
        row = np.minimum.accumulate(new - places) + places
    end = int(row.argmin())
    return int(row[end]), end


@dataclass
class Index:
    ids: list
    items: list[np.ndarray]
    sizes: np.ndarray
    has: np.ndarray  # hashed pairs of an item and a word of it
    classes: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def words_of(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, offsets of rows into them) of each slice of a batch."""
    for a, _, raw, off in slices(texts):
        buf = LOWER[raw]
        starts, ends, at = spans(buf, off, NOT_SPACE)
        yield a, span_hashes(buf, starts, ends), at


def build_index(ids: list, texts: list[str | None]) -> Index:
    items = [w[a:b] for _, w, at in words_of(pa.array(texts, pa.string())) for a, b in zip(at[:-1], at[1:], strict=True)]
    by: dict[tuple[int, int], list[int]] = {}
    for k, x in enumerate(items):
        if len(x):
            by.setdefault(size_class(len(x)), []).append(k)
    classes = []
    for (w, s), which in sorted(by.items()):
        flat = np.concatenate([items[k] for k in which])
        sizes = np.array([len(items[k]) for k in which])
        many = sizes - w + 1
        offset = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        starts = np.repeat(np.cumsum(sizes) - sizes, many) + offset
        keys = np.concatenate([window_keys(flat, starts[i : i + (1 << 16)], w) for i in range(0, len(starts), 1 << 16)], 1)
        order = np.argsort(keys, 1, kind="stable").astype(np.int32)
        maybe = np.zeros((TABLES, 1 << 16), bool)
        np.put_along_axis(maybe, (keys >> np.uint64(48)).astype(np.int64), True, 1)
        classes.append((w, s, np.repeat(which, many), offset, (np.take_along_axis(keys, order, 1), order), maybe))
    total = np.array([len(x) for x in items], np.int64)
    has = np.zeros(1 << max(16, (16 * int(total.sum())).bit_length()), bool)
    has[pair_place(has, np.repeat(np.arange(len(items)), total), np.concatenate([np.zeros(0, np.uint64), *items]))] = True
    return Index(ids, items, total, has, classes)


def pair_place(has: np.ndarray, item: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (mix(words ^ mix(item.astype(np.uint64) + np.uint64(1))) >> np.uint64(65 - len(has).bit_length())).astype(np.int64)


def candidates(index: Index, words: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """Distinct (row, item, place where the item would begin) triples of a slice, sorted, some windows at a time."""
    step = max(1 << 10, (1 << 16) >> (int(index.sizes.sum()) >> 16).bit_length())  # more items, more hits a window
    for w, s, which, offset, (keys, order), maybe in index.classes:
        n = np.maximum(0, (np.diff(at) - w) // s + 1)
        rows = np.repeat(np.arange(len(n)), n)
        starts = at[rows] + s * (np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n))
        for i in range(0, len(starts), step):
            here, out = starts[i : i + step], []
            mine = window_keys(words[here[0] : here[-1] + w], here - here[0], w)
            for t in range(TABLES):
                hit = np.flatnonzero(maybe[t][(mine[t] >> np.uint64(48)).astype(np.int64)])
                lo, hi = (np.searchsorted(keys[t], mine[t][hit], side) for side in ("left", "right"))
                many = hi - lo
                hit, lo = np.repeat(hit, many), np.repeat(lo, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                entry = order[t][lo]
                out.append(np.stack([rows[i + hit], which[entry], here[hit] - offset[entry]], 1))
            found = np.concatenate(out)
            if len(found):
                found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
                yield found[np.append(True, (found[1:] != found[:-1]).any(1))]


def regions_of(index: Index, words: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, from where, to where) of the joined surroundings of candidates that hold enough words of the item."""
    for found in candidates(index, words, at):
        row, item, place = found.T
        slack = (MAX_EDIT * index.sizes[item]).astype(np.int64)
        need = index.sizes[item] - slack
        a, b = np.maximum(at[row], place - slack), np.minimum(at[row + 1], place + index.sizes[item] + slack)
        new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (a[1:] > b[:-1])))
        row, item, need, a, b = row[new], item[new], need[new], a[new], b[np.append(new[1:], len(b)) - 1]
        ends = np.cumsum(b - a)
        i = 0
        while i < len(row):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] - (b - a)[i] + (1 << 18), "right")))
            many = (b - a)[i:j]
            first = np.cumsum(many) - many
            seen = words[np.repeat(a[i:j] - first, many) + np.arange(int(many.sum()))]
            hit = index.has[pair_place(index.has, np.repeat(item[i:j], many), seen)]
            good = i + np.flatnonzero(np.add.reduceat(hit, first, dtype=np.int64) >= need[i:j])
            yield from zip(*(x[good].tolist() for x in (row, item, a, b)), strict=True)
            i = j


def leaks_of(index: Index, words: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, item, edits, first word) of each verified pair, the best place of each."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for row, k, a, b in regions_of(index, words, at):
        item, region = index.items[k], words[a:b]
        slack = int(MAX_EDIT * len(item))
        if best.get((row, k), (1, 0))[0] == 0:
            continue
        if int(np.isin(item, region, invert=True).sum()) > slack:  # each absent word costs an edit
            continue
        edits, end = span_distance(item, region)
        if edits <= slack:
            first = int(max(0, a + end - len(item) - at[row]))
            best[row, k] = min(best.get((row, k), (edits, first)), (edits, first))
    return [(row, k, *x) for (row, k), x in best.items()]


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, n_item_words, first_word: each pair of a document and an item that leaks into it."""
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    items = items.selectExpr("cast(item_id as bigint) item_id", "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    out = None
    for k in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        rows = block.collect()  # about BLOCK_BYTES of text
        index = docs.sparkSession.sparkContext.broadcast(build_index([r.item_id for r in rows], [r.text for r in rows]))

        def find(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            x: Index = index.value
            for batch in batches:
                pairs = [(a + row, k, e, p) for a, words, at in words_of(batch["text"]) for row, k, e, p in leaks_of(x, words, at)]
                cols = [
                    batch["doc_id"].take(pa.array([p[0] for p in pairs], pa.int64())),
                    pa.array([x.ids[p[1]] for p in pairs], pa.int64()),
                    pa.array([p[2] for p in pairs], pa.int32()),
                    pa.array([len(x.items[p[1]]) for p in pairs], pa.int32()),
                    pa.array([p[3] for p in pairs], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "edits", "n_item_words", "first_word"])

        found = docs.mapInArrow(frugal(find), "doc_id long, item_id long, edits int, n_item_words int, first_word long")
        out = found if out is None else out.unionByName(found)
    return out
