"""Periodic run detection: a suffix automaton whose suffix links are kept as a link-cut forest.

A *run* is a stretch of words with smallest period q, at least three periods and ``LEAST`` words long, that can't be longer on
either side. The words of a text are appended one by one. Appending word i recolours the path of suffix links from prefix i to the
root (``access`` of the link-cut forest) with i: before, the path falls into segments, and all strings of a segment last ended at
the segment's colour p. With d = i - p and L the longest string of the segment, the L words up to i stand d words earlier too;
d <= L is a square of period d. Had these words a smaller period d', the same L words would have ended at i - d' > p, so d is the
smallest. The last i at which it holds ends the run, and its start is i - L - d + 1.

Only stretches that hold a run at all go through the automaton: in a run of period q and at least max(24, 3q) words each word lies in
a block of 16 words that stands q words earlier or later, as 24 - q >= 16 up to q = 8 and 2q >= 16 from there on. Blocks of 16
words are compared by rolling hashes with numpy; a stretch of words in repeated blocks is taken whole, so no run is cut, and equal
hashes of unlike blocks only give the automaton more to read. A task holds one slice of texts, and the automaton of one stretch.

Defined results: a null or empty text has no words and no runs; rows that repeat stay rows of their own; a table without rows gives
none; other columns than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import frugal, slices

LEAST, PERIODS, BLOCK = 24, 3, 16
SLICE_BYTES = 4 << 20  # texts that are numbered and hashed together

RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_MULTIPLIERS = [np.uint64(0x9E3779B97F4A7C15 + 2 * k) for k in range(5)]


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix links and longest lengths of the states, and the state of each prefix. State 0 is the root."""
    steps, link, length, prefix = [{}], [-1], [0], []
    last = 0
    for w in words:
        cur = len(link)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in steps[p]:
            steps[p][w] = cur
            p = link[p]
        if p >= 0:
            q = steps[p][w]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(link)
                steps.append(steps[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[cur] = clone
                while p >= 0 and steps[p].get(w) == q:
                    steps[p][w] = clone
                    p = link[p]
        last = cur
        prefix.append(cur)
    return link, length, prefix


class LinkCut:
    """A forest in which each path from a node to the root can be recoloured as a whole.

    Nodes of one colour that lie on one path are a splay tree ordered by depth; ``up`` of its root names the node above the path.
    All nodes of such a tree have one colour, which is kept at the tree's root.
    """

    def __init__(self, parents: list[int]):
        self.up, self.left, self.right, self.colour = parents, [-1] * len(parents), [-1] * len(parents), [-1] * len(parents)

    def splay(self, x: int) -> None:
        """Make x the root of its splay tree."""
        up, left, right, colour = self.up, self.left, self.right, self.colour
        while True:
            p = up[x]
            if p < 0 or (left[p] != x and right[p] != x):
                return
            g = up[p]
            if inner := g >= 0 and (left[g] == p or right[g] == p):
                self.rotate(p if (left[g] == p) == (left[p] == x) else x)
            else:
                colour[x] = colour[p]
            self.rotate(x)
            if inner and ((h := up[x]) < 0 or (left[h] != x and right[h] != x)):
                colour[x] = colour[g]
                return

    def rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b >= 0:
            up[b] = p
        up[p], up[x] = x, g
        if g >= 0:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    def access(self, x: int, colour: int) -> list[tuple[int, int]]:
        """Recolour the path from x to the root; its former segments as (lowest node, colour), from below."""
        segments, below, node = [], -1, x
        while node >= 0:
            self.splay(node)
            segments.append((node, self.colour[node]))
            cut = self.right[node]
            if cut >= 0:
                self.colour[cut] = self.colour[node]
            self.right[node] = below
            below, node = node, self.up[node]
        self.colour[below] = colour
        return segments


def runs_of(words: list[int], least: int = LEAST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``periods`` periods and ``least`` words, by start, then period."""
    link, length, prefix = automaton(words)
    forest, n, found = LinkCut(link), len(words), []
    for i, state in enumerate(prefix):
        for node, p in forest.access(state, i):
            d, size = i - p, length[node]
            if p >= 0 and size >= (periods - 1) * d and size + d >= least and (i + 1 == n or words[i + 1] != words[i + 1 - d]):
                found.append((i - size - d + 1, size + d, d))
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeated_stretches(ids: np.ndarray, text_of: np.ndarray) -> list[tuple[int, int]]:
    """[from, to) of the longest stretches of words that lie in blocks of 16 words which stand more than once in one text.

    ``ids`` are the words of several texts, ``text_of`` the number of each word's text (ascending).
    """
    if len(ids) <= BLOCK:
        return []
    h = (ids.astype(np.uint64) + np.uint64(1)) * _MULTIPLIERS[4]
    h ^= h >> np.uint64(29)
    for k in range(4):  # blocks of 2, 4, 8, 16
        h = (h[: -(1 << k)] * _MULTIPLIERS[k]) + h[1 << k :]
        h ^= h >> np.uint64(31)
    at = np.flatnonzero(text_of[: len(h)] == text_of[BLOCK - 1 :])
    key = (h[at] + text_of[at].astype(np.uint64)) * _MULTIPLIERS[4]
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    again = np.zeros(len(key), bool)
    again[1:] |= same
    again[:-1] |= same
    starts = at[order[again]]
    edge = np.zeros(len(ids) + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + BLOCK, -1)
    inside = np.cumsum(edge[:-1]) > 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (text_of[1:] != text_of[:-1])
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | (text_of[1:] != text_of[:-1])
    return list(zip(np.flatnonzero(begins).tolist(), (np.flatnonzero(ends) + 1).tolist(), strict=True))


def scan_texts(texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """Number of words, runs, and the words that stay, joined by one space, of each text."""
    split = [t.split() for t in texts]  # bytes split at exactly \x20 and \x09-\x0D
    sizes = np.array([len(w) for w in split], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for words in split for w in words), np.int64, int(first[-1]))
    text_of = np.repeat(np.arange(len(texts)), sizes)
    runs: dict[int, list[tuple[int, int, int]]] = {}
    for a, b in repeated_stretches(ids, text_of):
        if b - a >= LEAST and (got := runs_of(ids[a:b].tolist())):
            t = int(text_of[a])
            runs.setdefault(t, []).extend((a - int(first[t]) + s, n, q) for s, n, q in got)
    for t, words in enumerate(split):
        mine = sorted(runs.get(t, ()), key=lambda r: (r[0], r[2]))
        if mine:
            kept = np.ones(len(words), bool)
            for s, n, q in mine:
                kept[s + q : s + n] = False
            words = [words[k] for k in np.flatnonzero(kept).tolist()]
        yield int(sizes[t]), mine, b" ".join(words)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for a, b, *_ in slices(texts.fill_null(b""), SLICE_BYTES):
            rows = list(scan_texts([t or b"" for t in texts.slice(a, b - a).to_pylist()]))
            found = [[{"start": s, "length": n, "period": q} for s, n, q in runs] for _, runs, _ in rows]
            out = [batch.column("doc_id").slice(a, b - a), pa.array([n for n, _, _ in rows], pa.int64()), pa.array(found, _RUN), pa.array([c for _, _, c in rows], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs(start, length, period) by start, then period, and the text without each run's words after its first
    period, its words joined by one space."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(frugal(_scan), RUNS)
