"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character 3- to 5-grams (with its ends marked) and itself, hashed into ``BUCKETS``
embedding rows, so a misspelling that was never seen shares rows with known words. A passage of ``WINDOW`` words
is the average of its rows, and a softmax over (clean, toxic) reads it; a text scores as its most toxic passage,
so a long text does not dilute a few lines. Embeddings and softmax are trained together on the driver on at
most ``TRAIN_ROWS`` labelled documents of ``TRAIN_BYTES`` in all (a documented bound), as many of each label as far as there are.
The bias is then set so that a score of ``CUT`` is where recall and the share of clean documents kept are greatest in sum, as
found on the same documents by models that were trained without them (``FOLDS`` parts). Scoring is a map over all whole texts.
As the softmax is linear, a row's share in the log-odds is one number, and that table is all a task gets.

Defined results: a null, empty or wordless text gets the score of the empty bag, which is the bias alone; repeated
rows score alike; a table without rows gives none; without labelled rows of both kinds the score is the prior 0.5;
with fewer than ``FOLDS`` of a kind the bias stays as it was trained; null labels and labels without a document are ignored; of several labels of an id the largest stands, of several texts the
smallest; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .samples import first_of_each, texts_of
from .scratch import Tables
from .textkernel import ALNUM, BYTE_CODES, LOWER, frugal, mix, slices, span_hashes, spans

BUCKETS, DIM, WINDOW = 1 << 18, 8, 8
GRAMS = (3, 4, 5)
TRAIN_ROWS, TRAIN_BYTES, EPOCHS, RATE = 3000, 8 << 20, 6, 0.3
CUT, FOLDS = 0.3, 3
_MULT = np.uint64(0x9E3779B97F4A7C15)
_SALT = np.random.default_rng(3).integers(1, 1 << 63, 8, dtype=np.uint64)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % parts == part


def labels_of(labels: DataFrame, label: str, parts: int, part: int) -> DataFrame:
    """doc_id, y of the labels outside the held-out part; of labels of one id the largest stands."""
    rows = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    return rows.where(~held_out(F.col("doc_id"), parts, part)).groupBy("doc_id").agg(F.max("y").alias("y"))


def padded(texts: pa.Array) -> pa.Array:
    """Each text with a space behind, so that grams don't run into the next text."""
    return pc.binary_join_element_wise(texts.cast(pa.large_string()).fill_null(""), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))


def grams(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, word number) of every gram and word of a slice; also yields the words' offsets last."""
    buf = LOWER[raw]
    starts, ends, at = spans(buf, off, ALNUM)
    yield (span_hashes(buf, starts, ends) & np.uint64(BUCKETS - 1)).astype(np.int32), np.arange(len(starts)), at
    n = len(buf)
    word = ALNUM[buf]
    number = np.cumsum(np.bincount(starts, minlength=n)[:n]).astype(np.int32) - 1 if n else np.zeros(0, np.int32)
    n, number = n + 1, np.append(np.int32(0), number)  # a boundary in front of the first text as of all others
    code = BYTE_CODES[np.append(np.uint8(32), np.where(word, buf, np.uint8(32)))]
    inner = np.append(False, word)  # bytes i+1 .. i+g-2 are word bytes
    for g in GRAMS:
        m = n - g + 1
        if m <= 0:
            break
        h = np.full(m, _SALT[g])
        for k in range(g):
            h = (h ^ code[k : k + m]) * _MULT
        ok = inner[1 : 1 + m].copy()
        for k in range(2, g - 1):
            ok &= inner[k : k + m]
        at_gram = np.flatnonzero(ok)
        yield (mix(h[at_gram]) & np.uint64(BUCKETS - 1)).astype(np.int32), number[at_gram + 1], at


def windows(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The window number of each word, and the n+1 offsets of the rows into the windows (one at least for each row)."""
    n = np.diff(at)
    count = np.maximum(1, -(-n // WINDOW))
    first = np.concatenate([[0], np.cumsum(count)])
    rows = np.repeat(np.arange(len(n)), n)
    return first[rows] + (np.arange(int(n.sum())) - at[rows]) // WINDOW, first


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The grams of training texts, window by window, and the number of grams of each window."""
    for batch in batches:
        ys = batch["y"].to_pylist()
        out = {"doc_id": [], "y": [], "buckets": [], "sizes": []}
        for a, _, raw, off in slices(padded(batch["text"])):
            parts = list(grams(raw, off))
            of, first = windows(parts[0][2])
            bucket = np.concatenate([p[0] for p in parts])
            window = np.concatenate([of[p[1]] for p in parts])
            order = np.argsort(window, kind="stable")
            bucket, window = bucket[order], window[order]
            for i in range(len(first) - 1):
                lo, hi = np.searchsorted(window, [first[i], first[i + 1]])
                out["doc_id"].append(batch["doc_id"][a + i].as_py())
                out["y"].append(ys[a + i])
                out["buckets"].append(bucket[lo:hi])
                out["sizes"].append(np.bincount(window[lo:hi] - first[i]).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["doc_id"], pa.int64()), pa.array(out["y"], pa.int32()), pa.array(out["buckets"], pa.list_(pa.int32())), pa.array(out["sizes"], pa.list_(pa.int32()))],
            ["doc_id", "y", "buckets", "sizes"],
        )


def train(bags: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 0) -> tuple[np.ndarray, float]:
    """Fit embeddings and softmax by AdaGrad on each document's most toxic window; returns each bucket's share in
    the log-odds, and the bias."""
    ys = {y for y, *_ in bags}
    if len(ys) < 2:
        return np.zeros(BUCKETS, np.float32), 0.0
    rng = np.random.default_rng(seed)
    known = np.zeros(BUCKETS, bool)
    for _, bucket, _ in bags:
        known[bucket] = True
    emb = rng.normal(0, 0.01, (BUCKETS, DIM)).astype(np.float32)
    emb[~known] = 0
    soft = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    g_emb, g_soft, g_bias = np.full(BUCKETS, 1e-4, np.float32), np.full((DIM, 2), 1e-4, np.float32), np.full(2, 1e-4, np.float32)
    for epoch in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            y, bucket, size = bags[i]
            if not len(bucket):
                continue
            size = size[size > 0]
            edge = np.cumsum(size) - size
            if epoch and len(edge) > 1:
                share = emb[bucket] @ (soft[:, 1] - soft[:, 0])
                k = int((np.add.reduceat(share, edge) / size).argmax())
                rows = bucket[edge[k] : edge[k] + size[k]]
            else:
                rows = bucket
            rows, times = np.unique(rows, return_counts=True)
            weight = (times / times.sum()).astype(np.float32)
            mean = weight @ emb[rows]
            z = mean @ soft + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            err = p
            err[y] -= 1
            grad = np.outer(weight, soft @ err)
            d_soft = np.outer(mean, err)
            g_emb[rows] += (grad**2).mean(1)
            emb[rows] -= RATE * grad / np.sqrt(g_emb[rows])[:, None]
            g_soft += d_soft**2
            soft -= RATE * d_soft / np.sqrt(g_soft)
            g_bias += err**2
            bias -= RATE * err / np.sqrt(g_bias)
    return emb @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0])


def log_odds(model: tuple[np.ndarray, float], bags: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Of each bag, as for a text: its most toxic window."""
    weights, bias = model
    out = np.full(len(bags), float(bias))
    for i, (_, bucket, size) in enumerate(bags):
        size = size[size > 0]
        if len(size):
            out[i] += (np.add.reduceat(weights[bucket].astype(np.float64), np.cumsum(size) - size) / size).max()
    return out


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """Halfway below the log-odds down to which recall less the share of clean documents hit is greatest; ties: the higher one."""
    values, of = np.unique(z, return_inverse=True)
    hit = [np.cumsum(np.bincount(of[y == k], minlength=len(values))[::-1]) / max(1, (y == k).sum()) for k in (1, 0)]
    values, k = values[::-1], int(np.argmax(hit[0] - hit[1]))
    return float((values[k] + values[min(k + 1, len(values) - 1)]) / 2)


def calibrated(bags: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, float]:
    """The model of all bags, its bias moved so that the best cut of models that did not see what they score is at CUT."""
    weights, bias = train(bags)
    y = np.array([b[0] for b in bags], int)
    if min(np.bincount(y, minlength=2)) < FOLDS:
        return weights, bias
    fold, z = np.zeros(len(bags), int), np.zeros(len(bags))
    for label in (0, 1):
        fold[y == label] = np.arange((y == label).sum()) % FOLDS
    for k in range(FOLDS):
        z[fold == k] = log_odds(train([b for b, f in zip(bags, fold, strict=True) if f != k]), [b for b, f in zip(bags, fold, strict=True) if f == k])
    return weights, bias + float(np.log(CUT / (1 - CUT))) - best_cut(z, y)


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    known = labels_of(labels, "toxic", 4, 2)
    tables = Tables(docs.sparkSession, "toxicity")
    sample = texts_of(docs, first_of_each(known, "y", train_rows), train_bytes, tables)
    table = sample.select("doc_id", "text", "y").mapInArrow(frugal(_bags), "doc_id long, y int, buckets array<int>, sizes array<int>")
    table = table.toArrow().sort_by("doc_id")  # the bounded sample, as gram numbers
    bags = [(y.as_py(), b.values.to_numpy(), w.values.to_numpy()) for y, b, w in zip(table["y"], table["buckets"], table["sizes"], strict=True)]
    weights, bias = calibrated(bags)
    model = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, bias = model.value
        for batch in batches:
            out = []
            for _, _, raw, off in slices(padded(batch["text"])):
                total = size = None
                for bucket, word, at in grams(raw, off):
                    if total is None:
                        of, first = windows(at)
                        total, size = np.zeros(int(first[-1])), np.zeros(int(first[-1]))
                    total += np.bincount(of[word], share[bucket], len(total))
                    size += np.bincount(of[word], minlength=len(total))
                z = np.maximum.reduceat(total / np.maximum(size, 1), first[:-1]) + bias
                out.append(1 / (1 + np.exp(-z)))
            flat = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(flat)], ["doc_id", "score"])

    scored = docs.mapInArrow(frugal(score), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id"), 4, 2), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
