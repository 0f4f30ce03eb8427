"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; the unlabelled set is web text of any kind, whose labels are not
used. The share of good text in it, the class prior, is estimated from the two score distributions: the
least ratio of unlabelled to positive mass above any threshold. A small network then minimises the non-negative
unbiased risk ``p R+(P) + max(0, R-(U) - p R-(P))``, stepping back where the second part turns negative. It reads a
few measures of each whole text: shares of byte classes, word and line repetition, lengths.

Measures of every text are written once. The trusted positives are a bounded sample of labelled rows (``TRAIN_ROWS``,
documented). The unlabelled part of the risk covers all documents: scales, class prior and the last ``PASSES`` steps, each a sum of
gradients over the whole table, which Spark adds up; a bounded sample of it only gives these steps a start. Scoring is a map.

Defined results: null and empty texts are measured as zeros and scored like any other; repeated rows score alike; a
table without rows gives none; without labelled positives the score is 0.5; null labels are ignored; of several labels of an id the smallest stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Tables
from .subword_toxicity import held_out, padded
from .textkernel import NOT_SPACE, byte_class, frugal, slices, span_hashes, spans

TRAIN_ROWS, HIDDEN, EPOCHS, PASSES, BATCH, RATE = 4000, 16, 40, 10, 256, 0.01

_CLASSES = np.zeros(256, np.int64)  # 0: lower-case letters and all else
for _k, _bytes in enumerate((range(65, 91), range(48, 58), b"!", b"|", b"%$&#*@^~", b".,;:?'\"-()", b"\n\r", b" \t", range(128, 256)), 1):
    _CLASSES[list(_bytes)] = _k
N_CLASSES = 10
_LINE = ~byte_class((10, 10), (13, 13))


def _repeats(hashes: np.ndarray) -> tuple[float, float]:
    """Share of entries that repeat an earlier one, and share that repeat the one before."""
    n = len(hashes)
    return (1 - len(np.unique(hashes)) / n, float((hashes[1:] == hashes[:-1]).sum()) / n) if n else (0.0, 0.0)


def measures(texts: pa.Array) -> np.ndarray:
    """One row of measures for each text."""
    out = []
    for _, _, buf, off in slices(padded(texts)):
        rows = len(off) - 1
        size = np.maximum(1, np.diff(off) - 1)
        row_of = np.repeat(np.arange(rows), np.diff(off))
        shares = np.bincount(row_of * N_CLASSES + _CLASSES[buf], minlength=rows * N_CLASSES).reshape(rows, N_CLASSES) / size[:, None]
        starts, ends, at = spans(buf, off, NOT_SPACE)
        words = span_hashes(buf, starts, ends)
        l_starts, l_ends, l_at = spans(buf, off, _LINE)
        lines = span_hashes(buf, l_starts, l_ends)
        n = np.diff(at)
        more = [(*_repeats(words[at[i] : at[i + 1]]), *_repeats(lines[l_at[i] : l_at[i + 1]])) for i in range(rows)]
        letters = np.append(0, np.cumsum(ends - starts))
        mean = (letters[at[1:]] - letters[at[:-1]]) / np.maximum(1, n)
        out.append(np.column_stack([np.sqrt(shares), np.array(more), np.log1p(n), np.log1p(mean), np.log1p(np.diff(l_at))]))
    return np.concatenate(out) if out else np.zeros((0, N_CLASSES + 7))


class Net:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, rng: np.random.Generator):
        n = len(mean)
        self.mean, self.scale = mean, scale
        self.w = [rng.normal(0, 1 / np.sqrt(n), (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self.m = [np.zeros_like(x) for x in self.w]
        self.v = [np.zeros_like(x) for x in self.w]
        self.t = 0

    @classmethod
    def of(cls, mean: np.ndarray, scale: np.ndarray, w: list[np.ndarray]) -> Net:
        net = cls(mean, scale, np.random.default_rng(0))
        net.w = w
        return net

    def logit(self, x: np.ndarray) -> np.ndarray:
        self.x = np.clip((x - self.mean) / self.scale, -8, 8)
        self.h = np.tanh(self.x @ self.w[0] + self.w[1])
        return self.h @ self.w[2] + self.w[3]

    def gradient(self, d: np.ndarray) -> list[np.ndarray]:
        """The gradient that ``d``, that of the risk by the last logits, gives."""
        dh = np.outer(d, self.w[2]) * (1 - self.h**2)
        return [self.x.T @ dh, dh.sum(0), self.h.T @ d, np.array([d.sum()])]

    def step(self, d: np.ndarray) -> None:
        self.descend(self.gradient(d))

    def descend(self, gradient: list[np.ndarray]) -> None:
        """One Adam step."""
        self.t += 1
        for i, g in enumerate(gradient):
            g = g + 1e-4 * self.w[i] if i in (0, 2) else g
            self.m[i] = 0.9 * self.m[i] + 0.1 * g
            self.v[i] = 0.999 * self.v[i] + 0.001 * g**2
            self.w[i] -= RATE * (self.m[i] / (1 - 0.9**self.t)) / (np.sqrt(self.v[i] / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


CUTS = np.linspace(0, 0.9, 91)


def class_prior(p: np.ndarray, u: np.ndarray, n_positive: int, n_unlabelled: int) -> float:
    """The least ratio of unlabelled to positive mass above a threshold, with a margin for small samples."""
    margin = np.sqrt(1 / n_positive) + np.sqrt(1 / n_unlabelled)
    best = int(((u + margin / 2) / np.maximum(p, 1e-9)).argmin())
    return float(np.clip(u[best] / max(p[best], 1e-9), 0.02, 0.98))


def discriminator(positive: np.ndarray, unlabelled: np.ndarray, mean: np.ndarray, scale: np.ndarray, rng: np.random.Generator) -> tuple[Net, np.ndarray]:
    """A network that tells the two samples apart, trained on half of the positives, and which half that is."""
    net, half = Net(mean, scale, rng), rng.random(len(positive)) < 0.5
    half[:2] = [True, False][: len(half)]
    seen = positive[half]
    both, y = np.concatenate([seen, unlabelled]), np.repeat([1.0, 0.0], [len(seen), len(unlabelled)])
    weight = np.where(y == 1, 0.5 / len(seen), 0.5 / len(unlabelled)) * len(y)
    for _ in range(EPOCHS // 4):
        for i in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
            net.step((sigmoid(net.logit(both[i])) - y[i]) * weight[i] / max(1, len(i)))
    return net, half


def risk_step(net: Net, prior: float, zp: np.ndarray, loss_u: float) -> tuple[np.ndarray, bool]:
    """Gradient of the positive part by the logits of the positives, and whether the unlabelled part counts up."""
    n = len(zp)
    up = loss_u - prior * np.logaddexp(0, zp).mean() >= 0
    d_positive, d_negative = -prior * sigmoid(-zp) / n, -prior * sigmoid(zp) / n
    return (d_positive + d_negative if up else -d_negative), up


def start(positive: np.ndarray, unlabelled: np.ndarray, mean: np.ndarray, scale: np.ndarray, prior: float, rng: np.random.Generator) -> Net:
    """Stochastic steps down the non-negative risk of two samples."""
    net = Net(mean, scale, rng)
    for _ in range(EPOCHS):
        order = rng.permutation(len(unlabelled))
        for u in np.array_split(order, max(1, len(order) // BATCH)):
            p = rng.integers(0, len(positive), len(u))
            z = net.logit(np.concatenate([positive[p], unlabelled[u]]))
            d, up = risk_step(net, prior, z[: len(p)], float(np.logaddexp(0, z[len(p) :]).mean()))
            net.step(np.concatenate([d, (1 if up else -1) * sigmoid(z[len(p) :]) / len(u)]))
    return net


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return batch["m"].flatten().to_numpy().reshape(batch.num_rows, -1)


def _sums(table: DataFrame, of) -> np.ndarray:
    """The sum over all rows of ``table`` of the vectors that ``of`` makes of each batch: each task adds up its own, Spark the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = of(_rows(batch))
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total, pa.float64())], ["i", "x"])

    rows = table.select("m").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()  # one row a number
    return np.array([r.x for r in rows])


def train(positive: np.ndarray, sample: np.ndarray, table: DataFrame, seed: int = 0) -> tuple[Net, float]:
    """The network and the prior, from positives, a sample of the unlabelled table to start from, and all of the table."""
    rng, k = np.random.default_rng(seed), positive.shape[1]
    total = _sums(table, lambda x: np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)]))
    count = total[0]
    mean = total[1 : k + 1] / count
    scale = np.sqrt(np.maximum(0, total[k + 1 :] / count - mean**2)) + 1e-3
    first, half = discriminator(positive, sample, mean, scale, rng)
    held = first.logit(positive[~half] if (~half).any() else positive)
    cuts = np.quantile(held, CUTS)
    above = _sums(table, lambda x: (first.logit(x)[:, None] >= cuts).sum(0).astype(float))
    prior = class_prior(np.array([(held >= c).mean() for c in cuts]), above / count, len(held), int(count))
    net = start(positive, sample, mean, scale, prior, rng)
    for _ in range(PASSES):

        def gradient(x: np.ndarray, net=net) -> np.ndarray:
            z = net.logit(x)
            return np.concatenate([[np.logaddexp(0, z).sum()], *(g.ravel() for g in net.gradient(sigmoid(z)))])

        got = _sums(table, gradient) / count
        d, up = risk_step(net, prior, net.logit(positive), got[0])
        sizes = np.cumsum([w.size for w in net.w])[:-1]
        parts = [g.reshape(w.shape) for g, w in zip(np.split(got[1:], sizes), net.w, strict=True)]
        net.descend([(1 if up else -1) * g + p for g, p in zip(parts, net.gradient(d), strict=True)])
    return net, prior


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        m = measures(batch["text"])
        flat = pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), m.ravel())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], flat], ["doc_id", "m"])


def _few(table: DataFrame, ids: DataFrame, most: int) -> np.ndarray:
    """The measures of few ids, of rows that repeat an id of the first."""
    rows = table.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("m").alias("m")).orderBy("doc_id").limit(most).toArrow()
    return np.array(rows["m"].to_pylist(), float).reshape(rows.num_rows, N_CLASSES + 7)


def quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    first = [F.xxhash64("doc_id"), F.col("doc_id")]
    table = Tables(docs.sparkSession, "quality").keep(docs.mapInArrow(frugal(_measure), "doc_id long, m array<double>"), "measures")
    trusted = labels.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("y")).where(~held_out(F.col("doc_id"), 3, 1))
    trusted = trusted.groupBy("doc_id").agg(F.min("y").alias("y")).where("y = 1").select("doc_id").orderBy(*first).limit(rows)
    web = table.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit("web")), "doc_id").limit(rows)
    positive, sample = _few(table, trusted, rows), _few(table, web, rows)
    net = train(positive, sample, table)[0] if len(positive) > 1 and len(sample) else None
    shared = docs.sparkSession.sparkContext.broadcast(net and (net.mean, net.scale, net.w))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Net.of(*shared.value) if shared.value else None
        for batch in batches:
            s = sigmoid(net.logit(_rows(batch))) if net is not None and batch.num_rows else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(s, pa.float64())], ["doc_id", "score"])

    scored = table.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id"), 3, 1), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
