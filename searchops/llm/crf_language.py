"""Language ID with a linear-chain conditional random field over words.

Each word of a text is labelled with a language. Emissions sum hashed features of the word: itself (a
learned lexicon), its prefixes, suffixes and n-grams; transitions between languages are learned with them, on
sequences joined from pieces of texts of different languages, so that switches are seen. Labels come from
forward-backward: the posterior of each word. A text's language is the one with the largest mean posterior,
which is its score; the means of the others tell how far it is code-switched.

Training runs on the driver on ``PIECES`` pieces of ``PIECE`` words of each of at most ``TRAIN_ROWS`` documents with a language
and ``TRAIN_BYTES`` in all (documented bounds), of all languages alike many as far as there are, so a rare one is learned too;
tasks cut the pieces. Labelling is a map over all whole texts.

Defined results: a null text or one without a letter is ``und`` with score 0; words are runs of letters, so a
text whose letters the word rule misses gets the even posterior; ties go to the first language by name; of several texts or
languages of one id the smallest is learned from; repeated rows
are labelled alike; without labelled rows every text is ``und``; a table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .samples import first_of_each, texts_of
from .scratch import Tables
from .subword_toxicity import held_out, padded
from .textkernel import LETTER, LOWER, SpanHasher, frugal, slices, spans

BUCKETS = 1 << 17
TRAIN_ROWS, TRAIN_BYTES, PIECES, PIECE, EPOCHS, RATE, BATCH = 3000, 8 << 20, 3, 24, 3, 0.25, 64
SLICE = 1 << 20
UNKNOWN = "und"


def word_features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hasher: SpanHasher) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, buckets) of each kind of feature."""
    size = ends - starts
    every = np.arange(len(starts))
    fold = lambda h: (h & np.uint64(BUCKETS - 1)).astype(np.int64)
    yield every, fold(hasher(starts, ends, 1))
    for k in (1, 2, 3):
        w = every[size >= k]
        yield w, fold(hasher(starts[w], starts[w] + k, 10 + k))
    for k in (1, 2, 3, 4):
        w = every[size >= k]
        yield w, fold(hasher(ends[w] - k, ends[w], 20 + k))
    for k in (2, 3):
        for j in range(1, int(size.max(initial=0)) - k):
            w = every[size > j + k]  # inner n-grams; those at the ends are affixes
            yield w, fold(hasher(starts[w] + j, starts[w] + j + k, 30 + k))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (BUCKETS, languages)
    transitions: np.ndarray
    start: np.ndarray

    def emissions(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Scores of each word for each language; each distinct word of the slice is scored once."""
        hasher = SpanHasher(buf)
        _, first, back = np.unique(hasher(starts, ends), return_index=True, return_inverse=True)
        s, e = starts[first], ends[first]
        out = np.zeros((len(first), len(self.languages)), np.float32)
        for words, bucket in word_features(buf, s, e, hasher):
            if len(words) == len(out):
                out += self.weights[bucket]
            else:
                out[words] += self.weights[bucket]
        return out[back]


def forward_backward(emissions: np.ndarray, mask: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of (sequence, place, label), and expected transition counts; masked places stand at the ends."""
    n, size, k = emissions.shape
    e = np.exp(emissions - emissions.max(2, keepdims=True))
    a = np.exp(transitions)
    alpha, beta = np.empty_like(e), np.empty_like(e)
    x = e[:, 0] * np.exp(start)
    alpha[:, 0] = x / x.sum(1, keepdims=True)
    for t in range(1, size):
        x = (alpha[:, t - 1] @ a) * e[:, t]
        x /= x.sum(1, keepdims=True)
        alpha[:, t] = x
    beta[:, -1] = 1
    for t in range(size - 2, -1, -1):
        x = (beta[:, t + 1] * e[:, t + 1]) @ a.T
        x /= x.sum(1, keepdims=True)
        beta[:, t] = np.where(mask[:, t + 1, None], x, 1)
    post = alpha * beta
    post /= post.sum(2, keepdims=True)
    pair = alpha[:, :-1, :, None] * a * (beta * e)[:, 1:, None, :] if size > 1 else np.zeros((n, 0, k, k), e.dtype)
    pair /= np.maximum(pair.sum((2, 3), keepdims=True), 1e-30)
    return post, (pair * mask[:, 1:, None, None]).sum((0, 1))


def posteriors(emissions: np.ndarray, size: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> np.ndarray:
    """As forward_backward, without the pair counts, for chains of falling ``size`` side by side: emissions hold
    all first words, then all second words, and so on."""
    live = (np.searchsorted(-size, -np.arange(int(size[0])), "left") if len(size) else np.zeros(0, np.int64)).tolist()
    first = np.cumsum([0, *live]).tolist()
    e = np.exp(emissions - emissions.max(1, keepdims=True)).astype(np.float32)
    a = np.exp(transitions).astype(np.float32)
    back, ones = np.ascontiguousarray(a.T), np.ones((len(transitions), 1), np.float32)
    alpha = np.empty_like(e)
    x = e[: len(size)] * np.exp(start).astype(np.float32)
    for t, n in enumerate(live):
        if t:
            x = (x[:n] @ a) * e[first[t] : first[t] + n]
        x /= x @ ones
        alpha[first[t] : first[t] + n] = x
    x = np.zeros((0, e.shape[1]), np.float32)
    for t in range(len(live) - 1, -1, -1):
        n, m = live[t], len(x)
        y = np.ones((n, e.shape[1]), np.float32)
        if m:
            z = (x * e[first[t + 1] : first[t + 1] + m]) @ back
            y[:m] = z / (z @ ones)
        x = y
        alpha[first[t] : first[t] + n] *= x
    return alpha / alpha.sum(1, keepdims=True)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of at most PIECE words of the sampled texts, PIECES of each at most, at places drawn by the document's id."""
    for batch in batches:
        ids, langs, pieces = [], [], []
        for a, _, raw, off in slices(padded(batch["text"]), SLICE):
            starts, ends, at = spans(raw, off, LETTER)
            for i in range(len(at) - 1):
                n, doc = int(at[i + 1] - at[i]), batch["doc_id"][a + i].as_py()
                rng = np.random.default_rng(doc & (2**63 - 1))
                for k in sorted({int(x) for x in rng.integers(0, max(1, n - PIECE), PIECES)}) if n else ():
                    first, last = at[i] + k, min(at[i] + k + PIECE, at[i + 1]) - 1
                    ids.append(doc)
                    langs.append(batch["lang"][a + i].as_py())
                    pieces.append(raw[starts[first] : ends[last]].tobytes().decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(pieces, pa.string())], ["doc_id", "lang", "text"])


def train(texts: list[str], langs: list[str], seed: int = 0) -> Model:
    """Stochastic gradient ascent (AdaGrad) on the log-likelihood of short pieces, one to three of them joined to a sequence."""
    languages = sorted(set(langs))
    k = len(languages)
    rng = np.random.default_rng(seed)
    pieces: list[tuple[int, np.ndarray]] = []  # language, (words, features) bucket table
    for a, _, raw, off in slices(padded(pa.array(texts, pa.large_string())), SLICE):
        buf = LOWER[raw]
        starts, ends, at = spans(buf, off, LETTER)
        feats = list(word_features(buf, starts, ends, SpanHasher(buf)))
        word, bucket = (np.concatenate([f[i] for f in feats]).astype(np.int32) for i in (0, 1))
        order = np.argsort(word, kind="stable")
        word, bucket = word[order], bucket[order]
        edge = np.searchsorted(word, at)
        pieces += [(languages.index(langs[a + i]), np.stack([word[x:y] - at[i], bucket[x:y]])) for i, (x, y) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if y > x]
    weights, trans, start = np.zeros((BUCKETS, k), np.float32), np.zeros((k, k)), np.zeros(k)
    g_w, g_t, g_s = np.full((BUCKETS, k), 1e-3, np.float32), np.full((k, k), 1e-3), np.full(k, 1e-3)
    for _ in range(EPOCHS):
        order = rng.permutation(len(pieces))
        at = 0
        while at < len(order):
            seqs = []
            while len(seqs) < BATCH and at < len(order):
                m = int(rng.integers(1, 4))
                seqs.append([pieces[i] for i in order[at : at + m]])
                at += m
            sizes = [[int(f[0].max(initial=-1)) + 1 for _, f in s] for s in seqs]
            width = max(1, max(map(sum, sizes)))
            place, bucket = [], []
            gold, mask = np.zeros((len(seqs), width), np.int64), np.zeros((len(seqs), width), bool)
            for r, (s, z) in enumerate(zip(seqs, sizes, strict=True)):
                o = 0
                for (y, f), n in zip(s, z, strict=True):
                    gold[r, o : o + n], mask[r, o : o + n] = y, True
                    place.append(f[0] + o + r * width)
                    bucket.append(f[1])
                    o += n
            place, bucket = np.concatenate(place), np.concatenate(bucket)
            em = np.zeros((len(seqs) * width, k))
            np.add.at(em, place, weights[bucket])
            post, pairs = forward_backward(em.reshape(len(seqs), width, k), mask, trans, start)
            delta = -post
            np.put_along_axis(delta, gold[..., None], np.take_along_axis(delta, gold[..., None], 2) + 1, 2)
            delta *= mask[..., None]
            rows, back = np.unique(bucket, return_inverse=True)
            grad = np.zeros((len(rows), k))
            np.add.at(grad, back, delta.reshape(-1, k)[place])
            g_w[rows] += grad**2
            weights[rows] += RATE * grad / np.sqrt(g_w[rows])
            seen = np.zeros((k, k))
            both = mask[:, 1:] & mask[:, :-1]
            np.add.at(seen, (gold[:, :-1][both], gold[:, 1:][both]), 1)
            d = seen - pairs
            g_t += d**2
            trans += RATE * d / np.sqrt(g_t)
            d = delta[:, 0].sum(0)
            g_s += d**2
            start += RATE * d / np.sqrt(g_s)
    return Model(languages, weights, trans, start)


def label_words(model: Model, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of every word of a slice, and the offsets of the rows into the words."""
    buf = LOWER[raw]
    starts, ends, at = spans(buf, off, LETTER)
    em = model.emissions(buf, starts, ends)
    size = np.diff(at)
    rows = np.argsort(-size, kind="stable")
    rows = rows[size[rows] > 0]
    n = size[rows]
    before = np.repeat(np.cumsum(n) - n, n)
    place = np.arange(len(em)) - before
    turn = np.argsort(place, kind="stable")
    word = (place + np.repeat(at[rows], n))[turn]
    out = np.empty_like(em)
    out[word] = posteriors(em[word], n, model.transitions, model.start)
    return out, at


def _model(docs: DataFrame, rows: int) -> Model | None:
    """The model of a bounded sample, of all languages alike many documents as far as there are; tasks cut the pieces."""
    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string")).where("doc_id is not null and text is not null and lang is not null")
    known = keyed.where(~held_out(F.col("doc_id"), 4, 2)).groupBy("doc_id").agg(F.min("lang").alias("lang"))
    sample = texts_of(keyed, first_of_each(known, "lang", rows), TRAIN_BYTES, Tables(docs.sparkSession, "language"))
    cut = sample.select("doc_id", "lang", "text").mapInArrow(frugal(_cut), "doc_id long, lang string, text string").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return train(cut["text"].to_pylist(), cut["lang"].to_pylist()) if cut.num_rows else None


def with_language(docs: DataFrame, rows: int = TRAIN_ROWS, suffix: str = "") -> DataFrame:
    """The rows of ``docs`` with lang_pred, lang_score and lang_shares (mean posterior of each language; null
    for a text without a letter), the names with ``suffix``; input columns of these names are replaced."""
    names = [name + suffix for name in ("lang_pred", "lang_score", "lang_shares")]
    shared = docs.sparkSession.sparkContext.broadcast(_model(docs, rows))
    docs = docs.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            letters = pc.fill_null(pc.match_substring_regex(batch["text"], r"\p{L}"), False).to_numpy(zero_copy_only=False)
            pred, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            shares = [[] if x else None for x in letters]
            for a, b, raw, off in slices(padded(batch["text"]), SLICE) if model else ():
                post, at = label_words(model, raw, off)
                n, k = np.diff(at), len(model.languages)
                total = np.concatenate([np.zeros((1, k)), np.cumsum(post, 0, dtype=np.float64)])
                mean = np.where(n[:, None] > 0, (total[at[1:]] - total[at[:-1]]) / np.maximum(n, 1)[:, None], 1 / k)
                best = mean.argmax(1)
                for i in np.flatnonzero(letters[a:b]):
                    pred[a + i], score[a + i] = model.languages[best[i]], min(1.0, float(mean[i, best[i]]))
                    shares[a + i] = list(zip(model.languages, mean[i].tolist(), strict=True))
            cols = [pa.array(pred, pa.string()), pa.array(score), pa.array(shares, pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, *names])

    kinds = (T.StringType(), T.DoubleType(), T.MapType(T.StringType(), T.DoubleType()))
    return docs.mapInArrow(frugal(run), T.StructType([*docs.schema.fields, *map(T.StructField, names, kinds)]))


def languages(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, shares: one row per document."""
    doc_id = F.col("doc_id")
    out = with_language(docs.select(doc_id.cast("long"), "text", F.col("lang").cast("string")), rows)
    return out.select("doc_id", F.coalesce(held_out(doc_id, 4, 2), F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_shares").alias("shares"))
