"""Token counts by count-only Viterbi over a unigram vocabulary; see :mod:`unigram`.

Aho-Corasick enumerates the pieces that end at each place; dynamic programming carries only the best
score and the piece count, in a window of the longest piece. A map over the documents without shuffle.

Defined results: null and empty texts count 0 tokens; a repeated row is counted like any other; a table
without rows gives none; only ``doc_id`` and ``text`` are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textkernel import frugal
from .unigram import MODEL, automaton, chunks, count_pieces, distinct, load


def token_counts(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, n_chunks (words with the spaces before them) of every whole text."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(load(model))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(vocabulary.value)
        for batch in batches:
            tokens, words = [], []
            for _, _, buf, starts, ends, at in chunks(batch["text"]):
                which, back = distinct(buf, starts, ends)
                number, _ = count_pieces(a, buf, starts[which], ends[which])
                total = np.append(0, np.cumsum(number[back]))
                tokens.append(np.diff(total[at]))
                words.append(np.diff(at))
            flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (tokens, words)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(x, pa.int64()) for x in flat)], ["doc_id", "n_tokens", "n_chunks"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(frugal(count), "doc_id long, n_tokens long, n_chunks long")
