"""SentencePiece encoding and decoding by streaming Viterbi; see :mod:`unigram`.

Ids are committed wherever all surviving paths meet. At the start of a run of spaces they always do, so these cut
a text into chunks that are solved side by side; within a chunk a window of the longest piece is kept, and ids are
committed up to the boundary where the paths of all its places meet (:func:`unigram.stream_encode`). A map over
the documents without shuffle; a task holds one slice of a batch (1 MB of text, or one longer text) besides the batch.

Defined results: a null text gives null ids and an empty one an empty list; decoding gives the text back
exactly, but for the space mark U+2581, which the vocabulary can't tell from a space; null ids give a null text;
repeated rows are encoded alike; ties go to the longest piece; a table without rows gives none; an input column
named like an output column is replaced, others are carried along.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import unigram
from .textkernel import frugal
from .unigram import MODEL, Vocabulary, automaton, byte_table, load

IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))


def _map(docs: DataFrame, model: str, fields: list[T.StructField], slices: Callable[[Vocabulary, pa.RecordBatch], Iterator[tuple]]) -> DataFrame:
    """The rows of ``docs`` with more columns, a record batch for each slice that ``slices`` yields."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(load(model))
    names = [f.name for f in fields]
    docs = docs.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, *columns in slices(vocabulary.value, batch):
                yield pa.RecordBatch.from_arrays([*batch.slice(first, end - first).columns, *columns], [*batch.schema.names, *names])

    return docs.mapInArrow(frugal(run), T.StructType([*docs.schema.fields, *fields]))


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """The rows of ``docs`` (with a ``text`` column) and their ``ids``."""
    return _map(docs, model, [IDS], lambda v, batch: unigram.encode(automaton(v), batch["text"]))


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """The rows of ``rows`` (with an ``ids`` column) and their ``decoded`` text."""
    return _map(rows, model, [T.StructField("decoded", T.StringType())], lambda v, batch: [(0, batch.num_rows, unigram.decode(byte_table(v), batch["ids"]))])


def transcode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """The rows of ``docs``, their ``ids``, and ``round_trip``: whether these, decoded, are the text (null for a null text
    is). Encoded and decoded slice by slice in one map, so no decoded text leaves a task."""

    def both(v: Vocabulary, batch: pa.RecordBatch) -> Iterator[tuple]:
        for first, end, ids in unigram.encode(automaton(v), batch["text"]):
            text, back = batch["text"].slice(first, end - first), unigram.decode(byte_table(v), ids)
            same = pc.or_(pc.fill_null(pc.equal(back, text.cast(pa.string())), False), pc.and_(back.is_null(), text.is_null()))
            yield first, end, ids, same

    return _map(docs, model, [IDS, T.StructField("round_trip", T.BooleanType())], both)
