"""Vectorised byte-level text helpers that run inside Spark tasks.

A batch of texts is one ``uint8`` buffer with document offsets (Arrow's own layout), so
words, word hashes and shingle sets of a whole batch come from a few numpy passes.
Memory follows the batch: callers walk :func:`slices`, which cuts an Arrow batch into
pieces of about ``SLICE_BYTES`` (a longer text is a piece of its own).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def give_back() -> None:
    """Return freed memory to the system: Arrow's pool and the C heap keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over Arrow batches whose worker, which lives on through other stages, keeps no freed memory."""

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batches):
            yield out
            give_back()
        give_back()

    return call


def _table(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64)


BYTE_CODES = _table(11, 256)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``_BASE**i`` and its inverse for i < n, modulo 2**64; grown once per worker."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, SLICE_BYTES + (SLICE_BYTES >> 2))
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry boolean table that is true on the given inclusive byte ranges."""
    t = np.zeros(256, bool)
    for a, b in ranges:
        t[a : b + 1] = True
    return t


#: Bytes outside space and the controls 9 to 13.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: ASCII letters and digits, and every byte of a non-ASCII character.
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: ASCII letters and every byte of a non-ASCII character.
LETTER = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the n+1 offsets into them; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    if not len(off):
        off = np.zeros(1, np.int64)
    return data[off[0] : off[-1]], off - off[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into (first row, end row, bytes, offsets) pieces of about ``limit`` bytes."""
    data, off = buffers(texts)
    n, a = len(off) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def spans(buf: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` bytes that stay in one document, and the
    n+1 offsets of the documents into these runs."""
    m = inside[buf]
    if not len(m):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    edge = off[(off > 0) & (off < len(m))]
    before = np.empty_like(m)
    before[0], before[1:] = False, m[:-1]
    before[edge] = False
    after = np.empty_like(m)
    after[-1], after[:-1] = False, m[1:]
    after[edge - 1] = False
    starts = np.flatnonzero(m & ~before)
    return starts, np.flatnonzero(m & ~after) + 1, np.searchsorted(starts, off)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each byte span, from one prefix sum over the buffer."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(buf) + 1)
    total = np.empty(len(buf) + 1, np.uint64)
    total[0] = 0
    np.cumsum(BYTE_CODES[buf] * up[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_STEP = _table(12, 64) | np.uint64(1)


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Distinct hashes of the k-word shingles, sorted; fewer words make one shingle of all of them."""
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    if n >= k:
        width = k
    total = np.full(n - width + 1, _STEP[width], np.uint64)
    for j in range(width):
        total = total * _STEP[32 + j] + words[j : n - width + 1 + j] * _STEP[j]
        total ^= total >> np.uint64(29)
    return np.unique(mix(total))


def shingle_sets(texts: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """For each text, lower-cased on A-Z, its set of k-word shingle hashes."""
    for _, _, raw, off in slices(texts):
        buf = LOWER[raw]
        starts, ends, at = spans(buf, off, NOT_SPACE)
        words = span_hashes(buf, starts, ends)
        for i in range(len(at) - 1):
            yield shingle_hashes(words[at[i] : at[i + 1]], k)


class SpanHasher:
    """Hashes of any spans of one buffer, from a prefix sum that is made once."""

    def __init__(self, buf: np.ndarray):
        up, self.down = _powers(len(buf) + 1)
        self.total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(BYTE_CODES[buf] * up[: len(buf)], out=self.total[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
        h = (self.total[ends] - self.total[starts]) * self.down[starts]
        return mix(h + (ends - starts).astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 & _MASK))
