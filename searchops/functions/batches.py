"""Arrow batches in slices, so that a Python worker holds one slice's objects and not those of a whole batch."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Rows, and bytes of text but for a single longer text, of a slice; and the bytes of text after which freed memory goes back to the system.
ROWS, BYTES, TRIM = 256, 1 << 20, 1 << 24


def give_back() -> None:
    """Return freed memory to the system, which Arrow's pool and the C heap of a worker that lives on would keep."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def sliced(texts: pa.Array, read: Callable[[list[str | None]], pa.Array]) -> Iterator[pa.Array]:
    """``read`` of the texts, slice by slice in their order."""
    at = held = since = 0
    n = len(texts)
    for k in range(n):
        size = len(texts[k].as_buffer()) if texts[k].is_valid else 0
        if k > at and (held + size > BYTES or k - at >= ROWS):
            yield read(texts.slice(at, k - at).to_pylist())
            at, held, since = k, 0, since + held
            if since > TRIM:
                give_back()
                since = 0
        held += size
    yield read(texts.slice(at).to_pylist())
    give_back()
