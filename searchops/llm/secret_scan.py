"""Secret scans with a recursive decoding worklist.

Every whole text is scanned by the base patterns. Then each layer that can hide another one is unwrapped
- percent escapes, backslash-u escapes, base64 (both alphabets), and zlib, gzip or raw bytes inside it -
and put on a worklist, until nothing new comes out; a layer whose content was already seen on
the way to it is not taken again, so cycles end. Findings in a layer are mapped to the place in the
document: exactly for escapes, to the whole encoded run for base64 and compressed data. Bytes that are not UTF-8 stand for themselves, one
character a byte; a decoded layer that is not fully readable counts if any pattern matches in it.

A compressed layer of more than ``MAX_LAYER`` bytes is unzipped as a stream and scanned in overlapping blocks, so
that a hostile archive can't fill a task; encoded runs longer than the overlap are streams in it again. All
members of a gzip are read, and of a broken stream what comes out.

Defined results: a null text is the empty text; repeated rows are scanned alike; streams nested deeper than
``MAX_DEPTH`` (archives that hold themselves) are counted in ``n_refused``; a table without rows gives none; only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .textkernel import frugal

#: The kinds in the order in which they are listed, and their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4})+|(?:\\x[0-9A-Fa-f]{2})+|(?:\\u\{0*(?:10|[0-9A-Fa-f])?[0-9A-Fa-f]{1,4}\})+|(?:\\U00(?:10|0[0-9A-Fa-f])[0-9A-Fa-f]{4})+")
_CODES = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\U([0-9A-Fa-f]{8})")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Lines of base64, as mail and PEM wrap them.
LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+={0,2}(?![A-Za-z0-9+/_-]))+")
LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
MAX_LAYER = 16 << 20
BLOCK, OVERLAP, MAX_DEPTH = 4 << 20, 1 << 20, 64
_RUN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-\r\n"
_LEADING = re.compile(r"[A-Za-z0-9+/_\r\n-]*")
_TO_BASE64 = {ord("-"): "+", ord("_"): "/", ord("\r"): None, ord("\n"): None}

#: Texts without a match hold no finding of any layer (a superset of what each pattern needs).
_WORTH = r"(?i:passw(or)?d|secret|token|api_?key)|AKIA|[0-9a-f]{16}|%[0-9A-Fa-f]{2}|\\[ux][0-9A-Fa-f{]{2}|\\U00|[A-Za-z0-9+/_-]{16}"

Span = tuple[int, int, int]  # start, end, index of the kind


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches per kind; those that are too short are dropped afterwards."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), 2) for m in HEX_LONG.finditer(text)]
    return sorted(out)


class Layer:
    """A decoded text; place ``i`` of it stands for ``[starts[i], ends[i])`` of the document."""

    def __init__(self, text: str, places: list[tuple[int, int, int]]):
        self.text, self.places = text, places  # places: (from, start, end) of runs; exact where a run has one place for each character
        self.at = [p[0] for p in places]

    def span(self, start: int, end: int) -> tuple[int, int]:
        a, b = self._of(start), self._of(end - 1)
        return a[0], b[1]

    def _of(self, i: int) -> tuple[int, int]:
        k = bisect_right(self.at, i) - 1
        first, start, end = self.places[k]
        size = (self.at[k + 1] if k + 1 < len(self.at) else len(self.text)) - first
        return (start + i - first, start + i - first + 1) if size == end - start else (start, end)


def _unescaped(layer: Layer) -> Layer | None:
    """The layer with its percent and backslash runs decoded; None if nothing changes."""
    if "%" not in layer.text and "\\" not in layer.text:
        return None
    out, places, last, size = [], [], 0, 0

    def copy(a: int, b: int) -> None:
        nonlocal size
        i = a
        while i < b:  # split at the runs of the layer below, so that places stay exact
            k = bisect_right(layer.at, i) - 1
            stop = min(b, layer.at[k + 1] if k + 1 < len(layer.at) else b)
            places.append((size, *layer.span(i, stop)))
            size += stop - i
            i = stop
        out.append(layer.text[a:b])

    for m in ESCAPES.finditer(layer.text):
        run = m.group()
        if run[:2] == "\\U" or run[2] == "{":
            codes = [(c[1] or c[2], len(c[0])) for c in _CODES.finditer(run)]
            new, step = [chr(int(n, 16)) for n, _ in codes], [length for _, length in codes]
        elif run[:2] == "\\u":
            new = bytes.fromhex(run.replace("\\u", "")).decode("utf-16-be", "surrogatepass")
            step = [6 * (len(c.encode("utf-16-be", "surrogatepass")) // 2) for c in new]
        else:
            width = 3 if run[0] == "%" else 4
            new = bytes.fromhex(run.replace("%", "").replace("\\x", "")).decode(errors="surrogateescape")
            step = [width * len(c.encode(errors="surrogateescape")) for c in new]
            new = [chr(ord(c) - 0xDC00) if 0xDC80 <= ord(c) <= 0xDCFF else c for c in new]
        copy(last, m.start())
        at = m.start()
        for c, n in zip(new, step, strict=True):
            places.append((size, *layer.span(at, at + n)))
            out.append(c)
            size, at = size + 1, at + n
        last = m.end()
    if not out:
        return None
    copy(last, len(layer.text))
    return Layer("".join(out), places)


def _readable(data: bytes) -> str | None:
    """The bytes as text; of what is not fully readable only where a pattern matches."""
    for first, coding in ((1, "utf-16-le"), (0, "utf-16-be")):  # letters of two bytes, of which one is zero
        if len(data) > 7 and 4 * data[first::2].count(0) > len(data):
            return data.decode(coding, "replace").lstrip("\ufeff")
    try:
        text = data.decode()
        if not _CONTROL.search(text):
            return text or None
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    return text if base_spans(text) or BASE64.search(text) or ESCAPES.search(text) else None


def _zipped(data: bytes) -> bool:
    return data[:2] == b"\x1f\x8b" or (len(data) > 1 and data[0] & 0x0F == 8 and (data[0] * 256 + data[1]) % 31 == 0)


def _inflated(data: bytes) -> bytes | None:
    """Zlib or gzip content, of all members, up to MAX_LAYER bytes; None if it is neither; OverflowError beyond."""
    out, at = bytearray(), 0
    while _zipped(data[at : at + 2]):
        d = zlib.decompressobj(zlib.MAX_WBITS | 32)
        try:
            while at < len(data) and not d.eof:  # a broken stream gives what comes before the break
                part = data[at : at + (1 << 12)]
                out += d.decompress(part, MAX_LAYER + 1 - len(out))
                if len(out) > MAX_LAYER:
                    raise OverflowError
                at += len(part) - len(d.unused_data)
        except zlib.error:
            break
    return bytes(out) or None


def _opens(raw: str, at: int, window: int) -> bool:
    """Whether a compressed stream of a kind (zlib's ``wbits``) starts at a place of base64 characters. Its first bytes are read, then
    more: what only looks like one breaks off there."""
    for size in (128, 8192):
        part = raw[at : at + size]
        try:
            if not zlib.decompressobj(window).decompress(base64.b64decode(part + "=" * (-len(part) % 4))):
                return False
        except (zlib.error, binascii.Error):
            return False
    return True


def _taken(raw: str, at: int, window: int) -> int:
    """How many base64 characters from a place on the compressed streams there take; 128 if they break off, none if a bare deflate
    stream does, or a short one has no end."""
    d = zlib.decompressobj(window)
    for i in range(at, len(raw), 1 << 16):
        part = raw[i : i + (1 << 16)]
        data = base64.b64decode(part[: len(part) - (len(part) % 4 == 1)] + "=" * (-len(part) % 4 % 3))
        while data:
            try:
                d.decompress(data, 1 << 20)
            except zlib.error:
                return 128 if window > 0 else 0
            if not d.eof:
                data = d.unconsumed_tail
            elif window > 0 and _zipped(d.unused_data[:2]):
                data, d = d.unused_data, zlib.decompressobj(window)
            else:
                return i + len(part) - at - len(d.unused_data) * 4 // 3 if window > 0 or not d.unused_data else 0
    return len(raw) - at if window > 0 or len(raw) - at > 8192 else 0


def _deflated(data: bytes) -> bytes | None:
    """The content of a bare deflate stream that ends where the data ends, if it is text; OverflowError beyond MAX_LAYER bytes."""
    if len(data) < 16 or data[0] & 6 not in (2, 4):
        return None
    d = zlib.decompressobj(-zlib.MAX_WBITS)
    try:
        out = d.decompress(data, MAX_LAYER + 1)
    except zlib.error:
        return None
    if len(out) > MAX_LAYER:
        raise OverflowError
    return out if d.eof and not d.unused_data and not _CONTROL.search(out.decode("latin-1")) else None


class TextStream:
    """Kinds of secrets in a text that comes in pieces, and in all that is encoded in it."""

    def __init__(self, depth: int):
        self.depth, self.text, self.kinds, self.refused = depth, "", set(), 0
        self.run: RunStream | None = None

    def feed(self, text: str) -> None:
        if self.run:
            end = _LEADING.match(text).end()
            self.run.feed(text[:end])
            if end < len(text):
                self._end_run()
        self.text += text
        if len(self.text) >= BLOCK:
            self._scan()
            self._start_run()
            self.text = self.text[-OVERLAP:]

    def close(self) -> None:
        self._end_run()
        self._scan()

    def _scan(self) -> None:
        # spaces are as good as any number of them
        _, found, _, refused = scan(re.sub(" {64,}", " " * 64, self.text))
        self.kinds |= {k for _, _, k in found}
        self.refused += refused

    def _start_run(self) -> None:
        """A run that is longer than the overlap and has not ended is decoded as a stream of its own."""
        start = len(self.text.rstrip(_RUN))
        if self.run or start >= len(self.text) - OVERLAP:
            return
        lines = self.text[start:].split("\n")
        for line, after in zip(lines, lines[1:], strict=False):  # wrapped runs begin where lines are alike
            if len(line) >= 16 and len(after) >= len(line):
                break
            start += len(line) + 1
        if start < len(self.text) - OVERLAP:
            self.run = RunStream(self.depth + 1)
            self.run.feed(self.text[start:])

    def _end_run(self) -> None:
        if self.run:
            self.run.close()
            self.kinds |= self.run.bytes.kinds
            self.refused += self.run.bytes.refused
            self.run = None


class RunStream:
    """A base64 run that comes in pieces."""

    def __init__(self, depth: int):
        self.rest, self.bytes = "", ByteStream(depth)

    def feed(self, text: str) -> None:
        text = self.rest + text.translate(_TO_BASE64)
        cut = len(text) // 4 * 4
        self.rest = text[cut:]
        self.bytes.feed(base64.b64decode(text[:cut]))

    def close(self) -> None:
        if len(self.rest) > 1:
            self.bytes.feed(base64.b64decode(self.rest + "=" * (-len(self.rest) % 4)))
        self.bytes.close()


class ByteStream:
    """Bytes that come in pieces: unzipped, as often as they are zipped, or taken as text.

    All patterns are ASCII and the places within a layer don't matter, so one character a byte will do.
    """

    def __init__(self, depth: int):
        self.depth, self.head, self.kinds, self.refused = depth, b"", set(), int(depth > MAX_DEPTH)
        self.inner: ByteStream | TextStream | None = None
        self.d = None

    def feed(self, data: bytes) -> None:
        while data and self.depth <= MAX_DEPTH:
            data = self._member(data)

    def _member(self, data: bytes) -> bytes:
        """Takes the bytes up to the end of a zipped member, or all; what follows."""
        if self.inner is None or (self.d and self.d.eof):
            data, self.head = self.head + data, b""
            if len(data) < 2:
                self.head = data
                return b""
            if _zipped(data[:2]):
                self.d = zlib.decompressobj(zlib.MAX_WBITS | 32)
                self.inner = self.inner or ByteStream(self.depth + 1)
            else:
                self.inner, self.d = self.inner or TextStream(self.depth), None
        if not self.d:
            for i in range(0, len(data), 1 << 20):
                self._inward(data[i : i + (1 << 20)])
            return b""
        for i in range(0, len(data), 1 << 12):
            rest = data[i : i + (1 << 12)]
            while True:
                try:
                    out = self.d.decompress(rest, 1 << 20)
                except zlib.error:  # no stream, or broken: the rest as it is
                    self.d, self.inner = None, self.inner if self._begun() else TextStream(self.depth)
                    return rest + data[i + (1 << 12) :]
                if out:
                    self._inward(out)
                rest = self.d.unconsumed_tail
                if self.d.eof:
                    return self.d.unused_data + data[i + (1 << 12) :]
                if not rest and len(out) < 1 << 20:
                    break
        return b""

    def _begun(self) -> bool:
        return bool(self.inner.inner or self.inner.head or self.inner.depth > MAX_DEPTH)

    def _inward(self, data: bytes) -> None:
        self.inner.feed(data if isinstance(self.inner, ByteStream) else data.decode("latin-1"))

    def close(self) -> None:
        if self.inner is None and self.head:
            self.inner = TextStream(self.depth)
            self._inward(self.head)
        if self.inner:
            self.inner.close()
            self.kinds |= self.inner.kinds
            self.refused += self.inner.refused


#: How zlib and gzip streams begin in base64, and what separates a name or path from the run behind it.
_ZIP = re.compile("H4sI|e[AFJN]")
_BORDER = re.compile("[/_-]")


def _starts(run: str, raw: str) -> Iterator[int]:
    """Where a run's payload may begin behind a name or path: text is found at each of the four alignments, compressed data only at its
    very start. What lies inside a stream is not looked at again."""
    places = [(m.start(), zlib.MAX_WBITS | 32) for m in _ZIP.finditer(raw)] + [(m.end(), -zlib.MAX_WBITS) for m in _BORDER.finditer(run)]
    behind, opened = 0, {0, 1, 2, 3}
    for at, window in sorted(places):
        if at >= behind and len(raw) - at >= 16 and _opens(raw, at, window):
            behind = at + _taken(raw, at, window)
            if at == 0 and behind >= len(raw) - 4:
                opened = {0}
                break
            opened.add(at)
    yield from sorted(opened)


def _parts(start: int, end: int, run: str) -> Iterator[tuple[int, int, str]]:
    raw = run.rstrip("=").translate(_PLAIN)
    for k in _starts(run, raw):
        part = raw[k:]
        if len(part) >= 16:
            yield start + k, end, part[: len(part) - (len(part) % 4 == 1)]


_PLAIN = str.maketrans("-_", "+/")


def _runs(text: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and base64 characters of the runs, and of the lines that make one wrapped run."""
    for m in BASE64.finditer(text):
        yield from _parts(m.start(), m.end(), m.group())
    for m in LINES.finditer(text) if "\n" in text else ():
        lines = [(x.start(), x.end(), x.group()) for x in LINE.finditer(text, m.start(), m.end())]
        i = 0
        while i + 1 < len(lines):
            width, j = max(len(lines[i][2]), len(lines[i + 1][2])), i + 1  # the first may be short behind a name
            while len(lines[i][2]) >= 16 and j < len(lines) and lines[j - 1][2][-1] != "=" and len(lines[j][2]) <= width:
                j += 1
                if len(lines[j - 1][2]) < width:
                    break
            if j - i > 1:
                yield from _parts(lines[i][0], lines[j - 1][1], "".join(x[2] for x in lines[i:j]))
            i = max(i + 1, j if j - i > 1 else 0)


def _wrapped(layer: Layer) -> Iterator[Layer | tuple[tuple[int, int], ByteStream]]:
    """What the base64 runs of a layer hold, unzipped until readable text comes out; a stream if it is large."""
    for start, end, raw in _runs(layer.text):
        try:
            data = base64.b64decode(raw + "=" * (-len(raw) % 4), validate=True)
        except binascii.Error:
            continue
        try:
            below = {data}
            while (more := _inflated(data) or _deflated(data)) is not None and more not in below:
                below.add(data := more)
        except OverflowError:
            stream = ByteStream(0)
            stream.feed(data)
            stream.close()
            yield layer.span(start, end), stream
            continue
        if (text := _readable(data)) is not None:
            yield Layer(text, [(0, *layer.span(start, end))])


def scan(text: str) -> tuple[list[Span], list[Span], int, int]:
    """Base spans, all spans, decoded layers, refused layers of one text."""
    base = base_spans(text)
    found, layers, refused = set(base), 0, 0
    first = Layer(text, [(0, 0, len(text))])
    work, seen = [first], {text}
    while work:
        layer = work.pop()
        if layer is not first:
            layers += 1
            found |= {(*layer.span(a, b), k) for a, b, k in base_spans(layer.text)}
        new = [x] if (x := _unescaped(layer)) else []
        for x in _wrapped(layer):
            if isinstance(x, Layer):
                new.append(x)
            else:
                place, stream = x
                layers, refused = layers + 1, refused + stream.refused
                found |= {(*place, k) for k in stream.kinds}
        for x in new:
            key = x.text if x.places[0][1:] == (0, len(text)) else (x.text, x.places[0][1:])
            if key not in seen:
                seen.add(key)
                work.append(x)
    return base, sorted(found), layers, refused


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


SCHEMA = "doc_id long, base array<struct<kind:string,start:int,end:int>>, all array<struct<kind:string,start:int,end:int>>, n_layers int, n_refused int"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    rows = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1]))]
    for batch in batches:
        worth = pc.fill_null(pc.match_substring_regex(batch["text"], _WORTH), False)
        out = [([], [], 0, 0)] * batch.num_rows
        for i in pc.indices_nonzero(worth).to_pylist():
            out[i] = scan(batch["text"][i].as_py())
        cols = [pa.array([rows(x[0]) for x in out], kind), pa.array([rows(x[1]) for x in out], kind), pa.array([x[2] for x in out], pa.int32()), pa.array([x[3] for x in out], pa.int32())]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *cols], ["doc_id", "base", "all", "n_layers", "n_refused"])


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base and all spans (kind, start, end in code points), n_layers, n_refused: one row per document."""
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(frugal(_scan), SCHEMA)


def sha256_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
