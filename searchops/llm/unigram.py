"""Unigram segmentation over a public SentencePiece vocabulary.

The vocabulary file is read as a unigram model: each piece has the file's score, a text's pieces are
those of the highest total score, and characters that no piece covers cost ten less than the lowest
score and fall back to bytes. Ties follow the tokenizer's rule: a later start never replaces an equal
score, so the longest piece ending at a place wins. Scores are summed in float64 without rounding.

No piece holds a space mark after another character (:func:`load` checks it), so every surviving
path meets at the start of a run of spaces: those places cut a text into *chunks* that are solved
once per slice and distinct chunk, all chunks side by side.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textkernel import buffers, slices, span_hashes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE_MARK = "▁"
UNKNOWN_PENALTY = 10.0
SLICE = 1 << 20
PLACES = 1 << 19  # open places of chunks that are solved side by side


class Vocabulary:
    """Pieces (a space for the mark), their ids and scores; small enough to send to every task."""

    def __init__(self, pieces: list[bytes], ids: list[int], scores: list[float], byte_ids: list[int], size: int):
        self.pieces, self.ids, self.scores, self.byte_ids, self.size = pieces, ids, scores, byte_ids, size
        self.unknown = min(scores, default=0.0) - UNKNOWN_PENALTY

    def key(self) -> tuple:
        return self.size, len(self.pieces), hash(tuple(self.pieces)), hash(tuple(self.scores))


def load(path: str = MODEL) -> Vocabulary:
    """Read the normal pieces and byte pieces of a SentencePiece model file (on the driver)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    special = [sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
    ids = [i for i in range(n) if not special[i]]
    pieces = [sp.id_to_piece(i).replace(SPACE_MARK, " ").encode() for i in ids]
    if any(b" " in p.lstrip(b" ") for p in pieces):
        raise ValueError("a piece spans the start of a word: chunks are not independent")
    byte_ids = [0] * 256
    for i in range(n):
        if sp.is_byte(i):
            byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
    return Vocabulary(pieces, ids, [float(sp.get_score(i)) for i in ids], byte_ids, n)


class Automaton:
    """Aho-Corasick over the pieces' bytes, with dense transitions on the bytes that occur."""

    def __init__(self, v: Vocabulary):
        children: list[dict[int, int]] = [{}]
        own: dict[int, int] = {}
        for k, piece in enumerate(v.pieces):
            at = 0
            for b in piece:
                nxt = children[at].get(b)
                if nxt is None:
                    nxt = children[at][b] = len(children)
                    children.append({})
                at = nxt
            own.setdefault(at, k)
        used = sorted({b for p in v.pieces for b in p})
        self.classes = np.zeros(256, np.int32)
        self.classes[used] = np.arange(1, len(used) + 1)
        self.next = np.zeros((len(children), len(used) + 1), np.uint16 if len(children) <= 1 << 16 else np.int32)
        fail, outs = [0] * len(children), [[] for _ in children]
        queue = deque([0])
        while queue:
            s = queue.popleft()
            if s:
                self.next[s] = self.next[fail[s]]
                outs[s] = ([own[s]] if s in own else []) + outs[fail[s]]
            for b, c in children[s].items():
                k = self.classes[b]
                fail[c] = int(self.next[s, k]) if s else 0
                self.next[s, k] = c
                queue.append(c)
        self.most = max(map(len, outs))
        lengths, scores = np.array([len(p) for p in v.pieces]), np.array(v.scores)
        self.count = np.array([len(o) for o in outs], np.int32)
        self.out = np.zeros((len(children), self.most), np.int32)
        for s, o in enumerate(outs):
            self.out[s, : len(o)] = o
        self.length, self.score, self.ids = lengths, scores, np.array(v.ids, np.int32)
        self.window = int(lengths.max(initial=1))
        self.byte_ids = np.array(v.byte_ids, np.int32)
        self.unknown = v.unknown


_built: dict[type, tuple] = {}


def _once(kind: type, v: Vocabulary):
    """Built once in each Python worker; the last one is held."""
    if kind not in _built or _built[kind][0] != v.key():
        _built[kind] = v.key(), kind(v)
    return _built[kind][1]


def automaton(v: Vocabulary) -> Automaton:
    return _once(Automaton, v)


def byte_table(v: Vocabulary) -> "ByteTable":
    return _once(ByteTable, v)


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, chunk starts, chunk ends, offsets of rows into the chunks).

    A non-empty text gets one space in front, and the space mark counts as a space. Rows are cut into slices first, so that
    only a slice is copied.
    """
    for a, b, _, _ in slices(texts, SLICE):
        some = pc.replace_substring(texts.slice(a, b - a).cast(pa.large_string()).fill_null(""), SPACE_MARK, " ")
        some = pc.if_else(pc.equal(some, ""), some, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), some, pa.scalar("", pa.large_string())))
        buf, off = buffers(some)
        space = buf == 32
        head = space.copy()
        head[1:] &= ~space[:-1]
        head[off[:-1][off[:-1] < off[1:]]] = True
        starts = np.flatnonzero(head)
        ends = np.append(starts[1:], len(buf)) if len(starts) else starts
        yield a, b, buf, starts, ends, np.searchsorted(starts, off)


def distinct(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of one chunk of each kind, longest first, and each chunk's place among these."""
    _, first, back = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
    order = np.argsort(starts[first] - ends[first], kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return first[order], rank[back]


def _advance(a: Automaton, buf, starts, t, state, head):
    """One byte of every live chunk: its state, where its last character began, whether that ended."""
    at = starts + t
    byte = buf[at]
    state = a.next[state, a.classes[byte]]
    head = np.where((byte & 0xC0) != 0x80, t, head)
    return at, state, head


def count_pieces(a: Automaton, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece counts and best scores of chunks ordered by falling length.

    Count-only Viterbi: the window holds, for the last ``a.window`` places, the best score and its
    piece count; no back pointers exist.
    """
    n, size = len(starts), ends - starts
    width = max(a.window, 4) + 1
    best, count = np.full((n, width), -np.inf), np.zeros((n, width), np.int64)
    best[:, 0] = 0
    state, head = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for t in range(int(size[0]) if n else 0):
        live = n if t == 0 else int(np.searchsorted(-size, -t, "left"))
        at, s, h = _advance(a, buf, starts[:live], t, state[:live], head[:live])
        state[:live], head[:live] = s, h
        top, number = np.full(live, -np.inf), np.zeros(live, np.int64)
        single = np.zeros(live, bool)
        most = a.count[s]
        for j in range(int(most.max(initial=0))):
            rows = np.flatnonzero(most > j)
            piece = a.out[s[rows], j]
            back = t + 1 - a.length[piece]
            single[rows] |= back == h[rows]
            score = best[rows, back % width] + a.score[piece]
            better = score > top[rows]
            rows, back = rows[better], back[better]
            top[rows] = score[better]
            number[rows] = count[rows, back % width] + 1
        last = at + 1
        ended = (last >= ends[:live]) | ((buf[np.minimum(last, len(buf) - 1)] & 0xC0) != 0x80)
        rows = np.flatnonzero(ended & ~single)
        if len(rows):
            score = best[rows, h[rows] % width] + a.unknown
            better = score > top[rows]
            rows = rows[better]
            top[rows] = score[better]
            number[rows] = count[rows, h[rows] % width] + (t + 1 - h[rows])
        best[:live, (t + 1) % width], count[:live, (t + 1) % width] = top, number
    rows = np.arange(n)
    return count[rows, size % width], best[rows, size % width]


class _Region:
    """The open places of chunks side by side: the place reached, its best score, piece, step back and number of ids.

    Column ``lead + p - base`` of a row is place ``p`` of its chunk; ``base`` is the boundary up to which ids are committed.
    The ``lead`` columns in front stand for places before it, from which nothing more can start.
    """

    def __init__(self, n: int, lead: int, width: int):
        self.lead, self.base = lead, np.zeros(n, np.int64)
        self.best = np.full((n, lead + width + 1), -np.inf)
        self.piece = np.full(self.best.shape, -1, np.int32)
        self.back, self.count = np.zeros(self.best.shape, np.int16), np.zeros(self.best.shape, np.int32)
        self.best[:, lead] = 0

    def grow(self) -> None:
        more = ((0, 0), (0, self.best.shape[1]))
        self.best = np.pad(self.best, more, constant_values=-np.inf)
        self.piece, self.back, self.count = np.pad(self.piece, more, constant_values=-1), np.pad(self.back, more), np.pad(self.count, more)

    def boundary(self, rows: np.ndarray, t: int, window: int) -> np.ndarray:
        """The column at which the best paths of all places met that a piece can still start from, after ``t`` bytes."""
        columns = np.arange(self.best.shape[1])
        end = self.lead + t - self.base[rows]
        live = (self.best[rows] > -np.inf) & (columns > (end - window)[:, None]) & (columns <= end[:, None])
        while len(many := np.flatnonzero(live.sum(1) > 1)):
            last = live.shape[1] - 1 - live[many, ::-1].argmax(1)
            live[many, last] = False
            live[many, last - self.back[rows[many], last]] = True
        return live.argmax(1)

    def shift(self, rows: np.ndarray, column: np.ndarray) -> None:
        """Forget what lies before the column of each row."""
        by = column - self.lead
        take = np.arange(self.best.shape[1]) + by[:, None]
        out = take >= self.best.shape[1]
        take = np.minimum(take, self.best.shape[1] - 1)
        for x, fill in ((self.best, -np.inf), (self.piece, -1), (self.back, 0), (self.count, 0)):
            x[rows] = np.where(out, fill, np.take_along_axis(x[rows], take, 1))
        self.best[rows, : self.lead] = -np.inf
        self.base[rows] += by


def stream_encode(a: Automaton, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, region: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Streaming Viterbi over chunks of falling length, all side by side: their ids laid end to end, and the number of each.

    A chunk keeps at most ``region`` places, at least twice the longest piece. When these are used up, the best paths of all
    places that a piece can still start from are followed back to the boundary where they meet: ids up to
    it can't change, are committed and forgotten. Only where the paths don't meet does the region grow. At its end a chunk
    has one place left and commits the rest.
    """
    n, size = len(starts), ends - starts
    longest = int(size[0]) if n else 0
    region = max(2 * a.window, region or 0)
    open_ = _Region(n, a.window if longest > region else 0, min(longest, region))
    best, piece_at, back_by, count = open_.best, open_.piece, open_.back, open_.count
    state, head = np.zeros(n, np.int64), np.zeros(n, np.int64)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # chunk, place among its ids, id

    def commit(rows: np.ndarray, column: np.ndarray) -> None:
        while len(rows):
            piece, length = piece_at[rows, column], back_by[rows, column].astype(np.int64)
            slot, known = count[rows, column] - 1, piece >= 0
            parts.append((rows[known], slot[known], a.ids[piece[known]]))
            place = starts[rows] + open_.base[rows] + column - open_.lead
            for k in range(1, 5):
                m = ~known & (length >= k)
                if m.any():
                    parts.append((rows[m], slot[m] - k + 1, a.byte_ids[buf[place[m] - k]]))
            column = column - length
            going = column > open_.lead
            rows, column = rows[going], column[going]

    for t in range(longest):
        live = n if t == 0 else int(np.searchsorted(-size, -t, "left"))
        column = t - open_.base[:live] + open_.lead
        if len(full := np.flatnonzero(column + 1 == best.shape[1])):
            met = open_.boundary(full, t, a.window)
            commit(full, met)
            open_.shift(full, met)
            if (met == open_.lead).any():
                open_.grow()
            best, piece_at, back_by, count = open_.best, open_.piece, open_.back, open_.count
            column = t - open_.base[:live] + open_.lead
        at, s, h = _advance(a, buf, starts[:live], t, state[:live], head[:live])
        state[:live], head[:live] = s, h
        single, most = np.zeros(live, bool), a.count[s]
        for j in range(int(most.max(initial=0))):
            rows = np.flatnonzero(most > j)
            piece = a.out[s[rows], j]
            length, to = a.length[piece], column[rows] + 1
            single[rows] |= t + 1 - length == h[rows]
            score = best[rows, to - length] + a.score[piece]
            better = score > best[rows, to]
            rows, length, to = rows[better], length[better], to[better]
            best[rows, to], piece_at[rows, to], back_by[rows, to] = score[better], piece[better], length
            count[rows, to] = count[rows, to - length] + 1
        last = at + 1
        ended = (last >= ends[:live]) | ((buf[np.minimum(last, len(buf) - 1)] & 0xC0) != 0x80)
        rows = np.flatnonzero(ended & ~single)
        if len(rows):
            length, to = t + 1 - h[rows], column[rows] + 1
            score = best[rows, to - length] + a.unknown
            better = score > best[rows, to]
            rows, length, to = rows[better], length[better], to[better]
            best[rows, to], piece_at[rows, to], back_by[rows, to] = score[better], -1, length
            count[rows, to] = count[rows, to - length] + length
    every, end = np.arange(n), size - open_.base + open_.lead
    total = count[every, end].astype(np.int64)
    left = end > open_.lead
    commit(every[left], end[left])
    first = np.cumsum(total) - total
    ids = np.zeros(int(total.sum()), np.int32)
    for rows, slot, found in parts:
        ids[first[rows] + slot] = found
    return ids, total


def encode_chunks(a: Automaton, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, region: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct chunks (falling length) laid end to end, and the number of each; some chunks of like length at a time."""
    size = ends - starts
    ids, totals, at = [], [], 0
    while at < len(starts):
        n = max(1, PLACES // max(1, min(int(size[at]), 2 * a.window)))
        i, k = stream_encode(a, buf, starts[at : at + n], ends[at : at + n], region)
        ids.append(i)
        totals.append(k)
        at += n
    return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), (np.concatenate(totals) if totals else np.zeros(0, np.int64))


def spread(flat: np.ndarray, counts: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """The ragged rows ``pick`` of (flat, counts), laid end to end."""
    first = np.cumsum(counts) - counts
    n = counts[pick]
    place = np.repeat(first[pick] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return flat[place]


def encode(a: Automaton, texts: pa.Array, region: int | None = None) -> Iterator[tuple[int, int, pa.Array]]:
    """(first row, end row, a list of ids for each text) of the slices of a batch."""
    for first, end, buf, starts, ends, at in chunks(texts):
        which, back = distinct(buf, starts, ends)
        ids, counts = encode_chunks(a, buf, starts[which], ends[which], region)
        flat = spread(ids, counts, back)
        total = np.append(0, np.cumsum(counts[back]))[at]
        lists = pa.ListArray.from_arrays(pa.array(total.astype(np.int32)), pa.array(flat, pa.int32()))
        yield first, end, pc.if_else(texts.slice(first, end - first).is_valid(), lists, pa.scalar(None, lists.type))


class ByteTable:
    """The bytes of every id: all that decoding needs."""

    def __init__(self, v: Vocabulary):
        bytes_of = [b""] * v.size
        for i, p in zip(v.ids, v.pieces, strict=True):
            bytes_of[i] = p
        for b, i in enumerate(v.byte_ids):
            if i:
                bytes_of[i] = bytes([b])
        self.flat = np.frombuffer(b"".join(bytes_of), np.uint8)
        self.size = np.array([len(p) for p in bytes_of], np.int64)


def decode(table: ByteTable, ids: pa.Array) -> pa.Array:
    """The text of each list of ids: byte pieces joined, the space in front dropped; null gives null,
    an id outside the vocabulary gives nothing, bytes that are no UTF-8 give U+FFFD."""
    rows = ids.cast(pa.large_list(pa.int32()))
    end = np.cumsum(pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False))
    flat = pc.fill_null(pc.list_flatten(rows), -1).to_numpy(zero_copy_only=False)
    known = (flat >= 0) & (flat < len(table.size))
    size = np.where(known, table.size[np.where(known, flat, 0)], 0)
    data = spread(table.flat, table.size, flat[known].astype(np.int64))
    off = np.append(0, np.cumsum(size))[np.append(0, end)]
    lead = off[:-1][off[:-1] < off[1:]]
    lead = lead[data[lead] == 32]
    data = np.delete(data, lead)
    off = off - np.searchsorted(lead, off, "left")
    raw = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data)])
    try:
        text = raw.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        text = pa.array([x.as_py().decode("utf-8", "replace") for x in raw], pa.string())
    return pc.if_else(ids.is_valid(), text, pa.scalar(None, pa.string()))
