"""Byte-level BPE: texts to token ids with byte offsets, and back.

Pre-tokenisation looks at no regular expression. Each code point has a class; a
small automaton over classes says where a piece begins. A class is a function from
state to state, and such functions compose associatively: the state before every
code point is a prefix scan of functions, taken for a whole batch of texts at once
by lookups in the composition table. Pieces are slices of the batch's bytes; each
distinct piece is merged once and kept in a cache.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, utf8

# Classes of a code point, by itself and by what stands next to it.
LETTER, SHORT, LONG, NUMBER, OTHER, QUOTE, JOINED, LAST, BLANK, BREAK = range(10)
#: States: a piece must begin, in letters, in numbers, in others, after a space that
#: belongs to what follows, in blanks, after a quote that began a piece, one letter
#: before a contraction's end.
FRESH, WORD, DIGITS, MARKS, LEAD, GAP, APART, HALF = range(8)
# What makes a contraction with a quote before it.
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")
#: Texts of a batch are worked on in runs of about this many bytes.
RUN_BYTES = 1 << 20
#: Bytes of a piece up to which all its pairs are looked at for each merge.
SHORT_PIECE = 64
#: Tokens of distinct pieces that a worker keeps, give or take those of one run.
CACHED = 5_000_000


def step(state: int, kind: int) -> tuple[int, bool]:
    """The next state, and whether a piece begins at the code point."""
    if kind == BREAK:
        return FRESH, True
    if kind == BLANK:  # white space that more white space or the end follows
        return GAP, state != GAP
    if kind == LAST:  # the last of a run, not a space: a piece of its own
        return FRESH, True
    if kind == JOINED:  # a space that belongs to the piece after it
        return LEAD, True
    if kind in (LETTER, SHORT, LONG):
        if state == APART and kind == SHORT:  # 's 't 'm 'd
            return FRESH, False
        if state == APART and kind == LONG:  # 're 've 'll
            return HALF, False
        if state == HALF:
            return FRESH, False
        return WORD, state not in (WORD, LEAD)
    if kind == NUMBER:
        return DIGITS, state not in (DIGITS, LEAD)
    if state in (MARKS, LEAD, APART):
        return MARKS, False
    return (APART if kind == QUOTE else MARKS), True


def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All compositions of the classes' functions: the number of each class's, the
    table of compositions (first, then), the state that each gives from FRESH, and
    by state and class whether a piece begins."""
    states = range(HALF + 1)
    of = [tuple(step(s, k)[0] for s in states) for k in range(BREAK + 1)]
    known = {tuple(states): 0}
    queue = [tuple(states)]
    for f in queue:
        for g in of:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(known)
                queue.append(h)
    then = np.array([[known[tuple(g[s] for s in f)] for g in queue] for f in queue])
    begins = np.array([[step(s, k)[1] for k in range(BREAK + 1)] for s in states])
    return np.array([known[f] for f in of], np.int32), then, np.array([f[FRESH] for f in queue]), begins.ravel()


_OF, _THEN, _FROM, _BEGINS = monoid()
_SIDE = len(_THEN)
_FLAT = _THEN.ravel().astype(np.uint8 if _SIDE <= 256 else np.int32)


def scan(functions: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions. The sequence is laid out in columns; columns
    are scanned side by side, then their totals (by the same function), and the
    total of all columns before is put in front of each."""
    n = len(functions)
    if n <= 64:
        out = functions.copy()
        for i in range(1, n):
            out[i] = _FLAT[int(out[i - 1]) * _SIDE + int(out[i])]
        return out
    rows = max(2, int(n**0.5))
    columns = -(-n // rows)
    grid = np.zeros(rows * columns, np.int32)  # 0 changes nothing
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(columns, rows).T)
    for i in range(1, rows):
        grid[i] = _FLAT[grid[i - 1] * _SIDE + grid[i]]
    before = np.concatenate(([0], scan(grid[-1])[:-1]))
    return _FLAT[before[None, :] * _SIDE + grid].T.reshape(-1)[:n].astype(np.int32)


def code_point_classes() -> bytes:
    """A byte for each code point: letter, number, white space (BLANK) or other, by
    the tables that tiktoken itself uses, and the quote."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.full(0x110000, OTHER, np.uint8)
    single = {bytes([b]): b for b in range(256)}
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", BLANK)):
        # text outside the pattern gives no tokens, and a token is a byte
        found = bytes(tiktoken.Encoding(f"class-{kind}", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(every))
        table[np.frombuffer(found.decode().encode("utf-32-le"), np.uint32)] = kind
    table[ord("'")] = QUOTE
    table[[ord(c) for c in SHORT_ENDINGS]] = SHORT
    return table.tobytes()


def classes(points: np.ndarray, table: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Classes in the context of the next code points; ``breaks`` are the places of
    separators, the last of which ends ``points``."""
    kind = table[points]
    kind[breaks] = BREAK
    blank = np.flatnonzero(kind == BLANK)
    ends = blank[(kind[blank + 1] != BLANK) & (kind[blank + 1] != BREAK)]
    quote = np.flatnonzero(kind == QUOTE)
    quote = quote[quote + 2 < len(points)]
    first, second = points[quote + 1], points[quote + 2]
    for a, b in LONG_ENDINGS:
        at = quote[(first == ord(a)) & (second == ord(b)) & (kind[quote + 2] != BREAK)]
        kind[at + 1] = LONG
    kind[ends] = np.where(points[ends] == ord(" "), JOINED, LAST)
    return kind


def pieces(texts: list[bytes], table: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Pieces of all texts: the texts, a zero byte after each, in a row; the byte at
    which each piece begins, and one past the end; the numbers of the pieces that
    are the zero bytes."""
    data = b"\0".join(texts) + b"\0"
    points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
    if len(points) == len(data):
        at = np.arange(len(points) + 1)
    else:
        width = np.ones(len(points), np.int64)
        for least in (0x80, 0x800, 0x10000):
            width += points >= least
        at = np.concatenate(([0], np.cumsum(width)))
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    kind = classes(points, table, np.searchsorted(at, ends))
    after = scan(_OF[kind])
    state = np.empty(len(kind), np.intp)
    state[0], state[1:] = FRESH, _FROM[after[:-1]]
    state *= BREAK + 1
    state += kind
    begin = at[np.flatnonzero(_BEGINS[state])]
    return data, np.append(begin, len(data)), np.searchsorted(begin, ends)


def load_ranks(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """A piece's tokens: the pair of least rank is merged, the leftmost of equals,
    until none has a rank."""
    if piece in ranks:
        return [piece]
    if len(piece) > SHORT_PIECE:
        return merge_long(piece, ranks)
    get, none = ranks.get, 1 << 62
    parts = [piece[i : i + 1] for i in range(len(piece))]
    found = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while found and (least := min(found)) < none:
        i = found.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del found[i]
        if i < len(found):
            found[i] = get(parts[i] + parts[i + 1], none)
        if i:
            found[i - 1] = get(parts[i - 1] + parts[i], none)
    return parts


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The same by a heap of pairs and links between parts: n log n steps."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that begins at i; 0 once it is gone
    last = list(range(-1, n))  # begin of the part before
    rank = lambda a, b: ranks.get(piece[a:b])
    queue = [(r, i, i + 2) for i in range(n - 1) if (r := rank(i, i + 2)) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, b = heapq.heappop(queue)
        middle = end[i]
        if not middle or middle >= n or end[middle] != b:
            continue  # one of the two has changed
        end[i], end[middle] = b, 0
        if b < n:
            last[b] = i
            if (r := rank(i, end[b])) is not None:
                heapq.heappush(queue, (r, i, end[b]))
        if (a := last[i]) >= 0 and (r := rank(a, b)) is not None:
            heapq.heappush(queue, (r, a, b))
    out, i = [], 0
    while i < n:
        out.append(piece[i : end[i]])
        i = end[i]
    return out


class Encoder:
    """Texts to ids and byte offsets. Every piece that was met has a number; its ids
    and their lengths stand in two flat arrays from ``first`` on."""

    def __init__(self, lines: bytes, table: bytes):
        self.ranks = load_ranks(lines)
        self.table = np.frombuffer(table, np.uint8)
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.sizes = array("i"), array("i")
        self.first = array("q", [0])

    def learn(self, piece: bytes) -> int:
        parts = merge(piece, self.ranks)
        self.ids.extend(map(self.ranks.__getitem__, parts))
        self.sizes.extend(map(len, parts))
        self.first.append(len(self.ids))
        self.number[piece] = k = len(self.first) - 2
        return k

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts in a row, the byte of its text at which each begins,
        and where each text's ids begin, with the end."""
        if len(self.ids) > CACHED:
            self.clear()
        data, begin, breaks = pieces(texts, self.table)
        edge = begin.tolist()
        slices = [data[a:b] for a, b in zip(edge, edge[1:])]
        number = list(map(self.number.get, slices))
        if None in number:
            for i, k in enumerate(number):
                if k is None:
                    again = self.number.get(slices[i])  # met earlier in this run
                    number[i] = self.learn(slices[i]) if again is None else again
        number = np.array(number, np.int64)
        first = np.frombuffer(self.first, np.int64)
        count = first[number + 1] - first[number]
        count[breaks] = 0  # a separator is no part of any text
        past = np.cumsum(count)
        at = np.arange(past[-1]) + np.repeat(first[number] - (past - count), count)
        size = np.frombuffer(self.sizes, np.int32)[at].astype(np.int64)
        cut = np.concatenate(([0], past[breaks]))
        byte = np.cumsum(size) - size
        start = np.cumsum([0, *(len(t) for t in texts[:-1])])
        return np.frombuffer(self.ids, np.int32)[at], byte - np.repeat(start, np.diff(cut)), cut


    def encode_long(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``encode`` of one text, a segment at a time."""
        found, base = [], 0
        for part in segments(text):
            ids, offsets, _ = self.encode([part])
            found.append((ids, offsets + base))
            base += len(part)
        ids, offsets = (np.concatenate(x) for x in zip(*found))
        return ids, offsets, np.array([0, len(ids)])


def segments(text: bytes, size: int = RUN_BYTES) -> Iterator[bytes]:
    """A text in parts of ``size`` bytes and a little more. They begin at spaces
    between ASCII letters, where a piece begins whatever stands before; a text
    without such spaces stays whole."""
    at = 0
    while len(text) - at > size:
        b = text.find(b" ", at + size)
        while b > 0 and not (text[b - 1 : b].isalpha() and text[b + 1 : b + 2].isalpha()):
            b = text.find(b" ", b + 1)
        if b < 0:
            break
        yield text[at:b]
        at = b
    yield text[at:]


def default_vocabulary() -> str:
    """Path of the public byte-level vocabulary (tiktoken ranks)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _runs(values: list, size) -> Iterator[list]:
    run, total = [], 0
    for x in values:
        run.append(x)
        total += size(x)
        if total >= RUN_BYTES:
            yield run
            run, total = [], 0
    if run:
        yield run


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per row of ``docs``: ``(id, ids array<int>, offsets array<bigint>)``.

    ``ids`` are what tiktoken's ``encode_ordinary`` gives under the ranks, special
    tokens being plain text; ``offsets`` are the bytes of the text at which the
    tokens begin (a token may end inside a character). Null and empty texts have no
    tokens; texts of any length are taken whole, as are pieces; repeated rows are
    kept; an empty table gives an empty one. Other columns are not read.
    """
    with open(vocabulary or default_vocabulary(), "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast((f.read(), code_point_classes()))
    picked = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(sent)
        for batch in batches:
            at = 0
            for texts in _runs(utf8(batch.column(1)), len):
                *arrays, cut = encoder.encode(texts) if len(texts) > 1 else encoder.encode_long(texts[0])
                ids, offsets = (pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x)) for x in arrays)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), ids, offsets], ["id", "ids", "offsets"])
                at += len(texts)

    kind = picked.schema["id"].dataType.simpleString()
    return map_rows(picked, run, f"id {kind}, ids array<int>, offsets array<bigint>")


_WORKER: dict[str, Encoder] = {}


def worker_encoder(sent) -> Encoder:
    """The worker's encoder, with its cache, kept from task to task."""
    lines, table = sent.value
    key = hash((len(lines), lines[:64], lines[-64:], table[:256]))
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Encoder(lines, table)
    return _WORKER[key]


@lru_cache(maxsize=2)
def token_bytes(lines: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes in a row, where each id's begin, and how many it has."""
    by_id = {i: t for t, i in load_ranks(lines).items()}
    size = np.zeros(max(by_id) + 1, np.int64)
    for i, t in by_id.items():
        size[i] = len(t)
    flat = b"".join(by_id[i] for i in sorted(by_id))
    return np.frombuffer(flat, np.uint8), np.cumsum(size) - size, size


def decode_tokens(tokens: DataFrame, vocabulary: str | None = None, keep: bool = False) -> DataFrame:
    """``tokens(id, ids, offsets)`` back to ``(id, data binary)``, with ``ids`` too if
    ``keep``: each token's bytes are written at its offset. Ids without a token and offsets that don't follow from
    the ids end in an error; null and empty arrays give no bytes."""
    with open(vocabulary or default_vocabulary(), "rb") as f:
        sent = tokens.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, first, size = token_bytes(sent.value)
        for batch in batches:
            rows = []
            for ids, offsets in zip(batch.column(1), batch.column(2)):
                ids = np.asarray(ids.values if ids.is_valid else [], np.int64)
                offsets = np.asarray(offsets.values if offsets.is_valid else [], np.int64)
                n = size[ids]
                if not (n > 0).all() or not np.array_equal(np.cumsum(n) - n, offsets):
                    raise ValueError("ids and offsets don't belong together")
                # where each byte of the text stands among the tokens' bytes
                rows.append(flat[np.arange(int(n.sum())) + np.repeat(first[ids] - offsets, n)].tobytes())
            data = pa.array(rows, pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], data], ["id", "ids", "data"]) if keep else pa.RecordBatch.from_arrays([batch.column(0), data], ["id", "data"])

    kind = tokens.schema["id"].dataType.simpleString()
    return map_rows(tokens.select("id", "ids", "offsets"), run, f"id {kind}, {'ids array<int>, ' if keep else ''}data binary")
