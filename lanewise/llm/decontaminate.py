"""Benchmark decontamination with one Aho-Corasick automaton.

Test items (questions and answers) and documents are normalised alike: A-Z
lower-cased, words are runs of digits, letters and whatever is not ASCII. The
patterns are all windows of ``window`` consecutive item words (the whole item if
it is shorter). Words of the items are numbered and written in four digits, each
place with digits of its own, so that a match begins where a word does and a state
has few successors; words of no item are one symbol. Each text is scanned once. Normalising keeps byte positions, so hits map back to the
original text.

Items go to the executors in blocks of at most ``block_bytes`` of text, each with
an automaton of its own. A benchmark of one block is one pass over the corpus. For a
larger one, the corpus is scanned once against the 64-bit hashes of all windows of
all items, 8 bytes each; only texts in which one of them occurs are kept and go
through the automata, block by block. An equal hash decides nothing else.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, cut, map_batches, map_rows, utf8

#: Bytes to what they are as part of a word: A-Z lower-cased, else a space.
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD = re.compile(rb"[^ ]+")
#: How words are written for the automaton: in digits of this base, as many places as
#: the number of words asks for.
BASE = 32
#: Bytes of item text to an automaton (of some 150 bytes to each).
BLOCK_BYTES = 1 << 20
#: Hashes of windows that a stage of the scan holds: 128 MiB. More windows are more
#: stages of the same scan.
MOST_WINDOWS = 1 << 24


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(NORMAL).split()


def digits(k: int, places: int) -> str:
    """A number as digits of ``BASE``, each place with digits of its own."""
    if k >= BASE**places:
        raise ValueError(f"{k} has more than {places} places")
    return "".join([chr(1 + d * BASE + (k // BASE**d) % BASE) for d in range(places)])


class Scanner:
    """The automaton over the windows of ``items`` (pairs of id and text)."""

    def __init__(self, items: list[tuple[object, bytes | None]], window: int):
        import ahocorasick

        found = [(item, words(text)) for item, text in items]
        known = dict.fromkeys(w for _, ws in found for w in ws)
        places = 1
        while BASE**places < len(known):
            places += 1
        self.number = {w: digits(k, places) for k, w in enumerate(known)}
        owners: dict[str, set] = {}
        for item, ws in found:
            coded = [self.number[w] for w in ws]
            for i in range(max(1, len(coded) - window + 1) if coded else 0):
                owners.setdefault("".join(coded[i : i + window]), set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for key, ids in owners.items():
            self.automaton.add_word(key, (len(key) // places, tuple(ids)))
        self.some = bool(owners)
        if self.some:
            self.automaton.make_automaton()

    def scan(self, found: list[bytes]) -> list[tuple[int, int, tuple]]:
        """Word ranges ``(first, past, items)`` of all windows that occur."""
        if not self.some or not found:
            return []
        get, other = self.number.get, chr(0)
        coded = [get(w, other) for w in found]
        hits = list(self.automaton.iter("".join(coded)))
        if not hits:
            return []
        past = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)))  # where each word ends
        last = np.searchsorted(past, [end + 1 for end, _ in hits]).tolist()
        return [(k + 1 - n, k + 1, ids) for k, (_, (n, ids)) in zip(last, hits)]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def original_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as code-point offsets into the text, end exclusive."""
    if not ranges:
        return []
    at = [m.span() for m in _WORD.finditer(text.translate(NORMAL))]
    points = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [(int(points[at[a][0]]), int(points[at[b - 1][1]])) for a, b in ranges]


def window_hashes(found: list[bytes], window: int) -> np.ndarray:
    """A 64-bit hash of each run of ``window`` words, by position."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = max(0, len(h) - window + 1)
    out = np.full(n, window, np.uint64)
    for j in range(window):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return out


def _counted(items: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    picked = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return picked, picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def _blocks(picked: DataFrame, total: int, block_bytes: int) -> Iterator[tuple[Broadcast, bool]]:
    """The items in blocks, each collected on its own and bounded, and whether it
    is the last. A block is taken back when the next one is asked for."""
    sc = picked.sparkSession.sparkContext
    # hashing deals unevenly, so blocks are aimed at half of the bound
    n = 1 if total <= block_bytes else -(-2 * total // block_bytes)
    for k in range(n):
        part = picked if n == 1 else picked.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        block = sc.broadcast([(r["id"], bytes(r["text"]) if r["text"] is not None else None) for r in part.toLocalIterator()])
        yield block, k == n - 1
        if k < n - 1:
            block.destroy()


def _hash_sets(picked: DataFrame, window: int) -> list[tuple[Broadcast, list[int]]]:
    """The hashes of all windows, sorted, in sets of about ``MOST_WINDOWS`` at most,
    and the lengths of window that there are (an item of fewer words is one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in utf8(batch.column(0)):
                if found := words(text):
                    k = min(window, len(found))
                    h = np.unique(window_hashes(found, k)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k, np.int32)), pa.array(h)], ["k", "h"])

    sc = picked.sparkSession.sparkContext
    every = cut(map_rows(picked.select("text"), run, "k int, h bigint").distinct())
    lengths = sorted(r["k"] for r in every.select("k").distinct().collect())
    n = max(1, -(-every.count() // MOST_WINDOWS))
    part = lambda i: every if n == 1 else every.where(F.pmod(F.xxhash64("h"), F.lit(n)) == i)
    return [(sc.broadcast(np.sort(np.asarray(part(i).select("h").toArrow().column(0)).view(np.uint64))), lengths) for i in range(n)]


def _may_hit(found: list[bytes], hashes: np.ndarray, lengths: list[int]) -> bool:
    for k in lengths if len(hashes) else ():
        h = window_hashes(found, k)
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        if (hashes[at] == h).any():
            return True
    return False


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: ``(id, n_words, n_hit, items, spans)``.

    ``n_hit`` counts words inside any window that occurs, ``items`` are the ids
    (as sorted strings) of items with such windows, ``spans`` the hit ranges of
    the original text. Null and empty texts have no words; items without words
    and null item ids match nothing; repeated rows are kept; no items or no
    documents are fine. Other columns are not read. The corpus is scanned once,
    whatever the size of the benchmark.
    """
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    hit = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("items", pa.list_(pa.string()))])

    def step(block, last: bool, first: bool):
        def make():
            scanner = Scanner(block.value, window)

            def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
                texts = utf8(batch.column(1))
                earlier = [[]] * len(texts) if first else batch.column(2).to_pylist()
                out = []
                for text, before in zip(texts, earlier):
                    found = words(text) if text else []
                    hits = [(h["a"], h["b"], h["items"]) for h in before] + scanner.scan(found)
                    if not last:
                        out.append([{"a": a, "b": b, "items": list(ids)} for a, b, ids in hits])
                        continue
                    ranges = merged([(a, b) for a, b, _ in hits])
                    out.append((
                        len(found), sum(b - a for a, b in ranges), sorted({i for _, _, ids in hits for i in ids}),
                        [{"start": a, "end": b} for a, b in original_spans(text or b"", ranges)],
                    ))
                if not last:
                    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(hit))], ["id", "text", "hits"])
                n, h, i, s = zip(*out) if out else ((), (), (), ())
                span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
                return pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(h, pa.int64()), pa.array(i, pa.list_(pa.string())), pa.array(s, pa.list_(span))],
                    ["id", "n_words", "n_hit", "items", "spans"],
                )

            return apply

        return make

    done = f"id {kind}, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>"
    open_ = f"id {kind}, text string, hits array<struct<a:bigint,b:bigint,items:array<string>>>"
    listed, total = _counted(items, item_id, item_text)
    clean = None
    if total > block_bytes:
        once = cut(_scan_hashes(picked, kind, _hash_sets(listed, window)))
        none = [F.lit(0).cast("bigint").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")]
        clean = once.where("NOT maybe").select("id", "n_words", *none)
        picked = once.where("maybe").select("id", "text")
    first = True
    for block, last in _blocks(listed, total, block_bytes):
        picked = map_batches(picked, step(block, last, first), done if last else open_)
        if not last:
            picked = cut(picked)
        first = False
    return picked if clean is None else clean.unionByName(picked)


def _scan_hashes(picked: DataFrame, kind: str, sets: list[tuple[Broadcast, list[int]]]) -> DataFrame:
    """``(id, text, n_words, maybe)`` of ``picked(id, text)``: whether a window's hash
    occurs; only then is the text kept."""
    schema = f"id {kind}, text string, n_words bigint, maybe boolean"
    for k, (sent, lengths) in enumerate(sets):

        def run(batches: Iterator[pa.RecordBatch], sent=sent, lengths=lengths, first=k == 0, last=k == len(sets) - 1) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, BATCH_ROWS):
                    batch = whole.slice(at, BATCH_ROWS)
                    found = [words(t) for t in utf8(batch.column(1))]
                    maybe = [_may_hit(f, sent.value, lengths) for f in found]
                    if not first:
                        maybe = [a or b for a, b in zip(maybe, batch.column(3).to_pylist())]
                    maybe = pa.array(maybe, pa.bool_())
                    text = pc.if_else(maybe, batch.column(1), pa.scalar(None, batch.column(1).type)) if last else batch.column(1)
                    yield pa.RecordBatch.from_arrays([batch.column(0), text, pa.array(map(len, found), pa.int64()), maybe], ["id", "text", "n_words", "maybe"])

        picked = map_rows(picked, run, schema)
    return picked


def drop_contaminated(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = 10, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs`` in which no window occurs, all columns unchanged.

    Rows pass through as they are: no join, no shuffle, any column names. With a
    benchmark of more than a block the table is read twice: for the rows without a
    window's hash, which stay, and for the few others, which the automata decide on.
    """
    at = docs.columns.index(text_col)
    listed, total = _counted(items, item_id, item_text)
    stay = None
    if total > block_bytes:
        sets = _hash_sets(listed, window)

        def part(wanted: bool) -> DataFrame:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for whole in batches:
                    for k in range(0, whole.num_rows, BATCH_ROWS):
                        batch = whole.slice(k, BATCH_ROWS)
                        found = [words(t) for t in utf8(batch.column(at))]
                        yield batch.filter(pa.array([any(_may_hit(f, sent.value, n) for sent, n in sets) == wanted for f in found], pa.bool_()))

            return map_rows(docs, run, docs.schema)

        stay, docs = part(False), cut(part(True))
    for block, last in _blocks(listed, total, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            scanner = Scanner(block.value, window)
            for whole in batches:
                for k in range(0, whole.num_rows, BATCH_ROWS):
                    batch = whole.slice(k, BATCH_ROWS)
                    clean = [not scanner.scan(words(t) if t else []) for t in utf8(batch.column(at))]
                    yield batch.filter(pa.array(clean, pa.bool_()))

        docs = map_rows(docs, run, docs.schema)
        if not last:
            docs = cut(docs)
    return docs if stay is None else stay.union(docs)


def items_digest(ids: list[str] | None) -> str:
    return hashlib.sha256(",".join(ids or []).encode()).hexdigest()
