"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has one bit for each bit of a 64-bit hash; the bit is set if it
is set in over half of the hashes of a text's word shingles. Two fingerprints
link if they differ in ``radius`` bits or fewer.

Search. For an even radius every fingerprint emits all variants within
``radius / 2`` bits: two linked fingerprints meet in a variant, and whatever
meets is within the radius. An odd radius has no whole half, so the 64 bits are
dealt to three blocks and one block is left out at a time: at least one of the
three ways loses a differing bit, the rest differ in ``radius - 1`` bits at
most, and the half is whole again (3 x 44 variants for radius 3 rather than
2,081). Variants are shuffled and sorted; colliding fingerprints are verified
with the bits left out. Exact copies share one fingerprint and cost nothing.

A variant that thousands of fingerprints share is linked without looking at
all pairs: members are indexed by the bits left out and each one looks up the
few flips that keep the total within the radius, which is exact and linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, map_batches, utf8

SEED = 42
#: Shingles hashed at once; keeps the memory of one very long text bounded.
CHUNK = 1 << 16
#: Fingerprints of one variant that are compared directly.
DIRECT = 128
ONES = (1 << 64) - 1


def shingles(text: bytes | None, width: int) -> Iterator[list[bytes]]:
    """Chunks of the space-joined ``width``-word shingles, repeats included.

    A-Z are lower-cased, words are runs without ASCII white space. A text of
    fewer words is one shingle; a text of none has none.
    """
    words = (text or b"").lower().split()
    if not words:
        return
    if len(words) <= width:
        yield [b" ".join(words)]
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = len(words) - width + 1
    for at in range(0, n, CHUNK):
        stop = min(at + CHUNK, n)
        a, b = starts[at:stop].tolist(), (ends[at + width - 1 : stop + width - 1] - 1).tolist()
        yield [joined[i:j] for i, j in zip(a, b)]


def hashes(chunk: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x, SEED) for x in chunk], dtype=np.uint64)


def simhash(text: bytes | None, width: int) -> int:
    """The unsigned fingerprint of one text; no words give 0."""
    total, counts = 0, np.zeros(64, dtype=np.int64)
    for chunk in shingles(text, width):
        bits = np.unpackbits(hashes(chunk).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        total += len(chunk)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id, fingerprint BIGINT)``, one row per row of ``docs``.

    Null and empty texts have fingerprint 0. Other columns are not read.
    """
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([simhash(t, width) for t in utf8(batch.column(1))], dtype=np.uint64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fingerprint"])

        return apply

    return map_batches(picked, make, f"id {picked.schema['id'].dataType.simpleString()}, fingerprint bigint")


def plan(radius: int) -> list[tuple[int, list[int]]]:
    """For each way to leave a block out: the mask of the bits kept, and the
    flips (masks) whose variants are emitted."""
    if not 0 <= radius <= 5:
        raise ValueError("a radius of 0 to 5 bits is supported")
    if radius % 2 == 0:
        keeps = [ONES]
    else:
        blocks = [((1 << 22) - 1), ((1 << 21) - 1) << 22, ((1 << 21) - 1) << 43]
        keeps = [ONES ^ b for b in blocks]
    ways = []
    for keep in keeps:
        bits = [1 << i for i in range(64) if keep >> i & 1]
        ways.append((keep, [sum(c) for k in range(radius // 2 + 1) for c in combinations(bits, k)]))
    return ways


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class _Forest:
    """Union-find over positions; keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((i, j))


def link_bucket(found: np.ndarray, variant: int, keep: int, radius: int, direct: int = DIRECT) -> list[tuple[int, int]]:
    """Positions of linked members of one variant, a spanning forest of the
    links. ``found``: distinct fingerprints that all emitted ``variant``.

    Every pair within the radius *by way of this variant* ends up connected;
    with all variants together that is every pair within the radius.
    """
    forest = _Forest(len(found))
    if keep == ONES:
        return [(0, i) for i in range(1, len(found))]
    if len(found) <= direct:
        near = np.bitwise_count(found[:, None] ^ found[None, :]) <= radius
        for i, j in zip(*np.nonzero(np.triu(near, 1))):
            forest.join(int(i), int(j))
        return forest.links
    off = np.bitwise_count((found & np.uint64(keep)) ^ np.uint64(variant)).astype(np.int64)
    rest = found & np.uint64(ONES ^ keep)
    order = np.lexsort((off, rest))
    rest, off = rest[order], off[order]
    first = np.concatenate(([0], np.flatnonzero(rest[1:] != rest[:-1]) + 1))
    owner = np.repeat(first, np.diff(np.append(first, len(rest))))
    for i, j in enumerate(owner.tolist()):
        if i != j:  # same bits left out: within radius - 1 by the halves
            forest.join(int(order[i]), int(order[j]))
    at, low, where = rest[first], off[first], order[first]
    bits = [1 << i for i in range(64) if not keep >> i & 1]
    for t in range(1, radius + 1):
        for mine in range(min(radius // 2, radius - t) + 1):
            src = np.flatnonzero(low == mine)
            if not len(src):
                continue
            for flips in combinations(bits, t):
                want = at[src] ^ np.uint64(sum(flips))
                hit = np.searchsorted(at, want)
                hit[hit == len(at)] = 0
                for i in np.flatnonzero((at[hit] == want) & (low[hit] + mine + t <= radius)).tolist():
                    forest.join(int(where[src[i]]), int(where[hit[i]]))
    return forest.links


def links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints whose transitive closure
    is that of all pairs within ``radius`` bits.

    ``prints(fingerprint)`` holds distinct values. The variants of a key come
    to one task sorted, so a task keeps one variant's members at a time.
    """
    ways = plan(radius)
    table = F.array(*[
        F.struct(F.lit(k).cast("tinyint").alias("way"), F.lit(_signed(keep)).alias("keep"), F.lit(_signed(flip)).alias("flip"))
        for k, (keep, flips) in enumerate(ways)
        for flip in flips
    ])
    # adaptive execution sizes tasks by what they read; a row becomes len(flips) rows here
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    variants = (
        prints.select("fingerprint").repartition(tasks)
        .select("fingerprint", F.explode(table).alias("v"))
        .select(F.col("v.way").alias("way"), F.expr("(fingerprint & v.keep) ^ v.flip").alias("variant"), "fingerprint")
        .repartition("variant", "way")
        .sortWithinPartitions("variant", "way", "fingerprint")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def close(way: np.ndarray, variant: np.ndarray, found: np.ndarray) -> list[tuple[int, int]]:
            new = np.concatenate(([True], (variant[1:] != variant[:-1]) | (way[1:] != way[:-1])))
            at = np.append(np.flatnonzero(new), len(way))
            out = []
            for k in np.flatnonzero(np.diff(at) > 1).tolist():
                i, j = at[k], at[k + 1]
                members = found[i:j].view(np.uint64)
                keep = ways[int(way[i])][0]
                out += [(int(found[i + x]), int(found[i + y])) for x, y in link_bucket(members, int(variant[i]) & ONES, keep, radius)]
            return out

        def rows(out: list[tuple[int, int]]) -> pa.RecordBatch:
            a, b = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            way, variant, found = (batch.column(i).to_numpy() for i in range(3))
            last = (way[-1], variant[-1])
            tail = int(np.searchsorted(variant, variant[-1]))  # where the last run begins
            while (way[tail], variant[tail]) != last:
                tail += 1
            if tail or (held and (held[-1][0][-1], held[-1][1][-1]) != last):
                # all but the open run is complete
                whole = [np.concatenate(x) for x in zip(*held, (way[:tail], variant[:tail], found[:tail]))]
                if len(whole[0]) and (out := close(*whole)):
                    yield rows(out)
                held = []
            held.append((way[tail:], variant[tail:], found[tail:]))
        if held and (out := close(*[np.concatenate(x) for x in zip(*held)])):
            yield rows(out)

    return variants.mapInArrow(run, "a bigint, b bigint")


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3
) -> DataFrame:
    """One row per row of ``docs``: ``(id, fingerprint BIGINT, component)``.

    ``component`` is the smallest id reachable over links of ``radius`` bits or
    fewer (null only if every id there is null). Null and empty texts have
    fingerprint 0 and link like any other; repeated rows and ids stay; an empty
    table gives an empty one.
    """
    prints = cut(fingerprints(docs, id_col, text_col, width))
    distinct = prints.groupBy("fingerprint").agg(F.min("id").alias("low"))
    parts = cut(connected_components(links(distinct.select("fingerprint"), radius)))
    member = (
        distinct.join(parts.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
        .select("fingerprint", "low", F.coalesce("component", "fingerprint").alias("part"))
    )
    lowest = member.groupBy("part").agg(F.min("low").alias("component"))
    named = member.join(lowest, "part").select("fingerprint", "component")
    return prints.join(named, "fingerprint", "left").select("id", "fingerprint", "component")
