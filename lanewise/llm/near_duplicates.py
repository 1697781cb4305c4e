"""Near-duplicate groups for cleaning: SimHash balls, sketch bands, exact links.

Two texts are near copies if the Jaccard similarity of their sets of five-word
shingles is 0.8 or more. SimHash ball hashing finds the pairs whose
fingerprints differ in a few bits. On such shingles a similarity of 0.8 is a
distance of about 10 of 64 bits, which no ball can hold (7.6 million variants
for half of 10), so pairs further apart come from minimum-hash bands over the
same shingle hashes.

Neither kind of candidate decides anything. Candidates only gather nodes into
families: the components over balls, equal fingerprints and bands. All members
of a family are then compared with each other exactly, on whole texts, whichever
candidate brought them there, so a candidate that turns out false takes no true
link along. The groups are the components of the exact links.

A family goes to one task as long as its shingles fit a cell. The members of a
larger family are written as their differences from one reference member, dealt
to blocks, and every pair of blocks is a cell, so that any two members meet in
one. Inside a cell an inverted index over the differences counts what two sets
share: shingles that most members have are told by who lacks them, so a cell of
near copies is compared by their edits alone and no pair is written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, map_batches, map_rows, utf8
from .simhash import SEED, hashes, links, shingles

BANDS, ROWS = 16, 5
#: Estimated similarity under which a bucket's pair is not a candidate; three
#: standard errors of an estimate from 80 values lie between it and 0.8.
LEAST_ESTIMATE = 0.66
#: Members of a bucket whose sketches are compared. Those of a larger bucket are
#: one family without an estimate.
BLOCK = 4096
#: Shingles, or differences, of the sets that are compared at once; a set counts
#: for ``MEMBER`` more, which bounds the number of sets too.
CELL, MEMBER = 2_000_000, 256
#: Copies of a large family's reference, so that its members need not be in one task.
SALTS = 64

_rng = np.random.default_rng(SEED)
_MUL = _rng.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 62, BANDS * ROWS, dtype=np.uint64)


def sketch(text: bytes | None, width: int) -> tuple[int, list[int], bytes, int]:
    """Fingerprint, bucket of each band, a byte of each minimum hash, and the
    number of shingles. A text without words is in no band."""
    total, counts = 0, np.zeros(64, dtype=np.int64)
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for chunk in shingles(text, width):
        h = hashes(chunk)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(chunk)
        for at in range(0, len(h), 4096):
            np.minimum(least, (h[at : at + 4096, None] * _MUL + _ADD).min(axis=0), out=least)
    print_ = int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])
    bands = [xxhash.xxh3_64_intdigest(least[k : k + ROWS].tobytes(), k) for k in range(0, BANDS * ROWS, ROWS)] if total else []
    return print_, bands, (least >> np.uint64(32)).astype(np.uint8).tobytes(), total


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """The set of a text's shingles, as sorted 64-bit hashes."""
    found = [np.unique(hashes(chunk)) for chunk in shingles(text, width)]
    return np.unique(np.concatenate(found)) if len(found) > 1 else found[0] if found else np.empty(0, dtype=np.uint64)


def estimated_forest(sketches: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links that hold together what pairs of an estimate of at least ``least``
    hold together. Each member is compared with those not reached yet."""
    out, left = [], np.arange(len(sketches))
    waiting: list[int] = []
    while len(left):
        if waiting:
            at = waiting.pop()
        else:
            at, left = int(left[0]), left[1:]
        near = (sketches[left] == sketches[at]).mean(axis=1) >= least
        found = left[near].tolist()
        out += [(at, j) for j in found]
        waiting += found
        left = left[~near]
    return out


def exact_links(
    sets: list[np.ndarray], sizes: np.ndarray, similarity: float, core: np.ndarray | None = None, side: np.ndarray | None = None
) -> list[tuple[int, int]]:
    """Positions of linked sets: a forest of the links of at least ``similarity``.

    ``sets`` are the sets themselves or their symmetric differences from one
    reference, each sorted and without repeats; ``sizes`` are those of the sets
    themselves. Positions in ``core`` hang together already; with ``side`` only
    sets of different sides are compared.
    """
    n = len(sets)
    part = np.arange(n)
    if core is not None and core.any():
        part[core] = np.flatnonzero(core)[0]
    lens = np.fromiter(map(len, sets), np.int64, n)
    owner = np.repeat(np.arange(n), lens)
    _, value, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # differences from the set of what over half of the sets have
    common = np.flatnonzero(df > n / 2)
    place = np.full(len(df), -1)
    place[common] = np.arange(len(common))
    of_common = place[value] >= 0
    lacks = np.ones((n, len(common)), dtype=bool)
    lacks[owner[of_common], place[value[of_common]]] = False
    lacking, what = np.nonzero(lacks)
    length = np.bincount(owner[~of_common], minlength=n) + np.bincount(lacking, minlength=n)
    shared = ~of_common & (df[value] > 1)
    owner, value = np.concatenate((owner[shared], lacking)), np.concatenate((value[shared], len(df) + what))
    _, value = np.unique(value, return_inverse=True)
    by_value = np.argsort(value, kind="stable")
    posted, ends = owner[by_value], np.concatenate(([0], np.cumsum(np.bincount(value))))
    by_owner = np.argsort(owner, kind="stable")
    mine, starts = value[by_owner], np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n))))

    found: list[tuple[int, int]] = []
    first = int(np.argmin(length)) if core is None or not core.any() else int(np.flatnonzero(core)[0])
    for x in [first, *range(n)]:
        # two sets of the first one's part need no look; any other pair has an end outside
        if part[x] == part[first] and (x != first or found or core is not None):
            continue
        lists = [posted[ends[v] : ends[v + 1]] for v in mine[starts[x] : starts[x + 1]].tolist()]
        both = np.bincount(np.concatenate(lists), minlength=n) if lists else np.zeros(n, dtype=np.int64)
        apart = length[x] + length - 2 * both
        total = sizes[x] + sizes
        hit = (total - apart) / np.maximum(total + apart, 1) >= similarity
        hit &= part != part[x]
        if side is not None:
            hit &= side != side[x]
        for y in np.flatnonzero(hit).tolist():
            if part[y] != part[x]:
                found.append((x, y))
                part[part == part[y]] = part[x]
    return found


def band_edges(nodes: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` that hold together the candidate pairs of ``nodes(node,
    bands, sketch)``: those that share a bucket and have a high enough estimate."""
    keys = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("low")).where("n > 1")
    members = cut(keys.join(shared, "bucket"))
    # sketches are sent for members of shared buckets only
    keyed = (
        members.where(F.col("n") <= BLOCK).join(nodes.select("node", "sketch"), "node")
        .select("bucket", "node", "sketch").repartition("bucket").sortWithinPartitions("bucket", "node")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        key, found = None, []

        def close() -> None:
            tree = estimated_forest(np.stack([np.frombuffer(s, np.uint8) for _, s in held]), LEAST_ESTIMATE) if len(held) > 1 else []
            found.extend((held[i][0], held[j][0]) for i, j in tree)
            held.clear()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])
            found.clear()
            return out

        for batch in batches:
            for bucket, node, s in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != key:
                    close()
                    key = bucket
                held.append((node, s))
            if found:
                yield rows()
        close()
        if found:
            yield rows()

    return keyed.mapInArrow(run, "a bigint, b bigint").union(members.where(F.col("n") > BLOCK).select("low", "node"))


def few(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df``, marked to be broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= rows else df


def groups_of_small(members: DataFrame, width: int, similarity: float) -> DataFrame:
    """``(node, component)`` of ``members(family, node, text)``, whose families
    each fit a cell. A node that comes more than once counts once."""
    keyed = members.select("family", "node", "text").repartition("family").sortWithinPartitions("family", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, sets = None, [], []

        def close() -> pa.RecordBatch:
            part = np.array(held)  # sorted, so the smallest node is the first
            if len(held) > 1:
                for i, j in exact_links(sets, np.fromiter(map(len, sets), np.int64, len(sets)), similarity):
                    low, high = sorted((part[i], part[j]))
                    part[part == high] = low
            return pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(part)], ["node", "component"])

        for batch in batches:
            for family, node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2))):
                if family != key:
                    if held:
                        yield close()
                    key, held, sets = family, [], []
                if not held or node != held[-1]:
                    held.append(node)
                    sets.append(shingle_hashes(text, width))
        if held:
            yield close()

    return map_rows(keyed, run, "node bigint, component bigint")


def differences(members: DataFrame, width: int, similarity: float) -> DataFrame:
    """``(family, node, ref, size, delta, core)`` of ``members(family, node, ref,
    text)``: the symmetric difference from the family's reference member, and
    whether the node links to it."""
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
    refs = (
        members.where("node = ref").groupBy("family").agg(F.first("text").alias("r"))
        .select("family", "r", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    joined = members.withColumn("salt", salt).join(refs, ["family", "salt"]).select("family", "node", "ref", "text", "r")

    def make():
        kept: dict[bytes, np.ndarray] = {}

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            size, delta, core = [], [], []
            for text, r in zip(utf8(batch.column(3)), utf8(batch.column(4))):
                if r not in kept:
                    kept.clear()
                    kept[r] = shingle_hashes(r, width)
                mine, ref = shingle_hashes(text, width), kept[r]
                apart = np.setxor1d(mine, ref, assume_unique=True)
                total = len(mine) + len(ref)
                size.append(len(mine))
                delta.append(apart.tobytes())
                core.append(bool((total - len(apart)) / max(total + len(apart), 1) >= similarity))
            return pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), pa.array(size, pa.int64()), pa.array(delta, pa.binary()), pa.array(core, pa.bool_())],
                ["family", "node", "ref", "size", "delta", "core"],
            )

        return apply

    return map_batches(joined, make, "family bigint, node bigint, ref bigint, size bigint, delta binary, core boolean").dropDuplicates(["node"])


def links_of_large(apart: DataFrame, similarity: float) -> DataFrame:
    """Links ``(a, b)`` whose closure is that of all exact links in the families
    of ``differences``. A member of block p is in the cells (p, q) of all q."""
    blocks = F.ceil(F.sum(F.octet_length("delta") / 8 + MEMBER) / CELL).cast("int")
    sized = apart.join(few(apart.groupBy("family").agg(blocks.alias("blocks"))), "family")
    mine = F.pmod(F.xxhash64("node", "family"), F.col("blocks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda q: F.struct(F.least("mine", q).alias("p"), F.greatest("mine", q).alias("q")))
    keyed = (
        sized.withColumn("mine", mine)
        .select("family", F.explode(cells).alias("cell"), "mine", "node", "size", "delta", "core")
        .select("family", "cell.p", "cell.q", "mine", "node", "size", "delta", "core")
        .repartition("family", "p", "q").sortWithinPartitions("family", "p", "q", "node")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if len(held) < 2:
                return
            mine, node, size, delta, core = zip(*held)
            side = np.array(mine) if key[1] != key[2] else None
            sets = [np.frombuffer(d, np.uint64) for d in delta]
            found = exact_links(sets, np.array(size, dtype=np.int64), similarity, np.array(core), side)
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array([node[i] for i in x], pa.int64()) for x in (a, b)], ["a", "b"])

        for batch in batches:
            for family, p, q, *member in zip(*(c.to_pylist() for c in batch.columns)):
                if (family, p, q) != key:
                    yield from close()
                    key, held = (family, p, q), []
                held.append(member)
        yield from close()

    return map_rows(keyed, run, "a bigint, b bigint").union(apart.where("core and node <> ref").select("ref", "node"))


def exact_groups(members: DataFrame, width: int, similarity: float, any_large: bool) -> DataFrame:
    """``(node, component)`` of ``members(family, large, node, ref, text)``;
    ``component`` is the smallest node that exact links reach."""
    small = groups_of_small(members.where("not large") if any_large else members, width, similarity)
    if not any_large:
        return small
    apart = cut(differences(members.where("large"), width, similarity))
    return small.union(connected_components(links_of_large(apart, similarity)))


def _key(id_col: str):
    return F.coalesce(F.col(id_col).cast("string"), F.lit(""))


def _tie(id_col: str, text_col: str):
    """With the id, tells rows apart; null differs from empty in either column."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.col(text_col).isNull(), F.col(id_col).isNull())


def keep_one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, radius: int = 3
) -> DataFrame:
    """One document of every group of near copies, all columns unchanged.

    Groups are the components of exact links; texts that are equal word for word
    (A-Z in either case, white space aside) are one node from the start. The row
    with the smallest id stays (null ids come last, then the text decides); of
    rows equal in id and text one stays. Null and empty texts form one group. An
    empty table gives an empty one.
    """
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            node, prints, bands, short, n = [], [], [], [], []
            for text in utf8(batch.column(1)):
                fingerprint, keys, s, total = sketch(text, width)
                prints.append(fingerprint)
                bands.append(np.array(keys, dtype=np.uint64).view(np.int64))
                short.append(s)
                n.append(total)
                node.append(xxhash.xxh3_64_intdigest(b" ".join((text or b"").lower().split())))
            as_long = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), as_long(node), as_long(prints), pa.array(bands, pa.list_(pa.int64())),
                    pa.array(short, pa.binary()), pa.array(n, pa.int64()),
                ],
                ["id", "tie", "node", "fingerprint", "bands", "sketch", "shingles"],
            )

        return apply

    kind = picked.schema["id"].dataType.simpleString()
    tie = _tie("id", "text")
    rows = cut(map_batches(
        picked.select("id", "text", tie.alias("tie")), make,
        f"id {kind}, tie bigint, node bigint, fingerprint bigint, bands array<bigint>, sketch binary, shingles bigint",
    ))
    order = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("tie").alias("tie"))
    same = [F.min(c).alias(c) for c in ("fingerprint", "bands", "sketch", "shingles")]
    nodes = cut(rows.groupBy("node").agg(F.min(order).alias("first"), F.count("*").alias("copies"), *same))
    prints = nodes.groupBy("fingerprint").agg(F.min("node").alias("low"), F.count("*").alias("n"))
    balls = (
        links(prints.select("fingerprint"), radius)
        .join(prints.select(F.col("fingerprint").alias("a"), F.col("low").alias("x")), "a")
        .join(prints.select(F.col("fingerprint").alias("b"), F.col("low").alias("y")), "b")
        .select("x", "y")
    )
    equal = nodes.join(prints.where("n > 1"), "fingerprint").select("low", "node")
    families = connected_components(band_edges(nodes.select("node", "sketch", "bands")).union(balls).union(equal))
    members = families.join(nodes.select("node", "first", "copies", "shingles"), "node")
    facts = cut(
        members.groupBy(F.col("component").alias("family"))
        .agg((F.sum(F.col("shingles") + MEMBER) > CELL).alias("large"), F.max(F.struct("copies", "node"))["node"].alias("ref"))
    )
    wanted = cut(
        members.join(few(facts), members["component"] == facts["family"])
        .select("family", "large", "node", "ref", _key("first.id").alias("w_key"), F.col("first.tie").alias("w_tie"))
    )
    # only texts of families are read again, one for each node
    texts = (
        picked.select("id", "text", tie.alias("tie"))
        .join(few(wanted), (_key("id") == F.col("w_key")) & (F.col("tie") == F.col("w_tie")))
        .select("family", "large", "node", "ref", "text")
    )
    parts = exact_groups(texts, width, similarity, not facts.where("large").isEmpty())

    grouped = nodes.join(parts, "node", "left").select("first", F.coalesce("component", "node").alias("part"))
    stay = grouped.groupBy("part").agg(F.min("first").alias("first")).select(_key("first.id").alias("key"), F.col("first.tie").alias("tie"))
    # most rows stay, so what is joined to whole rows is a mark on the others and
    # on rows equal in id and text
    marks = cut(
        rows.groupBy(_key("id").alias("key"), "tie").agg(F.count("*").alias("n"))
        .join(stay.withColumn("stays", F.lit(True)), ["key", "tie"], "left")
        .where("stays is null or n > 1").select("key", "tie", F.col("stays").isNull().alias("goes"))
    )
    whole = docs.select(_key(id_col).alias("key"), _tie(id_col, text_col).alias("tie"), F.struct("*").alias("row"))
    marked = whole.join(few(marks), ["key", "tie"], "left")
    kept = marked.where("goes is null").select("row.*")
    if marks.where("not goes").isEmpty():
        return kept
    return kept.union(marked.where("not goes").dropDuplicates(["key", "tie"]).select("row.*"))
