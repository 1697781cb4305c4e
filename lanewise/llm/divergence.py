"""Source divergence audit: which sources of a language differ, and in which terms.

Terms are runs of letters. A first pass over the texts counts, in a count-min sketch
for each task, the documents of a language that hold a term. The sketches add up
cell by cell, so the merged one never shows less than the true frequency. A second
pass leaves out the terms that can't reach the frequency asked for before anything
is shuffled; what is left is counted exactly. Sources are then compared by a join of
the counts they share, and by a histogram of counts for all terms that only one of
the two has: a term that neither has costs nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, map_rows, utf8

#: Bytes to what they are as part of a term: A-Z lower-cased, else a space.
TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Cells to a row of the sketch, and rows: 12 MiB, whatever the corpus.
WIDTH, DEPTH = 1 << 22, 3
#: Cells that travel together.
BLOCK = 1 << 16
#: Distinct terms that a task holds before it hands them on: some 130 MB.
HELD = 800_000
#: Partial sums of a block that are merged apart before they are put together.
SALTS = 32
#: The scale of the shares, in two steps so that products stay in 64 bits.
SCALE, STEP = 10**9, 10**5


def cells(lang: bytes, terms: list[bytes], width: int, depth: int) -> np.ndarray:
    """The cell of each term in each row of the sketch, of shape (depth, terms):
    two halves of a hash, the second added once more for each row."""
    head = lang + b"\0"
    h = np.fromiter((xxhash.xxh3_64_intdigest(head + t) for t in terms), np.uint64, len(terms))
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([((low + np.uint64(k) * high) % np.uint64(width)).astype(np.int64) for k in range(depth)])


class Sketch:
    """Counts up to ``most``, which is all that a test against ``most`` needs."""

    def __init__(self, most: int, width: int, depth: int):
        self.most, self.cell = most, np.zeros((depth, width), np.uint8)

    def add(self, lang: bytes, counts: dict[bytes, int]) -> None:
        depth, width = self.cell.shape
        n = np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), self.most)
        for row, at in zip(self.cell, cells(lang, list(counts), width, depth)):
            where, of = np.unique(at, return_inverse=True)
            total = row[where] + np.bincount(of, n, len(where)).astype(np.int64)
            row[where] = np.minimum(total, self.most)

    def possible(self, lang: bytes, terms: list[bytes]) -> np.ndarray:
        """Whether a term may have ``most`` documents; never false where it has."""
        depth, width = self.cell.shape
        return np.min([row[at] for row, at in zip(self.cell, cells(lang, terms, width, depth))], axis=0) >= self.most


def _tally(into: dict[bytes, int], words) -> int:
    """Count ``words``; returns how many are new."""
    from collections import _count_elements

    before = len(into)
    _count_elements(into, words)
    return len(into) - before


def document_sketch(docs: DataFrame, least_docs: int, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """``(block, data)``: the merged sketch of document frequencies of ``docs(lang,
    text)``, block by block, compressed; blocks without a count are left out."""
    block = min(BLOCK, width)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sketch, held, n = Sketch(least_docs, width, depth), {}, 0

        def add():
            for lang, counts in held.items():
                sketch.add(lang, counts)
            held.clear()

        for batch in batches:
            for lang, text in zip(utf8(batch.column(0)), utf8(batch.column(1))):
                if words := set(text.translate(TERM).split()):
                    n += _tally(held.setdefault(lang, {}), words)
                if n > HELD:
                    add()
                    n = 0
        add()
        flat = sketch.cell.reshape(-1, block)
        some = np.flatnonzero(flat.any(axis=1))
        salt = TaskContext.get().partitionId() % SALTS
        for at in range(0, len(some), 16):
            part = some[at : at + 16]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array([salt] * len(part), pa.int32()), pa.array([zlib.compress(flat[k].tobytes(), 1) for k in part], pa.binary())],
                ["block", "salt", "data"],
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by block: one block is held at a time
        key, total, salt = None, None, 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([salt], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["block", "salt", "data"])
        for batch in batches:
            for k, s, data in zip(*(c.to_pylist() for c in batch.columns)):
                cell = np.frombuffer(zlib.decompress(data), np.uint8)
                if key is not None and (k, s) != (key, salt):
                    yield done()
                    key = None
                total = cell if key is None else np.minimum(total.astype(np.uint16) + cell, least_docs).astype(np.uint8)
                key, salt = k, s
        if key is not None:
            yield done()

    schema = "block int, salt int, data binary"
    parts = map_rows(docs.select("lang", "text"), count, schema)
    first = map_rows(parts.repartition("block", "salt").sortWithinPartitions("block", "salt"), merge, schema)
    last = first.withColumn("salt", F.lit(0)).repartition("block").sortWithinPartitions("block")
    return map_rows(last, merge, schema).select("block", "data")


def term_counts(docs: DataFrame, least_docs: int, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """``(lang, source, term, n, lang_n, first)`` of the terms in at least
    ``least_docs`` rows of their language: occurrences in the source and in the
    language, and whether this is the term's first source by code point."""
    block = min(BLOCK, width)
    cell = np.zeros(width * depth, np.uint8)
    # at most width * depth bytes
    for r in document_sketch(docs, least_docs, width, depth).toLocalIterator():
        cell[r["block"] * block : (r["block"] + 1) * block] = np.frombuffer(zlib.decompress(bytes(r["data"])), np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(cell)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(least_docs, width, depth)
        sketch.cell = sent.value.reshape(depth, width)
        held: dict[tuple[bytes, bytes], tuple[dict, dict]] = {}
        n = 0

        def hand_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (counts, rows) in held.items():
                if not counts:
                    continue
                terms = list(counts)
                keep = pa.array(sketch.possible(lang, terms))
                size = len(terms)
                columns = [
                    pa.array([lang], pa.binary()).cast(pa.string()).take(pa.array(np.zeros(size, np.int32))),
                    pa.array([source], pa.binary()).cast(pa.string()).take(pa.array(np.zeros(size, np.int32))),
                    pa.array(terms, pa.binary()).cast(pa.string()),
                    pa.array(np.fromiter(counts.values(), np.int64, size)),
                    pa.array(np.fromiter(map(rows.__getitem__, terms), np.int64, size)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"]).filter(keep)
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(utf8(c) for c in batch.columns)):
                words = text.translate(TERM).split()
                if words:
                    counts, rows = held.setdefault((lang, source), ({}, {}))
                    n += _tally(counts, words)
                    _tally(rows, set(words))
                if n > HELD:
                    yield from hand_on()
                    n = 0
        yield from hand_on()

    parts = map_rows(docs.select("lang", "source", "text"), count, "lang string, source string, term string, n bigint, docs bigint")
    # tasks have summed what they hold, so rows are dealt before they are summed again
    summed = parts.repartition("lang", "source", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # a term has as many rows here as its language has sources
    of = Window.partitionBy("lang", "term")
    return (
        summed.withColumns({"df": F.sum("docs").over(of), "lang_n": F.sum("n").over(of), "first": F.col("source") == F.min("source").over(of)})
        .where(F.col("df") >= least_docs)
        .select("lang", "source", "term", "n", "lang_n", "first")
    )


def share(n: Column, total: Column, smoothing: int = 1) -> Column:
    """``1 + floor(SCALE * (n + smoothing) / total)`` for ``n + smoothing <= total``,
    by long division in two steps: exact in 64 bits up to totals of 9e13."""
    whole = lambda a, b: F.call_function("div", a, b)
    a = F.lit(STEP) * (n + smoothing)
    rest = F.lit(SCALE // STEP)
    return F.lit(1) + rest * whole(a, total) + whole(rest * (a % total), total)


def divergence(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / q)``."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit_sources(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_docs: int = 3,
    smoothing: int = 1,
    most_terms: int = 200,
    width: int = WIDTH,
    depth: int = DEPTH,
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``, exact in all values.

    Part ``pair``: for each source of a language every other one, ``value`` being the
    sum of ``divergence(p, q)`` over the language's kept terms (in at least
    ``least_docs`` of its rows), p and q the smoothed shares of a term in the two.
    Part ``term``: the terms of a source with a greater share than in the whole
    language, the first ``most_terms`` of them. Ranks are by value, descending, then
    by the bytes of the item, and so have no ties.

    Null texts, languages and sources count as empty strings; a source without kept
    terms has pairs and no terms, a language without kept terms pairs of value 0;
    repeated rows count as rows; an empty table gives an empty one. Only the three
    columns are read. ``least_docs`` may be up to 255.

    The sketch has ``depth`` rows of ``width`` bytes, at the driver, in the broadcast
    and in each worker. It only saves shuffling: with many more distinct terms than
    cells fewer are discarded, and the result stays as it is.
    """
    if not 1 <= least_docs <= 255:
        raise ValueError("least_docs is between 1 and 255")
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), empty(text_col).alias("text"))
    counts = cut(term_counts(rows, least_docs, width, depth))

    # one row a source: occurrences, terms present, terms of its language
    by_source = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("present"), F.count_if("first").alias("firsts"))
    by_lang = by_source.groupBy("lang").agg(F.sum("firsts").alias("terms"), F.sum("total").alias("lang_total"))
    groups = rows.select("lang", "source").distinct().join(by_source.drop("firsts"), ["lang", "source"], "left").join(by_lang, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "present", "terms", "lang_total")])
    groups = cut(groups.withColumn("out_of", F.col("total") + F.lit(smoothing) * F.col("terms")))
    groups = groups.withColumn("none", F.when(F.col("terms") > 0, share(F.lit(0).cast("bigint"), F.col("out_of"), smoothing)))

    sized = groups.select("lang", "source", "out_of", "none", (F.col("lang_total") + F.lit(smoothing) * F.col("terms")).alias("lang_out_of"))
    shares = counts.join(sized, ["lang", "source"]).withColumns({"p": share(F.col("n"), F.col("out_of"), smoothing)})

    # what two sources share: the true value, less what the sums below put in its place
    col, f = F.col, divergence
    one = shares.select("lang", "term", col("source").alias("a"), col("p").alias("pa"), col("none").alias("za"))
    two = shares.select("lang", "term", col("source").alias("b"), col("p").alias("pb"), col("none").alias("zb"))
    met = one.join(two, ["lang", "term"]).where("a < b")
    pa_, pb_, za, zb = map(col, ("pa", "pb", "za", "zb"))
    both = met.groupBy("lang", "a", "b").agg(
        F.sum(f(pa_, pb_) - f(pa_, zb) - f(za, pb_) + f(za, zb)).alias("ab"), F.sum(f(pb_, pa_) - f(pb_, za) - f(zb, pa_) + f(zb, za)).alias("ba")
    )
    both = both.select("lang", F.explode(F.array(F.struct(col("a").alias("source"), col("b").alias("item"), col("ab").alias("s")), F.struct(col("b").alias("source"), col("a").alias("item"), col("ba").alias("s")))).alias("x")).select("lang", "x.*")

    # terms that a source has, each against a source that has none of them
    other = groups.select("lang", col("source").alias("item"), col("none").alias("zi"))
    bars = shares.groupBy("lang", "source", "p", "none").agg(F.count("*").alias("k"))
    against = bars.join(other, "lang").where(col("source") != col("item"))
    alone = against.groupBy("lang", "source", "item").agg(F.sum(col("k") * f(col("p"), col("zi"))).alias("mine"), F.sum(col("k") * f(col("zi"), col("p"))).alias("theirs"))
    sums = both.select("lang", "source", "item", "s").unionByName(alone.select("lang", "source", "item", col("mine").alias("s"))).unionByName(
        alone.select("lang", col("item").alias("source"), col("source").alias("item"), col("theirs").alias("s"))
    ).groupBy("lang", "source", "item").agg(F.sum("s").alias("s"))
    every = groups.select("lang", "source", "terms", "none", "present").join(
        groups.select("lang", col("source").alias("item"), col("none").alias("zi"), col("present").alias("has")), "lang"
    ).where(col("source") != col("item"))
    rest = (col("terms") - col("present") - col("has")) * f(col("none"), col("zi"))
    pairs = every.join(sums, ["lang", "source", "item"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce(F.coalesce("s", F.lit(0)) + rest, F.lit(0)).alias("value")
    )

    q = share(col("lang_n"), col("lang_out_of"), smoothing)
    terms = shares.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), col("term").alias("item"), f(col("p"), col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = pairs.withColumn("rank", place).unionByName(terms.withColumn("rank", place).where(col("rank") <= most_terms))
    return ranked
