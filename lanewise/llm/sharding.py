"""Sharding by longest-processing-time scheduling.

Groups that must stay together (equal texts) are sorted by size and each goes to
the least-loaded shard, taken from a heap. Groups of one size are alike to the
scheduler, so what reaches the driver is a run ``(size, number of groups)`` and
what goes back is how many of them each shard takes; groups are numbered within
their run on the executors and find their shard by that number. Sizes keep 12
significant bits (exact below 4,096 bytes, within 0.05 % above), so there are at
most 2,048 runs a doubling of the size, whatever the size of the corpus. A run of
more groups than a few per shard is dealt in one step with the same result.

A group larger than one shard's fair share can't stay whole if sizes are to be
near equal. It, and only it, is dealt by document into pieces of a fair share and
what is left, as few as will do, which are scheduled like groups.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Bytes counted for a document besides its text.
OVERHEAD = 16
#: Hash cells in which members of one run, group or shard are numbered.
CELLS = 1024
#: Documents to a cell when slots are numbered, about.
PER_CELL = 10_000


def schedule(runs: list[tuple[float, int]], shards: int) -> list[list[int]]:
    """Longest processing time first: ``runs`` are ``(size, count)``, the largest
    size first; for each the number of items that every shard takes. Of equally
    loaded shards the lower one is taken first."""
    loads, out = np.zeros(shards), []
    for size, count in runs:
        took = np.zeros(shards, dtype=np.int64)
        if count > 4 * shards and size > 0:
            # the level to which so many items fill the shards: whoever an item
            # lifts no higher takes it sooner than anyone takes one beyond
            low = np.sort(loads)
            level = (np.cumsum(low) + count * size) / np.arange(1, shards + 1)
            part = np.flatnonzero(level >= low)[-1]
            took = np.maximum(0, np.floor((level[part] - loads) / size * (1 - 1e-12))).astype(np.int64)
        heap = [(load, k) for k, load in enumerate((loads + took * size).tolist())]
        heapq.heapify(heap)
        for _ in range(count - int(took.sum())):
            load, k = heap[0]
            took[k] += 1
            heapq.heapreplace(heap, (load + size, k))
        loads = loads + took * size
        out.append(took.tolist())
    return out


def _numbered(df: DataFrame, by: str, cell: Column, order: list[str], name: str) -> DataFrame:
    """``name``: the place of a row among those of its ``by``, from 0, counted by
    hash cells first, so that no task holds all rows of one ``by``."""
    celled = df.withColumn("_cell", cell)
    before = celled.groupBy(by, "_cell").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select(by, "_cell", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(by, "_cell").orderBy(*order)) - 1
    return celled.withColumn("_inside", inside).join(before, [by, "_cell"]).withColumn(name, (F.col("_before") + F.col("_inside")).cast("bigint")).drop("_cell", "_before", "_inside")


def assign_shards(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = 40,
    order: tuple[Column, Column] | None = None,
    keep: list[Column] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``(id, size, crc, shard, slot)`` and ``keep``.

    ``size`` is the text's UTF-8 bytes plus 16, ``crc`` the CRC-32 of those
    bytes, ``slot`` counts from 0 without gaps within the shard: by ``order``, a
    coarse column (a file, say, whose rows one task can sort) and one within it,
    else by a hash. A null text has no bytes and is one group; repeated rows and
    ids are all placed; equal rows are interchangeable, so reruns agree. An empty
    table gives an empty one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = cut(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
            F.unhex(F.sha2(F.when(F.col(text_col).isNull(), F.lit("null")).otherwise(F.concat(F.lit("t"), text)), 256)).alias("key"),
            *([order[0].alias("_major"), order[1].alias("_minor")] if order else []),
            *[c.alias(f"_keep{i}") for i, c in enumerate(keep or [])],
        )
    )
    groups = cut(slim.groupBy("key").agg(F.count("*").alias("rows"), F.first("size").alias("one")).withColumn("bytes", F.col("rows") * F.col("one")))
    sums = groups.agg(F.sum("bytes"), F.sum("rows")).first()
    fair, rows = (sums[0] or 0) / shards, sums[1] or 0
    # fewer than ``shards`` rows: each has more than a shard's share
    split = cut(groups.where(F.col("bytes") > fair).select("key", F.greatest(F.floor(F.lit(fair) / F.col("one")), F.lit(1)).alias("each")))
    pieces = (
        groups.join(F.broadcast(split), "key", "left").withColumn("each", F.coalesce("each", "rows"))
        .withColumn("piece", F.explode(F.expr("sequence(0L, CAST(ceil(rows / each) AS BIGINT) - 1)")))
    )
    held = F.least(F.col("each"), F.col("rows") - F.col("piece") * F.col("each")) * F.col("one")
    spare = F.greatest(F.length(F.bin("bytes")) - 12, F.lit(0))
    units = (
        pieces.select("key", "piece", held.cast("bigint").alias("bytes")).withColumn("spare", spare.cast("int"))
        .select("key", "piece", "bytes", F.expr("shiftleft(shiftright(bytes, spare), spare)").alias("run"))
    )
    # at most 2,048 rows a doubling of the size
    runs = units.groupBy("run").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).orderBy(F.desc("run")).collect()
    took = schedule([(r["bytes"] / r["n"], r["n"]) for r in runs], shards)
    upto = docs.sparkSession.createDataFrame([(r["run"], np.cumsum(t).tolist()) for r, t in zip(runs, took)], "run bigint, upto array<bigint>")
    number = _numbered(units.select("key", "piece", "run"), "run", F.pmod(F.xxhash64("key", "piece"), F.lit(CELLS)), ["key", "piece"], "nth")
    placed = number.join(upto, "run").select("key", "piece", F.size(F.filter("upto", lambda x: x <= F.col("nth"))).alias("shard"))

    marked = slim.join(F.broadcast(split), "key", "left")
    in_pieces = _numbered(marked.where("each IS NOT NULL"), "key", F.pmod(F.xxhash64("id"), F.lit(CELLS)), ["id"], "nth")
    dealt = marked.where("each IS NULL").withColumn("piece", F.lit(0).cast("bigint")).drop("each").unionByName(
        in_pieces.withColumn("piece", F.floor(F.col("nth") / F.col("each"))).drop("nth", "each")
    )
    put = dealt.join(placed, ["key", "piece"])
    if order:
        cell, within = F.col("_major"), ["_minor", "id", "key"]
    else:
        cell, within = F.pmod(F.xxhash64("id", "key"), F.lit(max(1, rows // (shards * PER_CELL)))), ["id", "key"]
    out = _numbered(put, "shard", cell, within, "slot")
    return out.select("id", "size", "crc", "shard", "slot", *[F.col(f"_keep{i}").alias(docs.select(c).columns[0]) for i, c in enumerate(keep or [])])
