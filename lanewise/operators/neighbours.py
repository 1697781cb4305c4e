"""Exact nearest neighbours with pivots and the triangle inequality.

Points belong to their nearest pivot and lie in blocks by their distance from it. A
query first looks into the block that suits it best, which bounds how far its k-th
neighbour can be; then only into blocks whose ring about a pivot comes within that
bound, and there only at points whose own distance from the pivot does. Pivots are
chosen by farthest point from a bounded sample; they change what is pruned and never
what is found.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..materialise import cut
from .aggregates import numbered

#: Points of a block, and queries that meet a block at once.
BLOCK, QUERIES = 1024, 512
#: Points of a group of a join, and pairs whose distances are taken at once.
CELL, PAIRS = 65_536, 65_536
#: Points from which the pivots are chosen.
SAMPLE = 4096
#: Bounds come from rounded distances and are relaxed by this share.
SLACK = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def choose_pivots(points: DataFrame, count: int, sample: int = SAMPLE) -> np.ndarray:
    """Pivots far from each other: from ``sample`` points taken by a hash, the first
    is the first of them and each further one is farthest from those before. Fewer
    distinct points than ``count`` give fewer pivots."""
    rows = points.orderBy(F.xxhash64("id"), "id").limit(sample).select(F.col("features").cast("array<double>").alias("f")).collect()
    if not rows:
        return np.zeros((0, 0))
    x = np.array([r["f"] for r in rows], np.float64)
    chosen = [0]
    near = ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(x)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``x`` from all rows of ``y``, a row of ``y`` at a time."""
    return np.sqrt(np.stack([((x - v) ** 2).sum(axis=1) for v in y], axis=1))


def blocks_by_pivot(points: DataFrame, pivots: np.ndarray, block: int = BLOCK) -> DataFrame:
    """``(block, pivot, low, high, n, ids, near, data)``: points of one pivot in order
    of their distance from it, up to ``block`` together. The order is by ranges of
    (pivot, distance), so a pivot with a large share of all points has many tasks."""
    sent = points.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = distances(_matrix(batch.column(1)), sent.value)
                best = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.int32()), pa.array(d[np.arange(len(d)), best])], ["id", "features", "pivot", "near"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def hand_on():
            nonlocal number, held
            ids, near, data = (np.concatenate(c) for c in zip(*[h[1:] for h in held]))
            columns = [[number], [held[0][0]], [float(near[0])], [float(near[-1])], [len(ids)], [ids.tobytes()], [near.tobytes()], [data.tobytes()]]
            number, held = number + 1, []
            kinds = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["block", "pivot", "low", "high", "n", "ids", "near", "data"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            pivot, near = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            at = 0
            while at < len(ids):
                # as far as the pivot and the block go
                end = at + int(np.searchsorted(pivot[at:], pivot[at], side="right"))
                if held and held[0][0] != int(pivot[at]):
                    yield hand_on()
                end = min(end, at + block - sum(len(h[1]) for h in held))
                held.append((int(pivot[at]), ids[at:end], near[at:end], x[at:end]))
                if sum(len(h[1]) for h in held) == block:
                    yield hand_on()
                at = end
        if held:
            yield hand_on()

    picked = points.select(F.col("id").cast("bigint").alias("id"), F.col("features").cast("array<double>").alias("features"))
    near = picked.mapInArrow(assign, "id bigint, features array<double>, pivot int, near double")
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(near).repartitionByRange(n, "pivot", "near", "id").sortWithinPartitions("pivot", "near", "id")
    return cut(ranged.mapInArrow(pack, "block bigint, pivot int, low double, high double, n int, ids binary, near binary, data binary"))


def _visit(pairs: DataFrame, queries: DataFrame, blocks: DataFrame, k: int, centre: np.ndarray) -> DataFrame:
    """Look for each ``pairs(q, block, bound)`` into the block: ``(q, id, d2, seen)``,
    its ``k`` nearest points there within the bound; ``seen`` on the first of them
    counts the distances that were computed."""
    most = QUERIES
    sized = pairs.join(queries, "q").withColumn("part", F.pmod(F.xxhash64("q"), F.greatest(F.lit(1), F.ceil(F.count("*").over(Window.partitionBy("block")) / (most / 2))).cast("bigint")))
    asked = sized.groupBy("block", "part").agg(F.collect_list(F.struct("q", "features", "bound")).alias("asked"))
    sent = pairs.sparkSession.sparkContext.broadcast(centre)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, pivot, ids, near, data in zip(batch.column(0), *(batch.column(i).to_pylist() for i in range(1, 5))):
                rows = asked.values
                ids, near = np.frombuffer(ids, np.int64), np.frombuffer(near, np.float64)
                x = np.frombuffer(data, np.float64).reshape(len(ids), -1)
                out = []
                for q, v, bound in zip(rows.field(0).to_pylist(), _matrix(rows.field(1)), rows.field(2).to_pylist()):
                    own = float(np.sqrt(((v - sent.value[pivot]) ** 2).sum()))
                    first, past = np.searchsorted(near, [(own - bound) * (1 - SLACK) - SLACK, (own + bound) * (1 + SLACK) + SLACK])
                    d = ((x[first:past] - v) ** 2).sum(axis=1)
                    order = np.lexsort((ids[first:past], d))[:k]
                    out += [(q, int(ids[first + i]), float(d[i]), int(past - first) if j == 0 else 0) for j, i in enumerate(order)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], ["q", "id", "d2", "seen"])

    met = asked.join(blocks.select("block", "pivot", "ids", "near", "data"), "block").select("asked", "pivot", "ids", "near", "data")
    return met.mapInArrow(look, "q bigint, id bigint, d2 double, seen bigint")


def neighbours_by_pivots(points: DataFrame, queries: DataFrame, k: int, pivots: int = 32, block: int = BLOCK) -> DataFrame:
    """The ``k`` nearest points of each query, exact: ``(q, id, d2, rank, seen)``.

    ``points(id, features)``, ``queries(q, features)``; ties go to the lower id, a
    query is matched with points of its own id too, and fewer points than ``k`` give
    fewer rows. ``seen`` is how many distances were computed for the query. Nothing
    but pivots reaches the driver; queries may be as many as points."""
    spark = points.sparkSession
    centre = choose_pivots(points, pivots)
    if not len(centre):
        return spark.createDataFrame([], "q bigint, id bigint, d2 double, rank int, seen bigint")
    blocks = blocks_by_pivot(points, centre, block)
    rings = cut(blocks.select("block", "pivot", "low", "high", "n"))
    sent = spark.sparkContext.broadcast(centre)
    asked = cut(queries.select(F.col("q").cast("bigint").alias("q"), F.col("features").cast("array<double>").alias("features")))

    def from_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = distances(_matrix(batch.column(1)), sent.value)
                m = d.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(batch.column(0).to_numpy(), m)), pa.array(np.tile(np.arange(m, dtype=np.int32), len(d))), pa.array(d.ravel()), pa.array(d.argsort(axis=1).argsort(axis=1).ravel(), pa.int32())],
                    ["q", "pivot", "own", "place"],
                )

    far = asked.mapInArrow(from_pivots, "q bigint, pivot int, own double, place int")
    gap = F.greatest(F.col("own") - F.col("high"), F.col("low") - F.col("own"), F.lit(0.0))
    # the best block of the three nearest pivots, one with k points if there is one
    first = far.where("place < 3").join(rings, "pivot").groupBy("q").agg(F.min_by("block", F.struct(F.col("n") < k, gap, "block")).alias("block"))
    first = cut(first.withColumn("bound", F.lit(float("inf"))))
    found = cut(_visit(first, asked, blocks, k, centre))
    bound = found.groupBy("q").agg(F.when(F.count("*") >= k, F.sqrt(F.max("d2"))).otherwise(float("inf")).alias("bound"))
    wide = rings.groupBy("pivot").agg(F.min("low").alias("least"), F.max("high").alias("most"))
    limit = F.col("bound") * (1 + SLACK) + SLACK
    # whole pivots fall first, then their blocks
    live = far.join(bound, "q", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))).join(F.broadcast(wide), "pivot")
    live = live.where(F.greatest(F.col("own") - F.col("most"), F.col("least") - F.col("own"), F.lit(0.0)) <= limit)
    rest = live.join(rings, "pivot").where(gap <= limit).select("q", "block", "bound").join(first.select("q", "block"), ["q", "block"], "left_anti")
    every = found.unionByName(_visit(rest, asked, blocks, k, centre))
    seen = F.sum("seen").over(Window.partitionBy("q")).alias("seen")
    ranked = every.select("q", "id", "d2", F.row_number().over(Window.partitionBy("q").orderBy("d2", "id")).alias("rank"), seen)
    return ranked.where(F.col("rank") <= k)


def _merge(held: tuple, more: tuple, k: int) -> tuple:
    """The ``k`` nearest of each row among two sets of ``(row, d2, id)``."""
    row, d, ids = (np.concatenate(c) for c in zip(held, more))
    order = np.lexsort((ids, d, row))
    row, d, ids = row[order], d[order], ids[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], d[keep], ids[keep]


def nearest_of_block(ids: np.ndarray, x: np.ndarray, others: Iterable[tuple[float, np.ndarray, np.ndarray]], k: int) -> tuple:
    """``(row, d2, id)``: the ``k`` nearest points to each row of ``x`` but itself, from
    ``others`` as ``(least distance, ids, points)`` by rising distance. A product of
    matrices says which may be near; their distances are then taken from differences."""
    held = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
    most, xx = np.full(len(x), np.inf), (x * x).sum(axis=1)
    for gap, names, y in others:
        if gap * (1 - SLACK) - SLACK > np.sqrt(most.max()):
            break
        yy = (y * y).sum(axis=1)
        d = x @ y.T
        d *= -2
        d += xx[:, None]
        d += yy
        # what rounding may add to both sides
        slack = 8 * (x.shape[1] + 8) * np.finfo(np.float64).eps * (xx + yy.max())
        limit = most
        if np.isinf(most).any() and len(y) > k:
            limit = np.fmin(most, np.partition(d, k, axis=1)[:, k])  # one of them may be the row itself
        row, col = np.nonzero(~(d > (limit + slack)[:, None]))
        other = ids[row] != names[col]
        row, col = row[other], col[other]
        for at in range(0, len(row), PAIRS):
            r, c = row[at : at + PAIRS], col[at : at + PAIRS]
            held = _merge(held, (r, ((y[c] - x[r]) ** 2).sum(axis=1), names[c]), k)
        full = np.bincount(held[0], minlength=len(x)) >= k
        ends = np.searchsorted(held[0], np.arange(len(x)), side="right") - 1
        most = np.where(full, held[1][ends] if len(held[1]) else np.inf, np.inf)
    return held


def nearest_join(points: DataFrame, k: int, pivots: int = 32, block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """Each point with its ``k`` nearest other ones: ``(q, id, d2, rank)``.

    All points meet all, so blocks are dealt to groups of at most about ``cell`` points
    and each group meets each in a task of its own: a point is sent to as many tasks as
    there are groups, and not to every block. In a task, blocks meet by rising distance
    of their rings until the next is too far."""
    spark = points.sparkSession
    centre = choose_pivots(points, pivots)
    if not len(centre):
        return spark.createDataFrame([], "q bigint, id bigint, d2 double, rank int")
    blocks = blocks_by_pivot(points, centre, block)
    total = blocks.agg(F.sum("n"), F.count("*")).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(-(-total[0] // cell), min(total[1], math.isqrt(tasks)))
    each = -(-total[1] // groups)
    place = numbered(blocks.select("block"), "block", "_nth").select("block", F.floor(F.col("_nth") / each).cast("int").alias("part"))
    placed = blocks.join(F.broadcast(place), "block")
    every = F.explode(F.sequence(F.lit(0), F.lit(-(-total[1] // each) - 1)))
    asked = placed.select(F.col("part").alias("row"), every.alias("col"), "pivot", "low", "high", "n", "ids", "data")
    given = placed.select(every.alias("row"), F.col("part").alias("col"), *[F.col(c).alias(c) for c in ("pivot", "low", "high", "n", "ids", "data")])
    apart = distances(centre, centre)

    def unpacked(table: pa.Table) -> list[tuple]:
        rows = zip(*(table.column(c).to_pylist() for c in ("pivot", "low", "high", "n", "ids", "data")))
        return [(p, low, high, np.frombuffer(ids, np.int64), np.frombuffer(data, np.float64).reshape(n, -1)) for p, low, high, n, ids, data in rows]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        others, out = unpacked(right), []
        for p, low, high, ids, x in unpacked(left):
            near = []
            for o, low2, high2, names, y in others:
                far = apart[p, o]
                near.append((max(0.0, far - high - high2, low - far - high2, low2 - far - high), names, y))
            row, d, found = nearest_of_block(ids, x, sorted(near, key=lambda b: b[0]), k)
            out.append((ids[row], found, d))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["q", "id", "d2"])

    met = asked.groupBy("row", "col").cogroup(given.groupBy("row", "col")).applyInArrow(meet, "q bigint, id bigint, d2 double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d2", "id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)
