"""Embedding whitening over a covariance that is computed in tiles.

Entries are quantised to integers, so that equal vectors are equal exactly and sums
have no rounding. The distinct vectors are packed into row blocks and each row block
into column blocks; a tile key is a pair of column blocks. Column blocks are
shuffled by row block, the two of a tile are centred and multiplied, products are
summed per tile, and the driver puts the tiles together and finds eigenvectors.
Only the matrix and vectors of its side ever reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_rows

#: Rows of a row block and columns of a column block: 256 KiB of integers.
BLOCK_ROWS, TILE = 2048, 16
#: The widest vectors: the driver holds a matrix of this side twice (256 MiB).
MOST_DIMENSIONS = 4096
#: Quantised entries lie within; larger ones count as not finite. Sums of 2^19 of
#: them and all differences stay exact.
MOST = 1 << 43


def quantised(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``(id, x array<bigint>)`` with ``x = floor(scale * entry)``; rows without a
    vector, or with an entry that is null, not finite or beyond ``MOST``, go."""
    v = F.col(vector_col).cast("array<double>")
    good = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * scale < MOST))
    kept = rows.select(F.col(id_col).alias("id"), v.alias("v")).where(F.coalesce(good, F.lit(False)))
    return kept.select("id", F.transform("v", lambda c: F.floor(c * float(scale))).alias("x"))


def matrix(column: pa.Array, side: int) -> np.ndarray:
    """The vectors of an Arrow list column, all of one length."""
    return np.asarray(column.flatten(), np.int64).reshape(-1, side)


def sums(fit: DataFrame, side: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums of the dimensions."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * side
        for batch in batches:
            x = matrix(batch.column(0), side)
            n += len(x)
            for at in range(0, len(x), 1 << 19):
                total = [a + b for a, b in zip(total, x[at : at + (1 << 19)].sum(axis=0).tolist())]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(side)], pa.int32()), pa.array([str(v) for v in (n, *total)])], ["k", "v"])

    found = map_rows(fit.select("x"), add, "k int, v string").groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    got = {r["k"]: int(r["v"]) for r in found.collect()}
    return got.get(-1, 0), [got.get(k, 0) for k in range(side)]


def column_blocks(fit: DataFrame, side: int) -> DataFrame:
    """``(rows, part, data)``: row blocks of up to ``BLOCK_ROWS`` vectors, each as
    column blocks of ``TILE`` dimensions. A row block is known by partition and
    place in it, which are the same whenever a materialised table is read."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def hand_on() -> pa.RecordBatch:
            x = np.concatenate(held)
            parts = range(-(-side // TILE))
            data = [np.ascontiguousarray(x[:, k * TILE : (k + 1) * TILE]).tobytes() for k in parts]
            return pa.RecordBatch.from_arrays([pa.array([number] * len(parts), pa.int64()), pa.array(parts, pa.int32()), pa.array(data, pa.binary())], ["rows", "part", "data"])

        for batch in batches:
            x = matrix(batch.column(0), side)
            while len(x):
                held.append(x[: BLOCK_ROWS - size])
                x = x[BLOCK_ROWS - size :]
                size += len(held[-1])
                if size == BLOCK_ROWS:
                    yield hand_on()
                    number, held[:], size = number + 1, [], 0
        if size:
            yield hand_on()

    return map_rows(fit.select("x"), pack, "rows bigint, part int, data binary")


def covariance(fit: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """Covariance of ``fit(x)``, divisor n, centred before multiplying."""
    side = len(total)
    mean = np.array([s / n for s in total])
    blocks = column_blocks(fit, side)
    tiles = blocks.withColumnsRenamed({"part": "i", "data": "left"}).join(blocks.withColumnsRenamed({"part": "j", "data": "right"}), "rows").where("i <= j")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task adds up what it has of a tile: no more than one matrix
        held: dict[tuple[int, int], np.ndarray] = {}

        def centred(data: bytes, part: int) -> np.ndarray:
            m = mean[part * TILE : (part + 1) * TILE]
            return np.frombuffer(data, np.int64).reshape(-1, len(m)) - m

        for batch in batches:
            for i, j, left, right in zip(*(c.to_pylist() for c in batch.columns)):
                product = centred(left, i).T @ centred(right, j)
                held[i, j] = held[i, j] + product if (i, j) in held else product
        for (i, j), tile in held.items():
            r, c = np.indices(tile.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(i * TILE + r, pa.int32()), pa.array(j * TILE + c, pa.int32()), pa.array(tile.ravel())], ["r", "c", "v"])

    cells = map_rows(tiles.select("i", "j", "left", "right"), multiply, "r int, c int, v double").groupBy("r", "c").agg(F.sum("v").alias("v"))
    out = np.zeros((side, side))
    for r, c, v in cells.toLocalIterator():
        out[r, c] = out[c, r] = v / n
    return out


@dataclass
class Whitener:
    """What was fitted. ``axes`` has a component to a column, by falling eigenvalue."""

    n: int
    total: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def side(self) -> int:
        return len(self.total)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates, by row and component; not a number where the
        component has no variance."""
        mean = np.array([s / self.n for s in self.total])
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.values > 0, 1 / np.sqrt(np.maximum(self.values, 0)), np.nan)
        return (x - mean) @ self.axes * scale

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of ``(n x - total)^2``, exact."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.total), default=0)
        if most * most * self.side < 1 << 63:
            return ((self.n * x - np.array(self.total, np.int64)) ** 2).sum(axis=1).tolist()
        return [sum((self.n * a - s) ** 2 for a, s in zip(row, self.total)) for row in x.tolist()]


def fit_whitener(fit: DataFrame, components: int = 4) -> Whitener:
    """Fit on ``fit(x)``, all of one length: means, covariance, the largest
    eigenvalues, and how far the covariance of what comes out is from the identity."""
    first = fit.select(F.size("x").alias("side")).first()
    side = first["side"] if first else 0
    if side > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {side} dimensions; the driver takes up to {MOST_DIMENSIONS}")
    n, total = sums(fit, side)
    if not n:
        return Whitener(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    v = covariance(fit, n, total)
    e, axes = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")[: min(components, side)]
    e, axes = e[order], axes[:, order]
    # below this an eigenvalue is the rounding of the matrix
    e = np.where(e > side * np.finfo(float).eps * max(float(e.max(initial=0)), 0), e, 0.0)
    axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)
    model = Whitener(n, total, e, axes, float(np.trace(v)))
    model.identity_error = identity_error(fit, model)
    return model


def identity_error(fit: DataFrame, model: Whitener) -> float | None:
    """Largest absolute entry of the whitened vectors' covariance less the identity,
    over components with variance; None if there are none."""
    some = np.flatnonzero(model.values > 0)
    if not len(some):
        return None

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(len(some)), np.zeros((len(some), len(some)))
        for batch in batches:
            w = model.project(matrix(batch.column(0), model.side))[:, some]
            first, second = first + w.sum(axis=0), second + w.T @ w
        values = np.concatenate([first, second.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], ["k", "v"])

    got = map_rows(fit.select("x"), add, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    values = np.array([r["v"] for r in sorted(got, key=lambda r: r["k"])]) / model.n
    mean = values[: len(some)]
    return float(np.abs(values[len(some) :].reshape(len(some), -1) - np.outer(mean, mean) - np.eye(len(some))).max())


def whiten(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, components: int = 4
) -> DataFrame:
    """One row for each row of ``rows`` that has a usable vector and each component:
    ``(id, component, n, deviation decimal(38,0), whitened, explained, identity_error)``.

    Vectors are quantised to ``floor(scale * entry)``. Rows go whose vector is null or
    empty, holds a null, an entry that isn't finite or one beyond 2^43 / scale, or has
    another length than most usable vectors (the greater of two that tie). Each
    distinct quantised vector counts once in the fit. Components are numbered from 1
    by falling eigenvalue, the sign is such that the entry of largest size is positive,
    and there are as many as dimensions if those are fewer. A component without
    variance (one distinct vector, say) has ``whitened`` null, and ``explained`` is null
    where nothing varies. Repeated rows and ids are kept; an empty table gives an empty
    one. ``deviation`` is null beyond 38 digits.
    """
    usable = quantised(rows, id_col, vector_col, scale)
    distinct = cut(usable.select("x").where(F.size("x") > 0).distinct())
    lengths = usable.groupBy(F.size("x").alias("side")).count().where("side > 0")
    best = lengths.agg(F.max_by("side", F.struct("count", "side"))).first()[0]
    fit = distinct.where(F.size("x") == F.lit(best or 0))
    model = fit_whitener(fit, components)
    some = model.side and len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), model.side)
            k = len(model.values)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), k)))
            deviation = pa.array([None if d >= 10**38 else str(d) for d in model.deviation(x)], pa.string())
            explained = model.values / model.trace if model.trace > 0 else np.full(k, np.nan)
            nan_null = lambda v: pa.array(v, pa.float64(), from_pandas=True)
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), deviation.take(pa.array(np.repeat(np.arange(len(x)), k))),
                    nan_null(model.project(x).ravel()), nan_null(np.tile(explained, len(x))),
                ],
                ["id", "component", "deviation", "whitened", "explained"],
            )

    kind = usable.schema["id"].dataType.simpleString()
    kept = usable.where(F.size("x") == F.lit(best or 0)) if some else usable.limit(0)
    out = map_rows(kept, run, f"id {kind}, component int, deviation string, whitened double, explained double")
    return out.select(
        "id", "component", F.lit(model.n).cast("bigint").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened", "explained",
        F.lit(model.identity_error).cast("double").alias("identity_error"),
    )
