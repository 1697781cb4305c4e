"""Samples of a road graph, written once and joined to the tiles of any capture.

Where a road is looked at depends on the graph and not on the capture. A batch of
roads is sampled and packed by tile where it is, so what is shuffled is packed rows;
they are written as a table of buckets by tile. Tiles come dealt into the same buckets,
so the join moves tiles only and never a sample, for one capture or for as many as a
batch has. A tile with very many samples lies in several slots, each in a bucket of its
own, and goes to all of them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..materialise import small_batches
from .decode import SeenClasses, lay_points, weights_of_votes
from .graph import graph_id

#: Roads in a row with how many samples each has there, and the places ``i << 16 | j`` of these.
ROW = "tx INT, ty INT, edges ARRAY<BIGINT>, sizes ARRAY<INT>, places ARRAY<INT>"
PACKED = "tx INT, ty INT, slot INT, edges ARRAY<BIGINT>, sizes ARRAY<INT>, places ARRAY<INT>"
#: Samples of a row, about, and of a slot. A reader of Parquet holds 4,096 rows at once, so they are small.
MOST_PACKED, SLOT = 1024, 1 << 20


@dataclass
class SampleStore:
    """A bucketed table of packed samples and a table of how many each edge has."""

    spark: SparkSession
    table: str
    counts_path: str
    buckets: int
    slots_path: str
    divided: bool = False

    def packed(self) -> DataFrame:
        return self.spark.table(self.table)

    def counts(self) -> DataFrame:
        return self.spark.read.parquet(self.counts_path)

    def slots(self) -> DataFrame:
        """``(tx, ty, slots)``."""
        return self.spark.read.parquet(self.slots_path)


def _row(tx: int, ty: int, edges: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t)) for x, t in ((edges, pa.int64()), (sizes, pa.int32()), (places, pa.int32()))]
    return pa.RecordBatch.from_arrays([pa.array([tx], pa.int32()), pa.array([ty], pa.int32()), *lists], ["tx", "ty", "edges", "sizes", "places"])


def pack(ids: np.ndarray, first: np.ndarray, lon: np.ndarray, lat: np.ndarray, zoom: int, step_m: float, trim_m: float, tile_px: int, offset_px: float) -> Iterator[pa.RecordBatch]:
    """Rows of ``ROW``: the places that samples of these lines look at, as ``place_samples``
    has them. The samples that a road has in a tile stay together."""
    line, x, y, dlon, dlat = lay_points(first, lon, lat, step_m, trim_m)
    length = np.sqrt(dlon * dlon + dlat * dlat)
    norm = np.where(length > 0, length, 1.0)
    a = np.radians(y)
    px = (x + 180.0) / 360.0 * 2.0**zoom * tile_px - dlat / norm * offset_px
    py = (1.0 - np.log(np.tan(a) + 1.0 / np.cos(a)) / math.pi) / 2.0 * 2.0**zoom * tile_px - dlon / norm * offset_px
    tx, ty = (np.nan_to_num(np.floor(c / tile_px)).astype(np.int64) for c in (px, py))
    i, j = (np.nan_to_num(c - t * tile_px).astype(np.int64) for c, t in ((px, tx), (py, ty)))
    place = (i << 16 | j).astype(np.uint32).view(np.int32)
    order = np.lexsort((line, ty, tx))
    tx, ty, line, place = tx[order], ty[order], line[order], place[order]
    new_tile = np.concatenate(([True], (np.diff(tx) != 0) | (np.diff(ty) != 0)))
    runs = np.flatnonzero(new_tile | np.concatenate(([True], np.diff(line) != 0)))  # of a road in a tile
    sizes = np.diff(np.concatenate((runs, [len(line)])))
    tiles = np.concatenate((np.flatnonzero(new_tile[runs]), [len(runs)]))
    for low, high in zip(tiles[:-1], tiles[1:]):
        for at in _parts(sizes[low:high]):
            r = slice(low + at.start, low + at.stop)
            start, stop = runs[r.start], runs[r.stop - 1] + sizes[r.stop - 1]
            yield _row(tx[start], ty[start], ids[line[runs[r]]], sizes[r], place[start:stop])


def _parts(sizes: np.ndarray, most: int = MOST_PACKED) -> Iterator[slice]:
    """Runs in a row, of about ``most`` samples together."""
    part = (np.cumsum(sizes) - 1) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    return (slice(a, b) for a, b in zip(cuts[:-1], cuts[1:]))


def packed_rows(edges: DataFrame, zoom: int, step_m: float, trim_m: float, tile_px: int, offset_px: float) -> DataFrame:
    """Rows of ``ROW`` from each batch of ``edges(edge_id, geometry)``; an edge without
    geometry has no samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shape = batch.column(1)
            lon, lat = (c.to_numpy(zero_copy_only=False).astype(np.float64) for c in shape.flatten().flatten())
            if len(lon):
                first = np.concatenate(([0], np.cumsum(shape.value_lengths().to_numpy())))
                yield from pack(batch.column(0).to_numpy(), first, lon, lat, zoom, step_m, trim_m, tile_px, offset_px)

    g = F.col("geometry")
    g = F.when(F.size(g) == 1, F.concat(g, g)).otherwise(g)
    point = lambda p: F.struct(p["lon"].cast("double").alias("lon"), p["lat"].cast("double").alias("lat"))
    whole = lambda p: p["lon"].isNotNull() & p["lat"].isNotNull()
    lines = edges.where(F.col("edge_id").isNotNull() & (F.size("geometry") > 0) & F.forall("geometry", whole))
    lines = lines.select(F.col("edge_id").cast("bigint").alias("edge_id"), F.transform(g, point).alias("geometry"))
    small_batches(lines)
    return lines.mapInArrow(run, ROW)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``PACKED`` in their order; those of a slot that follow each other are put
    together up to about ``MOST_PACKED`` samples."""

    def out(key: tuple, held: list[tuple]) -> pa.RecordBatch:
        row = _row(key[0], key[1], *(np.concatenate(c) for c in zip(*held)))
        return pa.RecordBatch.from_arrays([*row.columns[:2], pa.array([key[2]], pa.int32()), *row.columns[2:]], ["tx", "ty", "slot", "edges", "sizes", "places"])

    held, last, n = [], None, 0
    for batch in batches:
        for k, key in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
            if held and (key != last or n >= MOST_PACKED):
                yield out(last, held)
                held, n = [], 0
            held.append(tuple(batch.column(c)[k].values.to_numpy() for c in (3, 4, 5)))
            last, n = key, n + len(held[-1][2])
    if held:
        yield out(last, held)


def store_samples(
    edges: DataFrame, folder: str, zoom: int, step_m: float = 5.0, trim_m: float = 10.0, tile_px: int = 256, offset_px: float = 4.0, buckets: int = 64, slot: int = SLOT
) -> SampleStore:
    """Write the samples of ``edges`` below ``folder``, unless they are there for this
    graph and these settings, and name the table.

    The folder's name holds the graph's fingerprint (``edge_id``, ``u``, ``v`` and
    ``length_m`` where the edges have them, else id and geometry). A write that was
    broken off has no mark and is made again. A tile has a slot for every ``slot`` samples."""
    spark = edges.sparkSession
    if {"u", "v", "length_m"} <= set(edges.columns):
        mark = graph_id(edges).first()["graph_id"]
    else:
        mark = "{0:016x}".format(edges.agg(F.bit_xor(F.xxhash64("edge_id", "geometry"))).first()[0] or 0).replace("-", "n")
    path = f"{folder}/places-{mark}-{zoom}-{step_m:g}-{trim_m:g}-{tile_px}-{offset_px:g}-{buckets}"
    name = f"samples_{zlib.crc32(path.encode()):08x}_{mark}"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/loose")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/counts/_SUCCESS")):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        packed_rows(edges, zoom, step_m, trim_m, tile_px, offset_px).write.mode("overwrite").parquet(f"{path}/loose")
        loose = spark.read.parquet(f"{path}/loose")
        samples = F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda n, x: n + x))
        loose.groupBy("tx", "ty").agg(F.ceil(samples / slot).cast("int").alias("slots")).write.mode("overwrite").parquet(f"{path}/slots")
        dealt = loose.join(F.broadcast(spark.read.parquet(f"{path}/slots")), ["tx", "ty"])
        dealt = dealt.select("tx", "ty", F.pmod(F.xxhash64(F.col("edges")[0]), F.col("slots")).cast("int").alias("slot"), "edges", "sizes", "places")
        small_batches(dealt)
        packed = dealt.repartition(buckets, "tx", "ty", "slot").sortWithinPartitions("tx", "ty", "slot").mapInArrow(_merged, PACKED)
        packed.write.mode("overwrite").option("path", f"{path}/packed").format("parquet").bucketBy(buckets, "tx", "ty", "slot").sortBy("tx", "ty", "slot").saveAsTable(name)
        each = loose.select(F.explode(F.arrays_zip("edges", "sizes")).alias("e")).groupBy(F.col("e.edges").alias("edge_id"))
        each.agg(F.sum("e.sizes").cast("int").alias("n_samples")).write.mode("overwrite").parquet(f"{path}/counts")  # last: its mark says that all is there
        fs.delete(at, True)
    # a new session knows the files and not the table
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({PACKED}) USING parquet CLUSTERED BY (tx, ty, slot) SORTED BY (tx, ty, slot) INTO {buckets} BUCKETS LOCATION '{path}/packed'")
    store = SampleStore(spark, name, f"{path}/counts", buckets, f"{path}/slots")
    store.divided = not store.slots().where("slots > 1").isEmpty()
    return store


def tile_join(store: SampleStore, tiles: DataFrame) -> DataFrame:
    """Each of ``tiles(x, y, content, ...)`` with the samples that look at it. Tiles
    are dealt into the store's buckets; samples stay where they are."""
    keyed = tiles.withColumns({"tx": F.col("x").cast("int"), "ty": F.col("y").cast("int")}).drop("x", "y")
    if store.divided:
        keyed = keyed.join(F.broadcast(store.slots().where("slots > 1")), ["tx", "ty"], "left")
    else:
        keyed = keyed.withColumn("slots", F.lit(1))
    # not a literal, which would leave the keys of the join
    keyed = keyed.withColumn("slot", F.explode(F.sequence(F.lit(0), F.coalesce("slots", F.lit(1)) - 1))).drop("slots")
    return store.packed().join(keyed.repartition(store.buckets, "tx", "ty", "slot"), ["tx", "ty", "slot"])


def tile_votes(store: SampleStore, tiles: DataFrame, window: int = 1) -> DataFrame:
    """``(capture, edge_id, some, c1, c2, c3, c4)`` of ``tiles(capture, x, y,
    content)``: samples of a class for each road that shows one. A tile is decoded once
    for each of its rows of samples, at most; damaged ones show nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = SeenClasses(window)
        for batch in batches:
            for capture, edges, sizes, places, content in zip(*(batch.column(k) for k in range(5))):
                edges, sizes, places = (x.values.to_numpy() for x in (edges, sizes, places))
                cls = seen(content.as_py(), places >> 16 & 0xFFFF, places & 0xFFFF)
                votes = np.bincount(np.repeat(np.arange(len(edges)), sizes) * 5 + cls, minlength=5 * len(edges)).reshape(-1, 5)[:, 1:]
                if len(some := np.flatnonzero(votes.any(axis=1))):
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(capture.as_py(), pa.string()), len(some)), pa.array(edges[some]), *(pa.array(votes[some, c].astype(np.int64)) for c in range(4))], ["capture", "edge_id", "c1", "c2", "c3", "c4"])

    joined = tile_join(store, tiles).select(F.col("capture").cast("string").alias("capture"), "edges", "sizes", "places", "content")
    small_batches(joined)
    each = joined.mapInArrow(run, "capture string, edge_id bigint, c1 bigint, c2 bigint, c3 bigint, c4 bigint")
    names = [f"c{k}" for k in (1, 2, 3, 4)]
    summed = each.groupBy("capture", "edge_id").agg(*[F.sum(c).alias(c) for c in names])
    return summed.withColumn("some", F.col("c1") + F.col("c2") + F.col("c3") + F.col("c4"))


def decode_captures(store: SampleStore, tiles: DataFrame, window: int = 1, least_coverage: float = 0.25) -> DataFrame:
    """The weight tables of many captures at once: ``capture`` and the columns of
    ``edge_votes``, for the roads of which a capture shows something."""
    per = tile_votes(store, tiles, window).join(store.counts(), "edge_id")
    return weights_of_votes(per, least_coverage, "capture")


def decode_capture(store: SampleStore, tiles: DataFrame, window: int = 1, least_coverage: float = 0.25) -> DataFrame:
    """The weight table of one capture ``tiles(x, y, content)``, a row for each edge
    that has samples."""
    votes = tile_votes(store, tiles.select(F.lit("").alias("capture"), "x", "y", "content"), window).drop("capture")
    return weights_of_votes(store.counts().join(votes, "edge_id", "left").na.fill(0), least_coverage)
