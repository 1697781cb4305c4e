"""Area queries that read a part of a table: nodes and edges along a curve.

A place has a key on the Z-order curve, and tables are sorted and cut into files by
it. A disc is covered by a few intervals of keys, which reach Parquet as filters on
one column, so files and row groups outside are not read; the distance decides.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo

#: Bits of a key to an axis: cells of 0.0055 degrees of longitude, half of latitude.
BITS = 16
#: Intervals that a disc is covered by, at most; more are a closer fit.
MOST_INTERVALS = 48


def _spread(x: Column) -> Column:
    """The bits of a number, a zero after each."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return x


def curve_key(lon: Column, lat: Column, bits: int = BITS) -> Column:
    """Place on the Z-order curve over all longitudes and latitudes; places beyond
    them have the key of the edge, null ones have none."""
    side = 1 << bits
    cell = lambda v, low, span: F.least(F.greatest(F.floor((v - low) / span * side), F.lit(0)), F.lit(side - 1)).cast("bigint")
    key = _spread(cell(lon, -180.0, 360.0)).bitwiseOR(F.shiftleft(_spread(cell(lat, -90.0, 180.0)), 1))
    return F.when(lon.isNotNull() & lat.isNotNull(), key)


def covering(west: float, south: float, east: float, north: float, bits: int = BITS, most: int = MOST_INTERVALS) -> list[tuple[int, int]]:
    """Intervals of keys, both ends included, that hold every place of a box: cells
    are quartered, largest first, while there are no more than ``most`` of them."""
    # a cell is (level, x, y): a square of side 2^(bits - level) of key cells
    def box(level: int, x: int, y: int) -> tuple[float, float, float, float]:
        n = 1 << level
        return x / n * 360 - 180, y / n * 180 - 90, (x + 1) / n * 360 - 180, (y + 1) / n * 180 - 90

    def meets(cell: tuple[int, int, int]) -> bool:
        a, b, c, d = box(*cell)
        return a <= east and c >= west and b <= north and d >= south

    def inside(cell: tuple[int, int, int]) -> bool:
        a, b, c, d = box(*cell)
        return west <= a and c <= east and south <= b and d <= north

    done: list[tuple[int, int, int]] = []
    open_ = [(0, 0, 0)]
    while open_ and open_[0][0] < bits:
        next_ = []
        for cell in open_:
            if inside(cell):
                done.append(cell)
                continue
            level, x, y = cell
            next_ += [q for q in ((level + 1, 2 * x + i, 2 * y + j) for j in (0, 1) for i in (0, 1)) if meets(q)]
        if len(done) + len(next_) > most:
            break
        open_ = next_
    spans = []
    for level, x, y in done + open_:
        key = 0
        for k in range(level):
            key |= (x >> k & 1) << 2 * k | (y >> k & 1) << 2 * k + 1
        width = 2 * (bits - level)
        spans.append((key << width, (key + 1 << width) - 1))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def write_by_curve(rows: DataFrame, path: str, lon: str = "lon", lat: str = "lat", files: int | None = None, row_group_bytes: int = 8 << 20) -> None:
    """Write ``rows`` with their ``curve`` key, in files of neighbouring ranges of it,
    sorted. Ranges are chosen from a sample, so a crowded place has more files."""
    keyed = rows.withColumn("curve", curve_key(F.col(lon), F.col(lat)))
    dealt = keyed.repartitionByRange(files, "curve") if files else keyed.repartitionByRange("curve")
    dealt.sortWithinPartitions("curve").write.mode("overwrite").option("parquet.block.size", row_group_bytes).parquet(path)


def write_graph_by_curve(nodes: DataFrame, edges: DataFrame, path: str, **options) -> None:
    """Nodes by their place and edges by that of their start; edges carry the places
    of both ends, so an area query on them needs no join. Edges of which an end has
    no node are left out."""
    end = lambda side: nodes.select(F.col("node_id").alias(side), F.col("lon").alias(f"{side}_lon"), F.col("lat").alias(f"{side}_lat"))
    write_by_curve(nodes, f"{path}/nodes", **options)
    write_by_curve(edges.join(end("u"), "u").join(end("v"), "v"), f"{path}/edges", lon="u_lon", lat="u_lat", **options)


def disc_filter(lon: float, lat: float, radius_m: float) -> Column:
    """Intervals of ``curve`` that hold every place within a radius, as a condition."""
    dy = radius_m / 110_000.0
    low, high = max(-90.0, lat - dy), min(90.0, lat + dy)
    narrow = math.cos(math.radians(max(abs(low), abs(high))))
    dx = 360.0 if narrow < 1e-6 else min(360.0, dy / narrow)
    boxes = [(lon - dx, lon + dx)]
    if lon - dx < -180 or lon + dx > 180:  # over the date line: all longitudes
        boxes = [(-180.0, 180.0)]
    spans = [s for w, e in boxes for s in covering(w, low, e, high)]
    c = F.col("curve")
    return reduce(lambda a, b: a | b, [(c >= a) & (c <= b) for a, b in spans])


def nodes_in_disc(spark: SparkSession, path: str, lon: float, lat: float, radius_m: float) -> DataFrame:
    """Nodes within a radius, from a graph written by curve."""
    near = geo.haversine_m(F.col("lon"), F.col("lat"), F.lit(lon), F.lit(lat)) <= radius_m
    return spark.read.parquet(f"{path}/nodes").where(disc_filter(lon, lat, radius_m) & near).drop("curve")


def edges_in_disc(spark: SparkSession, path: str, lon: float, lat: float, radius_m: float) -> DataFrame:
    """Edges with both ends within a radius, from a graph written by curve."""
    near = lambda side: geo.haversine_m(F.col(f"{side}_lon"), F.col(f"{side}_lat"), F.lit(lon), F.lit(lat)) <= radius_m
    return spark.read.parquet(f"{path}/edges").where(disc_filter(lon, lat, radius_m) & near("u") & near("v")).drop("curve")
