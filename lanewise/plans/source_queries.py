"""Queries that write what the tables give and read it back through the sources."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import geo, palette, traffic
from ..materialise import scratch
from ..operators import batch as B
from ..operators import decode as X
from ..operators import viewer as V
from ..sources import files as S
from ..sources import png
from . import adapters as A
from .chain_queries import _lined
from .columns import hav
from .registry import query, rounded

_LOCAL = "(ts + INTERVAL 6 HOUR)"


@query(
    """SELECT edge_id, CASE level WHEN 1 THEN 55E0 WHEN 2 THEN 85E0 WHEN 3 THEN 105E0 ELSE 25E0 END AS weight,
      CASE WHEN level IS NULL THEN 'predicted' ELSE 'observed' END AS source, CASE WHEN level IS NULL THEN -1 ELSE 0 END AS hops FROM edges LEFT JOIN today USING (edge_id)""",
    ("edges", "today"),
)
def weights_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Today's weight table, written as gzip CSV and read back with its types."""
    level = F.coalesce("level", F.lit(0))
    seen = A.edges(spark, sf_dir).select("edge_id").join(A.today(spark, sf_dir), "edge_id", "left")
    given = {
        "edge_id": F.col("edge_id"), "weight": F.element_at(F.array(*[F.lit(x) for x in traffic.LADDER]), level + 1),
        "source": F.when(F.col("level").isNull(), "predicted").otherwise("observed"), "hops": F.when(F.col("level").isNull(), -1).otherwise(0),
    }
    names = [(c.split()[0], c.split()[1]) for c in schemas.COMPLETE.split(", ")]
    full = seen.select(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in names])
    S.write_weights(full, folder := scratch(spark))
    return S.read_weights(spark, folder, ["edge_id", "weight", "source", "hops"])


@query(f"SELECT edge_id, ts, level, painted, CAST({_LOCAL} AS DATE) AS day FROM readings", ("readings",))
def readings_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All readings, written by local day and read back."""
    S.write_readings(A.readings(spark, sf_dir), folder := scratch(spark))
    return S.read_readings(spark, folder).select("edge_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "level", "painted", "day")


@query(
    f"""SELECT highway, CAST(sum(CASE WHEN m <= 2000 THEN 1 ELSE ceil(m / 2000) - CASE WHEN m - (ceil(m / 2000) - 1) * 2000 < 20 THEN 1 ELSE 0 END END) AS BIGINT) AS pieces, round(sum(m) / 1000) AS km
    FROM (SELECT highway, {hav("a.lon", "a.lat", "b.lon", "b.lat")} AS m FROM edges e JOIN nodes a ON a.node_id = e.u JOIN nodes b ON b.node_id = e.v) GROUP BY highway""",
    ("nodes", "edges"),
)
def chained_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges cut into chains of two kilometres at most: how many, and that none is lost."""
    e = _lined(spark, sf_dir, "u", "v", "highway", "free_flow_kmph")
    cut = X.chain_edges(e, 2000.0)
    return cut.groupBy("highway").agg(F.count("*").alias("pieces"), F.round(F.sum("length_m") / 1000).alias("km"))


_ZOOM = 13
_AT = f"""CAST(floor((lon + 180) / 360 * {2.0**_ZOOM}) AS BIGINT) AS x, CAST(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * {2.0**_ZOOM}) AS BIGINT) AS y"""


@query(
    f""", counted AS (SELECT x, y, count(*) AS n FROM (SELECT {_AT} FROM nodes) GROUP BY ALL),
    expected AS (SELECT x, y FROM (SELECT unnest(range((SELECT min(x) FROM counted), (SELECT max(x) FROM counted) + 1)) AS x), (SELECT unnest(range((SELECT min(y) FROM counted), (SELECT max(y) FROM counted) + 1)) AS y))
    SELECT x, y, CASE WHEN n IS NULL OR n % 7 = 0 THEN NULL WHEN n % 5 > 0 THEN 1E0 ELSE 0E0 END AS opaque_frac,
      CASE WHEN n IS NULL OR n % 7 = 0 THEN NULL WHEN n % 5 > 0 THEN 1E0 ELSE 0E0 END AS traffic_frac,
      CASE WHEN n IS NULL THEN 'missing' WHEN n % 7 = 0 THEN 'damaged' ELSE 'ok' END AS status FROM expected LEFT JOIN counted USING (x, y)""",
    ("nodes",),
)
def audited_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles painted by how many junctions they hold, some of them damaged, against
    all that the junctions' box should have."""
    lon, lat = F.col("lon"), F.col("lat")
    counted = A.nodes(spark, sf_dir).groupBy(F.floor(geo.lon_to_tx(lon, _ZOOM)).alias("x"), F.floor(geo.lat_to_ty(lat, _ZOOM)).alias("y")).agg(F.count("*").alias("n"))

    def paint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fills = {c: rgb for c, rgb in reversed(palette.PALETTE)}
        for batch in batches:
            out = []
            for n in batch.column(2).to_pylist():
                image = np.zeros((32, 32, 4), np.uint8)
                if n % 5:
                    image[...] = (*fills[n % 5], 255)
                out.append(b"damaged" if n % 7 == 0 else png.encode(image))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["x", "y", "content"])

    tiles = counted.mapInArrow(paint, "x bigint, y bigint, content binary")
    ends = counted.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    expected = ends.select(F.explode(F.sequence("x0", "x1")).alias("x"), "y0", "y1").select("x", F.explode(F.sequence("y0", "y1")).alias("y"))
    return X.audit_tiles(expected, tiles).select("x", "y", "opaque_frac", "traffic_frac", "status")


@query(f"SELECT DISTINCT strftime({_LOCAL}, '%Y-%m-%d') AS capture FROM readings WHERE day(CAST({_LOCAL} AS DATE)) % 2 = 0 AND level < 3", ("readings",))
def republished_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame a day is published; then every second day's levels change, and only
    those days in which one does are published again."""
    day = F.date_format(F.col("ts") + F.expr("INTERVAL 6 HOUR"), "yyyy-MM-dd")
    frames = A.readings(spark, sf_dir).select(day.alias("capture"), F.xxhash64("edge_id", "ts").alias("line"), F.col("level").alias("code"))
    folder = scratch(spark)
    B.publish(frames, folder)
    even = F.dayofmonth(F.to_date("capture")) % 2 == 0
    changed = frames.withColumn("code", F.when(even, F.least(F.col("code") + 1, F.lit(3))).otherwise(F.col("code")))
    return B.publish(changed, folder).select("capture")


@query(
    """, caps AS (SELECT ts, strftime(ts, '%Y-%m-%d %H') AS name, hour(ts) % 3 <> 0 AS processed FROM (SELECT DISTINCT ts FROM readings)),
    here AS (SELECT name, ts FROM caps ORDER BY ts DESC LIMIT 1 OFFSET 9)
    SELECT name, CAST(step AS INTEGER) AS step FROM (SELECT c.name, row_number() OVER (ORDER BY c.ts <= h.ts, c.ts, c.name) AS step FROM caps c, here h WHERE c.processed) WHERE step <= 60""",
    ("readings",),
)
def loaded_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a viewer loads after the tenth capture from the end, round the end."""
    ts = F.col("ts")
    caps = A.readings(spark, sf_dir).select("ts").distinct().select("ts", F.date_format(ts, "yyyy-MM-dd HH").alias("name"), (F.hour(ts) % 3 != 0).alias("processed"))
    here = caps.orderBy(F.desc("ts")).limit(10).agg(F.min_by("name", "ts")).first()[0]
    return V.frames_ahead(caps, here)


@query(
    """, caps AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d %H') AS name, strftime(ts, '%Y-%m-%dT%H:00:00Z') AS slot, hour(ts) AS h FROM readings)
    SELECT name, CASE WHEN h % 2 = 0 THEN 'tables/' || name WHEN slot = (SELECT max(slot) FROM caps) THEN 'served' END AS source FROM caps""",
    ("readings",),
)
def sources_of_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a capture's frame comes from its own table, from what is served or from nowhere."""
    ts = F.col("ts")
    caps = A.readings(spark, sf_dir).select(F.date_format(ts, "yyyy-MM-dd HH").alias("name"), F.date_format(ts, "yyyy-MM-dd'T'HH:00:00'Z'").alias("captured_utc"), F.hour(ts).alias("h")).distinct()
    tables = caps.select("name", F.concat(F.lit("tables/"), "name").alias("path"), (F.col("h") % 2 == 0).alias("has_hops"))
    last = caps.agg(F.max("captured_utc")).first()[0]
    return V.frame_sources(caps.select("name", "captured_utc"), tables, last).select("name", "source")
