"""Queries of whole chains: elements to graph, tiles to weights, weights to frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, palette, traffic
from ..materialise import scratch
from ..operators import batch as B
from ..operators import decode as X
from ..operators import demand as D
from ..operators import graph as G
from ..operators import lines as L
from ..operators import planning as P
from ..operators import sample_store as Z
from ..sources import png
from ..streaming import captures as C
from . import adapters as A
from .columns import hav
from .graph_queries import _PAINTED, _REACH, _painted
from .registry import query, rounded

# Elements: a way per order over three junctions and two points of its own, some
# of which are missing.

_ELEMENTS = """, points AS (
  SELECT node_id AS node, lon, lat FROM nodes
  UNION ALL SELECT 10000000 + o_orderkey, 90.33E0 + CAST((o_orderkey * 4421) % 10000 AS DOUBLE) / 10000E0 * 0.16E0, 23.72E0 + CAST((o_orderkey * 3571) % 10000 AS DOUBLE) / 10000E0 * 0.18E0 FROM orders WHERE o_orderkey % 3 <> 0
), ways AS (
  SELECT o_orderkey AS way, [o_custkey, 10000000 + o_orderkey, (o_custkey * 31 + o_orderkey * 17 + 1) % (SELECT count(*) FROM customer), 20000000 + o_orderkey, (o_custkey * 5 + o_orderkey * 3 + 2) % (SELECT count(*) FROM customer)] AS ns,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'primary' WHEN '2' THEN 'secondary_link' WHEN '3' THEN 'tertiary' WHEN '4' THEN 'residential' ELSE 'footway' END AS highway,
    CASE o_orderkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN '-1' WHEN 2 THEN 'no' END AS oneway, CASE WHEN o_orderkey % 4 < 2 THEN (o_orderkey % 3 + 1)::VARCHAR || ';9' END AS lanes
  FROM orders
)"""


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    schema = "STRING"
    node = lambda df: df.selectExpr("'node' AS type", "id", "lon", "lat", "CAST(NULL AS ARRAY<BIGINT>) AS nodes", f"CAST(NULL AS MAP<{schema}, {schema}>) AS tags")
    own = o.where("o_orderkey % 3 <> 0").selectExpr(
        "10000000 + o_orderkey AS id", "90.33E0 + CAST((o_orderkey * 4421) % 10000 AS DOUBLE) / 10000E0 * 0.16E0 AS lon", "23.72E0 + CAST((o_orderkey * 3571) % 10000 AS DOUBLE) / 10000E0 * 0.18E0 AS lat"
    )
    ways = o.selectExpr(
        "'way' AS type", "o_orderkey AS id", "CAST(NULL AS DOUBLE) AS lon", "CAST(NULL AS DOUBLE) AS lat",
        f"array(o_custkey, 10000000 + o_orderkey, (o_custkey * 31 + o_orderkey * 17 + 1) % {n}, 20000000 + o_orderkey, (o_custkey * 5 + o_orderkey * 3 + 2) % {n}) AS nodes",
        "map_filter(map('highway', CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'primary' WHEN '2' THEN 'secondary_link' WHEN '3' THEN 'tertiary' WHEN '4' THEN 'residential' ELSE 'footway' END, "
        "'oneway', CASE o_orderkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN '-1' WHEN 2 THEN 'no' END, 'lanes', CASE WHEN o_orderkey % 4 < 2 THEN concat(CAST(o_orderkey % 3 + 1 AS STRING), ';9') END), (k, v) -> v IS NOT NULL) AS tags",
    )
    return node(A.nodes(spark, sf_dir).withColumnRenamed("node_id", "id")).union(node(own)).union(ways)


@query(
    _ELEMENTS + f""", kept AS (SELECT *, replace(highway, '_link', '') AS base FROM ways WHERE highway <> 'footway'),
    used AS (SELECT way, pos, p.node, lon, lat FROM (SELECT way, unnest(ns) AS node, generate_subscripts(ns, 1) AS pos FROM kept) w JOIN points p ON p.node = w.node),
    ended AS (SELECT *, pos = min(pos) OVER (PARTITION BY way) OR pos = max(pos) OVER (PARTITION BY way) AS is_end FROM used),
    uses AS (SELECT node, count(*) + count(*) FILTER (is_end) AS n FROM ended GROUP BY node),
    steps AS (
      SELECT e.way, e.pos, e.node, lead(e.node) OVER w AS next_node, sum((e.is_end OR u.n >= 2)::INT) OVER w AS piece,
        {hav("e.lon", "e.lat", "lead(e.lon) OVER w", "lead(e.lat) OVER w")} AS metres
      FROM ended e JOIN uses u ON u.node = e.node WINDOW w AS (PARTITION BY e.way ORDER BY e.pos)
    ),
    pieces AS (SELECT way, piece, arg_min(node, pos) AS a, arg_max(next_node, pos) AS b, sum(metres) AS length_m FROM steps WHERE next_node IS NOT NULL GROUP BY way, piece),
    sided AS (
      SELECT p.*, k.base, k.oneway, CAST(split_part(k.lanes, ';', 1) AS INTEGER) AS tagged, s.side FROM pieces p JOIN kept k USING (way), (VALUES (0), (1)) s(side)
      WHERE a <> b AND CASE WHEN s.side = 0 THEN coalesce(k.oneway, '') <> '-1' ELSE coalesce(k.oneway, '') <> 'yes' END
    ),
    classes(base, cap, speed, lanes) AS (VALUES ('primary', 1200, 50E0, 2), ('secondary', 1000, 40E0, 2), ('tertiary', 800, 35E0, 2), ('residential', 500, 25E0, 1))
    SELECT way, piece::BIGINT AS piece, CAST(side AS INTEGER) AS side, CASE side WHEN 0 THEN a ELSE b END AS u, CASE side WHEN 0 THEN b ELSE a END AS v, coalesce(oneway, '') IN ('yes', '-1') AS oneway,
      CAST(coalesce(tagged, c.lanes) AS INTEGER) AS lanes, round(length_m, 3) AS length_m, CAST(c.cap * coalesce(tagged, c.lanes) AS DOUBLE) AS capacity_vph, round(length_m / (c.speed / 3.6), 3) AS free_flow_s
    FROM sided JOIN classes c USING (base)""",
    ("nodes",),
)
def graph_from_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways cut at junctions into directed edges with their class's defaults."""
    g = G.edges_from_elements(_elements(spark, sf_dir))
    return g.select(
        "way", F.col("piece").cast("bigint").alias("piece"), "side", "u", "v", "oneway", F.col("lanes").cast("int").alias("lanes"),
        rounded("length_m", 3).alias("length_m"), "capacity_vph", rounded("free_flow_s", 3).alias("free_flow_s"),
    )


# Samples and decoding: edges are straight lines, tiles are painted in one colour.

_STEP, _ZOOM = 500, 12
_SIZE = float(2**_ZOOM * 256)
_SAMPLES = f""", lined AS (
  SELECT e.edge_id, a.lon AS x0, a.lat AS y0, b.lon - a.lon AS dlon, b.lat - a.lat AS dlat, {hav("a.lon", "a.lat", "b.lon", "b.lat")} AS metres FROM edges e JOIN nodes a ON a.node_id = e.u JOIN nodes b ON b.node_id = e.v
), spans AS (
  SELECT *, least(10E0, metres * 0.3E0) AS low, metres - 2 * least(10E0, metres * 0.3E0) AS span FROM lined
), laid AS (
  SELECT *, CAST(greatest(floor(span / {_STEP}), 1) AS BIGINT) AS last FROM spans
), samples AS (
  SELECT *, CASE WHEN metres > 0 THEN (low + n * span / last) / metres ELSE 0 END AS f FROM (SELECT *, unnest(range(0, last + 1)) AS n FROM laid)
)"""


def _lined(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    at = lambda side: A.nodes(spark, sf_dir).select(F.col("node_id").alias(side), F.struct("lon", "lat").alias(f"p{side}"))
    return A.edges(spark, sf_dir).join(at("u"), "u").join(at("v"), "v").select("edge_id", *more, F.array("pu", "pv").alias("geometry"))


@query(_SAMPLES + " SELECT edge_id, count(*) AS n, round(avg(x0 + f * dlon), 6) AS lon, round(avg(y0 + f * dlat), 6) AS lat, round(max(f), 6) AS furthest FROM samples GROUP BY edge_id", ("nodes", "edges"))
def edge_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points along every edge: how many, their middle and how far they go."""
    lined = _lined(spark, sf_dir)
    s = X.sample_points(lined, step_m=_STEP).join(lined.select("edge_id", F.col("geometry")[0].alias("p")), "edge_id")
    away = F.greatest(F.abs(F.col("dlon")), F.abs(F.col("dlat")))
    gone = F.greatest(F.abs(F.col("lon") - F.col("p.lon")), F.abs(F.col("lat") - F.col("p.lat")))
    far = F.max(F.when(away > 0, gone / away).otherwise(0.0))
    return s.groupBy("edge_id").agg(F.count("*").alias("n"), rounded(F.avg("lon")).alias("lon"), rounded(F.avg("lat")).alias("lat"), rounded(far).alias("furthest"))


def _painted_tiles(spark: SparkSession) -> DataFrame:
    """A tile for each place of the box but every seventh: one colour, or none."""
    x0, x1, y0, y1 = geo.tile_range(A.BOX, _ZOOM)
    places = [(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1) if (x * 3 + y) % 7]

    def paint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fills = {c: rgb for c, rgb in reversed(palette.PALETTE)}
        for batch in batches:
            out = []
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                image = np.zeros((256, 256, 4), np.uint8)
                if c := (x + y) % 5:
                    image[...] = (*fills[c], 255)
                out.append(png.encode(image))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["x", "y", "content"])

    return spark.createDataFrame(places, "x int, y int").repartition(8).mapInArrow(paint, "x int, y int, content binary").select(F.lit(_ZOOM).alias("z"), "x", "y", "content")


_PLACED = f""", seen AS (
  SELECT edge_id, CAST(floor(((x + 180) / 360 * {_SIZE} - dlat / norm * 4) / 256) AS BIGINT) AS tx,
    CAST(floor(((1 - ln(tan(radians(y)) + 1 / cos(radians(y))) / pi()) / 2 * {_SIZE} - dlon / norm * 4) / 256) AS BIGINT) AS ty
  FROM (SELECT edge_id, x0 + f * dlon AS x, y0 + f * dlat AS y, dlon, dlat, CASE WHEN dlon = 0 AND dlat = 0 THEN 1 ELSE sqrt(dlon * dlon + dlat * dlat) END AS norm FROM samples)
), told AS (SELECT edge_id, CASE WHEN (tx * 3 + ty) % 7 = 0 THEN 0 ELSE (tx + ty) % 5 END AS cls FROM seen),
per AS (SELECT edge_id, CAST(count(*) AS INTEGER) AS n, count(*) FILTER (cls > 0) AS s, count(*) FILTER (cls = 1) AS c1, count(*) FILTER (cls = 2) AS c2, count(*) FILTER (cls = 3) AS c3, count(*) FILTER (cls = 4) AS c4 FROM told GROUP BY 1),
top AS (SELECT *, CASE WHEN s > 0 AND s / n >= 0.25 THEN CASE greatest(c1, c2, c3, c4) WHEN c4 THEN 4 WHEN c3 THEN 3 WHEN c2 THEN 2 ELSE 1 END ELSE 0 END AS cls FROM per)"""


_DECODED = (
    _SAMPLES + _PLACED + """ SELECT edge_id, CAST(cls AS INTEGER) AS cls, CASE cls WHEN 1 THEN 25E0 WHEN 2 THEN 55E0 WHEN 3 THEN 85E0 WHEN 4 THEN 105E0 ELSE 0E0 END AS weight, round(c1 / n, 4) AS f_green, round(c2 / n, 4) AS f_orange,
      round(c3 / n, 4) AS f_red, round(c4 / n, 4) AS f_darkred, round(s / n, 4) AS coverage, n AS n_samples, CASE WHEN cls > 0 THEN 'observed' ELSE 'none' END AS source FROM top"""
)


@query(_DECODED, ("nodes", "edges"))
def decoded_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From tiles to the weight table: points, tile join, pixel votes, coverage."""
    seen = X.classify_samples(X.sample_points(_lined(spark, sf_dir), step_m=_STEP), _painted_tiles(spark), _ZOOM)
    return X.edge_votes(seen).drop("vc_ratio")


@query(_DECODED, ("nodes", "edges"))
def decoded_capture_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from samples that are written once, in buckets by tile."""
    store = Z.store_samples(_lined(spark, sf_dir), scratch(spark), _ZOOM, step_m=_STEP)
    return Z.decode_capture(store, _painted_tiles(spark)).drop("vc_ratio")


@query(
    f"""WITH base AS (SELECT x, y, (x + y) % 5 AS cls FROM
      (SELECT unnest(range(CAST(floor((90.326774E0 + 180) / 360 * {_SIZE / 256}) AS BIGINT), CAST(floor((90.499678E0 + 180) / 360 * {_SIZE / 256}) AS BIGINT) + 1)) AS x),
      (SELECT unnest(range(CAST(floor((1 - asinh(tan(radians(23.902086E0))) / pi()) / 2 * {_SIZE / 256}) AS BIGINT), CAST(floor((1 - asinh(tan(radians(23.711736E0))) / pi()) / 2 * {_SIZE / 256}) AS BIGINT) + 1)) AS y)
      WHERE (x * 3 + y) % 7 <> 0)
    SELECT CAST(z AS INTEGER) AS z, CAST(x >> ({_ZOOM} - z) AS INTEGER) AS x, CAST(y >> ({_ZOOM} - z) AS INTEGER) AS y, """
    + ", ".join(f"CAST(sum(CASE WHEN cls = {k} THEN power(256 >> ({_ZOOM} - z), 2) ELSE 0 END) AS BIGINT) AS c{k}" for k in range(1, 5))
    + f" FROM base, range({_ZOOM - 3}, {_ZOOM + 1}) t(z) GROUP BY 1, 2, 3"
)
def pyramid_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles pooled three levels out, and the pixels of each class on every one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.bincount(X.classify_array(png.decode(c).reshape(-1, 4)), minlength=5)[1:] for c in batch.column(3).to_pylist()]
            counts = np.stack(rows).T if rows else np.zeros((4, 0), np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *(pa.array(c.astype(np.int64)) for c in counts)], ["z", "x", "y", "c1", "c2", "c3", "c4"])

    return X.pyramid(_painted_tiles(spark), _ZOOM - 3).mapInArrow(count, "z int, x int, y int, c1 bigint, c2 bigint, c3 bigint, c4 bigint")


# Completed tables and frames

_TABLE = _PAINTED + _REACH + """, won AS (SELECT edge_id, arg_max(level, -hops * 10 + rung) AS level, min(hops) AS hops FROM claims GROUP BY edge_id),
ladder(rung, weight) AS (VALUES (0, 25E0), (1, 55E0), (2, 85E0), (3, 105E0)),
tab AS (SELECT e.edge_id, least(e.u, e.v) AS a, greatest(e.u, e.v) AS b, coalesce(lp.weight, lw.weight, 25E0) AS weight, CASE WHEN p.rung IS NOT NULL THEN 'observed' ELSE 'predicted' END AS source,
  CASE WHEN p.rung IS NOT NULL THEN 'observed' WHEN w.hops = 1 THEN 'adjacent' WHEN w.hops IS NOT NULL THEN 'spread' ELSE 'assumed_clear' END AS method, CAST(coalesce(w.hops, -1) AS INTEGER) AS hops
  FROM edges e LEFT JOIN painted p USING (edge_id) LEFT JOIN won w USING (edge_id) LEFT JOIN ladder lp ON lp.rung = p.rung LEFT JOIN ladder lw ON lw.rung = w.level)"""


def _completed(spark: SparkSession, sf_dir: str, e: DataFrame) -> DataFrame:
    painted = _painted(spark, sf_dir, e)
    weight = F.element_at(F.array(*[F.lit(x) for x in traffic.LADDER]), F.col("rung") + 1)
    return L.complete_table(e, painted.select("edge_id", weight.alias("weight")), G.spread(e, painted))


@query(_TABLE + " SELECT edge_id, weight, source, method, hops FROM tab", ("edges", "today"))
def completed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge with its observed weight or the one that the spread gives it."""
    return _completed(spark, sf_dir, A.edges(spark, sf_dir))


@query(
    _TABLE + """, best AS (SELECT a, b, first(weight ORDER BY source, weight DESC, edge_id) AS weight, first(source ORDER BY source, weight DESC, edge_id) AS source FROM tab GROUP BY a, b)
    SELECT a, b, CAST(CASE WHEN weight < 40 THEN 0 WHEN weight < 70 THEN 1 WHEN weight < 95 THEN 2 ELSE 3 END + CASE WHEN source = 'observed' THEN 0 ELSE 4 END AS INTEGER) AS code FROM best""",
    ("edges", "today"),
)
def frame_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One capture as a viewer plays it: a code for every street."""
    e = A.edges(spark, sf_dir)
    table = _completed(spark, sf_dir, e)
    lines = L.lines_best(e, table).select(F.struct("a", "b").alias("line"), "edge_id")
    return B.frame(lines, table).select("line.a", "line.b", F.col("code").cast("int").alias("code"))


# Planning

_AREA = """, inside AS (SELECT node_id FROM nodes WHERE lon BETWEEN 90.38E0 AND 90.44E0 AND lat BETWEEN 23.77E0 AND 23.84E0),
loaded AS (SELECT e.*, capacity_vph * CASE coalesce(level, 0) WHEN 0 THEN 0.25E0 WHEN 1 THEN 0.55E0 WHEN 2 THEN 0.85E0 ELSE 1.05E0 END AS load,
  u IN (SELECT node_id FROM inside) AS iu, v IN (SELECT node_id FROM inside) AS iv FROM edges e LEFT JOIN today USING (edge_id)),
entries AS (SELECT v AS node, sum(load) AS flow FROM loaded WHERE iv AND NOT iu GROUP BY v), exits AS (SELECT u AS node, sum(load) AS flow FROM loaded WHERE iu AND NOT iv GROUP BY u),
reach AS (SELECT DISTINCT u AS enter, v AS leave FROM loaded WHERE iu AND iv)"""


@query(
    _AREA + f""" SELECT enter, leave, round(a.flow * b.flow / (SELECT sum(flow) FROM exits), 4) AS vehicles FROM reach r JOIN entries a ON a.node = r.enter JOIN exits b ON b.node = r.leave
    JOIN nodes p ON p.node_id = r.enter JOIN nodes q ON q.node_id = r.leave WHERE {hav("p.lon", "p.lat", "q.lon", "q.lat")} > 200 ORDER BY a.flow * b.flow DESC, enter, leave LIMIT 150""",
    ("nodes", "edges", "today"),
)
def gate_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journeys between the gates of an area, the largest 150."""
    n = A.nodes(spark, sf_dir)
    inside = n.where("lon BETWEEN 90.38E0 AND 90.44E0 AND lat BETWEEN 23.77E0 AND 23.84E0").select("node_id")
    mark = lambda side: inside.select(F.col("node_id").alias(side), F.lit(True).alias(f"i{side}"))
    load = traffic.actual_load(F.coalesce("level", F.lit(0)), F.col("capacity_vph"))
    e = A.edges(spark, sf_dir).join(A.today(spark, sf_dir), "edge_id", "left").withColumn("load", load).join(mark("u"), "u", "left").join(mark("v"), "v", "left")
    gate = lambda side, there, away: (
        e.where(F.col(f"i{there}").isNotNull() & F.col(f"i{away}").isNull()).groupBy(F.col(side).alias("node")).agg(F.sum("load").alias("flow"))
        .join(n.select(F.col("node_id").alias("node"), "lon", "lat"), "node")
    )
    reach = e.where("iu AND iv").select(F.col("u").alias("enter"), F.col("v").alias("leave")).distinct()
    return D.gate_demand(gate("v", "v", "u"), gate("u", "u", "v"), reach).withColumn("vehicles", rounded("vehicles", 4))


@query(
    """, hub AS (SELECT 0 AS node), fwd(node) AS (SELECT CAST(node AS BIGINT) FROM hub UNION SELECT e.v FROM fwd JOIN edges e ON e.u = fwd.node),
    bwd(node) AS (SELECT CAST(node AS BIGINT) FROM hub UNION SELECT e.u FROM bwd JOIN edges e ON e.v = bwd.node), core AS (SELECT node FROM fwd INTERSECT SELECT node FROM bwd),
    less(node) AS (SELECT CAST(node AS BIGINT) FROM hub UNION SELECT e.v FROM less JOIN edges e ON e.u = less.node WHERE e.highway NOT IN ('primary', 'secondary', 'tertiary', 'residential'))
    SELECT node FROM core EXCEPT SELECT node FROM less""",
    ("edges",),
)
def trapped_after_closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Junctions of the core that are cut off when all but the smallest roads close."""
    e = A.edges(spark, sf_dir)
    hub = spark.range(1).withColumnRenamed("id", "node")
    return P.nobody_trapped(G.core(e, hub), G.reachable(e.where("highway = 'living_street'"), hub))


# Freshness: a capture an hour, outputs by the hour of day.

_WRITTEN = """, caps AS (SELECT DISTINCT ts FROM readings), written AS (
  SELECT ts AS capture, epoch(ts)::BIGINT AS capture_at, CASE WHEN hour(ts) % 4 <> 0 THEN epoch(ts)::BIGINT + CASE WHEN hour(ts) % 5 = 0 THEN -60 ELSE 60 END END AS decode_at,
    CASE WHEN hour(ts) % 3 <> 0 THEN epoch(ts)::BIGINT + 90 END AS impute_at, CASE WHEN hour(ts) % 6 <> 1 THEN epoch(ts)::BIGINT + CASE WHEN hour(ts) % 7 = 0 THEN 30 ELSE 120 END END AS layers_at,
    (SELECT epoch(min(ts))::BIGINT + 86400 * 5 FROM caps) AS graph_at FROM caps)"""


@query(
    _WRITTEN + """, d AS (SELECT *, CASE WHEN decode_at IS NULL THEN 'missing' WHEN decode_at < capture_at OR decode_at < graph_at THEN 'older' END AS decode FROM written),
    i AS (SELECT *, CASE WHEN impute_at IS NULL THEN 'missing' WHEN coalesce(impute_at < decode_at, false) OR impute_at < graph_at THEN 'older' WHEN decode IS NOT NULL THEN 'input' END AS impute FROM d),
    l AS (SELECT *, CASE WHEN layers_at IS NULL THEN 'missing' WHEN coalesce(layers_at < impute_at, false) OR layers_at < graph_at THEN 'older' WHEN impute IS NOT NULL THEN 'input' END AS layers FROM i)
    SELECT strftime(capture, '%Y-%m-%d %H') AS capture, stage, reason FROM (SELECT capture, 'decode' AS stage, decode AS reason FROM l UNION ALL SELECT capture, 'impute', impute FROM l UNION ALL SELECT capture, 'layers', layers FROM l)
    WHERE reason IS NOT NULL""",
    ("readings",),
)
def stage_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stages of which captures have to run, and why."""
    ts, at, hour = F.col("ts"), F.unix_seconds("ts"), F.hour("ts")
    caps = A.readings(spark, sf_dir).select("ts").distinct().withColumn("capture", F.date_format("ts", "yyyy-MM-dd HH"))
    times = {
        "capture": at, "decode": F.when(hour % 4 != 0, at + F.when(hour % 5 == 0, -60).otherwise(60)), "impute": F.when(hour % 3 != 0, at + 90),
        "layers": F.when(hour % 6 != 1, at + F.when(hour % 7 == 0, 30).otherwise(120)),
    }
    written = None
    for name, when in times.items():
        one = caps.select("capture", F.lit(name).alias("name"), when.alias("at")).where("at IS NOT NULL")
        written = one if written is None else written.unionByName(one)
    graph = caps.agg((F.unix_seconds(F.min(ts)) + 86400 * 5).alias("at")).select(F.lit(None).cast("string").alias("capture"), F.lit("graph").alias("name"), "at")
    return B.stale_stages(caps, written.unionByName(graph)).select("capture", "stage", "reason")


# Streams: the events as they would arrive, to the end of what is there.

_EVENTS = "WITH r AS (SELECT user_id AS edge_id, ts, CAST(floor(value) AS BIGINT) % 4 AS level, event_type <> 'error' AS painted FROM events), closed AS (SELECT max(ts) - INTERVAL 2 HOUR AS mark FROM r)"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1000).parquet(f"{sf_dir}/events.parque[t]")  # a file or a folder of files
    return events.selectExpr("user_id AS edge_id", "CAST(ts AS TIMESTAMP) AS ts", "CAST(floor(value) AS BIGINT) % 4 AS level", "event_type <> 'error' AS painted", "event_id", "event_type")


@query(
    _EVENTS + """ SELECT date_trunc('hour', ts) AS hour, edge_id, round(avg(level), 6) AS mean_level, round(avg(painted::INT), 6) AS painted_share, count(*) AS n
    FROM r WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT mark FROM closed) GROUP BY 1, 2"""
)
def stream_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling hours of the hours that the watermark has closed."""
    out = C.finished(C.hourly_levels(_stream(spark, sf_dir)), scratch(spark))
    return out.withColumns({"hour": F.col("hour").cast("timestamp_ntz"), **{c: rounded(c) for c in ("mean_level", "painted_share")}})


@query(
    _EVENTS + """, marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY edge_id ORDER BY ts) < INTERVAL 25 MINUTE THEN 0 ELSE 1 END AS new FROM r),
    numbered AS (SELECT *, sum(new) OVER (PARTITION BY edge_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked)
    SELECT min(ts) AS first, max(ts) + INTERVAL 25 MINUTE AS until, edge_id, count(*) AS captures FROM numbered GROUP BY edge_id, s HAVING max(ts) + INTERVAL 25 MINUTE <= (SELECT mark FROM closed)"""
)
def stream_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session windows that the watermark has closed."""
    out = C.finished(C.runs(_stream(spark, sf_dir)), scratch(spark))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first", "until")})


@query("SELECT user_id AS edge_id, ts FROM events GROUP BY 1, 2")
def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of which each counts once, published through the exactly-once sink."""
    folder = scratch(spark)
    C.publish(_stream(spark, sf_dir).select("edge_id", "ts", "level", "painted"), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("edge_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(
    """WITH marked AS (SELECT user_id, event_id, event_type, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS i FROM events),
    counted AS (SELECT *, row_number() OVER (PARTITION BY user_id, i ORDER BY event_id) AS streak FROM marked WHERE event_type = 'error')
    SELECT CAST(user_id AS VARCHAR) AS source, event_id AS seq, CAST(streak AS INTEGER) AS streak FROM counted WHERE streak = 2"""
)
def stream_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources at their second refusal in a row, from kept state."""
    log = _stream(spark, sf_dir).selectExpr("CAST(edge_id AS STRING) AS source", "event_id AS seq", "CASE WHEN event_type = 'error' THEN 403 ELSE 200 END AS status")
    return C.finished(C.blocked(log, 2), scratch(spark))
