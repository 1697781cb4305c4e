"""Queries of layers, capture lists and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, traffic
from ..materialise import scratch
from ..operators import history as H
from ..operators import layers as Y
from ..operators import lines as L
from ..operators import sketches as K
from ..operators import tiles as T
from ..sources import quarters as U
from . import adapters as A
from .columns import _DELAY
from .history_queries import _CAPS
from .registry import query, rounded
from .tile_queries import _GRID, _tiles, coverage_filter


@query(
    "SELECT level, weight, weight / 100 AS vc, round(d, 6) AS delay, round(50 / d, 6) AS kmph, CASE WHEN d <= 1.4 THEN '#16e098' WHEN d <= 2.2 THEN '#ffcf43' WHEN d <= 3.5 THEN '#d1352b' ELSE '#a92727' END AS colour "
    f"FROM (SELECT level, weight, {_DELAY.format(vc='weight / 100')} AS d FROM (VALUES (0, 25E0), (1, 55E0), (2, 85E0), (3, 105E0)) t(level, weight))"
)
def legend_calculator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.legend(spark)


@query(
    """WITH per AS (SELECT l_orderkey AS e, count(*) AS n, count(*) FILTER (CAST(l_quantity AS BIGINT) % 5 > 0) AS s FROM lineitem GROUP BY 1), c AS (SELECT round(s / n, 4) AS coverage FROM per WHERE s > 0 AND s / n >= 0.25)
    SELECT CASE WHEN coverage <= 0.5 THEN 'half' WHEN coverage <= 0.75 THEN 'most' ELSE 'full' END AS band, count(*) AS edges, round(avg(coverage), 4) AS mean_coverage FROM c GROUP BY 1"""
)
def decoder_coverage_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.coverage_bands(coverage_filter(spark, sf_dir))


@query(
    """, member AS (SELECT CAST(least(greatest(trunc((n.lat - 23.711736E0) / 0.031725E0), 0), 5) * 6 + least(greatest(trunc((n.lon - 90.326774E0) / 0.028817333333E0), 0), 5) AS INTEGER) AS zone,
      CASE t.level WHEN 0 THEN 25E0 WHEN 1 THEN 55E0 WHEN 2 THEN 85E0 ELSE 105E0 END AS weight FROM today t JOIN edges e USING (edge_id) JOIN nodes n ON e.u = n.node_id),
    per AS (SELECT zone, count(*) AS members, round(avg(weight), 4) AS mean_weight FROM member GROUP BY zone)
    SELECT *, CAST(row_number() OVER (ORDER BY mean_weight DESC, zone) AS INTEGER) AS place FROM per""",
    ("nodes", "edges", "today"),
)
def zone_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = {"west": 90.326774, "east": 90.326774 + 6 * 0.028817333333, "south": 23.711736, "north": 23.711736 + 6 * 0.031725}
    n = A.nodes(spark, sf_dir).select(F.col("node_id").alias("u"), geo.grid_cell(F.col("lon"), F.col("lat"), box, 6).alias("zone"))
    w = F.element_at(F.array(*[F.lit(x) for x in traffic.LADDER]), F.col("level") + 1)
    return Y.zone_stats(A.today(spark, sf_dir).join(A.edges(spark, sf_dir), "edge_id").join(n, "u").select("zone", w.alias("weight")))


@query(
    """SELECT event_type, list_sort(list(value))[len(list(value)) // 2 + 1] AS median, CAST(len(list(value)) AS INTEGER) AS n FROM (
      SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) WHERE r <= 12 GROUP BY event_type"""
)
def stage_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.upper_medians(spark.read.parquet(f"{sf_dir}/events.parquet"), ["event_type"], "event_id", "value")


_VERTICES = """, vert AS (SELECT edge_id, 0 AS pos, lon, lat FROM edges JOIN nodes ON u = node_id UNION ALL SELECT edge_id, 1, lon, lat FROM edges JOIN nodes ON v = node_id),
named AS (SELECT DISTINCT round(n.lon, 7) AS kx, round(n.lat, 7) AS ky, c.c_mktsegment AS name FROM nodes n JOIN customer c ON n.node_id = c.c_custkey)"""


@query(
    _VERTICES + """ SELECT edge_id, name FROM (SELECT edge_id, name, row_number() OVER (PARTITION BY edge_id ORDER BY count(*) DESC, min(pos), name DESC) AS r
      FROM vert JOIN named ON round(lon, 7) = kx AND round(lat, 7) = ky GROUP BY edge_id, name) WHERE r = 1""",
    ("nodes", "edges"),
)
def street_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = A.edges(spark, sf_dir), A.nodes(spark, sf_dir)
    end = lambda side, pos: e.select("edge_id", F.lit(pos).alias("pos"), F.col(side).alias("node_id")).join(n, "node_id").drop("node_id")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("node_id"), F.col("c_mktsegment").alias("name"))
    return Y.named_streets(end("u", 0).unionByName(end("v", 1)), n.join(c, "node_id"))


@query(
    """SELECT key, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || ' (block ' || row_number() OVER (PARTITION BY name ORDER BY key) || ')' ELSE name END AS name
    FROM (SELECT p_partkey AS key, p_name || ' ' || p_brand AS name FROM part)"""
)
def numbered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.numbered_names(spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS key", "p_name || ' ' || p_brand AS name"))


@query(
    """, m AS (SELECT e.edge_id, e.class_rank, (a.lon + b.lon) / 2 AS lon, (a.lat + b.lat) / 2 AS lat FROM edges e JOIN nodes a ON e.u = a.node_id JOIN nodes b ON e.v = b.node_id), o AS (SELECT avg(lon) AS lon0, avg(lat) AS lat0 FROM nodes)
    SELECT edge_id, round(lon, 11) AS lon, round(lat, 11) AS lat, round((lon - lon0) * 111320 * cos(radians(lat0)), 3) AS x, round((lat - lat0) * 110540, 3) AS y, CAST(class_rank AS INTEGER) AS class_rank FROM m, o""",
    ("nodes", "edges"),
)
def edge_midpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Y.midpoints(A.edges(spark, sf_dir), A.nodes(spark, sf_dir))
    return m.withColumns({"lon": rounded("lon", 11), "lat": rounded("lat", 11), "x": rounded("x", 3), "y": rounded("y", 3)})


@query(
    """, caps AS (SELECT ts, max(level) AS top, max(painted) AS painted FROM readings GROUP BY ts)
    SELECT strftime(ts, 'dhaka-%Y-%m-%dT%H%MZ') AS name, CASE WHEN top >= 3 THEN CASE WHEN painted = 1 THEN 'processed' ELSE 'stale' END ELSE 'waiting' END AS state FROM caps""",
    ("readings",),
)
def processed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures against tables; a capture with a dark road has one here."""
    from ..functions import clock

    r = A.readings(spark, sf_dir).groupBy(clock.capture_name(F.col("ts")).alias("name")).agg(F.max("level").alias("top"), F.max("painted").alias("p"))
    return Y.processed_index(r.select("name"), r.where("top >= 3").select("name", (F.col("p") == 1).alias("has_hops")))


@query(
    _CAPS + " SELECT ts, coalesce(lag(ts) OVER (ORDER BY ts), (SELECT max(ts) FROM caps)) AS previous, coalesce(lead(ts) OVER (ORDER BY ts), (SELECT min(ts) FROM caps)) AS next FROM caps",
    ("readings",),
)
def capture_stepping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.stepping(H.captures_of(A.readings(spark, sf_dir)).select("ts"))


@query(
    "SELECT edge_id, count(*) FILTER (level <> CASE WHEN painted = 1 THEN level ELSE 0 END) AS steps FROM readings GROUP BY edge_id HAVING count(*) FILTER (level <> CASE WHEN painted = 1 THEN level ELSE 0 END) > 0",
    ("readings",),
)
def differing_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roads whose level changes if unpainted readings are taken as clear."""
    r = A.readings(spark, sf_dir).withColumnRenamed("ts", "step")
    return Y.differing(r.select("step", "edge_id", "level"), r.where("painted = 1").select("step", "edge_id", "level"))


@query(
    "SELECT ts, count(*) FILTER (level = 0) AS green, count(*) FILTER (level = 1) AS yellow, count(*) FILTER (level = 2) AS red, count(*) FILTER (level = 3) AS darkred FROM readings GROUP BY ts",
    ("readings",),
)
def level_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.level_histogram(A.readings(spark, sf_dir), ["ts"])


@query(
    _GRID + """, n AS (SELECT x, y, row_number() OVER (ORDER BY x, y) - 1 AS i, min(x) OVER () AS x0, max(x) OVER () AS x1, min(y) OVER () AS y0, max(y) OVER () AS y1, count(*) OVER () AS c FROM expected)
    SELECT x, y FROM n WHERE (x IN (x0, x1) AND y IN (y0, y1)) OR i % greatest(1, c // 200) = 0""",
    ("nodes",),
)
def georeference_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.stride_sample(_tiles(spark, sf_dir)[0])


@query(
    """, dense AS (SELECT c.ts, e.edge_id, coalesce(r.level, 0) AS level, coalesce(r.painted, 0) AS painted FROM (SELECT DISTINCT edge_id FROM readings) e, (SELECT DISTINCT ts FROM readings) c LEFT JOIN readings r ON r.ts = c.ts AND r.edge_id = e.edge_id)
    SELECT ts, count(*) AS roads, CAST(sum(level) AS BIGINT) AS levels, CAST(sum(painted) AS BIGINT) AS painted FROM dense GROUP BY ts""",
    ("readings",),
)
def dense_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = A.readings(spark, sf_dir)
    d = H.dense_levels(r, r.select("edge_id").distinct(), H.captures_of(r))
    return d.groupBy("ts").agg(F.count("*").alias("roads"), F.sum("level").alias("levels"), F.sum("painted").alias("painted"))


_RANKS = (0.1, 0.25, 0.5, 0.75, 0.9)


@query(
    f"""SELECT event_type, q AS rank, count(value) AS n, true AS within FROM events, (VALUES {", ".join(f"({r}E0)" for r in _RANKS)}) t(q)
    WHERE value IS NOT NULL GROUP BY 1, 2"""
)
def sketched_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles from sketches kept by day and put together: whether their true ranks,
    counted, are within one in a hundred."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.to_date("ts").alias("day"), "event_type", "value")
    K.keep_by_day(K.sketch(e, ["day", "event_type"], "value"), folder := scratch(spark))
    found = K.quantiles(K.over_days(spark, folder, None, None, ["event_type"]), list(_RANKS))
    errors = K.rank_errors(found.select("event_type", "n", "rank", "value"), e, ["event_type"], "value")
    return errors.select("event_type", "rank", "n", (F.col("error") <= 0.01).alias("within"))


@query(
    f""", placed AS (SELECT CAST(least(greatest(floor((lon - {A.BOX["west"]}E0) / ({A.BOX["east"]}E0 - {A.BOX["west"]}E0) * 4096), 0), 4095) AS BIGINT) AS x,
      CAST(least(greatest(floor((lat - {A.BOX["south"]}E0) / ({A.BOX["north"]}E0 - {A.BOX["south"]}E0) * 4096), 0), 4095) AS BIGINT) AS y FROM nodes),
    counts AS (SELECT level, x >> (12 - level) AS x, y >> (12 - level) AS y, count(*) AS n FROM placed, range(13) t(level) GROUP BY ALL)
    SELECT CAST(c.level AS INTEGER) AS level, c.x, c.y, c.n FROM counts c LEFT JOIN counts p ON p.level = c.level - 1 AND p.x = c.x >> 1 AND p.y = c.y >> 1
    WHERE (c.n <= 20 OR c.level = 12) AND (p.n IS NULL OR p.n > 20)""",
    ("nodes",),
)
def quartered_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box quartered until no part has more than twenty junctions."""
    return U.quartered(A.nodes(spark, sf_dir), A.BOX, 20)
