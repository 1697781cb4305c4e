"""Queries of demand, assignment, planning, diversion and learning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import traffic
from ..materialise import cut
from ..operators import corridors as K
from ..operators import demand as D
from ..operators import graph as G
from ..operators import history as H
from ..operators import learning as M
from ..operators import neighbours as N
from ..operators import planning as P
from ..operators import settle as S
from ..operators.diversion import run_diversion
from . import adapters as A
from .columns import hav
from .graph_queries import _cheapest
from .registry import query, rounded

_ZONES = f""", grid AS (
  SELECT i AS zone, 90.326774E0 + (i % 6 + 0.5E0) * ((90.499678E0 - 90.326774E0) / 6) AS lon, 23.711736E0 + (i // 6 + 0.5E0) * ((23.902086E0 - 23.711736E0) / 6) AS lat, 1E0 + i % 4 AS weight FROM range(36) t(i)
), zones AS (
  SELECT zone, nlon AS lon, nlat AS lat, lon AS mid_lon, lat AS mid_lat, weight, node FROM (SELECT g.*, n.lon AS nlon, n.lat AS nlat, n.node_id AS node, row_number() OVER (PARTITION BY g.zone ORDER BY {hav("g.lon", "g.lat", "n.lon", "n.lat")}, n.node_id) AS r FROM grid g, nodes n) WHERE r = 1
), od AS (
  SELECT a.zone AS i, b.zone AS j, a.node AS origin, b.node AS destination,
    a.weight * b.weight / power(greatest({hav("a.lon", "a.lat", "b.lon", "b.lat")}, 200) / 1000, 1.5) AS trips FROM zones a JOIN zones b ON a.zone <> b.zone
)"""


def _zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.zone_grid(A.BOX, 6, 6, A.nodes(spark, sf_dir)).withColumn("weight", 1.0 + F.col("zone") % 4)


@query(_ZONES + " SELECT i, j, origin, destination, round(trips, 6) AS trips FROM od", ("nodes",))
def gravity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.gravity(_zones(spark, sf_dir)).withColumn("trips", rounded("trips"))


@query(
    _ZONES + """, od6 AS (SELECT i, j, round(trips, 6) AS trips FROM od)
    SELECT i, j, trips, round(trips / (SELECT sum(trips) FROM od6), 5) AS share, round(trips / (SELECT max(trips) FROM od6), 5) AS width
    FROM od6 ORDER BY trips DESC, i, j LIMIT 60""",
    ("nodes",),
)
def top_flows_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    od = D.gravity(_zones(spark, sf_dir)).withColumn("trips", rounded("trips"))
    return D.top_flows(od).select("i", "j", "trips", rounded("share", 5).alias("share"), rounded("width", 5).alias("width"))


@query(None)
def sampled_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.sample_trips(D.gravity(_zones(spark, sf_dir)), 300)


def _trips(spark: SparkSession, sf_dir: str, n: int = 60) -> DataFrame:
    return D.sample_trips(D.gravity(_zones(spark, sf_dir)), n).select("trip", "origin", "destination", F.lit(40.0).alias("vehicles"))


@query(None)
def astar_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest ways between zones, free-flow and at today's levels."""
    z = cut(_zones(spark, sf_dir).select("node"))
    j = z.select(F.col("node").alias("origin")).join(F.broadcast(z.select(F.col("node").alias("destination"))), F.col("origin") != F.col("destination"))
    e = A.edges(spark, sf_dir).join(A.today(spark, sf_dir), "edge_id", "left")
    jammed = traffic.bpr_time(F.col("free_flow_s"), traffic.actual_load(F.coalesce("level", F.lit(0)), F.col("capacity_vph")), F.col("capacity_vph"))
    e = cut(e.select("edge_id", "u", "v", "free_flow_s", F.when(F.col("capacity_vph") > 0, jammed).alias("jam_s")))
    free = S.routes_both_ways(j, e, F.col("free_flow_s")).select("origin", "destination", F.col("cost").alias("free_s"), F.size("route").alias("free_edges"))
    jam = S.routes_both_ways(j, e, F.col("jam_s")).select("origin", "destination", F.col("cost").alias("jam_s"), F.size("route").alias("jam_edges"))
    return free.join(jam, ["origin", "destination"])


@query(None)
def assignment_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One assignment all at once and one in ten batches, measured."""
    e, out = A.edges(spark, sf_dir), None
    routed, loads = K.assign_runs(e, _trips(spark, sf_dir), {"all at once": 1, "in batches": 10})
    for name, load in loads.items():
        v = F.broadcast(K.volumes(e, load))
        mine = routed.where(F.col("run") == name)
        near = e.join(v.select("edge_id"), "edge_id", "left_semi")
        row = D.measures(near, v).join(F.broadcast(D.trip_minutes(near, v, mine))).select(F.lit(name).alias("run"), "*")
        out = row if out is None else out.unionByName(row)
    return out


_ROUTED = """, routed AS (
  SELECT o_orderkey AS trip, list_transform([0, 1, 2, 3], lambda k: (o_orderkey * 13 + k * k) % 1000) AS route, CAST(1 + o_orderkey % 5 AS DOUBLE) AS vehicles FROM orders
), loads AS (SELECT edge_id, sum(vehicles) * 10 AS volume FROM (SELECT unnest(route) AS edge_id, vehicles FROM routed) GROUP BY edge_id)"""
_BPR = "(e.free_flow_s * (1 + 3E0 / power(1.05E0, 4) * power(least(volume / e.capacity_vph, 2E0), 4)))"


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.selectExpr("o_orderkey AS trip", "transform(array(0, 1, 2, 3), k -> (o_orderkey * 13 + k * k) % 1000) AS route", "CAST(1 + o_orderkey % 5 AS DOUBLE) AS vehicles")


@query(_ROUTED + " SELECT edge_id, volume FROM loads", ("edges",))
def load_by_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.edge_loads(_routed(spark, sf_dir)).withColumn("volume", F.col("volume") * 10)


@query(
    _ROUTED + f""" SELECT round(sum(volume * {_BPR}) / 3600, 4) AS vehicle_hours, count(*) FILTER (volume > e.capacity_vph) AS over_capacity, count(*) AS loaded_roads
    FROM edges e JOIN loads USING (edge_id)""",
    ("edges",),
)
def vehicle_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    loads = D.edge_loads(_routed(spark, sf_dir)).withColumn("volume", F.col("volume") * 10)
    return D.measures(A.edges(spark, sf_dir), loads).withColumn("vehicle_hours", rounded("vehicle_hours", 4))


@query(
    _ROUTED + f""", times AS (SELECT edge_id, e.free_flow_s * (1 + 3E0 / power(1.05E0, 4) * power(least(coalesce(volume, 0) / e.capacity_vph, 2E0), 4)) AS s FROM edges e LEFT JOIN loads USING (edge_id)),
    per AS (SELECT trip, sum(s) AS s FROM (SELECT trip, unnest(route) AS edge_id FROM routed) JOIN times USING (edge_id) GROUP BY trip)
    SELECT round(avg(s / 60), 6) AS mean_trip_minutes, count(*) AS trips FROM per""",
    ("edges",),
)
def mean_trip_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _routed(spark, sf_dir)
    loads = D.edge_loads(r).withColumn("volume", F.col("volume") * 10)
    return D.trip_minutes(A.edges(spark, sf_dir), loads, r).withColumn("mean_trip_minutes", rounded("mean_trip_minutes"))


@query(
    _ROUTED + """, inside AS (SELECT trip, vehicles, pos, u, v FROM (SELECT trip, vehicles, unnest(route) AS edge_id, generate_subscripts(route, 1) AS pos FROM routed) JOIN edges USING (edge_id) WHERE class_rank <= 3)
    SELECT enter, leave, sum(vehicles) AS vehicles, count(*) AS trips FROM (SELECT trip, any_value(vehicles) AS vehicles, arg_min(u, pos) AS enter, arg_max(v, pos) AS leave FROM inside GROUP BY trip) GROUP BY enter, leave""",
    ("edges",),
)
def trips_through_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.through_trips(_routed(spark, sf_dir), A.edges(spark, sf_dir).where("class_rank <= 3"))


_V = ("s0", "s1", "s2", "s3", "s4", "g0", "g1", "g2")


def _problem() -> P.Problem:
    domains = {v: (("twoway", "forward", "backward") if v[0] == "s" else ("open", "closed")) for v in _V}
    today = {v: domains[v][0] for v in _V}
    rules = P.budget_prefixes(today, 3)
    rules.append((("s0", "s1"), lambda c: ~((c["s0"] == "forward") & (c["s1"] == "forward"))))
    rules.append((("g0", "g1"), lambda c: ~((c["g0"] == "closed") & (c["g1"] == "closed"))))
    return P.Problem(domains, rules)


@query(
    "SELECT * FROM "
    + ", ".join(f"(SELECT unnest({['twoway', 'forward', 'backward'] if v[0] == 's' else ['open', 'closed']}) AS {v})" for v in _V)
    + " WHERE " + " + ".join(f"({v} <> '{'twoway' if v[0] == 's' else 'open'}')::INT" for v in _V)
    + " <= 3 AND NOT (s0 = 'forward' AND s1 = 'forward') AND NOT (g0 = 'closed' AND g1 = 'closed')"
)
def csp_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _problem().solve(spark)


@query(
    f"""SELECT a.node_id AS key, b.node_id AS other, round({hav("a.lon", "a.lat", "b.lon", "b.lat")}, 4) AS metres FROM nodes a JOIN nodes b ON a.node_id < b.node_id
    WHERE {hav("a.lon", "a.lat", "b.lon", "b.lat")} < 400""",
    ("nodes",),
)
def gaps_too_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.gaps_too_close(A.nodes(spark, sf_dir).withColumnRenamed("node_id", "key"), digits=4)


_HEAD = "((degrees(atan2(({b}.lon - {a}.lon) * cos(radians({a}.lat)), {b}.lat - {a}.lat)) + 360) % 360)"


@query(
    f""", h AS (SELECT e.*, {_HEAD.format(a="a", b="b")} AS heading FROM edges e JOIN nodes a ON e.u = a.node_id JOIN nodes b ON e.v = b.node_id),
    main AS (SELECT * FROM h WHERE oneway AND highway IN ('trunk', 'primary', 'secondary', 'tertiary'))
    SELECT least(l.u, l.v) AS a, greatest(l.u, l.v) AS b, min(l.edge_id) AS edge_id, count(DISTINCT l.edge_id) AS links FROM h l JOIN main i ON i.v = l.u JOIN main o ON o.u = l.v
    WHERE l.length_m <= 60 AND l.edge_id <> i.edge_id AND l.edge_id <> o.edge_id AND abs((o.heading - i.heading + 180 + 720) % 360 - 180) > 150 GROUP BY 1, 2""",
    ("nodes", "edges"),
)
def u_turn_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.u_turns(A.edges(spark, sf_dir), A.nodes(spark, sf_dir))


@query(
    """, options AS (SELECT edge_id % 40 AS key, edge_id, CASE edge_id % 3 WHEN 0 THEN 'forward' WHEN 1 THEN 'backward' ELSE 'gap' END AS role FROM edges),
    layout AS (SELECT key, CASE key % 4 WHEN 0 THEN 'twoway' WHEN 1 THEN 'forward' WHEN 2 THEN 'backward' ELSE 'closed' END AS value FROM range(40) t(key)),
    touched AS (SELECT edge_id, role, value FROM options JOIN layout USING (key))
    SELECT e.edge_id, e.u, e.v, e.capacity_vph * CASE WHEN t.role = t.value THEN 2 ELSE 1 END AS capacity_vph FROM edges e LEFT JOIN touched t USING (edge_id)
    WHERE NOT coalesce((t.role = 'gap' AND t.value = 'closed') OR (t.value IN ('forward', 'backward') AND t.role <> t.value), false)""",
    ("edges",),
)
def layout_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.edges(spark, sf_dir)
    options = e.selectExpr("edge_id % 40 AS key", "edge_id", "CASE edge_id % 3 WHEN 0 THEN 'forward' WHEN 1 THEN 'backward' ELSE 'gap' END AS role")
    layout = spark.range(40).selectExpr("id AS key", "CASE id % 4 WHEN 0 THEN 'twoway' WHEN 1 THEN 'forward' WHEN 2 THEN 'backward' ELSE 'closed' END AS value")
    return P.layout_edges(e, options, layout).select("edge_id", "u", "v", "capacity_vph")


@query(None)
def diversion_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both timelines over all captures, in a run a day."""
    r = A.readings(spark, sf_dir).where("ts IS NOT NULL")
    levels = r.select(F.date_format("ts", "yyyy-MM-dd").alias("period"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("capture"), "edge_id", "level")
    steps, _ = run_diversion(A.nodes(spark, sf_dir), A.edges(spark, sf_dir), levels)
    return steps


# Learning, on the embeddings


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), "label")


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).where("id % 50 = 0").select(F.col("id").alias("q"), "features", "label")


_NEAR = """WITH p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS f, label FROM embeddings), d AS (
  SELECT q.id AS q, p.id, p.label, q.label AS truth, list_sum(list_transform(list_zip(q.f, p.f), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2 FROM p q JOIN p ON q.id % 50 = 0
), near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, id) AS rank FROM d) WHERE rank <= 5)"""


@query(_NEAR + " SELECT q, id, round(d2, 6) AS d2, CAST(rank AS INTEGER) AS rank FROM near")
def knn_embeddings_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.neighbours(_points(spark, sf_dir), _queries(spark, sf_dir), 5).select("q", "id", rounded("d2").alias("d2"), "rank")


@query(_NEAR + " SELECT q, id, round(d2, 6) AS d2, CAST(rank AS INTEGER) AS rank FROM near")
def knn_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same neighbours with pivots and the triangle inequality."""
    found = N.neighbours_by_pivots(_points(spark, sf_dir), _queries(spark, sf_dir), 5)
    return found.select("q", "id", rounded("d2").alias("d2"), "rank")


@query(
    """WITH p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS f FROM embeddings), d AS (
      SELECT q.id AS q, p.id, list_sum(list_transform(list_zip(q.f, p.f), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2 FROM p q JOIN p ON q.id <> p.id)
    SELECT q, id, round(d2, 6) AS d2, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, id) AS rank FROM d) WHERE rank <= 3"""
)
def nearest_join_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its three nearest other ones."""
    return N.nearest_join(_points(spark, sf_dir), 3).withColumn("d2", rounded("d2"))


@query(
    _NEAR + """ SELECT q, CAST(label AS INTEGER) AS label FROM (SELECT q, label, row_number() OVER (PARTITION BY q ORDER BY sum(1 / (sqrt(d2) + 1e-9)) DESC, label) AS r FROM near GROUP BY q, label) WHERE r = 1"""
)
def knn_weighted_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.knn_classify(_points(spark, sf_dir), _queries(spark, sf_dir), 5)


@query(_NEAR + " SELECT q, round(sum(label / (sqrt(d2) + 1e-6)) / sum(1 / (sqrt(d2) + 1e-6)), 6) AS value FROM near GROUP BY q")
def knn_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.knn_regress(_points(spark, sf_dir), _queries(spark, sf_dir), 5).withColumn("value", rounded("value"))


@query(
    """WITH x AS (SELECT vec_id AS id, label, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
    s AS (SELECT pos, avg(v) AS m, stddev_pop(v) AS sd FROM x GROUP BY pos)
    SELECT id, CAST(pos - 1 AS INTEGER) AS pos, round((v - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) AS z FROM x JOIN s USING (pos)"""
)
def standardised_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = M.standardised(_points(spark, sf_dir)).select("id", F.posexplode("features").alias("pos", "z"))
    return z.withColumn("z", rounded("z"))


_FLAT = """WITH p AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS f, label FROM embeddings),
x AS MATERIALIZED (SELECT id, label, unnest(f) AS v, generate_subscripts(f, 1) AS pos FROM p)"""


def _lloyd(rounds: int) -> str:
    """SQL of so many rounds, each a table of assignments and one of centres."""
    nearest = """SELECT id, cluster, d2 FROM (SELECT p.id, c.cluster, list_sum(list_transform(list_zip(p.f, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2,
      row_number() OVER (PARTITION BY p.id ORDER BY list_sum(list_transform(list_zip(p.f, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c.cluster) AS r FROM p, c{k} c) WHERE r = 1"""
    out = _FLAT + ", c0 AS MATERIALIZED (SELECT dense_rank() OVER (ORDER BY label) - 1 AS cluster, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(v) AS m FROM x GROUP BY 1, 2) GROUP BY label)"
    for k in range(rounds):
        out += f""", a{k} AS MATERIALIZED ({nearest.format(k=k)}), c{k + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(n.c, o.c) AS c FROM c{k} o LEFT JOIN
          (SELECT cluster, list(m ORDER BY pos) AS c FROM (SELECT cluster, pos, avg(v) AS m FROM a{k} JOIN x USING (id) GROUP BY 1, 2) GROUP BY cluster) n USING (cluster))"""
    return f"{out} SELECT id, CAST(cluster AS INTEGER) AS cluster, round(d2, 6) AS d2 FROM ({nearest.format(k=rounds)})"


@query(_lloyd(10))
def kmeans_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten of Lloyd's rounds from the labels' means as centres."""
    p = _points(spark, sf_dir)
    means = p.select("label", F.posexplode("features").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("m"))
    starts = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("c")).orderBy("label").collect()  # a row per label
    return M.kmeans(p, [[x["m"] for x in r["c"]] for r in starts], rounds=10, tolerance=0.0)[0].withColumn("d2", rounded("d2"))


def _descent(epochs: int) -> str:
    """SQL of so many steps of full-batch descent, each a row of weights and bias."""
    out = _FLAT + ", w0 AS MATERIALIZED (SELECT list_transform(any_value(f), lambda v: 0E0) AS w, 0E0 AS b FROM p)"
    for k in range(epochs):
        out += f""", e{k} AS MATERIALIZED (SELECT id, 1 / (1 + exp(-least(greatest(list_sum(list_transform(list_zip(f, w), lambda z: z[1] * z[2])) + b, -30), 30))) - label % 2 AS e FROM p, w{k}),
          w{k + 1} AS MATERIALIZED (SELECT list_transform(list_zip(w, g), lambda z: z[1] - 0.5 * (z[2] + 0.001 * z[1])) AS w, b - 0.5 * (SELECT avg(e) FROM e{k}) AS b
            FROM w{k}, (SELECT list(m ORDER BY pos) AS g FROM (SELECT pos, avg(e * v) AS m FROM e{k} JOIN x USING (id) GROUP BY pos)))"""
    return f"{out} SELECT CAST(unnest(range(len(w) + 1)) AS INTEGER) AS pos, round(unnest(list_concat([b], w)), 6) AS weight FROM w{epochs}"


@query(_descent(6))
def logistic_descent_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bias (at 0) and weights of odd against even labels after six steps of descent."""
    w, b, _ = M.logistic_descent(_points(spark, sf_dir).withColumn("label", F.col("label") % 2), rate=0.5, epochs=6)
    rows = [(k, float(x)) for k, x in enumerate([b, *w])]
    return spark.createDataFrame(rows, "pos int, weight double").withColumn("weight", rounded("weight"))


@query(None)
def forecast_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four forecasters on the later captures, over all hours and by hour."""
    r = A.readings(spark, sf_dir)
    caps = H.with_split(H.captures_of(r))
    train, asked = caps.where("part = 'train'"), caps.where("part = 'test'")
    return H.score(r, H.forecasts(r, A.edges(spark, sf_dir), train, asked))


@query(None)
def kmeans_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.kmeans_mllib(_points(spark, sf_dir), 10)


@query(None)
def logistic_ovr_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    return M.logistic_ovr(p.where("id % 5 <> 0"), p.where("id % 5 = 0"), rounds=30)


@query(None)
def logistic_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of the later captures by one-vs-rest models on profiles of the earlier ones."""
    r = A.readings(spark, sf_dir)
    caps = H.with_split(H.captures_of(r))
    asked = r.join(F.broadcast(caps.where("part = 'test'").select("ts")), "ts").select("ts", "edge_id", "level")
    return M.logistic_forecast(r, A.edges(spark, sf_dir), caps.where("part = 'train'"), asked)


@query(
    _ZONES + """, mids AS (SELECT (a.lon + b.lon) / 2 AS lon, (a.lat + b.lat) / 2 AS lat, CASE t.level WHEN 0 THEN 25E0 WHEN 1 THEN 55E0 WHEN 2 THEN 85E0 ELSE 105E0 END AS w
      FROM today t JOIN edges e USING (edge_id) JOIN nodes a ON e.u = a.node_id JOIN nodes b ON e.v = b.node_id)
    SELECT zone, round(1 + greatest(0, (coalesce(avg(w), 25) - 25) / 40), 6) AS weight FROM zones z LEFT JOIN mids m ON abs(m.lon - z.mid_lon) <= 0.015 AND abs(m.lat - z.mid_lat) <= 0.015 GROUP BY zone""",
    ("nodes", "edges", "today"),
)
def zone_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = A.nodes(spark, sf_dir)
    a = n.select(F.col("node_id").alias("u"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"))
    b = n.select(F.col("node_id").alias("v"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    w = F.element_at(F.array(*[F.lit(x) for x in traffic.LADDER]), F.col("level") + 1)
    mids = A.today(spark, sf_dir).join(A.edges(spark, sf_dir), "edge_id").join(a, "u").join(b, "v").select(
        ((F.col("lon1") + F.col("lon2")) / 2).alias("lon"), ((F.col("lat1") + F.col("lat2")) / 2).alias("lat"), w.alias("weight")
    )
    middles = _zones(spark, sf_dir).select("zone", F.col("mid_lon").alias("lon"), F.col("mid_lat").alias("lat"))
    return D.zone_weights(middles, mids).select("zone", rounded("weight").alias("weight"))


@query(
    _cheapest(
        "SELECT arg_max(node, n * 1000000 - node) AS node FROM (SELECT node, count(*) AS n FROM (SELECT u AS node FROM edges UNION ALL SELECT v FROM edges) GROUP BY node)",
        "SELECT u, v, free_flow_s * (1 + 3E0 / power(1.05E0, 4) * power(CASE coalesce(level, 0) WHEN 0 THEN 0.25E0 WHEN 1 THEN 0.55E0 WHEN 2 THEN 0.85E0 ELSE 1.05E0 END, 4)) AS c FROM edges LEFT JOIN today USING (edge_id)",
    ) + " SELECT CAST(floor(cost / 60) AS BIGINT) AS minute, count(*) AS nodes FROM best GROUP BY 1",
    ("edges", "today"),
)
def dijkstra_reach_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Junctions by minutes of travel from the busiest one, at today's levels."""
    e = A.edges(spark, sf_dir).join(A.today(spark, sf_dir), "edge_id", "left")
    cost = traffic.bpr_time_from_ratio(F.col("free_flow_s"), traffic.level_load(F.coalesce("level", F.lit(0))))
    d = G.distances(e, G.busiest_node(e), cost)
    return d.groupBy(F.floor(F.col("cost") / 60).alias("minute")).agg(F.count("*").alias("nodes"))


@query(None)
def city_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before, all at once and in batches, on today's levels."""
    from ..operators.city import run_city

    n, e = A.nodes(spark, sf_dir), A.edges(spark, sf_dir)
    return run_city(n, e, A.today(spark, sf_dir), _trips(spark, sf_dir), batches=4)[0]


@query(None)
def layout_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every layout of the busiest side streets with at most two changes, scored
    by a batched assignment and ranked."""
    from ..operators import lines as L
    from ..operators.city import plan

    e = cut(A.edges(spark, sf_dir))
    keyed = L.side_streets(e, A.today(spark, sf_dir), 4).select("a", "b").withColumn("key", F.concat_ws("-", F.lit("s"), "a", "b"))
    role = F.when(F.col("u") < F.col("v"), "forward").otherwise("backward")
    options = e.join(F.broadcast(keyed), (F.least("u", "v") == F.col("a")) & (F.greatest("u", "v") == F.col("b"))).select("key", "edge_id", role.alias("role"))
    options = cut(options)  # of four streets
    names = sorted(r["key"] for r in options.select("key").distinct().collect())
    today = {k: "twoway" for k in names}
    layouts = P.Problem({k: ("twoway", "forward", "backward") for k in names}, P.budget_prefixes(today, 2)).solve(spark)
    return plan(layouts, options, e, _trips(spark, sf_dir), today, G.busiest_node(e), top=1000)[0]
