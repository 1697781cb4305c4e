"""Queries over the road graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..materialise import cut, scratch
from ..operators import areas as R
from ..operators import graph as G
from ..operators import layouts as Y
from ..operators import lines as L
from ..operators import settle as S
from . import adapters as A
from .columns import hav
from .registry import query, rounded


@query(
    """SELECT least(u, v) AS a, greatest(u, v) AS b, min(edge_id) AS edge_id, count(*) AS edges, count(*) FILTER (u < v) > 0 AND count(*) FILTER (u > v) > 0 AS twoway
    FROM edges GROUP BY 1, 2""",
    ("edges",),
)
def street_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.street_pairs(A.edges(spark, sf_dir))


@query(
    """SELECT node, count(*) AS degree, count(DISTINCT other) AS neighbours, CAST(min(class_rank) AS INTEGER) AS best_class FROM (
      SELECT u AS node, v AS other, class_rank FROM edges UNION ALL SELECT v, u, class_rank FROM edges) GROUP BY node""",
    ("edges",),
)
def node_degree_best_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.node_facts(A.edges(spark, sf_dir))


_ENDS = ", ends AS (SELECT edge_id, u AS node FROM edges UNION SELECT edge_id, v FROM edges)"


@query(_ENDS + " SELECT DISTINCT a.edge_id, b.edge_id AS other FROM ends a JOIN ends b ON a.node = b.node AND a.edge_id <> b.edge_id", ("edges",))
def adjacency_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.adjacency(A.edges(spark, sf_dir))


@query(
    _ENDS + """, adj AS (SELECT DISTINCT a.edge_id, b.edge_id AS other FROM ends a JOIN ends b ON a.node = b.node AND a.edge_id <> b.edge_id)
    SELECT e.edge_id, CAST(e.class_rank AS INTEGER) AS class_rank, round(coalesce(avg(o.class_rank), e.class_rank), 6) AS mean_rank, e.class_rank > coalesce(avg(o.class_rank), e.class_rank) + 0.5 AS smaller
    FROM edges e LEFT JOIN adj ON adj.edge_id = e.edge_id LEFT JOIN edges o ON o.edge_id = adj.other GROUP BY e.edge_id, e.class_rank""",
    ("edges",),
)
def mean_neighbour_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.mean_neighbour_rank(A.edges(spark, sf_dir)).withColumn("mean_rank", rounded("mean_rank"))


_PAINTED = ", painted AS (SELECT t.edge_id, t.level AS rung FROM today t JOIN edges e USING (edge_id))"
#: Searched to the end over junctions; a road is one hop beyond its nearer end.
_REACH = """, lends AS (SELECT edge_id, u AS node FROM edges UNION SELECT edge_id, v FROM edges),
lsteps AS (SELECT u AS node, v AS other FROM edges UNION SELECT v, u FROM edges),
bfs(node, rung, far) USING KEY (node, rung) AS (
  SELECT DISTINCT node, rung, 0 FROM painted JOIN lends USING (edge_id)
  UNION SELECT x.node, x.rung, x.far FROM (SELECT l.other AS node, b.rung, min(b.far) + 1 AS far FROM bfs b JOIN lsteps l ON l.node = b.node GROUP BY 1, 2) x
    LEFT JOIN recurring.bfs r ON r.node = x.node AND r.rung = x.rung WHERE r.far IS NULL OR x.far < r.far
), reach AS (SELECT edge_id, rung, min(hops) AS hops FROM (
  SELECT edge_id, rung, far + 1 AS hops FROM bfs JOIN lends USING (node) UNION ALL SELECT edge_id, rung, 0 FROM painted) GROUP BY 1, 2),
claims AS (SELECT edge_id, rung, hops, greatest(rung - CASE WHEN hops <= 1 THEN 0 ELSE hops - 1 END, 0) AS level FROM reach)"""
_SPREAD = """ SELECT e.edge_id, CASE coalesce(p.rung, c.level, 0) WHEN 0 THEN 25E0 WHEN 1 THEN 55E0 WHEN 2 THEN 85E0 ELSE 105E0 END AS weight,
  CASE WHEN p.rung IS NOT NULL THEN 0 WHEN c.hops IS NULL THEN 3 WHEN c.hops = 1 THEN 1 ELSE 2 END AS method, CAST(coalesce(c.hops, -1) AS INTEGER) AS hops
  FROM edges e LEFT JOIN painted p ON p.edge_id = e.edge_id LEFT JOIN (
    SELECT edge_id, arg_max(level, {order}) AS level, min(hops) AS hops FROM claims GROUP BY edge_id) c ON c.edge_id = e.edge_id"""


def _painted(spark: SparkSession, sf_dir: str, e: DataFrame) -> DataFrame:
    return A.today(spark, sf_dir).join(e, "edge_id", "left_semi").select("edge_id", F.col("level").alias("rung"))


@query(_PAINTED + _REACH + _SPREAD.format(order="-hops * 10 + rung"), ("edges", "today"))
def spread_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.edges(spark, sf_dir)
    return G.spread(e, _painted(spark, sf_dir, e))


@query(_PAINTED + _REACH + _SPREAD.format(order="level * 100 - hops"), ("edges", "today"))
def spread_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.edges(spark, sf_dir)
    return G.spread(e, _painted(spark, sf_dir, e), claim="worst")


@query(None)
def spread_holdout_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors on hidden edges, three times over, for two claims."""
    e = A.edges(spark, sf_dir)
    return G.holdout_errors(e, _painted(spark, sf_dir, e), 0.2, 3)


_HUB = ", hub AS (SELECT 0 AS node)"


@query(
    _HUB + ", fwd(node) AS (SELECT CAST(node AS BIGINT) FROM hub UNION SELECT e.v FROM fwd JOIN edges e ON e.u = fwd.node) SELECT node FROM fwd",
    ("edges",),
)
def reachability_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Junctions that junction 0 reaches over roads of every class."""
    return G.reachable(A.edges(spark, sf_dir), spark.range(1).withColumnRenamed("id", "node")).select("node")


@query(
    _HUB + """, fwd(node) AS (SELECT CAST(node AS BIGINT) FROM hub UNION SELECT e.v FROM fwd JOIN edges e ON e.u = fwd.node),
    bwd(node) AS (SELECT CAST(node AS BIGINT) FROM hub UNION SELECT e.u FROM bwd JOIN edges e ON e.v = bwd.node) SELECT node FROM fwd INTERSECT SELECT node FROM bwd""",
    ("edges",),
)
def core_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Junctions that junction 0 reaches and that reach it."""
    return G.core(A.edges(spark, sf_dir), spark.range(1).withColumnRenamed("id", "node"))


@query(
    """SELECT arg_max(node, n * 1000000 - node) AS node FROM (SELECT node, count(*) AS n FROM (SELECT u AS node FROM edges UNION ALL SELECT v FROM edges) GROUP BY node)""",
    ("edges",),
)
def busiest_hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.busiest_node(A.edges(spark, sf_dir))


def _cheapest(start: str, roads: str, limit: str = "") -> str:
    """SQL of ``best(node, cost)``: improvements from ``start(node)`` over ``roads(u, v, c)`` until there are none."""
    return f""", roads AS ({roads}), best(node, cost) USING KEY (node) AS (
      SELECT DISTINCT CAST(node AS BIGINT), 0E0 FROM ({start})
      UNION SELECT x.node, x.cost FROM (SELECT e.v AS node, min(b.cost + e.c) AS cost FROM best b JOIN roads e ON e.u = b.node GROUP BY e.v) x
        LEFT JOIN recurring.best r ON r.node = x.node WHERE (r.cost IS NULL OR x.cost < r.cost) {limit})"""


@query(_cheapest("SELECT 0 AS node", "SELECT u, v, 1E0 AS c FROM edges") + " SELECT node, cost FROM best", ("edges",))
def dijkstra_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.distances(A.edges(spark, sf_dir), spark.range(1).withColumnRenamed("id", "node"), F.lit(1.0)).select("node", "cost")


@query(
    _cheapest("SELECT 0 AS node", "SELECT u, v, free_flow_s AS c FROM edges")
    + """ SELECT b.node, round(b.cost, 6) AS cost, x.via FROM best b LEFT JOIN (SELECT e.v AS node, first(e.edge_id ORDER BY b.cost + e.free_flow_s, e.edge_id) AS via FROM edges e JOIN best b ON b.node = e.u WHERE e.v <> 0 GROUP BY e.v) x ON x.node = b.node""",
    ("edges",),
)
def dijkstra_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-flow seconds from junction 0 to all others, with the last edge."""
    return G.distances(A.edges(spark, sf_dir), spark.range(1).withColumnRenamed("id", "node"), F.col("free_flow_s")).withColumn("cost", rounded("cost"))


_WAYS = (
    _cheapest("SELECT 0 AS node", "SELECT u, v, free_flow_s AS c FROM edges")
    + """, last AS (SELECT e.v AS node, first(e.edge_id ORDER BY b.cost + e.free_flow_s, e.edge_id) AS via, first(e.u ORDER BY b.cost + e.free_flow_s, e.edge_id) AS u FROM edges e JOIN best b ON b.node = e.u WHERE e.v <> 0 GROUP BY e.v),
    back(node, here, edge_id, n) AS (SELECT l.node, l.u, l.via, 0 FROM last l WHERE l.node % 50 = 0 UNION ALL SELECT b.node, l.u, l.via, b.n + 1 FROM back b JOIN last l ON l.node = b.here)
    SELECT node, CAST(max(n) OVER (PARTITION BY node) - n AS INTEGER) AS pos, edge_id FROM back"""
)


@query(_WAYS, ("edges",))
def dijkstra_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest ways from junction 0 to every fiftieth one, edge by edge."""
    e = A.edges(spark, sf_dir)
    best = G.distances(e, spark.range(1).withColumnRenamed("id", "node"), F.col("free_flow_s"))
    return G.ways(best, e, best.where("node % 50 = 0").select("node"))


@query(_WAYS, ("edges",))
def way_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ways by pointer doubling, from costs by delta-stepping."""
    e = A.edges(spark, sf_dir)
    costs = S.settle(e, spark.range(1).select(F.col("id").alias("origin"), F.col("id").alias("node")), F.col("free_flow_s")).costs
    last = cut(S.last_edges(costs, e, F.col("free_flow_s")))
    return S.ways_by_doubling(last, last.where("node % 50 = 0").select("origin", "node"))[0].select("node", "pos", "edge_id")


#: Junctions from which the routes of `landmark_routes` start.
ORIGINS = (0, 37, 74, 111)


@query(
    f""", best(origin, node, cost) USING KEY (origin, node) AS (
      SELECT CAST(o AS BIGINT), CAST(o AS BIGINT), 0E0 FROM (VALUES {", ".join(f"({o})" for o in ORIGINS)}) t(o)
      UNION SELECT x.origin, x.node, x.cost FROM (SELECT b.origin, e.v AS node, min(b.cost + e.free_flow_s) AS cost FROM best b JOIN edges e ON e.u = b.node GROUP BY ALL) x
        LEFT JOIN recurring.best r ON r.origin = x.origin AND r.node = x.node WHERE r.cost IS NULL OR x.cost < r.cost),
    last AS (SELECT b.origin, e.v AS node, first(e.edge_id ORDER BY b.cost + e.free_flow_s, e.edge_id) AS via, first(e.u ORDER BY b.cost + e.free_flow_s, e.edge_id) AS u
      FROM edges e JOIN best b ON b.node = e.u WHERE e.v <> b.origin GROUP BY ALL),
    back(origin, node, here, edge_id, n) AS (SELECT l.origin, l.node, l.u, l.via, 0 FROM last l WHERE l.node % 50 = 0
      UNION ALL SELECT b.origin, b.node, l.u, l.via, b.n + 1 FROM back b JOIN last l ON l.origin = b.origin AND l.node = b.here),
    route AS (SELECT origin, node, string_agg(edge_id::VARCHAR, ',' ORDER BY n DESC) AS route FROM back GROUP BY ALL)
    SELECT CAST(t.o AS BIGINT) AS origin, n.node_id AS destination, round(b.cost, 6) AS cost, coalesce(r.route, '') AS route
    FROM nodes n CROSS JOIN (VALUES {", ".join(f"({o})" for o in ORIGINS)}) t(o)
    LEFT JOIN best b ON b.origin = t.o AND b.node = n.node_id LEFT JOIN route r ON r.origin = t.o AND r.node = n.node_id WHERE n.node_id % 50 = 0""",
    ("nodes", "edges"),
)
def landmark_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest routes from four junctions to every fiftieth one, as joins on the edge table."""
    ends = A.nodes(spark, sf_dir).where("node_id % 50 = 0").select(F.col("node_id").alias("destination"))
    journeys = ends.select(F.explode(F.array(*[F.lit(o).cast("bigint") for o in ORIGINS])).alias("origin"), "destination")
    found = S.routes_by_landmarks(journeys, A.edges(spark, sf_dir), F.col("free_flow_s"))
    cost = F.when(F.col("cost") < float("inf"), rounded("cost"))
    return found.select("origin", "destination", cost.alias("cost"), F.array_join(F.col("route").cast("array<string>"), ",").alias("route"))


@query(
    _cheapest(
        "SELECT u AS node FROM edges WHERE class_rank <= 2 AND oneway UNION SELECT v FROM edges WHERE class_rank <= 2 AND oneway",
        "SELECT u, v, greatest(length_m, 1) AS c FROM edges UNION ALL SELECT v, u, greatest(length_m, 1) FROM edges", "AND x.cost <= 1200",
    ) + " SELECT node, round((rank() OVER (ORDER BY cost) - 1) / greatest((SELECT count(*) FROM best) - 1, 1), 3) AS reveal FROM best",
    ("edges",),
)
def reveal_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How early a map shows each junction: distance from the nearest main road."""
    e = A.edges(spark, sf_dir)
    main = e.where("class_rank <= 2 AND oneway")
    start = main.select(F.col("u").alias("node")).union(main.select("v")).distinct()
    return L.reveal_rank(G.distances(G.two_way(e), start, F.greatest("length_m", F.lit(1.0)), limit=1200.0).select("node", "cost"))


_WITHIN = (
    f"""SELECT e.edge_id FROM edges e JOIN nodes a ON e.u = a.node_id JOIN nodes b ON e.v = b.node_id
    WHERE {hav("a.lon", "a.lat", "90.41E0", "23.81E0")} <= 6000 AND {hav("b.lon", "b.lat", "90.41E0", "23.81E0")} <= 6000"""
)


@query(_WITHIN, ("nodes", "edges"))
def edges_within_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.within(A.nodes(spark, sf_dir), A.edges(spark, sf_dir), 90.41, 23.81, 6000.0).select("edge_id")


@query(_WITHIN, ("nodes", "edges"))
def edges_within_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a graph that is sorted along a curve, by intervals of its key."""
    folder = scratch(spark)
    R.write_graph_by_curve(A.nodes(spark, sf_dir), A.edges(spark, sf_dir), folder)
    return R.edges_in_disc(spark, folder, 90.41, 23.81, 6000.0).select("edge_id")


@query(
    f"""SELECT zone, lon, lat, node FROM (
      SELECT z.zone, round(n.lon, 6) AS lon, round(n.lat, 6) AS lat, n.node_id AS node, row_number() OVER (PARTITION BY z.zone ORDER BY {hav("z.lon", "z.lat", "n.lon", "n.lat")}, n.node_id) AS r
      FROM (SELECT i AS zone, 90.326774E0 + (i % 6 + 0.5E0) * ((90.499678E0 - 90.326774E0) / 6) AS lon, 23.711736E0 + (i // 6 + 0.5E0) * ((23.902086E0 - 23.711736E0) / 6) AS lat FROM range(36) t(i)) z, nodes n) WHERE r = 1""",
    ("nodes",),
)
def nearest_node_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.zone_grid(A.BOX, 6, 6, A.nodes(spark, sf_dir)).select("zone", rounded("lon").alias("lon"), rounded("lat").alias("lat"), "node")


@query(
    """, obs AS (SELECT edge_id, CASE level WHEN 0 THEN 25E0 WHEN 1 THEN 55E0 WHEN 2 THEN 85E0 ELSE 105E0 END AS weight FROM today),
    tab AS (SELECT e.*, coalesce(o.weight, 25E0) AS weight, CASE WHEN o.weight IS NULL THEN 'predicted' ELSE 'observed' END AS source FROM edges e LEFT JOIN obs o USING (edge_id))
    SELECT a, b, edge_id, weight, source, CASE WHEN weight < 40 THEN 0 WHEN weight < 70 THEN 1 WHEN weight < 95 THEN 2 ELSE 3 END + CASE WHEN source = 'observed' THEN 0 ELSE 4 END AS code FROM (
      SELECT least(u, v) AS a, greatest(u, v) AS b, edge_id, weight, source,
        row_number() OVER (PARTITION BY least(u, v), greatest(u, v) ORDER BY CASE WHEN source = 'observed' THEN 0 ELSE 1 END, weight DESC, edge_id) AS r FROM tab) WHERE r = 1""",
    ("edges", "today"),
)
def lines_best_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.edges(spark, sf_dir)
    return L.lines_best(e, _table(spark, sf_dir, e))


def _table(spark: SparkSession, sf_dir: str, e: DataFrame) -> DataFrame:
    from ..functions import traffic

    w = F.element_at(F.array(*[F.lit(x) for x in traffic.LADDER]), F.col("level") + 1)
    seen = A.today(spark, sf_dir).select("edge_id", w.alias("weight"))
    none = spark.createDataFrame([], "edge_id bigint, weight double, method int, hops int")
    return L.complete_table(e, seen, none)


@query(
    """, tab AS (SELECT e.edge_id, CASE t.level WHEN 1 THEN 55E0 WHEN 2 THEN 85E0 WHEN 3 THEN 105E0 ELSE 25E0 END AS weight,
      CASE WHEN t.level IS NULL THEN 'predicted' ELSE 'observed' END AS source, CASE WHEN t.level IS NULL THEN 'assumed_clear' ELSE 'observed' END AS method
      FROM edges e LEFT JOIN today t USING (edge_id))
    SELECT source, method, count(*) AS n, round(avg(weight), 4) AS mean_weight FROM tab GROUP BY ROLLUP (source, method)""",
    ("edges", "today"),
)
def method_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.method_counts(_table(spark, sf_dir, A.edges(spark, sf_dir)))


@query(
    """SELECT bucket, string_agg(code::VARCHAR, '' ORDER BY edge_id) AS codes FROM (SELECT edge_id // 5000 AS bucket, edge_id, class_rank % 4 AS code FROM edges) GROUP BY bucket""",
    ("edges",),
)
def packed_level_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.packed_codes(A.edges(spark, sf_dir).select("edge_id", (F.col("class_rank") % 4).alias("code")), 5000)


@query(
    """SELECT a, b, min(edge_id) AS edge_id, round(sum(ld), 6) AS load FROM (
      SELECT least(u, v) AS a, greatest(u, v) AS b, u, v, edge_id, capacity_vph * CASE coalesce(level, 0) WHEN 0 THEN 0.25E0 WHEN 1 THEN 0.55E0 WHEN 2 THEN 0.85E0 ELSE 1.05E0 END AS ld
      FROM edges LEFT JOIN today USING (edge_id) WHERE highway IN ('tertiary', 'unclassified', 'residential', 'living_street'))
    GROUP BY a, b HAVING count(*) = 2 AND count(*) FILTER (u < v) = 1 ORDER BY sum(ld) DESC, a, b LIMIT 20""",
    ("edges", "today"),
)
def side_street_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.side_streets(A.edges(spark, sf_dir), A.today(spark, sf_dir), 20).withColumn("load", rounded("load"))


def _role_reach(name: str, start: str, a: str, b: str) -> str:
    """SQL of ``name(layout, origin, node)``: a search for each layout from ``start(origin, node)``."""
    return f""", {name}(layout, origin, node) AS (SELECT l.layout, s.origin, s.node FROM layouts l, ({start}) s
      UNION SELECT r.layout, r.origin, q.{b} FROM {name} r JOIN quiet q ON q.{a} = r.node LEFT JOIN shut s ON s.layout = r.layout AND s.edge_id = q.edge_id WHERE s.edge_id IS NULL)"""


@query(
    """, quiet AS (SELECT edge_id, u, v, capacity_vph FROM edges WHERE class_rank >= 6),
    streets AS (SELECT least(u, v) AS a, greatest(u, v) AS b FROM quiet LEFT JOIN today USING (edge_id)
      GROUP BY 1, 2 HAVING count(*) = 2 AND count(*) FILTER (u < v) = 1
      ORDER BY sum(capacity_vph * CASE coalesce(level, 0) WHEN 0 THEN 0.25E0 WHEN 1 THEN 0.55E0 WHEN 2 THEN 0.85E0 ELSE 1.05E0 END) DESC, 1, 2 LIMIT 8),
    options AS (SELECT printf('%09d-%09d', a, b) AS key, edge_id, CASE WHEN u < v THEN 'forward' ELSE 'backward' END AS role FROM streets JOIN quiet ON least(u, v) = a AND greatest(u, v) = b),
    changed AS (SELECT DISTINCT key, value FROM options, (VALUES ('forward'), ('backward')) t(value)),
    listed AS (SELECT [] AS keys, [] AS vals, '' AS name UNION ALL SELECT [key], [value], key || '=' || value FROM changed
      UNION ALL SELECT [x.key, y.key], [x.value, y.value], x.key || '=' || x.value || ' ' || y.key || '=' || y.value FROM changed x JOIN changed y ON x.key < y.key),
    layouts AS (SELECT row_number() OVER (ORDER BY len(keys), name) - 1 AS layout, name, keys, vals FROM listed),
    shut AS (SELECT l.layout, o.edge_id FROM (SELECT layout, unnest(keys) AS key, unnest(vals) AS value FROM layouts) l JOIN options o ON o.key = l.key AND o.role <> l.value),
    hub AS (SELECT arg_max(node, n * 1000000 - node) AS node FROM (SELECT node, count(*) AS n FROM (SELECT u AS node FROM quiet UNION ALL SELECT v FROM quiet) GROUP BY node)),
    journeys AS (SELECT DISTINCT a AS enter, b AS leave FROM streets)"""
    + _role_reach("ahead", "SELECT -1 AS origin, node FROM hub UNION SELECT enter, enter FROM journeys", "u", "v")
    + _role_reach("behind", "SELECT -1 AS origin, node FROM hub", "v", "u")
    + """, core AS (SELECT node FROM ahead WHERE layout = 0 AND origin = -1 INTERSECT SELECT node FROM behind WHERE layout = 0),
    asked AS (SELECT j.* FROM journeys j JOIN ahead r ON r.layout = 0 AND r.origin = j.enter AND r.node = j.leave),
    counts AS (SELECT l.layout, l.name, (SELECT count(*) FROM core) - (SELECT count(*) FROM ahead r JOIN core c ON c.node = r.node WHERE r.layout = l.layout AND r.origin = -1) AS trapped_out,
      (SELECT count(*) FROM core) - (SELECT count(*) FROM behind r JOIN core c ON c.node = r.node WHERE r.layout = l.layout) AS trapped_in,
      (SELECT count(*) FROM asked) - (SELECT count(*) FROM asked j JOIN ahead r ON r.origin = j.enter AND r.node = j.leave WHERE r.layout = l.layout) AS journeys_lost FROM layouts l)
    SELECT *, trapped_out = 0 AND trapped_in = 0 AND journeys_lost = 0 AS allowed FROM counts""",
    ("edges", "today"),
)
def layout_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All layouts of the eight busiest two-way streets of the quiet network with at
    most two made one-way: who would be trapped, which journeys lost."""
    e = cut(A.edges(spark, sf_dir).where("class_rank >= 6"))
    streets = L.side_streets(e, A.today(spark, sf_dir), 8).select("a", "b")
    keyed = streets.withColumn("key", F.format_string("%09d-%09d", "a", "b"))
    role = F.when(F.col("u") < F.col("v"), "forward").otherwise("backward")
    # the streets are eight at most
    options = cut(e.join(F.broadcast(keyed), (F.least("u", "v") == F.col("a")) & (F.greatest("u", "v") == F.col("b"))).select("key", "edge_id", role.alias("role"), "a", "b"))
    values = options.select("key", F.explode(F.array(F.lit("forward"), F.lit("backward"))).alias("value"))
    layouts = Y.layouts_within_budget(values, 2)
    journeys = options.select(F.col("a").alias("enter"), F.col("b").alias("leave"))
    return Y.judge_layouts(e, options, layouts, G.busiest_node(e), journeys)


@query(None)
def graph_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.graph_id(A.edges(spark, sf_dir))
