"""Road graphs: building, adjacency, spreading levels, reachability, distances.

Iterative operators keep a frontier and join it with the edges; every round is
cut from its lineage. A round touches nodes, not pairs of edges, so a junction
of many roads costs its roads and not their square.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import traffic
from ..materialise import Rounds, cut
from .settle import dealt

METHODS = ("observed", "adjacent", "spread", "assumed_clear")
#: Fronts that are kept apart before they are put together.
LOG = 6


# Reading and building


def edges_from_elements(elements: DataFrame, min_class: str = "living_street") -> DataFrame:
    """Directed edges of OSM ways, cut at junctions.

    ``elements(type, id, lon, lat, nodes, tags)``. A junction is a node used
    twice or more, way ends counting once more. ``oneway`` yes, true and 1 keep
    the way's direction, -1 reverses it, all else gives both. Nodes that are
    missing are dropped; pieces that end where they begin are no edges.
    """
    ranks = [c for c, *_ in traffic.ROAD_CLASSES]
    allowed = ranks[: ranks.index(min_class) + 1]
    tag = lambda k: F.try_element_at(F.col("tags"), F.lit(k))
    ways = (
        elements.where("type = 'way'").withColumn("highway", tag("highway"))
        .where(traffic.base_class(F.col("highway")).isin(allowed) & (F.size("nodes") >= 2))
        .select(F.col("id").alias("way"), "highway", tag("oneway").alias("oneway"), tag_int(tag("lanes")).alias("lanes"), tag_float(tag("maxspeed")).alias("maxspeed"), "nodes")
    )
    points = elements.where("type = 'node'").select(F.col("id").alias("node"), "lon", "lat")
    used = ways.select("way", F.posexplode("nodes").alias("pos", "node")).join(points, "node")
    ends = used.groupBy("way").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    used = used.join(ends, "way").withColumn("end", F.col("pos").isin(F.col("a"), F.col("b")))
    counts = used.groupBy("node").agg((F.count("*") + F.count_if(F.col("end"))).alias("uses"))
    placed = used.join(counts, "node").withColumn("cut", F.col("end") | (F.col("uses") >= 2))
    along = Window.partitionBy("way").orderBy("pos")
    piece = F.sum(F.col("cut").cast("int")).over(along)
    numbered = placed.withColumn("piece", piece)
    # a cut point ends one piece and begins the next
    both = numbered.select("way", "pos", "node", "lon", "lat", F.explode(F.when(F.col("cut"), F.array("piece", F.col("piece") - 1)).otherwise(F.array("piece"))).alias("piece"))
    lines = both.groupBy("way", "piece").agg(F.array_sort(F.collect_list(F.struct("pos", "node", "lon", "lat"))).alias("p")).where(F.size("p") >= 2)
    lines = lines.select(
        "way", "piece", F.col("p")[0]["node"].alias("u"), F.element_at("p", -1)["node"].alias("v"), F.transform("p", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"))).alias("geometry")
    ).where("u <> v").join(ways.drop("nodes"), "way")
    back = F.col("oneway") == "-1"
    single = F.coalesce(F.col("oneway").isin("yes", "true", "1") | back, F.lit(False))
    there = lines.where(~F.coalesce(back, F.lit(False))).withColumn("side", F.lit(0))
    return_ = lines.where(~single | F.coalesce(back, F.lit(False))).withColumns(
        {"t": F.col("u"), "geometry": F.reverse("geometry"), "side": F.lit(1)}
    ).withColumn("u", F.col("v")).withColumn("v", F.col("t")).drop("t")
    every = there.unionByName(return_).withColumn("oneway", single)
    return with_defaults(every.withColumn("free_flow_kmph", F.col("maxspeed"))).withColumn("edge_id", F.xxhash64("way", "piece", "side"))


def tag_int(text: Column) -> Column:
    return F.split_part(text, F.lit(";"), F.lit(1)).try_cast("int")


def tag_float(text: Column) -> Column:
    return F.regexp_extract(F.trim(text), r"^\S+", 0).try_cast("double")


def with_defaults(edges: DataFrame) -> DataFrame:
    """Lanes, capacity, speed, length and time from the class where missing."""
    from ..functions import geo

    h = F.col("highway")
    out = edges.withColumn("lanes", F.coalesce("lanes", traffic.class_value(h, 3)))
    out = out.withColumn("free_flow_kmph", F.coalesce("free_flow_kmph", traffic.class_value(h, 2).cast("double")))
    out = out.withColumn("length_m", geo.polyline_length_m(F.col("geometry"))).withColumn("capacity_vph", traffic.capacity_of(h, F.col("lanes")).cast("double"))
    return out.withColumn("free_flow_s", traffic.free_flow_s(F.col("length_m"), F.col("free_flow_kmph")))


def two_way(edges: DataFrame) -> DataFrame:
    """Each edge and its reverse."""
    return edges.unionByName(edges.withColumn("_u", F.col("u")).withColumn("u", F.col("v")).withColumn("v", F.col("_u")).drop("_u"))


def graph_id(edges: DataFrame) -> DataFrame:
    """A fingerprint that doesn't depend on row order: counts and a combination
    of the hashes of ``id:u:v:length``; no list of all edges is built."""
    line = F.concat_ws(":", "edge_id", "u", "v", F.format_string("%.1f", "length_m"))
    return edges.agg(F.count("*").alias("edges"), F.bit_xor(F.xxhash64(line)).alias("x"), F.sum(F.crc32(line.cast("binary"))).alias("s")).select(
        "edges", F.substring(F.sha1(F.concat_ws(":", "edges", "x", "s").cast("binary")), 1, 12).alias("graph_id")
    )


# Pairs, degree and adjacency


def pair_key(prefix: str = "") -> list[Column]:
    return [F.least("u", "v").alias(prefix + "a"), F.greatest("u", "v").alias(prefix + "b")]


def street_pairs(edges: DataFrame) -> DataFrame:
    """One row per unordered pair of junctions: the first edge, how many, both ways."""
    return edges.groupBy(*pair_key()).agg(
        F.min("edge_id").alias("edge_id"), F.count("*").alias("edges"), (F.count_if(F.col("u") < F.col("v")) > 0).alias("_f"), (F.count_if(F.col("u") > F.col("v")) > 0).alias("_b")
    ).select("a", "b", "edge_id", "edges", (F.col("_f") & F.col("_b")).alias("twoway"))


def node_facts(edges: DataFrame) -> DataFrame:
    """Degree, distinct neighbours and best class of each junction."""
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("other"), "class_rank").unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("other"), "class_rank"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"), F.count_distinct("other").alias("neighbours"), F.min("class_rank").alias("best_class"))


def touching(edges: DataFrame) -> DataFrame:
    """``(edge_id, node)``: both ends, once each."""
    return edges.select("edge_id", F.explode(F.array_distinct(F.array("u", "v"))).alias("node"))


def adjacency(edges: DataFrame) -> DataFrame:
    """Ordered pairs of distinct edges that share a junction. Edges that share both
    ends meet twice and are paired at the smaller one, so nothing is made distinct."""
    t = touching(edges).join(edges.select("edge_id", *pair_key()), "edge_id")
    other = t.select("node", F.col("edge_id").alias("other"), F.col("a").alias("c"), F.col("b").alias("d"))
    both = (F.col("a") == F.col("c")) & (F.col("b") == F.col("d"))
    return t.join(other, "node").where((F.col("edge_id") != F.col("other")) & (~both | (F.col("node") == F.col("a")))).select("edge_id", "other")


def mean_neighbour_rank(edges: DataFrame) -> DataFrame:
    """Mean class rank of adjacent edges, the edge's own if it has none.

    By sums and not by pairs: what both ends have, less the edge itself at each of
    them, less the edges that share both ends and so were counted twice."""
    total = lambda by: [F.sum("class_rank").alias(f"s_{by}"), F.count("*").alias(f"n_{by}")]
    ends = touching(edges).join(edges.select("edge_id", "class_rank"), "edge_id").groupBy("node").agg(*total("node")).repartition("node")
    at = lambda end: ends.select(F.col("node").alias(end), F.col("s_node").alias(f"s_{end}"), F.col("n_node").alias(f"n_{end}"))
    pairs = edges.groupBy(*pair_key()).agg(*total("pair"))
    every = edges.select("edge_id", "u", "v", "class_rank", *pair_key()).join(at("u"), "u").join(at("v"), "v").join(pairs, ["a", "b"])
    own, loop = F.col("class_rank"), F.col("u") == F.col("v")
    s = F.when(loop, F.col("s_u") - own).otherwise(F.col("s_u") + F.col("s_v") - own - F.col("s_pair"))
    n = F.when(loop, F.col("n_u") - 1).otherwise(F.col("n_u") + F.col("n_v") - 1 - F.col("n_pair"))
    return every.select("edge_id", "class_rank", F.when(n > 0, s / n).otherwise(own.cast("double")).alias("mean_rank")).withColumn(
        "smaller", F.col("class_rank") > F.col("mean_rank") + 0.5
    )


# Spreading and reaching


def hops_by_rung(edges: DataFrame, painted: DataFrame, most_hops: int | None = None) -> DataFrame:
    """``(edge_id, rung, hops)``: hops over shared junctions from the nearest edge
    painted with that rung. ``most_hops`` stops early; None goes on to the end.

    The search runs over junctions, which are fewer than edges. Adjacency goes
    both ways, so a junction next to one of distance d has d - 1, d or d + 1: a
    round need only leave out the two fronts before it, and no front is written
    again. An edge is one hop beyond its nearer end."""
    painted = cut(painted.select("edge_id", "rung").join(edges.select("edge_id"), "edge_id", "left_semi"))
    steps = cut(two_way(edges.select("u", "v")).where("u <> v").distinct().select(F.col("u").alias("node"), F.col("v").alias("to")))
    tables = Rounds(edges.sparkSession)
    front = tables.keep(touching(edges).join(painted, "edge_id").select("node", "rung").distinct())
    fronts, before = [front.withColumn("far", F.lit(0))], front.limit(0)
    far = 0
    while most_hops is None or far + 1 < most_hops:
        far += 1
        next_ = front.join(steps, "node").select(F.col("to").alias("node"), "rung").distinct()
        next_ = tables.keep(next_.join(front.unionByName(before), ["node", "rung"], "left_anti"))
        if next_.isEmpty():
            break
        fronts.append(next_.withColumn("far", F.lit(far)))
        before, front = front, next_
    reached = reduce(DataFrame.unionByName, fronts)
    found = touching(edges).join(reached, "node").groupBy("edge_id", "rung").agg((F.min("far") + 1).alias("hops"))
    if most_hops == 0:
        found = found.limit(0)
    return tables.close(found.join(painted.withColumn("own", F.lit(0)), ["edge_id", "rung"], "full").select("edge_id", "rung", F.coalesce("own", "hops").alias("hops")))


def spread(edges: DataFrame, painted: DataFrame, per_rung: int = 1, claim: str = "nearest", most_hops: int | None = None) -> DataFrame:
    """A weight for every edge from the painted ones: ``(edge_id, weight, method, hops)``.

    Each rung claims an edge at its own distance and loses a rung for every
    ``per_rung`` hops after the first. The nearest claim decides (a tie goes to
    the worse rung), or the worst one. Painted edges keep their weight; edges that
    nothing reaches are clear, with -1 hops. Nothing painted leaves all clear.
    """
    reach = hops_by_rung(edges, painted, most_hops)
    level = F.greatest(F.col("rung") - traffic.rungs_lost(F.col("hops"), per_rung), F.lit(0))
    order = F.struct(-F.col("hops"), F.col("rung")) if claim == "nearest" else F.struct(level, -F.col("hops"))
    won = reach.groupBy("edge_id").agg(F.max_by(level, order).alias("level"), F.min("hops").alias("hops"))
    own = painted.select("edge_id", F.col("rung").alias("own"))
    best = edges.select("edge_id").join(won, "edge_id", "left").join(own, "edge_id", "left")
    rung = F.coalesce("own", "level", F.lit(0))
    method = F.when(F.col("own").isNotNull(), 0).when(F.col("hops").isNull(), 3).when(F.col("hops") == 1, 1).otherwise(2)
    return best.select(
        "edge_id", F.element_at(F.array(*[F.lit(x) for x in traffic.LADDER]), rung.cast("int") + 1).alias("weight"),
        method.alias("method"), F.coalesce("hops", F.lit(-1)).alias("hops"),
    )


def hide(painted: DataFrame, share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Split painted edges into kept and hidden by a hash of their id."""
    hidden = F.pmod(F.xxhash64(F.col("edge_id"), F.lit(seed)), F.lit(1000)) < int(share * 1000)
    return painted.where(~hidden), painted.where(hidden)


def error_columns() -> list[Column]:
    """Aggregates of the error ``e``."""
    return [
        F.count("*").alias("n"), F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"),
        F.avg((F.col("e") == 0).cast("int")).alias("rung_accuracy"), F.avg((F.col("e") < 0).cast("int")).alias("too_green"),
    ]


def spread_errors(found: DataFrame, hidden: DataFrame) -> DataFrame:
    """Mean and root mean square error, share of right rungs, share too green."""
    truth = F.element_at(F.array(*[F.lit(x) for x in traffic.LADDER]), F.col("rung").cast("int") + 1)
    both = found.join(hidden.select("edge_id", truth.alias("truth")), "edge_id").withColumn("e", F.col("weight") - F.col("truth"))
    return both.agg(*error_columns())


def junction_hops(edges: DataFrame, painted: DataFrame) -> DataFrame:
    """``(node, bits, far)``: the bits of ``painted(edge_id, bits)`` that first reach a
    junction after ``far`` hops. One search for up to 63 sets of painted edges: a
    junction has one row a round, whatever the number of sets. As in
    ``hops_by_rung``, only the two fronts before are left out."""
    union = F.bit_or("bits").alias("bits")
    steps = cut(two_way(edges.select("u", "v")).where("u <> v").distinct().select(F.col("u").alias("node"), F.col("v").alias("to")))
    tables = Rounds(edges.sparkSession)
    front = tables.keep(touching(edges).join(painted, "edge_id").groupBy("node").agg(union))
    fronts, before, far = [front.withColumn("far", F.lit(0))], front.limit(0), 0
    while not front.isEmpty():
        far += 1
        offers = front.join(steps, "node").select(F.col("to").alias("node"), "bits").groupBy("node").agg(union)
        known = front.unionByName(before).groupBy("node").agg(F.bit_or("bits").alias("old"))
        new = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("bigint"))))
        before, front = front, tables.keep(offers.join(known, "node", "left").select("node", new.alias("bits")).where("bits <> 0"))
        fronts.append(front.withColumn("far", F.lit(far)))
    return tables.close(reduce(DataFrame.unionByName, fronts))


def holdout_errors(edges: DataFrame, painted: DataFrame, share: float, seeds: int, claims: tuple[str, ...] = ("nearest", "worst"), per_rung: int = 1) -> DataFrame:
    """``spread_errors`` of ``hide(painted, share, seed)`` for each seed and claim, in
    one search: ``(repeat, claim, n, ...)``. Only hidden edges are given a weight."""
    spark, rungs = edges.sparkSession, len(traffic.LADDER)
    if seeds * rungs > 63:
        raise ValueError(f"{seeds} repeats of {rungs} rungs are more than 63 bits")
    painted = cut(painted.select("edge_id", F.col("rung").cast("int").alias("rung")).join(edges.select("edge_id"), "edge_id", "left_semi"))
    split = [hide(painted, share, seed) for seed in range(seeds)]
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("bigint"), at)
    kept = reduce(DataFrame.unionByName, [k.select("edge_id", bit(F.lit(seed * rungs) + F.col("rung")).alias("bits")) for seed, (k, _) in enumerate(split)])
    fronts = junction_hops(edges, kept.groupBy("edge_id").agg(F.bit_or("bits").alias("bits")))
    hidden = cut(reduce(DataFrame.unionByName, [h.withColumn("repeat", F.lit(seed)) for seed, (_, h) in enumerate(split)]))
    ends = touching(edges.join(hidden.select("edge_id"), "edge_id", "left_semi"))
    every = F.explode(F.array(*map(F.lit, range(rungs)))).alias("rung")
    met = hidden.select("edge_id", "repeat").join(ends, "edge_id").join(fronts, "node").select("edge_id", "repeat", "far", "bits", every)
    met = met.where(F.col("bits").bitwiseAND(bit(F.col("repeat") * rungs + F.col("rung"))) != 0)
    reach = met.groupBy("edge_id", "repeat", "rung").agg((F.min("far") + 1).alias("hops"))
    level = F.greatest(F.col("rung") - traffic.rungs_lost(F.col("hops"), per_rung), F.lit(0))
    orders = {"nearest": F.struct(-F.col("hops"), F.col("rung")), "worst": F.struct(level, -F.col("hops"))}
    won = reach.groupBy("edge_id", "repeat").agg(*[F.max_by(level, orders[c]).alias(c) for c in claims])
    weight = lambda rung: F.element_at(F.array(*[F.lit(x) for x in traffic.LADDER]), F.coalesce(rung, F.lit(0)).cast("int") + 1)
    found = hidden.join(won, ["edge_id", "repeat"], "left").select(
        "repeat", weight(F.col("rung")).alias("truth"), F.explode(F.array(*[F.struct(F.lit(c).alias("claim"), weight(F.col(c)).alias("weight")) for c in claims])).alias("x")
    ).select("repeat", "x.claim", (F.col("x.weight") - F.col("truth")).alias("e"))
    asked = spark.createDataFrame([(seed, c) for seed in range(seeds) for c in claims], "repeat int, claim string")
    errors = found.groupBy("repeat", "claim").agg(*error_columns())
    return asked.join(errors, ["repeat", "claim"], "left").na.fill(0, ["n"])


def reachable(edges: DataFrame, start: DataFrame, forward: bool = True) -> DataFrame:
    """``(node, hops)`` of all nodes that ``start(node)`` reaches, or that reach it.

    What was reached is a log of fronts; it is put together every few rounds, so a
    round writes its own front only. Steps are dealt by junction once and stay where
    they are; fronts and what was reached are shuffled to each other and never
    broadcast, as they grow with the graph and would come through the driver."""
    step = edges.select(F.col("u").alias("node"), F.col("v").alias("to")) if forward else edges.select(F.col("v").alias("node"), F.col("u").alias("to"))
    step = dealt(step.distinct(), "node")
    tables = Rounds(edges.sparkSession)
    front = tables.keep(start.select("node", F.lit(0).alias("hops")))
    log, hop = [front], 0
    while True:
        hop += 1
        seen = reduce(DataFrame.unionByName, log)
        next_ = front.hint("shuffle_hash").join(step, "node").select(F.col("to").alias("node")).distinct()
        front = tables.keep(next_.join(seen.hint("merge"), "node", "left_anti").withColumn("hops", F.lit(hop)))
        if front.isEmpty():
            return tables.close(seen)
        log = [tables.keep(seen.unionByName(front))] if len(log) == LOG else [*log, front]


def core(edges: DataFrame, hub: DataFrame) -> DataFrame:
    """Nodes that the hub reaches and that reach it."""
    ahead, behind = (reachable(edges, hub.select("node").distinct(), forward).select("node") for forward in (True, False))
    return ahead.join(behind.hint("merge"), "node", "left_semi")


def busiest_node(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node")))
    return ends.groupBy("node").count().agg(F.max_by("node", F.struct("count", -F.col("node"))).alias("node"))


def distances(edges: DataFrame, start: DataFrame, cost: Column, limit: float | None = None) -> DataFrame:
    """Least cost from ``start(node)`` to every node, by rounds of relaxation. Costs
    must not be negative; null and infinite costs block an edge. Nodes beyond
    ``limit`` are left out. ``via`` is the last edge, the smallest id of all that end
    a cheapest way; it is found when the costs have settled."""
    roads = cut(edges.select(F.col("u").alias("node"), F.col("v").alias("to"), "edge_id", cost.cast("double").alias("c")).where(F.col("c") < float("inf")))
    tables = Rounds(edges.sparkSession)
    begin = tables.keep(start.select("node").distinct())
    front = begin.select("node", F.lit(0.0).alias("cost"))
    # offers that were taken, kept as a log: the least of a node holds
    log = [front]
    while True:
        taken = reduce(DataFrame.unionByName, log)
        best = taken.groupBy("node").agg(F.min("cost").alias("cost")) if len(log) > 1 else taken
        offers = front.join(roads, "node").select(F.col("to").alias("node"), (F.col("cost") + F.col("c")).alias("cost"))
        if limit is not None:
            offers = offers.where(F.col("cost") <= limit)
        offers = offers.groupBy("node").agg(F.min("cost").alias("cost"))
        front = tables.keep(offers.join(best.select("node", F.col("cost").alias("old")), "node", "left").where("old IS NULL OR cost < old").drop("old"))
        if front.isEmpty():
            break
        log = [tables.keep(best), front] if len(log) >= LOG else [*log, front]
    best = tables.keep(best)
    last = best.join(roads, "node").select(F.col("to").alias("node"), (F.col("cost") + F.col("c")).alias("cost"), "edge_id")
    last = last.join(best, ["node", "cost"]).join(begin, "node", "left_anti").groupBy("node").agg(F.min("edge_id").alias("via"))
    return tables.close(best.join(last, "node", "left").select("node", "cost", "via"))


def ways(best: DataFrame, edges: DataFrame, ends: DataFrame) -> DataFrame:
    """The cheapest way to each of ``ends(node)`` by the last edges that
    ``distances`` found: ``(node, pos, edge_id)``, from the start. A round goes one
    edge back for all ends together; ends that aren't reached have no rows."""
    step = cut(best.where("via IS NOT NULL").select(F.col("node").alias("at"), F.col("via").alias("edge_id")).join(edges.select("edge_id", "u"), "edge_id"))
    front = cut(ends.select("node", F.col("node").alias("at")).distinct())
    log, back = [], 0
    while True:
        found = cut(front.join(step, "at").select("node", F.lit(back).alias("back"), "edge_id", "u"))
        if found.isEmpty():
            break
        log.append(found)
        front, back = found.select("node", F.col("u").alias("at")), back + 1
    if not log:
        return ends.sparkSession.createDataFrame([], "node bigint, pos int, edge_id bigint")
    every = reduce(DataFrame.unionByName, log)
    last = every.groupBy("node").agg(F.max("back").alias("last"))
    return every.join(last, "node").select("node", (F.col("last") - F.col("back")).alias("pos"), "edge_id")


# Areas and selections


def within(nodes: DataFrame, edges: DataFrame, lon: float, lat: float, radius_m: float) -> DataFrame:
    """Edges with both ends within a radius; a latitude band is tested first."""
    from ..functions import geo

    near = nodes.where(F.abs(F.col("lat") - lat) <= radius_m / 110_000.0).where(geo.haversine_m(F.col("lon"), F.col("lat"), F.lit(lon), F.lit(lat)) <= radius_m)
    return edges.join(near.select(F.col("node_id").alias("u")), "u", "left_semi").join(near.select(F.col("node_id").alias("v")), "v", "left_semi")


def nearest_node(nodes: DataFrame, points: DataFrame, cell_deg: float = 0.02) -> DataFrame:
    """The nearest node of each point ``(point, lon, lat)``; ties go to the lower id.

    Nodes are looked up in the 3 x 3 cells about the point. Points that find no
    node there, or none nearer than a cell's width, go on with cells four times as
    wide, until the cells cover everything.
    """
    from ..functions import geo

    cut_at = lambda lon, lat, width: [F.floor(lon / width).alias("cx"), F.floor(lat / width).alias("cy")]
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    d = geo.haversine_m(F.col("lon"), F.col("lat"), F.col("nlon"), F.col("nlat"))
    pick = F.min_by(F.struct("node_id", d.alias("metres")), F.struct(d, "node_id")).alias("x")
    out, rest = None, points.select("point", "lon", "lat")
    while True:
        n = nodes.select("node_id", F.col("lon").alias("nlon"), F.col("lat").alias("nlat"), *cut_at(F.col("lon"), F.col("lat"), cell_deg))
        p = rest.select("point", "lon", "lat", *cut_at(F.col("lon"), F.col("lat"), cell_deg)).withColumn("a", F.explode(around))
        p = p.withColumns({"cx": F.col("cx") + F.col("a.i"), "cy": F.col("cy") + F.col("a.j")}).drop("a")
        close = p.join(n, ["cx", "cy"]).groupBy("point").agg(pick).select("point", "x.*")
        sure = F.lit(cell_deg >= 360) | (F.col("metres") <= cell_deg * 110_000.0 * F.cos(F.radians("lat")))
        found = cut(rest.join(close, "point", "left").withColumn("ok", F.coalesce(sure & F.col("node_id").isNotNull(), F.lit(False))))
        near = found.where("ok").select("point", "node_id", "metres")
        out = near if out is None else out.unionByName(near)
        rest = found.where("NOT ok").select("point", "lon", "lat")
        if cell_deg >= 360 or rest.isEmpty():
            return out
        cell_deg *= 4


def zone_grid(box: dict, rows: int, cols: int, nodes: DataFrame) -> DataFrame:
    """Cells of a box, each anchored at the node nearest to its middle: ``(zone,
    lon, lat, node, mid_lon, mid_lat)`` with the node's own place as the zone's."""
    spark = nodes.sparkSession
    dx, dy = (box["east"] - box["west"]) / cols, (box["north"] - box["south"]) / rows
    cells = spark.range(rows * cols).select(
        F.col("id").alias("point"), (F.lit(box["west"]) + (F.col("id") % cols + 0.5) * dx).alias("lon"), (F.lit(box["south"]) + (F.floor(F.col("id") / cols) + 0.5) * dy).alias("lat")
    )
    anchored = nearest_node(nodes, cells).join(cells.withColumnsRenamed({"lon": "mid_lon", "lat": "mid_lat"}), "point")
    return anchored.join(nodes.select("node_id", "lon", "lat"), "node_id").select(F.col("point").alias("zone"), "lon", "lat", F.col("node_id").alias("node"), "mid_lon", "mid_lat")
