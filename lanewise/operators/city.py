"""City experiments: traffic with extra trips, and layouts scored by assignment."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, traffic
from ..materialise import cut
from .corridors import assign_runs, volumes
from .demand import gravity, sample_trips, trip_minutes
from .layouts import in_words, missing_layouts, reach_of_layouts
from .search import Roads

MEASURES = "run string, vehicle_hours double, over_capacity long, mean_trip_minutes double, routed long, unreachable long"


def zone_demand(nodes: DataFrame, edges: DataFrame, levels: DataFrame, zones: DataFrame, box: dict, trips: int, seed: int = 0) -> DataFrame:
    """Trips between zones weighted by 1 plus the mean level of the roads in their cell."""
    n = nodes.select(F.col("node_id").alias("u"), geo.grid_cell(F.col("lon"), F.col("lat"), box, int(math.sqrt(zones.count()))).alias("zone"))
    mean = edges.join(n, "u").join(levels, "edge_id", "left").groupBy("zone").agg(F.avg(F.coalesce("level", F.lit(0))).alias("m"))
    weighted = zones.join(mean, "zone", "left").withColumn("weight", 1.0 + F.coalesce("m", F.lit(0.0)))
    return sample_trips(gravity(weighted), trips, seed)


def run_city(nodes: DataFrame, edges: DataFrame, levels: DataFrame, trips: DataFrame, batches: int = 10) -> tuple[DataFrame, DataFrame]:
    """Measures before, all at once and in batches; and per touched road its level
    after each batch: ``(batch, edge_id, level)``.

    ``trips(trip, origin, destination, vehicles)`` come on top of the levels' load;
    unlisted roads are clear. The graph stays a table (``corridors.assign_runs``)."""
    spark = edges.sparkSession
    level = levels.groupBy("edge_id").agg(F.max("level").alias("level"))
    held = traffic.actual_load(F.coalesce("level", F.lit(0)), F.col("capacity_vph"))
    places = nodes.select("node_id")
    base = edges.join(level, "edge_id", "left").join(places.withColumnRenamed("node_id", "u"), "u", "left_semi").join(places.withColumnRenamed("node_id", "v"), "v", "left_semi")
    base = cut(base.select("edge_id", "u", "v", "free_flow_s", "capacity_vph", held.alias("background")))
    touched: list[tuple[int, int, float]] = []

    def frame(b: int, loads: dict[str, dict[int, float]]) -> None:
        if b < batches:
            touched.extend((b, int(k), float(x)) for k, x in loads["in batches"].items() if x > 0)

    total = trips.count()
    routed, loads = assign_runs(base, trips, {"all at once": 1, "in batches": batches}, after_batch=frame)
    rows = []
    for name, load in (("before", {}), *loads.items()):
        at = base.join(F.broadcast(volumes(base, load)), "edge_id", "left")
        at = at.withColumn("volume", F.col("background") + F.coalesce("volume", F.lit(0.0))).drop("background")
        time = traffic.bpr_time(F.col("free_flow_s"), F.col("volume"), F.col("capacity_vph"))
        m = at.where("volume > 0").agg((F.sum(F.col("volume") * time) / 3600).alias("hours"), F.count_if((F.col("capacity_vph") > 0) & (F.col("volume") > F.col("capacity_vph"))).alias("over")).first()
        took = (0.0, 0)
        if load:
            took = trip_minutes(at.drop("volume"), at.select("edge_id", "volume"), routed.where(F.col("run") == name)).first()
        lost = 0 if name == "before" else total - took[1]
        rows.append((name, round(m["hours"] or 0.0, 4), m["over"], round(took[0] or 0.0, 4), took[1], lost))
    added = spark.createDataFrame(touched, "batch int, edge_id bigint, added double")
    vc = (F.col("background") + F.col("added")) / F.greatest("capacity_vph", F.lit(1e-9))
    rung = F.when(vc >= 0.95, 3).when(vc >= 0.7, 2).when(vc >= 0.4, 1).otherwise(0)
    return spark.createDataFrame(rows, MEASURES), base.join(F.broadcast(added), "edge_id").select("batch", "edge_id", rung.alias("level"))


def reached(roads: Roads, hub: int, shut: np.ndarray, forward: bool = True) -> np.ndarray:
    """Which nodes a hub reaches over roads that aren't ``shut``, or which reach it."""
    a, b = (roads.tail, roads.head) if forward else (roads.head, roads.tail)
    a, b = a[~shut], b[~shut]
    seen = np.zeros(len(roads.node_id), dtype=bool)
    seen[roads.place[hub]] = True
    while True:
        new = b[seen[a] & ~seen[b]]
        if not len(new):
            return seen
        seen[new] = True


def score_layouts(
    layouts: DataFrame, options: DataFrame, roads: Roads, trips: list[tuple[int, int, float]], batches: int = 4, hub: int | None = None
) -> DataFrame:
    """Every layout's vehicle-hours after a batched assignment of ``trips``, its
    trips without a way, and the nodes it traps: those that the ``hub`` reaches
    and that reach it today, but not under the layout (none without a hub).

    ``layouts`` has one string column per option key; ``options(key, edge_id,
    role)`` as in ``planning.layout_edges``. Layouts are independent, so each is
    assigned whole inside one task on the broadcast graph."""
    spark = layouts.sparkSession
    keys = layouts.columns
    place = {int(e): i for i, e in enumerate(roads.edge_id)}
    roles: dict[str, list[tuple[int, str]]] = {}
    for r in options.collect():
        if r["edge_id"] in place:
            roles.setdefault(r["key"], []).append((place[r["edge_id"]], r["role"]))
    none = np.zeros(len(roads.edge_id), dtype=bool)
    core = reached(roads, hub, none) & reached(roads, hub, none, False) if hub is not None else np.zeros(len(roads.node_id), dtype=bool)
    sent = spark.sparkContext.broadcast((roads, roles, trips, core))

    def score(layout: dict[str, str]) -> tuple[float, int, int]:
        graph, parts, journeys, inner = sent.value
        capacity, blocked = graph.capacity.copy(), np.zeros(len(graph.edge_id), dtype=bool)
        for key, value in layout.items():
            for k, role in parts.get(key, ()):
                if (role == "gap" and value == "closed") or (value in ("forward", "backward") and role in ("forward", "backward") and role != value):
                    blocked[k] = True
                elif role == value:
                    capacity[k] *= 2
        volume, lost = np.zeros(len(capacity)), 0
        size = max(1, math.ceil(len(journeys) / batches))

        def now() -> np.ndarray:
            with np.errstate(divide="ignore", invalid="ignore"):
                vc = np.minimum(volume / capacity, traffic.MOST_VC)
                return np.where(blocked | (capacity <= 0), np.inf, graph.free_s * (1 + traffic.ALPHA * vc**traffic.BETA))

        for at in range(0, len(journeys), size):
            cost, known, add = now(), {}, np.zeros(len(capacity))
            for o, d, v in journeys[at : at + size]:
                if (o, d) not in known:
                    known[o, d] = graph.shortest(o, d, cost)
                c, way = known[o, d]
                if math.isinf(c):
                    lost += 1
                else:
                    add[way] += v
            volume += add
        used = volume > 0
        trapped = int((inner & ~(reached(graph, hub, blocked) & reached(graph, hub, blocked, False))).sum()) if hub is not None and blocked.any() else 0
        return float((volume[used] * now()[used]).sum() / 3600), lost, trapped

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            rows = [score(dict(zip(keys, r.values()))) for r in batch.to_pylist()]
            names = [",".join(f"{k}={v}" for k, v in r.items()) for r in batch.to_pylist()]
            h, n, t = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(h, pa.float64()), pa.array(n, pa.int64()), pa.array(t, pa.int64())], ["layout", "vehicle_hours", "unreachable", "trapped"]
            )

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return layouts.repartition(tasks).mapInArrow(run, "layout string, vehicle_hours double, unreachable long, trapped long")


def score_layouts_by_joins(
    layouts: DataFrame, options: DataFrame, edges: DataFrame, trips: DataFrame, batches: int = 4, hub: DataFrame | None = None
) -> DataFrame:
    """The same scores where the graph stays a table: all layouts are assigned together
    in the corridors of each journey (``corridors.assign_runs``), and what they trap is
    found in one search (``layouts.reach_of_layouts``).

    ``trips(trip, origin, destination, vehicles)`` are routed by trip number, ``hub(node)``
    has one row at most. Layouts with their few roads and the roads that trips load come
    to the driver, nothing that grows with the graph."""
    spark, keys = edges.sparkSession, layouts.columns
    roles: dict[str, list[tuple[int, str]]] = {}
    for r in options.join(edges.select("edge_id"), "edge_id", "left_semi").select("key", "edge_id", "role").distinct().collect():
        roles.setdefault(r["key"], []).append((r["edge_id"], r["role"]))
    changes: dict[str, dict[int, int]] = {}
    for layout in (r.asDict() for r in layouts.collect()):
        times: dict[int, int] = {}
        for key, value in layout.items():
            for e, role in roles.get(key, ()):
                if (role == "gap" and value == "closed") or (value in ("forward", "backward") and role in ("forward", "backward") and role != value):
                    times[e] = 0
                elif role == value:
                    times[e] = 2 * times.get(e, 1)
        changes[",".join(f"{k}={layout[k]}" for k in keys)] = times
    names = sorted(changes)
    numbers = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "layout bigint, name string")
    roads = cut(edges.select("edge_id", "u", "v", "free_flow_s", "capacity_vph"))
    trips = cut(trips.select("trip", "origin", "destination", "vehicles"))
    routed, loads = assign_runs(roads, trips, {n: batches for n in names}, changes)
    used = [(n, int(e), float(x), float(changes[n].get(e, 1))) for n in names for e, x in loads[n].items() if x > 0]
    at = roads.join(F.broadcast(spark.createDataFrame(used, "name string, edge_id bigint, volume double, times double")), "edge_id")
    time = traffic.bpr_time(F.col("free_flow_s"), F.col("volume"), F.col("capacity_vph") * F.col("times"))
    hours = at.groupBy("name").agg((F.sum(F.col("volume") * time) / 3600).alias("vehicle_hours"))
    ways = routed.groupBy(F.col("run").alias("name")).agg(F.count("*").alias("ways"))
    out = numbers.join(F.broadcast(hours), "name", "left").join(F.broadcast(ways), "name", "left")
    if hub is None:
        out = out.withColumn("trapped", F.lit(0).cast("bigint"))
    else:
        closed = spark.createDataFrame([(i + 1, e) for i, n in enumerate(names) for e, x in changes[n].items() if not x], "layout bigint, edge_id bigint")
        # layout 0 is the graph as it is, whether or not it is among those asked for
        shut = cut(closed.select("edge_id", *in_words()).groupBy("edge_id", "word").agg(F.bit_or("bit").alias("shut")))
        found = reach_of_layouts(roads, shut, len(names) + 1, hub, spark.createDataFrame([], "enter bigint, leave bigint"))
        both = found.ahead.join(found.behind.withColumnRenamed("bits", "back"), ["origin", "node", "word"])
        both = both.select("origin", "node", "word", F.col("bits").bitwiseAND(F.col("back")).alias("bits"))
        missed = missing_layouts(found.groups, both, len(names) + 1).select((F.col("layout") - 1).alias("layout"), F.col("missed").alias("trapped"))
        out = out.join(F.broadcast(missed), "layout", "left")
    zero = lambda c, v: F.coalesce(c, F.lit(v))
    return out.select(
        F.col("name").alias("layout"), zero("vehicle_hours", 0.0).alias("vehicle_hours"), (F.lit(trips.count()) - zero("ways", 0)).cast("bigint").alias("unreachable"),
        zero("trapped", 0).cast("bigint").alias("trapped"),
    )


def plan(
    layouts: DataFrame, options: DataFrame, roads: Roads | DataFrame, trips: list[tuple[int, int, float]] | DataFrame, today: dict[str, str],
    hub: int | DataFrame | None = None, top: int = 10,
) -> tuple[DataFrame, dict[str, float]]:
    """The best changes and what they are measured by.

    ``layouts`` satisfy the rules that need no search; those that lose a trip or
    trap a junction are left out, and so is today's. The second result has today's
    vehicle-hours, how many layouts were scored and how many are better. ``roads`` as a
    table of edges, with tables of trips and hub, are for graphs of any size."""
    from .planning import ranked

    table = isinstance(roads, DataFrame)
    scores = cut((score_layouts_by_joins if table else score_layouts)(layouts, options, roads, trips, hub=hub))
    vehicles = trips.agg(F.sum("vehicles")).first()[0] or 0.0 if table else sum(v for _, _, v in trips)
    now = ",".join(f"{k}={today[k]}" for k in layouts.columns)
    kept = scores.where((F.col("unreachable") == 0) & (F.col("trapped") == 0))
    base = scores.where(F.col("layout") == now).first()
    hours = base["vehicle_hours"] if base else float("nan")
    others = kept.where(F.col("layout") != now)
    facts = {"baseline_hours": hours, "layouts_scored": others.count(), "layouts_better": others.where(F.col("vehicle_hours") < hours).count(), "vehicles": float(vehicles)}
    return ranked(others, hours or 1.0, top), facts
