"""Trips assigned in batches on graphs of any size.

Traffic on top of the background only makes roads dearer. So circles about both ends
of each journey, grown once at the prices of the background until their radii add up
to ``STRETCH`` times the cheapest way, hold every way that costs no more than that at
any later prices. These few roads are the journey's corridor; batches are searched
there, in a group to a journey. A way that is dearer than its corridor vouches for is
searched again on the whole graph, by joins. Nothing of the graph reaches the driver.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import traffic
from ..materialise import cut
from .aggregates import numbered
from .settle import routes_both_ways, search_both_ways

STRETCH = 1.1
#: Roads of a corridor that one group may hold; journeys beyond it are searched by joins.
MOST_ROADS = 2_000_000

FOUND = "run string, origin bigint, destination bigint, cost double, route array<bigint>, sure boolean"


def priced(edges: DataFrame) -> Column:
    """Seconds at the volume ``background``; roads without capacity are closed."""
    return F.when(F.col("capacity_vph") > 0, traffic.bpr_time(F.col("free_flow_s"), F.col("background"), F.col("capacity_vph")))


def corridors(journeys: DataFrame, edges: DataFrame, stretch: float = STRETCH) -> DataFrame:
    """``(origin, destination, budget, edge_id, u, v, free_flow_s, capacity_vph,
    background)``: each journey's roads. They hold all ways that cost no more than
    ``budget``, which is infinite where a circle has all there is. Journeys that are
    not possible have no rows."""
    pairs = ["origin", "destination"]
    found = search_both_ways(journeys, edges, priced(edges), stretch)
    best = found.best.select(*pairs, (F.col("cost") * stretch).alias("budget"))
    roads = edges.where("capacity_vph > 0").select("edge_id", "u", "v", "free_flow_s", "capacity_vph", "background")
    parts, whole = [], best
    for side, name, here, there in ((0, "origin", "u", "v"), (1, "destination", "v", "u")):
        circle = found.labels.where(F.col("side") == side).select(F.col("end").alias(name), F.col("node").alias(here))
        own = cut(roads.join(circle.hint("shuffle_hash"), here))
        parts.append(own)
        past = own.join(circle.withColumnRenamed(here, there).hint("merge"), [name, there], "left_anti").select(name).distinct()
        whole = whole.join(past.withColumn(f"past_{name}", F.lit(True)), name, "left")
    budget = F.when(F.col("past_origin") & F.col("past_destination"), F.col("budget")).otherwise(float("inf"))
    known = cut(whole.select(*pairs, budget.alias("budget")))
    every = parts[0].join(F.broadcast(known), "origin").unionByName(parts[1].join(F.broadcast(known), "destination"))
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(every.repartition(n, *pairs))


def cheapest(origin: int, destination: int, first: dict[int, tuple[int, int]], head: list[int], tail: list[int], cost: list[float]) -> tuple[float, list[int]]:
    """Cost and positions of a cheapest way over roads in order of their start."""
    best, via, queue = {origin: 0.0}, {}, [(0.0, origin)]
    while queue:
        so_far, here = heapq.heappop(queue)
        if here == destination:
            break
        if so_far > best[here]:
            continue
        for k in range(*first.get(here, (0, 0))):
            total = so_far + cost[k]
            if total < best.get(head[k], math.inf):
                best[head[k]], via[head[k]] = total, k
                heapq.heappush(queue, (total, head[k]))
    if destination not in best:
        return math.inf, []
    way, at = [], destination
    while at != origin:
        way.append(via[at])
        at = tail[via[at]]
    return best[destination], way[::-1]


def _search(parts: DataFrame, asked: DataFrame, loads: dict, changes: dict) -> DataFrame:
    """``FOUND`` for ``asked(run, origin, destination)`` at the runs' loads."""
    sent = asked.sparkSession.sparkContext.broadcast((loads, changes))

    def one(key: tuple, roads: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
        volumes, factors = sent.value
        roads = roads.drop_duplicates("edge_id").sort_values(["u", "edge_id"])
        ids, u = roads["edge_id"].to_numpy(), roads["u"].to_numpy()
        starts, at = np.unique(u, return_index=True)
        first = {int(a): (int(b), int(c)) for a, b, c in zip(starts, at, [*at[1:], len(u)])}
        tail, head = u.tolist(), roads["v"].tolist()
        by_id = {int(e): i for i, e in enumerate(ids)}
        free, budget, out = roads["free_flow_s"].to_numpy(), roads["budget"].iloc[0] if len(roads) else math.inf, []
        known: dict[tuple, tuple[float, list[int]]] = {}  # runs that are alike in this corridor
        for run in sorted(runs["run"]):
            state = tuple(tuple(sorted((e, x) for e, x in table.get(run, {}).items() if e in by_id)) for table in (volumes, factors))
            volume, capacity = roads["background"].to_numpy(copy=True), roads["capacity_vph"].to_numpy(np.float64, copy=True)
            for e, x in volumes.get(run, {}).items():
                if e in by_id:
                    volume[by_id[e]] += x
            shut = []
            for e, x in factors.get(run, {}).items():
                if e in by_id:
                    capacity[by_id[e]] *= x or 1
                    if not x:
                        shut.append(by_id[e])
            cost = free * (1 + traffic.ALPHA * np.minimum(volume / capacity, traffic.MOST_VC) ** traffic.BETA)
            cost[shut] = math.inf
            if state not in known:
                known[state] = cheapest(*key, first, head, tail, cost.tolist())
            total, way = known[state]
            out.append((run, *key, total, ids[way].tolist() if way else [], bool(total <= budget or budget == math.inf)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")])

    pairs = ["origin", "destination"]
    roads = parts.join(F.broadcast(asked.select(*pairs).distinct()), pairs, "left_semi")
    return roads.groupBy(*pairs).cogroup(asked.groupBy(*pairs)).applyInPandas(one, FOUND)


def _whole(edges: DataFrame, asked: DataFrame, load: dict, factor: dict) -> DataFrame:
    """The ways of one run on the whole graph."""
    spark = edges.sparkSession
    more = spark.createDataFrame([(int(e), float(load.get(e, 0.0)), float(factor.get(e, 1))) for e in {*load, *factor}], "edge_id bigint, more double, factor double")
    e = edges.join(F.broadcast(more), "edge_id", "left").withColumns({
        "background": F.col("background") + F.coalesce("more", F.lit(0.0)), "capacity_vph": F.col("capacity_vph") * F.coalesce("factor", F.lit(1.0)),
    })
    return routes_both_ways(asked, e.select("edge_id", "u", "v", priced(e).alias("c")), F.col("c"))


def assign_runs(
    edges: DataFrame, trips: DataFrame, batches: dict[str, int], changes: dict[str, dict[int, int]] | None = None,
    after_batch: Callable[[int, dict[str, dict[int, float]]], None] | None = None, stretch: float = STRETCH, most_roads: int = MOST_ROADS,
) -> tuple[DataFrame, dict[str, dict[int, float]]]:
    """Route ``trips(trip, origin, destination, vehicles)`` in each run's number of
    batches by trip number; prices change between batches, and runs go on together.

    ``edges`` may have the vehicles ``background`` that are there before. ``changes``
    are by run and edge: 0 closes it, else its capacity is so many times as large; they
    may not make a road with traffic in the background cheaper. Returns ``(run, trip,
    origin, destination, vehicles, cost, route)`` of the trips that have a way and, by
    run, the vehicles that trips add to each edge they load: that is all that comes to
    the driver."""
    spark, changes = edges.sparkSession, changes or {}
    if "background" not in edges.columns:
        edges = edges.withColumn("background", F.lit(0.0))
    edges = edges.select("edge_id", "u", "v", "free_flow_s", "capacity_vph", "background")
    pairs = ["origin", "destination"]
    trips = trips.select("trip", F.col("origin").cast("bigint").alias("origin"), F.col("destination").cast("bigint").alias("destination"), "vehicles")
    trips = cut(numbered(trips, "trip", "_n"))
    total = trips.count()
    sizes = {run: max(1, math.ceil(total / n)) for run, n in batches.items()}
    sized = spark.createDataFrame(list(sizes.items()), "run string, size bigint")
    placed = cut(trips.crossJoin(F.broadcast(sized)).withColumn("batch", F.floor(F.col("_n") / F.col("size"))).drop("_n", "size"))
    parts = corridors(trips.select(*pairs), edges, stretch)
    held = cut(parts.groupBy(*pairs).agg((F.count("*") <= most_roads).alias("fits")))
    fits, large = held.where("fits").select(*pairs), held.where("NOT fits").select(*pairs)
    parts = parts.join(F.broadcast(fits), pairs, "left_semi")
    loads: dict[str, dict[int, float]] = {run: {} for run in batches}
    out = None
    for b in range(max((math.ceil(total / s) for s in sizes.values()), default=0)):
        now = placed.where(F.col("batch") == b)
        asked = now.select("run", *pairs).distinct()
        found = cut(_search(parts, asked.join(F.broadcast(fits), pairs, "left_semi"), loads, changes))
        again = cut(found.where("NOT sure").select("run", *pairs).unionByName(asked.join(F.broadcast(large), pairs, "left_semi")))
        for run in sorted(r["run"] for r in again.select("run").distinct().collect()):
            ways = _whole(edges, again.where(F.col("run") == run).select(*pairs), loads[run], changes.get(run, {}))
            found = found.join(again.where(F.col("run") == run), ["run", *pairs], "left_anti").unionByName(
                ways.select(F.lit(run).alias("run"), *pairs, "cost", "route", F.lit(True).alias("sure"))
            )
        routed = cut(now.join(found.drop("sure"), ["run", *pairs]).where(F.col("cost") < float("inf")).drop("batch"))
        added = routed.select("run", F.explode("route").alias("edge_id"), "vehicles").groupBy("run", "edge_id").agg(F.sum("vehicles").alias("x"))
        for r in added.collect():
            loads[r["run"]][r["edge_id"]] = loads[r["run"]].get(r["edge_id"], 0.0) + r["x"]
        out = routed if out is None else out.unionByName(routed)
        if after_batch:
            after_batch(b, loads)
    empty = spark.createDataFrame([], "run string, trip bigint, origin bigint, destination bigint, vehicles double, cost double, route array<bigint>")
    return (out if out is not None else empty).select("run", "trip", *pairs, "vehicles", "cost", "route"), loads


def volumes(edges: DataFrame, load: dict[int, float]) -> DataFrame:
    """``(edge_id, volume)`` of the edges that trips load."""
    return edges.sparkSession.createDataFrame([(int(k), float(x)) for k, x in load.items() if x > 0], "edge_id bigint, volume double")
