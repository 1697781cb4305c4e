"""Travel demand and its assignment to roads."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo, traffic
from .aggregates import numbered
from .search import Roads, routes


def gravity(zones: DataFrame, gamma: float = 1.5, k: float = 1.0, nearest_m: float = 200.0) -> DataFrame:
    """Trips between different zones: ``k * wi * wj / km ** gamma``, with distances
    of at least 200 m. Zones are a small table (a grid over a city)."""
    a = zones.select(F.col("zone").alias("i"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), F.col("weight").alias("w1"), F.col("node").alias("origin"))
    b = zones.select(F.col("zone").alias("j"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), F.col("weight").alias("w2"), F.col("node").alias("destination"))
    d = F.greatest(geo.haversine_m(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2")), F.lit(nearest_m)) / 1000.0
    return a.join(F.broadcast(b), F.col("i") != F.col("j")).select(
        "i", "j", "origin", "destination", (F.lit(k) * F.col("w1") * F.col("w2") / F.pow(d, F.lit(gamma))).alias("trips")
    )


def top_flows(od: DataFrame, top: int = 60) -> DataFrame:
    """The largest flows, their share of all trips and of the largest one."""
    total = od.agg(F.sum("trips").alias("total"), F.max("trips").alias("most"))
    return od.orderBy(F.desc("trips"), "i", "j").limit(top).join(F.broadcast(total)).select(
        "i", "j", "trips", (F.col("trips") / F.col("total")).alias("share"), (F.col("trips") / F.col("most")).alias("width")
    )


def sample_trips(od: DataFrame, trips: int, seed: int = 0) -> DataFrame:
    """Trips drawn with replacement in proportion, by hashed uniform numbers.

    Cumulative shares are formed per origin zone and offset by the zones before,
    and a draw is joined to its pair by zone, then by place."""
    per = od.groupBy("i").agg(F.sum("trips").alias("zone_trips"))
    every = Window.orderBy("i")  # one row per zone
    per = per.withColumn("hi", F.sum("zone_trips").over(every)).withColumn("lo", F.col("hi") - F.col("zone_trips"))
    total = per.agg(F.max("hi").alias("total"))
    unit = (F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1 << 53)).cast("double")) / float(1 << 53)
    draws = od.sparkSession.range(trips).withColumn("u", unit).join(F.broadcast(total)).withColumn("at", F.col("u") * F.col("total"))
    zone = draws.join(F.broadcast(per), (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))).select("id", "i", (F.col("at") - F.col("lo")).alias("at"))
    cum = F.sum("trips").over(Window.partitionBy("i").orderBy("j"))
    pairs = od.withColumn("hi", cum).withColumn("lo", F.col("hi") - F.col("trips"))
    return zone.join(pairs.drop("trips"), "i").where((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))).select(F.col("id").alias("trip"), "i", "j", "origin", "destination")


def zone_weights(zones: DataFrame, midpoints: DataFrame, radius_deg: float = 0.015) -> DataFrame:
    """1 plus a term of the mean weight of observed roads near each zone; 1 if none.
    ``midpoints(lon, lat, weight)``; zones are few and broadcast."""
    z = F.broadcast(zones.select("zone", F.col("lon").alias("zlon"), F.col("lat").alias("zlat")))
    near = midpoints.join(z, (F.abs(F.col("lon") - F.col("zlon")) <= radius_deg) & (F.abs(F.col("lat") - F.col("zlat")) <= radius_deg))
    mean = near.groupBy("zone").agg(F.avg("weight").alias("mean"))
    return zones.join(mean, "zone", "left").withColumn("weight", 1.0 + F.greatest(F.lit(0.0), (F.coalesce("mean", F.lit(25.0)) - 25.0) / 40.0)).drop("mean")


def edge_loads(routed: DataFrame, vehicles: str = "vehicles") -> DataFrame:
    """Vehicles per edge of all routes ``(route, vehicles)``."""
    return routed.select(F.explode("route").alias("edge_id"), F.col(vehicles).alias("v")).groupBy("edge_id").agg(F.sum("v").alias("volume"))


def measures(edges: DataFrame, volumes: DataFrame) -> DataFrame:
    """Vehicle-hours at the loaded times and roads over capacity."""
    e = edges.join(volumes, "edge_id").where("volume > 0")
    time = traffic.bpr_time(F.col("free_flow_s"), F.col("volume"), F.col("capacity_vph"))
    return e.agg(
        (F.sum(F.col("volume") * time) / 3600.0).alias("vehicle_hours"), F.count_if(F.col("volume") > F.col("capacity_vph")).alias("over_capacity"), F.count("*").alias("loaded_roads")
    )


def trip_minutes(edges: DataFrame, volumes: DataFrame, routed: DataFrame) -> DataFrame:
    """Mean minutes of the routed trips at the loaded times."""
    time = traffic.bpr_time(F.col("free_flow_s"), F.coalesce("volume", F.lit(0.0)), F.col("capacity_vph"))
    at = edges.join(volumes, "edge_id", "left").select("edge_id", time.alias("s"))
    per = routed.select("trip", F.explode("route").alias("edge_id")).join(at, "edge_id").groupBy("trip").agg(F.sum("s").alias("s"))
    return per.agg(F.avg(F.col("s") / 60.0).alias("mean_trip_minutes"), F.count("*").alias("trips"))


def price(roads: Roads, volume: np.ndarray) -> np.ndarray:
    """Travel times of all edges at these volumes; no capacity blocks an edge."""
    with np.errstate(divide="ignore", invalid="ignore"):
        vc = np.minimum(volume / roads.capacity, traffic.MOST_VC)
        return np.where(roads.capacity > 0, roads.free_s * (1 + traffic.ALPHA * vc**traffic.BETA), np.inf)


def assign(
    trips: DataFrame, roads: Roads, batches: int = 1, background: np.ndarray | None = None, after_batch: Callable[[int, np.ndarray], None] | None = None
) -> tuple[DataFrame, np.ndarray]:
    """Route ``trips(trip, origin, destination, vehicles)`` in batches by trip
    number; prices change between batches. One batch is all at once.

    The order of batches is inherent: each depends on the loads before. Within a
    batch the searches run in parallel and loads are summed by edge; what comes
    back to the driver is one number per loaded edge. Trips without a way stay
    out. Returns the routed trips and the volumes by edge position."""
    volume = np.zeros(len(roads.edge_id)) if background is None else background.astype(float).copy()
    place = {int(e): i for i, e in enumerate(roads.edge_id)}
    total = trips.count()
    size = max(1, math.ceil(total / batches))
    out = None
    placed = numbered(trips, "trip", "_b").withColumn("_b", F.floor(F.col("_b") / size)) if batches > 1 else trips.withColumn("_b", F.lit(0))
    placed = placed.cache()
    for b in range(math.ceil(total / size) if total else 0):
        routed = routes(placed.where(F.col("_b") == b).drop("_b"), roads, price(roads, volume)).where(F.size("route") > 0).cache()
        for row in edge_loads(routed).collect():
            volume[place[row["edge_id"]]] += row["volume"]
        out = routed if out is None else out.unionByName(routed)
        if after_batch:
            after_batch(b, volume)
    empty = trips.sparkSession.createDataFrame([], "origin bigint, destination bigint, trip bigint, vehicles double, cost double, route array<bigint>")
    return (out if out is not None else empty), volume


def vehicle_hours(roads: Roads, volume: np.ndarray) -> float:
    used = volume > 0
    return float((volume[used] * price(roads, volume)[used]).sum() / 3600.0)


def through_trips(routed: DataFrame, area: DataFrame) -> DataFrame:
    """Journeys through an area: its first and last edge on each route, summed."""
    inside = routed.select("trip", "vehicles", F.posexplode("route").alias("pos", "edge_id")).join(area.select("edge_id", "u", "v"), "edge_id")
    per = inside.groupBy("trip").agg(F.min_by("u", "pos").alias("enter"), F.max_by("v", "pos").alias("leave"), F.first("vehicles").alias("vehicles"))
    return per.groupBy("enter", "leave").agg(F.sum("vehicles").alias("vehicles"), F.count("*").alias("trips"))


def gate_demand(entries: DataFrame, exits: DataFrame, reach: DataFrame, least_m: float = 200.0, top: int = 150) -> DataFrame:
    """Arriving and departing gates matched in proportion: ``A * D / sum(D)``.
    ``entries(node, lon, lat, flow)``, ``exits`` alike, ``reach(enter, leave)``."""
    total = exits.agg(F.sum("flow").alias("total"))
    a = entries.select(F.col("node").alias("enter"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), F.col("flow").alias("f1"))
    b = exits.select(F.col("node").alias("leave"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), F.col("flow").alias("f2"))
    pairs = reach.join(a, "enter").join(b, "leave").where(geo.haversine_m(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2")) > least_m)
    return pairs.join(F.broadcast(total)).select("enter", "leave", (F.col("f1") * F.col("f2") / F.col("total")).alias("vehicles")).orderBy(F.desc("vehicles"), "enter", "leave").limit(top)
