"""Point-to-point routes: A* in parallel over journeys.

The graph is broadcast as flat arrays after a check of its size; journeys are
spread over the executors and each task searches its own. A graph over the
limit is searched as joins on the edge table instead, for all origins at once
(``settle.routes_by_landmarks``).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EAST_M, NORTH_M

#: Edges of a graph that may be broadcast: about 400 MB of arrays.
MOST_EDGES = 10_000_000


@dataclass
class Roads:
    """A graph in flat arrays: nodes by position, edges sorted by start."""

    node_id: np.ndarray
    x: np.ndarray
    y: np.ndarray
    first: np.ndarray
    edge_id: np.ndarray
    head: np.ndarray
    tail: np.ndarray
    length: np.ndarray
    free_s: np.ndarray
    capacity: np.ndarray
    speed: float
    place: dict[int, int]

    @classmethod
    def collect(cls, nodes: DataFrame, edges: DataFrame, most_edges: int = MOST_EDGES) -> Roads:
        """Bring a graph of checked size to the driver."""
        if (n := edges.count()) > most_edges:
            raise ValueError(f"{n} edges are more than the {most_edges} that may be broadcast; use graph.distances, settle.routes_both_ways or corridors.assign_runs")
        p = nodes.select("node_id", "lon", "lat").toPandas().sort_values("node_id")
        e = edges.select("edge_id", "u", "v", "length_m", "free_flow_s", "capacity_vph").toPandas()
        ids = p["node_id"].to_numpy(np.int64)
        place = {int(k): i for i, k in enumerate(ids)}
        e = e[e["u"].isin(place) & e["v"].isin(place)]
        u = np.searchsorted(ids, e["u"].to_numpy(np.int64))
        v = np.searchsorted(ids, e["v"].to_numpy(np.int64))
        order = np.lexsort((e["edge_id"].to_numpy(), u))
        lat0 = math.radians(float(p["lat"].mean())) if len(p) else 0.0
        get = lambda c: e[c].to_numpy(np.float64)[order]
        length, free = get("length_m"), get("free_flow_s")
        speed = float((length / np.maximum(free, 1e-9)).max()) if len(e) else 1.0
        return cls(
            ids, p["lon"].to_numpy() * EAST_M * math.cos(lat0), p["lat"].to_numpy() * NORTH_M, np.searchsorted(u[order], np.arange(len(ids) + 1)),
            e["edge_id"].to_numpy(np.int64)[order], v[order], u[order], length, free, get("capacity_vph"), speed, place,
        )

    def shortest(self, origin: int, destination: int, cost: np.ndarray, shut: Callable[[int], bool] = lambda k: False) -> tuple[float, list[int]]:
        """Cost and edge positions of the cheapest way; infinite if there is none.

        ``cost`` is by edge position; infinite entries and ``shut`` ones are never taken. The
        estimate is the straight line at the graph's top speed, a little less."""
        a, b = self.place.get(origin), self.place.get(destination)
        if a is None or b is None:
            return math.inf, []
        if a == b:
            return 0.0, []
        scale = 0.99 / self.speed
        guess = lambda i: math.hypot(self.x[i] - self.x[b], self.y[i] - self.y[b]) * scale
        best, via, done = {a: 0.0}, {}, set()
        queue = [(guess(a), 0, a)]
        count = 0
        first, head = self.first, self.head
        while queue:
            _, _, here = heapq.heappop(queue)
            if here == b:
                break
            if here in done:
                continue
            done.add(here)
            so_far = best[here]
            for k in range(first[here], first[here + 1]):
                there, total = int(head[k]), so_far + cost[k]
                if total < best.get(there, math.inf) and not shut(k):
                    best[there], via[there] = total, k
                    count += 1
                    heapq.heappush(queue, (total + guess(there), count, there))
        if b not in best:
            return math.inf, []
        way, at = [], b
        while at != a:
            way.append(via[at])
            at = int(self.tail[via[at]])
        return best[b], way[::-1]


def straight_line_admissible(roads: Roads) -> bool:
    """No edge is faster than the estimate allows (for free-flow costs)."""
    d = np.hypot(roads.x[roads.head] - roads.x[roads.tail], roads.y[roads.head] - roads.y[roads.tail])
    return bool((d * 0.99 / roads.speed <= roads.free_s + 1e-9).all())


def routes(journeys: DataFrame, roads: Roads, cost: np.ndarray | None = None) -> DataFrame:
    """``journeys(origin, destination)`` with ``cost`` and ``route`` (edge ids).

    Each distinct journey is searched once; the result is joined back. No way
    gives an infinite cost and an empty route."""
    spark = journeys.sparkSession
    sent = spark.sparkContext.broadcast((roads, roads.free_s if cost is None else cost))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, c = sent.value
        for batch in batches:
            found = [graph.shortest(a, b, c) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.float64()), pa.array([graph.edge_id[w].tolist() for _, w in found], pa.list_(pa.int64()))],
                ["origin", "destination", "cost", "route"],
            )

    distinct = journeys.select(F.col("origin").cast("bigint").alias("origin"), F.col("destination").cast("bigint").alias("destination")).distinct()
    found = distinct.repartition("origin", "destination").mapInArrow(run, "origin bigint, destination bigint, cost double, route array<bigint>")
    return journeys.join(found, ["origin", "destination"], "left")
