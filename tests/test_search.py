import heapq
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lanewise.operators import demand as D
from lanewise.operators import graph as G
from lanewise.operators.diversion import Run, onward, run_diversion
from lanewise.operators.search import Roads, routes, straight_line_admissible

EDGE = "edge_id bigint, u bigint, v bigint, length_m double, free_flow_s double, capacity_vph double, highway string"


def lattice(spark, n=6, seed=None):
    rng = np.random.default_rng(seed)
    nodes = [(r * n + c, 90.40 + c * 0.002, 23.75 + r * 0.002) for r in range(n) for c in range(n)] + [(99, 91.0, 24.0)]
    rows, k = [], 0
    for r in range(n):
        for c in range(n):
            for a, b in ((r, c + 1), (r + 1, c)):
                if a < n and b < n:
                    d = 0.002 * (111320 * math.cos(math.radians(23.755)) if a == r else 110540)
                    for u, v in ((r * n + c, a * n + b), (a * n + b, r * n + c)):
                        slow = 1 if seed is None else float(rng.uniform(1, 3))
                        rows.append((k, u, v, d, d / (40 / 3.6) * slow, 2000.0, "secondary"))
                        k += 1
    return spark.createDataFrame(nodes, "node_id bigint, lon double, lat double"), spark.createDataFrame(rows, EDGE)


def dijkstra(rows, start, cost):
    out, best, queue = {}, {start: 0.0}, [(0.0, start)]
    near = {}
    for r in rows:
        near.setdefault(r.u, []).append(r)
    while queue:
        d, u = heapq.heappop(queue)
        if u in out:
            continue
        out[u] = d
        for r in near.get(u, ()):
            if d + cost(r) < best.get(r.v, math.inf):
                best[r.v] = d + cost(r)
                heapq.heappush(queue, (best[r.v], r.v))
    return out


@pytest.mark.parametrize("seed", [None, 1])
def test_routes_cost_what_the_cheapest_way_costs(spark, seed):
    nodes, edges = lattice(spark, seed=seed)
    roads = Roads.collect(nodes, edges)
    assert straight_line_admissible(roads)
    j = spark.createDataFrame([(0, 35), (3, 30), (0, 99), (7, 7), (0, 35)], "origin bigint, destination bigint")
    got = {(r.origin, r.destination): r for r in routes(j, roads).collect()}
    rows = edges.collect()
    for o, d in ((0, 35), (3, 30)):
        assert got[o, d].cost == pytest.approx(dijkstra(rows, o, lambda r: r.free_flow_s)[d])
        way = [next(r for r in rows if r.edge_id == e) for e in got[o, d].route]
        assert way[0].u == o and way[-1].v == d and all(a.v == b.u for a, b in zip(way, way[1:]))
    if seed is None:
        assert len(got[0, 35].route) == 10
    assert got[0, 99].cost == math.inf and got[0, 99].route == []
    assert (got[7, 7].cost, got[7, 7].route) == (0.0, [])
    assert routes(j, roads).count() == 5


def test_distances_equal_the_search(spark):
    nodes, edges = lattice(spark, seed=2)
    got = {r.node: r.cost for r in G.distances(edges, spark.createDataFrame([(0,)], "node bigint"), F.col("free_flow_s")).collect()}
    want = dijkstra(edges.collect(), 0, lambda r: r.free_flow_s)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_blocked_edges_are_never_taken(spark):
    nodes, edges = lattice(spark)
    roads = Roads.collect(nodes, edges)
    cost = roads.free_s.copy()
    cost[[i for i, (u, v) in enumerate(zip(roads.tail, roads.head)) if (roads.node_id[u] // 6 == 2) != (roads.node_id[v] // 6 == 2)]] = math.inf
    assert routes(spark.createDataFrame([(0, 35)], "origin bigint, destination bigint"), roads, cost).first().cost == math.inf


def test_size_of_a_broadcast_graph_is_checked(spark):
    nodes, edges = lattice(spark)
    with pytest.raises(ValueError, match="graph.distances"):
        Roads.collect(nodes, edges, most_edges=5)


def two_ways(spark):
    nodes = spark.createDataFrame([(0, 90.40, 23.75), (1, 90.41, 23.75), (2, 90.405, 23.751)], "node_id bigint, lon double, lat double")
    edges = spark.createDataFrame([(0, 0, 1, 1000.0, 72.0, 100.0, "primary"), (1, 0, 2, 520.0, 46.8, 1000.0, "trunk"), (2, 2, 1, 520.0, 46.8, 1000.0, "trunk")], EDGE)
    return nodes, edges


def test_batches_share_the_load(spark):
    nodes, edges = two_ways(spark)
    roads = Roads.collect(nodes, edges)
    trips = spark.range(400).select(F.col("id").alias("trip"), F.lit(0).cast("bigint").alias("origin"), F.lit(1).cast("bigint").alias("destination"), F.lit(1.0).alias("vehicles"))
    _, at_once = D.assign(trips, roads, 1)
    seen = []
    _, batched = D.assign(trips, roads, 10, after_batch=lambda b, v: seen.append(b))
    assert at_once.tolist() == [400, 0, 0] and seen == list(range(10))
    assert 0 < batched[0] < 400 and batched[0] + batched[1] == 400
    assert D.vehicle_hours(roads, batched) < D.vehicle_hours(roads, at_once)
    _, with_load = D.assign(trips.where("false"), roads, 1, background=np.array([150.0, 0, 0]))
    v = spark.createDataFrame([(0, float(with_load[0]))], "edge_id bigint, volume double")
    assert D.measures(edges, v).first().over_capacity == 1


def test_gravity_and_sampling(spark):
    zones = spark.createDataFrame([(i, 90.4 + i % 2 / 50, 23.7 + i // 2 / 50, float(i + 1), i) for i in range(4)], "zone int, lon double, lat double, weight double, node bigint")
    od = D.gravity(zones)
    rows = od.collect()
    assert len(rows) == 12 and all(r.trips > 0 for r in rows)
    drawn = D.sample_trips(od, 4000).groupBy("i", "j").count().collect()
    total = sum(r.trips for r in rows)
    want = {(r.i, r.j): 4000 * r.trips / total for r in rows}
    assert sum(r["count"] for r in drawn) == 4000
    assert all(abs(r["count"] - want[r.i, r.j]) < 6 * math.sqrt(want[r.i, r.j]) for r in drawn)


def detour_town(spark):
    """A main road 0-1-2 in two pieces, a way round it over 3, and a far loop over 4."""
    nodes = spark.createDataFrame([(0, 90.40, 23.75), (1, 90.404, 23.75), (2, 90.408, 23.75), (3, 90.404, 23.752), (4, 90.404, 23.80)], "node_id bigint, lon double, lat double")
    rows = [(10, 0, 1, 407.0, 30.0, 2000.0, "primary"), (11, 1, 2, 407.0, 30.0, 1800.0, "primary_link"), (12, 0, 3, 464.0, 40.0, 1500.0, "residential"), (13, 3, 2, 464.0, 40.0, 1500.0, "residential"), (14, 0, 4, 5500.0, 1.0, 9000.0, "primary"), (15, 4, 2, 5500.0, 1.0, 9000.0, "primary")]
    return nodes, spark.createDataFrame(rows, EDGE)


LEVELS = "period string, capture string, edge_id bigint, level int"


def test_onward_goes_straight_within_a_class(spark):
    assert {(r.edge_id, r.next_id) for r in onward(*detour_town(spark)).collect()} == {(10, 11)}


def test_diversion_moves_traffic_round_a_jam(spark):
    nodes, edges = detour_town(spark)
    rows = [(day, f"{day} {t}", e, lv) for day in ("mon", "tue") for t in (1, 2, 3) for e, lv in ((10, 3), (11, 3), (99, 2))] + [("wed", "wed 1", 10, 0)]
    steps, apart = run_diversion(nodes, edges, spark.createDataFrame(rows, LEVELS))
    got = {(r.period, r.step, r.timeline): r for r in steps.collect()}
    for day in ("mon", "tue"):
        start, end = got[day, 0, "diverted"], got[day, 9, "diverted"]
        assert start.vehicle_hours == got[day, 0, "actual"].vehicle_hours and start.diversions == 0
        assert end.diversions == 1 and end.vehicle_hours < got[day, 9, "actual"].vehicle_hours
        # a tenth of what runs the whole stretch a round, as long as that saves time and the way round has room
        through, room = 1.05 * 1800, (0.70 - 0.25) * 1500
        moved = [got[day, k, "diverted"].moved_vph for k in range(10)]
        assert moved[:4] == pytest.approx([0, 0.1 * through, 0.2 * through, 0.3 * through]) and moved == sorted(moved) and moved[-1] <= room
    assert got["wed", 3, "diverted"].diversions == 0 and len([k for k in got if k[0] == "wed"]) == 8
    assert {r.edge_id for r in apart.where("period = 'mon' and step = 9").collect()} <= {10, 11, 12, 13}
    assert apart.where("period = 'wed'").count() == 0


def test_each_move_is_the_best_of_three(spark):
    """Against trying every amount on whole copies of the loads."""
    nodes, edges = detour_town(spark)
    roads = Roads.collect(nodes, edges)
    place = {int(e): i for i, e in enumerate(roads.edge_id)}
    run = Run(roads, np.array([[place[10], place[11]]]), np.isin(roads.edge_id, [10, 11, 14, 15]))
    rng = np.random.default_rng(0)
    run.add_detours(roads.capacity * np.where(np.isin(roads.edge_id, [10, 11]), 1.05, 0.25))
    for _ in range(40):
        actual = roads.capacity * rng.choice([0.25, 0.55, 0.85, 1.05], len(roads.edge_id))
        share = run.share.copy()
        hours = {}
        t, load = run.through(actual)[0], run.load(actual)
        room = max(min(0.70 * roads.capacity[place[e]] - load[place[e]] for e in (12, 13)), 0.0) / t
        for x in (0.0, min(0.1, room, 1 - share[0]), -min(0.1, share[0])):
            run.share = share + x
            hours[round(float(run.share[0]), 9)] = float(run.vehicle_hours(run.load(actual)))
        run.share = share.copy()
        run.move(actual)
        assert hours[round(float(run.share[0]), 9)] == pytest.approx(min(hours.values()))


def test_a_stretch_looks_at_the_roads_it_meets_only(spark, monkeypatch):
    """No array of all roads is made for a stretch, and what is open is what lies in its circle."""
    nodes, edges = lattice(spark, n=12)
    roads = Roads.collect(nodes, edges)
    run = Run(roads, np.zeros((0, 2), dtype=np.int64), np.ones(len(roads.edge_id), dtype=bool))
    given = []
    whole = Roads.shortest

    def shortest(self, a, b, cost, shut=None):
        open_ = np.array([not shut(k) for k in range(len(cost))])
        i, j = self.place[a], self.place[b]
        away = np.hypot(self.x[self.head] - (self.x[i] + self.x[j]) / 2, self.y[self.head] - (self.y[i] + self.y[j]) / 2)
        row = (self.tail == i) & (self.head == j)
        assert (open_ == ((away <= 800 + self.length[row].sum() / 2) & ~row)).all() and 0 < open_.sum() < len(cost) - 1
        given.append(cost)
        return whole(self, a, b, cost, shut)

    monkeypatch.setattr(Roads, "shortest", shortest)
    load = roads.capacity * 0.25
    load[[0, 40, 90]] = roads.capacity[[0, 40, 90]]
    found = list(run.jams(load))
    assert len(found) == 3 and len({id(c) for c in given}) == 1
    cost = given[0]
    for row, way in found:
        # the cheapest of the ways that are open
        assert roads.tail[way[0]] == roads.tail[row[0]] and roads.head[way[-1]] == roads.head[row[-1]] and not set(row) & set(way)
        assert cost[way].sum() >= 2 * roads.free_s.min()


def grid_town(spark, side=14, seed=3):
    """Streets about 130 m apart, both ways, of classes by row and column."""
    rng = np.random.default_rng(seed)
    at = lambda i, j: i * side + j
    nodes = [(at(i, j), 90.40 + 0.0013 * i + rng.normal() * 2e-5, 23.75 + 0.0012 * j + rng.normal() * 2e-5) for i in range(side) for j in range(side)]
    rows = []
    for i in range(side):
        for j in range(side):
            for a, b, street in ((i + 1, j, j), (i, j + 1, i)):
                if a < side and b < side:
                    kind, cap = (("primary", 2400.0), ("residential", 500.0), ("secondary", 2000.0))[street % 3]
                    for u, v in ((at(i, j), at(a, b)), (at(a, b), at(i, j))):
                        rows.append((len(rows), u, v, float(rng.uniform(110, 150)), 12.0 + street % 3, cap, kind))
    rows.append((len(rows), 0, 9999, 50.0, 5.0, 2400.0, "primary"))  # leads out of the map
    levels = [(f"day {d}", f"{h:02d}", int(e), int(lv)) for d in range(2) for h in range(3) for e, lv in zip(rng.permutation(len(rows))[:250], rng.integers(0, 4, 250))]
    return spark.createDataFrame(nodes, "node_id bigint, lon double, lat double"), spark.createDataFrame(rows, EDGE), levels


@pytest.mark.parametrize("stretches", [1000, 2])
def test_diversion_keeps_the_graph_off_the_driver(spark, monkeypatch, stretches):
    """The rows of a run over the whole graph, which is never collected."""
    from lanewise.operators import diversion as V

    nodes, edges, levels = grid_town(spark)
    roads = Roads.collect(nodes, edges)
    place = {int(e): i for i, e in enumerate(roads.edge_id)}
    pairs = np.array([(place[r.edge_id], place[r.next_id]) for r in onward(nodes, edges).orderBy("turn", "next_id", "edge_id").collect()])
    main = {r.edge_id for r in edges.where("highway != 'residential'").collect()}
    frame = pd.DataFrame(levels, columns=["period", "capture", "edge_id", "level"])
    want = [r for day, part in frame.groupby("period") for r in V._steps(day, part, Run(roads, pairs, np.isin(roads.edge_id, list(main))), 3)]
    assert max(r[6] for r in want) > 20 and any(len(x) > 2 for x in [r[-1] for r in want])
    monkeypatch.setattr(Roads, "collect", None)
    steps, apart = run_diversion(nodes, edges, spark.createDataFrame(levels, LEVELS), most_stretches=stretches)
    got = sorted(map(tuple, steps.collect()))
    assert [r[:4] + r[6:] for r in got] == [r[:4] + r[6:-1] for r in sorted(want)]
    assert [x for r in got for x in r[4:6]] == pytest.approx([x for r in sorted(want) for x in r[4:6]], abs=2e-4)
    assert sorted(map(tuple, apart.collect())) == sorted((r[0], r[1], *d) for r in want if r[3] == "diverted" for d in r[-1])
