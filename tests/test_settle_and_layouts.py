"""Delta-stepping, landmarks, pointer doubling and layouts as bitmaps."""

import heapq
import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lanewise.operators import graph as G
from lanewise.operators import layouts as Y
from lanewise.operators import settle as S

def cost():
    return F.col("c")


def roads(spark, rows):
    return spark.createDataFrame(rows, "edge_id bigint, u bigint, v bigint, c double")


def brute(rows, origin):
    best, queue = {origin: 0.0}, [(0.0, origin)]
    while queue:
        d, a = heapq.heappop(queue)
        if d > best[a]:
            continue
        for _, u, v, c in rows:
            if u == a and c is not None and d + c < best.get(v, math.inf):
                best[v] = d + c
                heapq.heappush(queue, (d + c, v))
    return best


@pytest.fixture(scope="module")
def grid():
    """A grid of 7 x 7 with costs that leave many ties, a few heavy edges, closed ones and an island."""
    r = random.Random(7)
    rows = []
    for x in range(7):
        for y in range(7):
            for dx, dy in ((1, 0), (0, 1)):
                if x + dx < 7 and y + dy < 7:
                    a, b = 10 * x + y, 10 * (x + dx) + y + dy
                    for u, v in ((a, b), (b, a)):
                        rows.append((len(rows), u, v, float(r.choice([1, 1, 2, 3, 20]))))
    rows += [(900, 0, 66, None), (901, 0, 66, math.inf), (902, 500, 501, 1.0), (903, 501, 0, 5.0), (904, 3, 3, 1.0)]
    return rows


@pytest.mark.parametrize("delta", [None, 2.0, 1000.0])
def test_costs_by_buckets(spark, grid, delta):
    starts = spark.createDataFrame([(0, 0), (33, 33), (500, 500), (777, 777)], "origin bigint, node bigint")
    done = S.settle(roads(spark, grid), starts, cost(), delta)
    got = {}
    for r in done.costs.collect():
        got.setdefault(r["origin"], {})[r["node"]] = r["cost"]
    assert got == {o: brute(grid, o) for o in (0, 33, 500, 777)}
    assert done.rounds <= {None: 30, 2.0: 60, 1000.0: 20}[delta]


def test_origins_share_their_rounds(spark, grid):
    """Two origins take no more rounds than the longer of the two."""
    e = roads(spark, grid)
    rounds = [S.settle(e, spark.createDataFrame([(o, o) for o in os], "origin bigint, node bigint"), cost(), 1000.0).rounds for os in ([0], [33], [0, 33])]
    assert rounds[2] == max(rounds[:2])


def test_settle_edge_cases(spark, grid):
    none = spark.createDataFrame([], "origin bigint, node bigint")
    assert S.settle(roads(spark, grid), none, cost()).costs.count() == 0
    starts = spark.createDataFrame([(1, 1), (1, 1), (2, None)], "origin bigint, node bigint")
    assert [tuple(r) for r in S.settle(roads(spark, []), starts, cost()).costs.collect()] == [(1, 1, 0.0)]
    far = S.settle(roads(spark, grid), starts, cost(), limit=3.0).costs.collect()
    assert {r["node"]: r["cost"] for r in far} == {k: v for k, v in brute(grid, 1).items() if v <= 3}


def route_cost(rows, way):
    by = {r[0]: r for r in rows}
    assert all(by[a][2] == by[b][1] for a, b in zip(way, way[1:]))
    return sum(by[k][3] for k in way)


def test_routes_by_landmarks(spark, grid):
    journeys = [(0, 66), (66, 0), (33, 4), (33, 33), (500, 60), (0, 500), (12345, 3), (0, 66), (None, 1)]
    df = spark.createDataFrame(journeys, "origin bigint, destination bigint")
    e = roads(spark, grid)
    marks = S.landmarks(e, cost(), count=3, candidates=6, delta=1000.0)
    assert len(marks.nodes) == 3
    found = S.routes_by_landmarks(df, e, cost(), marks, delta=1000.0)
    assert "MapInArrow" not in found._jdf.queryExecution().toString()  # no search over a collected graph
    got = found.collect()
    assert len(got) == len(journeys)
    for r in got:
        want = math.inf if r.origin is None or r.origin == 12345 else brute(grid, r.origin).get(r.destination, math.inf)
        assert r.cost == want
        if 0 < want < math.inf:
            assert route_cost(grid, r.route) == want
        else:
            assert r.route == []


def test_landmarks_are_sought_only_for_few_targets(spark, grid, monkeypatch):
    sought, whole = [], S.landmarks
    monkeypatch.setattr(S, "landmarks", lambda *a, **k: sought.append(1) or whole(*a, **k))
    e, want = roads(spark, grid), brute(grid, 0)
    for nodes, few in ((list(want), 5), ([66], 5)):
        monkeypatch.setattr(S, "FEW", few)
        found = S.routes_by_landmarks(spark.createDataFrame([(0, n) for n in nodes], "origin bigint, destination bigint"), e, cost(), delta=1000.0).collect()
        assert {r.destination: r.cost for r in found} == {n: want[n] for n in nodes}
        assert all(route_cost(grid, r.route) == r.cost for r in found)
        assert len(sought) == (len(nodes) == 1)


def test_bounds_leave_out_what_is_of_no_use(spark):
    """On a long street the search to a near junction doesn't go to the far end."""
    rows = [(2 * i + k, i + k, i + 1 - k, 1.0) for i in range(20) for k in (0, 1)]
    e = roads(spark, rows)
    marks = S.landmarks(e, cost(), count=2, candidates=21, delta=1000.0)
    table = {r["node"]: (r["from_l"], r["to_l"]) for r in marks.table.collect()}
    assert all(len(a) == 2 == len(b) for a, b in table.values())
    asked = spark.createDataFrame([(10, 12)], "origin bigint, destination bigint")
    starts = spark.createDataFrame([(10, 10)], "origin bigint, node bigint")
    costs = S.settle(e, starts, cost(), 1.0, prune=S.Prune(asked, marks)).costs.collect()
    assert {r["node"]: r["cost"] for r in costs}[12] == 2.0 and len(costs) < 8
    assert all(r["cost"] == abs(r["node"] - 10) for r in costs)


def test_landmark_bounds_hold(spark, grid):
    marks = S.landmarks(roads(spark, grid), cost(), count=4, candidates=8, delta=1000.0)
    table = {r["node"]: r for r in marks.table.collect()}
    for k, mark in enumerate(marks.nodes):
        own = brute(grid, mark)
        assert all(r["from_l"][k] == own.get(n, math.inf) for n, r in table.items())
        assert all(r["to_l"][k] == brute(grid, n).get(mark, math.inf) for n, r in list(table.items())[::9])


def test_ties_go_to_the_smallest_edge(spark):
    """Two equal ways into 3, and the dearer first hop found in a later round."""
    rows = [(9, 0, 1, 1.0), (5, 0, 2, 1.0), (8, 1, 3, 2.0), (4, 2, 4, 1.0), (2, 4, 3, 1.0), (7, 2, 3, 2.0)]
    e = roads(spark, rows)
    best = {r["node"]: r["via"] for r in G.distances(e, spark.createDataFrame([(0,)], "node bigint"), cost()).collect()}
    assert best == {0: None, 1: 9, 2: 5, 3: 2, 4: 4}
    costs = S.settle(e, spark.createDataFrame([(0, 0)], "origin bigint, node bigint"), cost()).costs
    assert {r["node"]: (r["edge_id"], r["before"]) for r in S.last_edges(costs, e, cost()).collect()} == {1: (9, 0), 2: (5, 0), 3: (2, 4), 4: (4, 2)}


def test_pointer_doubling_takes_few_rounds(spark):
    n = 100
    e = roads(spark, [(i, i, i + 1, 1.0) for i in range(n)])
    last = spark.createDataFrame([(o, i + 1, i, i) for o in (0, 7) for i in range(n)], "origin bigint, node bigint, edge_id bigint, before bigint")
    ends = spark.createDataFrame([(0, n), (0, 41), (7, 2), (0, 0), (0, 5000)], "origin bigint, node bigint")
    found, rounds = S.ways_by_doubling(last, ends)
    got = {}
    for r in found.orderBy("pos").collect():
        assert r["pos"] == len(got.setdefault((r["origin"], r["node"]), []))
        got[r["origin"], r["node"]].append(r["edge_id"])
    assert got == {(0, n): list(range(n)), (0, 41): list(range(41)), (7, 2): [0, 1]}
    assert rounds <= 2 * math.ceil(math.log2(n)) + 1
    assert S.ways_by_doubling(S.last_edges(S.settle(e, ends.limit(0), cost()).costs, e, cost()), ends)[0].count() == 0


# Layouts


def reached(edges, start, forward=True):
    step = {}
    for _, u, v in edges:
        step.setdefault(u if forward else v, []).append(v if forward else u)
    seen, stack = {start}, [start]
    while stack:
        for b in step.get(stack.pop(), []):
            if b not in seen:
                seen.add(b)
                stack.append(b)
    return seen


def judged(edges, options, hub, journeys, most, values):
    """Layout by layout, each with searches of its own."""
    keys = sorted({k for k, *_ in options})
    changes = [(k, v) for k in keys for v in values[k]]
    layouts = [c for n in range(most + 1) for c in combinations(changes, n) if len({k for k, _ in c}) == n]
    base = reached(edges, hub) & reached(edges, hub, False)
    possible = {(a, b) for a, b in journeys if b in reached(edges, a)}
    out = {}
    for c in layouts:
        shut = {e for k, e, role in options for key, v in c if k == key and role != v}
        left = [e for e in edges if e[0] not in shut]
        a, b = len(base - reached(left, hub)), len(base - reached(left, hub, False))
        lost = sum(y not in reached(left, x) for x, y in possible)
        out[" ".join(f"{k}={v}" for k, v in sorted(c))] = (a, b, lost, not (a or b or lost))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_all_layouts_in_one_search(spark, seed):
    r = random.Random(seed)
    edges = [(i, r.randrange(25), r.randrange(25)) for i in range(45)]
    streets = []
    for k in range(7):  # two-way streets, some to junctions that nothing else reaches
        a, b = r.randrange(25), r.choice([r.randrange(25), 25 + k])
        streets.append((f"s{k}", a, b))
        edges += [(100 + 2 * k, a, b), (101 + 2 * k, b, a)]
    options = [(key, 100 + 2 * k + i, role) for k, (key, _, _) in enumerate(streets) for i, role in enumerate(("forward", "backward"))]
    options += [("g", 0, "gap"), ("g", 1, "gap")]
    values = {**{f"s{k}": ("forward", "backward", "closed") for k in range(7)}, "g": ("closed",)}
    journeys = [(a, b) for _, a, b in streets] + [(3, 77)]
    want = judged(edges, options, 0, journeys, 2, values)
    assert len(want) > 2 * Y.WORD and {v[3] for v in want.values()} == {True, False}
    e = spark.createDataFrame(edges, "edge_id bigint, u bigint, v bigint")
    o = spark.createDataFrame(options, "key string, edge_id bigint, role string")
    layouts = Y.layouts_within_budget(spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "key string, value string"), 2)
    hub = spark.createDataFrame([(0,)], "node bigint")
    j = spark.createDataFrame(journeys, "enter bigint, leave bigint")
    got = {x.name: (x.trapped_out, x.trapped_in, x.journeys_lost, x.allowed) for x in Y.judge_layouts(e, o, layouts, hub, j).collect()}
    assert got == want


def test_today_alone_and_no_journeys(spark):
    e = spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "edge_id bigint, u bigint, v bigint")
    none = spark.createDataFrame([], "key string, edge_id bigint, role string")
    layouts = Y.layouts_within_budget(spark.createDataFrame([], "key string, value string"), 2)
    found = Y.judge_layouts(e, none, layouts, spark.createDataFrame([(0,)], "node bigint"), spark.createDataFrame([], "enter bigint, leave bigint")).collect()
    assert [tuple(r) for r in found] == [(0, "", 0, 0, 0, True)]


def test_layouts_are_told_apart_on_marked_junctions_alone(spark, monkeypatch):
    """The whole graph is never searched with layouts: their bitmaps are of the ends of changed streets."""
    ring = [(i, i, (i + 1) % 60) for i in range(60)] + [(100 + i, (i + 1) % 60, i) for i in range(60)]
    sizes, search = [], Y.reach_bitmaps

    def counted(edges, *args, **kwargs):
        found = search(edges, *args, **kwargs)
        sizes.append(found.select("node").distinct().count())
        return found

    monkeypatch.setattr(Y, "reach_bitmaps", counted)
    options = [("s", 7, "forward"), ("s", 107, "backward"), ("t", 30, "forward"), ("t", 130, "backward")]
    values = {"s": ("forward", "backward"), "t": ("forward", "backward", "closed")}
    journeys = [(7, 8), (30, 31)]
    e = spark.createDataFrame(ring, "edge_id bigint, u bigint, v bigint")
    layouts = Y.layouts_within_budget(spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "key string, value string"), 2)
    found = Y.judge_layouts(e, spark.createDataFrame(options, "key string, edge_id bigint, role string"), layouts, spark.createDataFrame([(0,)], "node bigint"), spark.createDataFrame(journeys, "enter bigint, leave bigint"))
    assert {x.name: (x.trapped_out, x.trapped_in, x.journeys_lost, x.allowed) for x in found.collect()} == judged(ring, options, 0, journeys, 2, values)
    assert sizes and max(sizes) <= 5
