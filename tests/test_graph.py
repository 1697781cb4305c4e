import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lanewise.operators import graph as G


def edges(spark, pairs):
    return spark.createDataFrame([(i, u, v) for i, (u, v) in enumerate(pairs)], "edge_id bigint, u bigint, v bigint")


def painted(spark, rungs):
    return spark.createDataFrame(list(rungs.items()), "edge_id bigint, rung int")


def spread(spark, pairs, rungs, **options):
    rows = G.spread(edges(spark, pairs), painted(spark, rungs), **options).orderBy("edge_id").collect()
    return [r.weight for r in rows], [r.hops for r in rows], [r.method for r in rows]


def chain(k):
    return [(i, i + 1) for i in range(k)]


def test_spread_along_a_ring(spark):
    """One dark red road in a ring of nine: its neighbours share the level, then
    a rung is lost a road, on both sides alike; a ring of its own stays clear."""
    ring = [(i, (i + 1) % 9) for i in range(9)]
    weights, hops, methods = spread(spark, ring + [(50, 51), (51, 50)], {4: 3})
    assert hops[:9] == [4, 3, 2, 1, 0, 1, 2, 3, 4]
    assert weights[:9] == [25, 55, 85, 105, 105, 105, 85, 55, 25]
    assert methods[:9] == [2, 2, 2, 1, 0, 1, 2, 2, 2]
    assert (weights[9:], hops[9:], methods[9:]) == ([25, 25], [-1, -1], [3, 3])


def test_spread_without_paint(spark):
    star = [(0, i) for i in range(1, 6)]
    assert spread(spark, star, {}) == ([25] * 5, [-1] * 5, [3] * 5)


def test_spread_between_two_paints(spark):
    """At equal distance the worse level holds, whichever end has it."""
    road = [(i, i + 1) for i in range(5)]
    assert spread(spark, road, {0: 2, 4: 1})[0] == spread(spark, [(v, u) for u, v in road], {0: 2, 4: 1})[0] == [85, 85, 55, 55, 55]
    assert spread(spark, road[:3], {0: 0, 2: 2})[0] == spread(spark, road[:3], {0: 2, 2: 0})[0][::-1] == [25, 85, 85]


def brute_spread(pairs, rungs, per, claim):
    n = len(pairs)
    near = [[j for j in range(n) if j != i and set(pairs[i]) & set(pairs[j])] for i in range(n)]
    reach = {}
    for rung in range(4):
        dist = {i: 0 for i, r in rungs.items() if r == rung}
        queue = list(dist)
        for i in queue:
            for j in near[i]:
                if j not in dist:
                    dist[j] = dist[i] + 1
                    queue.append(j)
        for i, d in dist.items():
            reach.setdefault(i, []).append((d, rung))
    out = []
    for i in range(n):
        if i in rungs:
            level = rungs[i]
        elif i not in reach:
            level = 0
        else:
            lost = lambda d: 0 if d <= 1 else -(-(d - 1) // per)
            if claim == "nearest":
                d, r = min(reach[i], key=lambda x: (x[0], -x[1]))
                level = max(r - lost(d), 0)
            else:
                level = max(max(r - lost(d), 0) for d, r in reach[i])
        out.append((25, 55, 85, 105)[level])
    return out


@pytest.mark.parametrize("claim, per, seed", [("nearest", 1, 1), ("worst", 2, 2), ("nearest", 3, 3)])
def test_random_spreads(spark, claim, per, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(25), rng.randrange(25)) for _ in range(40)]
    rungs = {i: rng.randrange(4) for i in rng.sample(range(40), 6)}
    assert spread(spark, pairs, rungs, per_rung=per, claim=claim)[0] == brute_spread(pairs, rungs, per, claim)


def test_adjacency_with_loops(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(12), rng.randrange(12)) for _ in range(30)]
    got = {(r.edge_id, r.other) for r in G.adjacency(edges(spark, pairs)).collect()}
    assert got == {p for i, j in combinations(range(30), 2) if set(pairs[i]) & set(pairs[j]) for p in ((i, j), (j, i))}


def test_reach_and_core(spark):
    e = edges(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (4, 0)])
    start = spark.createDataFrame([(0,)], "node bigint")
    assert sorted(r.node for r in G.reachable(e, start).collect()) == [0, 1, 2, 3]
    assert sorted(r.node for r in G.reachable(e, start, forward=False).collect()) == [0, 1, 2, 4]
    assert sorted(r.node for r in G.core(e, start).collect()) == [0, 1, 2]


OSM = [
    *[("node", i, 90.4 + i / 1000, 23.8, None, None) for i in range(1, 6)],
    ("way", 100, None, None, [1, 2, 3], {"highway": "primary", "lanes": "3;2"}),
    ("way", 101, None, None, [2, 4], {"highway": "residential", "oneway": "yes"}),
    ("way", 102, None, None, [5, 3], {"highway": "secondary_link", "oneway": "-1", "maxspeed": "50 mph"}),
    ("way", 103, None, None, [1, 5], {"highway": "footway"}),
]


def test_graph_from_elements(spark):
    e = spark.createDataFrame(OSM, "type string, id bigint, lon double, lat double, nodes array<bigint>, tags map<string,string>")
    got = {(r.u, r.v): r for r in G.edges_from_elements(e).collect()}
    assert set(got) == {(1, 2), (2, 1), (2, 3), (3, 2), (2, 4), (3, 5)}
    assert sum(r.oneway for r in got.values()) == 2
    assert (got[1, 2].lanes, got[1, 2].capacity_vph, got[3, 5].free_flow_kmph, got[2, 4].lanes) == (3, 3600.0, 50.0, 1)
    assert got[3, 5].geometry[0].lon > got[3, 5].geometry[-1].lon or got[3, 5].geometry[0].lon == pytest.approx(90.403)


def test_long_edges_become_chains(spark):
    from lanewise.operators.decode import chain_edges

    osm = [("node", 1, 90.4, 23.8, None, None), ("node", 2, 90.4 + 600 / 101850, 23.8, None, None), ("way", 9, None, None, [1, 2], {"highway": "tertiary"})]
    whole = G.edges_from_elements(spark.createDataFrame(osm, "type string, id bigint, lon double, lat double, nodes array<bigint>, tags map<string,string>"))
    total = whole.agg(F.sum("length_m")).first()[0]
    parts = chain_edges(whole).collect()
    assert sum(p.length_m for p in parts) == pytest.approx(total, rel=1e-6)
    assert all(p.length_m <= 170.01 for p in parts)
    new = {x for p in parts for x in (p.u, p.v)} - {1, 2}
    assert new and all(x < 0 for x in new)
    forth = sorted((p.u, p.v) for p in parts if p.u > p.v or p.u < p.v)
    assert all((v, u) in forth for u, v in forth)  # both directions share their junctions


def cut_one(lon, lat, most, tail):
    """A line cut by itself."""
    import numpy as np

    from lanewise.operators.decode import _metres

    along = np.concatenate(([0.0], np.cumsum(_metres(lon, lat))))
    marks = np.arange(most, along[-1], most)
    if len(marks) and along[-1] - marks[-1] < tail:
        marks = marks[:-1]
    stops = [0.0, *marks.tolist(), along[-1]]
    at = lambda m: (float(np.interp(m, along, lon)), float(np.interp(m, along, lat)))
    return [[at(a), *((lon[i], lat[i]) for i in np.flatnonzero((along > a + 1e-9) & (along < b - 1e-9))), at(b)] for a, b in zip(stops, stops[1:])]


def test_lines_are_cut_together_without_a_shuffle(spark):
    import numpy as np

    from lanewise.operators.decode import chain_edges

    r = np.random.default_rng(3)
    lines = [np.cumsum(r.normal(size=(k, 2)) * 1e-3, axis=0) + (90.4, 23.8) for k in (2, 2, 3, 9, 40, 2, 5)]
    lines[6][2] = lines[6][1]
    rows = [(i, 2 * i, 2 * i + 1, "primary", 50.0, [(float(x), float(y)) for x, y in line]) for i, line in enumerate(lines)]
    rows += [(90, 1, 2, "primary", 50.0, [(90.4, 23.8)]), (91, 1, 2, "primary", 50.0, None)]
    e = spark.createDataFrame(rows, "edge_id bigint, u bigint, v bigint, highway string, free_flow_kmph double, geometry array<struct<lon:double,lat:double>>")
    chained = chain_edges(e.withColumn("name", F.col("edge_id")), 60.0)
    assert "Exchange" not in chained._jdf.queryExecution().executedPlan().toString()
    got = {}
    for row in chained.collect():
        got.setdefault(row.name, []).append([(p.lon, p.lat) for p in row.geometry])
    want = {i: cut_one(line[:, 0], line[:, 1], 60.0, 20.0) for i, line in enumerate(lines)}
    assert set(got) == set(want) and max(map(len, want.values())) > 20
    for i, pieces in want.items():
        assert [len(p) for p in got[i]] == [len(p) for p in pieces]
        assert np.concatenate(got[i]) == pytest.approx(np.concatenate(pieces), abs=1e-12)


def test_fingerprint_ignores_order(spark):
    df = edges(spark, chain(20)).withColumn("length_m", F.col("edge_id") * 1.5)
    assert G.graph_id(df).first() == G.graph_id(df.repartition(5)).first()
    assert G.graph_id(df).first() != G.graph_id(df.where("edge_id > 0")).first()


def test_what_is_reached_is_never_broadcast(spark):
    """Tables that grow with the graph don't come through the driver."""
    from lanewise.operators import planning as P

    seen, keep = [], G.Rounds.keep
    G.Rounds.keep = lambda self, df: seen.append(df) or keep(self, df)
    try:
        e = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (4, 0)], "u bigint, v bigint")
        hub = spark.createDataFrame([(0,)], "node bigint")
        core = G.core(e, hub)
        left = P.nobody_trapped(core, G.reachable(e.where("u <> 1"), hub))
    finally:
        G.Rounds.keep = keep
    assert sorted(r.node for r in core.collect()) == [0, 1, 2] and [r.node for r in left.collect()] == [2]
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in [*seen, core, left]]
    assert len(plans) > 8 and not any("Broadcast" in p for p in plans)
