"""Batches assigned on tables, against a search of the whole graph for each trip."""

import pytest

from lanewise.operators import corridors as K
from lanewise.operators.search import Roads
from test_search import dijkstra, lattice


def test_each_batch_takes_the_cheapest_ways(spark, monkeypatch):
    """At the prices of its time, with the graph as a table all along."""
    nodes, edges = lattice(spark, n=5, seed=3)
    monkeypatch.setattr(Roads, "collect", lambda *a: pytest.fail("the graph is collected"))
    rows = edges.collect()
    trips = [(0, 24), (0, 24), (4, 20), (0, 99), (0, 24), (7, 7)]
    df = spark.createDataFrame([(i, o, d, 1500.0) for i, (o, d) in enumerate(trips)], "trip bigint, origin bigint, destination bigint, vehicles double")
    routed, loads = K.assign_runs(edges, df, {"once": 1, "three": 3})
    got = {(r.run, r.trip): r for r in routed.collect()}
    assert {t for _, t in got} == {0, 1, 2, 4}
    by = {r.edge_id: r for r in rows}
    for run, size in (("once", 6), ("three", 2)):
        load = dict.fromkeys(by, 0.0)
        for at in range(0, 6, size):
            price = lambda r: r.free_flow_s * (1 + 3.0 / 1.05**4 * min(load[r.edge_id] / r.capacity_vph, 2.0) ** 4)
            mine = [got[run, t] for t in range(at, at + size) if (run, t) in got]
            for r in mine:
                way = [by[e] for e in r.route]
                assert way[0].u == r.origin and way[-1].v == r.destination and all(a.v == b.u for a, b in zip(way, way[1:]))
                assert sum(map(price, way)) == pytest.approx(r.cost) == pytest.approx(dijkstra(rows, r.origin, price)[r.destination])
            for r in mine:
                for e in r.route:
                    load[e] += 1500.0
        assert {k: v for k, v in load.items() if v} == loads[run]


def test_a_city_experiment_collects_no_graph(spark, monkeypatch):
    from lanewise.operators import city as C

    nodes, edges = lattice(spark, n=3)
    monkeypatch.setattr(Roads, "collect", lambda *a: pytest.fail("the graph is collected"))
    trips = spark.createDataFrame([(0, 0, 8, 40.0), (1, 0, 99, 40.0)], "trip bigint, origin bigint, destination bigint, vehicles double")
    m = {r.run: r for r in C.run_city(nodes, edges, spark.createDataFrame([(0, 1)], "edge_id bigint, level int"), trips, batches=1)[0].collect()}
    assert (m["in batches"].routed, m["in batches"].unreachable, m["before"].routed) == (1, 1, 0)
    assert m["before"].vehicle_hours < m["all at once"].vehicle_hours == m["in batches"].vehicle_hours
