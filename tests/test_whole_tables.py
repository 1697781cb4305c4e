"""Queries over small tables of their own: every capture, every road."""

import datetime

import pytest

from lanewise.plans import load

QUERIES, _ = load()


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    """A chain of 20 roads of two classes over junctions 0 to 20; one road is painted, on three days."""
    at, n = str(tmp_path_factory.mktemp("chain")), 29
    keys = [(-30 * i * pow(17, -1, n)) % n + n * i for i in range(20)]
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    write("customer", [(i,) for i in range(n)], "c_custkey bigint")
    orders = [(k, i, 100.0, ("1-URGENT", "2-HIGH")[i % 2]) for i, k in enumerate(keys)]
    write("orders", orders, "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderpriority string")
    events = [(keys[0], datetime.datetime(2024, 1, d, h), 3.0, "view") for d in (1, 2, 3) for h in (8, 20)]
    write("events", events, "user_id bigint, ts timestamp, value double, event_type string")
    return at


def test_diversion_steps_over_all_captures(spark, chain):
    rows = [r for r in QUERIES["diversion_steps"](spark, chain).collect() if r.timeline == "actual"]
    # two captures a day, three rounds each, and the start of each day
    assert len({r.capture for r in rows}) == 6 and len(rows) == 21
    # levels are those recorded: one road is dark red, the others are clear
    assert {(r.green, r.yellow, r.red, r.darkred) for r in rows} == {(19, 0, 0, 1)}


def test_reachability_over_all_classes(spark, chain):
    assert sorted(r.node for r in QUERIES["reachability_closure"](spark, chain).collect()) == list(range(21))
    assert [r.node for r in QUERIES["core_intersection"](spark, chain).collect()] == [0]


def test_spread_runs_to_the_end(spark, chain):
    for name in ("spread_nearest", "spread_worst"):
        assert sorted(r.hops for r in QUERIES[name](spark, chain).collect()) == list(range(20))
