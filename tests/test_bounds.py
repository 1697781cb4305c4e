"""What a row, a matrix or a round holds doesn't grow with the tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.operators import decode as X
from lanewise.operators import learning as M


def test_samples_of_one_tile_lie_in_rows_of_bounded_size(spark):
    placed = spark.range(6000).select((F.col("id") % 2000).alias("edge_id"), F.col("id").alias("n"), F.lit(3).alias("tx"), F.lit(4).alias("ty"), F.lit(1).alias("i"), F.lit(2).alias("j"))
    rows = X.pack_by_tile(placed, "edge_id", "n", most=100).collect()
    assert len(rows) > 50 and max(len(r["s"]) for r in rows) < 300
    assert sorted(x["n"] for r in rows for x in r["s"]) == list(range(6000))
    homes = {}
    for k, r in enumerate(rows):
        for x in r["s"]:
            assert homes.setdefault(x["edge_id"], k) == k


def test_neighbours_hold_small_matrices():
    import tracemalloc

    import pyarrow as pa

    x = np.random.default_rng(0).normal(size=(2048, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(2048)), pa.array(list(x), pa.list_(pa.float64()))], ["id", "features"])
    tracemalloc.start()
    out = next(M.nearest_of_batches(iter([batch]), np.arange(2048), x, 3))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10e6  # all by all are 34 MB and more
    assert out.column(1).to_pylist()[::3] == list(range(2048)) and out.num_rows == 3 * 2048


def test_gaps_at_one_place_are_measured_once(spark):
    from lanewise.operators import planning as P

    gaps = spark.range(600).select(F.col("id").alias("key"), (90.4 + (F.col("id") % 3) * 0.003).alias("lon"), F.lit(23.75).alias("lat"))
    near = P.gaps_too_close(gaps, digits=2)
    got = near.groupBy("metres").count().collect()
    # 200 gaps at each of three places, 305 m from one to the next
    assert sorted((r["metres"] > 0, r["count"]) for r in got if r["metres"] == 0) == [(False, 3 * 199 * 100)]
    assert sum(r["count"] for r in got if r["metres"] > 0) == 2 * 200 * 200
    assert all(abs(r["metres"] - 305.34) < 0.3 for r in got if r["metres"] > 0)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("key#") < plan.index("ASIN") and "ASIN" not in plan[: plan.index("Join")]  # no distance is left to the pairs


def test_holdout_errors_of_one_search_equal_those_of_each(spark):
    from lanewise.operators import graph as G

    rng = np.random.default_rng(3)
    ends = rng.integers(0, 150, (400, 2))
    edges = spark.createDataFrame([(k, int(u), int(v)) for k, (u, v) in enumerate(ends)], "edge_id bigint, u bigint, v bigint")
    painted = spark.createDataFrame([(int(k), int(rng.integers(0, 4))) for k in range(0, 400, 5)], "edge_id bigint, rung int")
    got = {(r["repeat"], r["claim"]): tuple(r)[2:] for r in G.holdout_errors(edges, painted, 0.3, 2).collect()}
    for seed in range(2):
        kept, hidden = G.hide(painted, 0.3, seed)
        for claim in ("nearest", "worst"):
            assert got[seed, claim] == pytest.approx(tuple(G.spread_errors(G.spread(edges, kept, claim=claim), hidden).first()))
    assert len(got) == 4


def test_search_from_both_ends_finds_the_cheapest_ways(spark):
    import heapq

    from lanewise.operators import settle as S

    rng = np.random.default_rng(5)
    rows = [(k, int(u), int(v), float(c)) for k, (u, v, c) in enumerate(zip(rng.integers(0, 60, 150), rng.integers(0, 60, 150), rng.integers(1, 9, 150)))]
    rows += [(900, 70, 71, 1.0), (901, 3, 70, float("inf")), (902, 3, 5, None)]
    edges = spark.createDataFrame(rows, "edge_id bigint, u bigint, v bigint, c double")
    pairs = [(o, d) for o in (0, 1, 2, 3, 71) for d in (1, 20, 40, 71, 99)] + [(0, 20)]
    got = S.routes_both_ways(spark.createDataFrame(pairs, "origin bigint, destination bigint"), edges, F.col("c")).collect()
    assert len(got) == len(pairs)
    by_id = {r[0]: r for r in rows}
    for o in {p[0] for p in pairs}:
        best, queue = {o: 0.0}, [(0.0, o)]
        while queue:
            x, at = heapq.heappop(queue)
            for _, u, v, c in rows:
                if u == at and c is not None and c < float("inf") and x + c < best.get(v, float("inf")):
                    best[v] = x + c
                    heapq.heappush(queue, (x + c, v))
        for r in got:
            if r["origin"] == o:
                assert r["cost"] == best.get(r["destination"], float("inf"))
                way = [by_id[e] for e in r["route"]]
                assert [w[1] for w in way] + [r["destination"]] == [o] + [w[2] for w in way] if way else r["cost"] in (0.0, float("inf"))
                assert sum(w[3] for w in way) == r["cost"] or not way
