import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.operators import city as C
from lanewise.operators.search import Roads
from lanewise.sources import fetch, png
from test_search import EDGE, two_ways


def test_city_batches_beat_all_at_once(spark):
    nodes, edges = two_ways(spark)
    trips = spark.range(100).select(F.col("id").alias("trip"), F.lit(0).cast("bigint").alias("origin"), F.when(F.col("id") < 99, 1).otherwise(77).cast("bigint").alias("destination"), F.lit(4.0).alias("vehicles"))
    levels = spark.createDataFrame([(0, 1)], "edge_id bigint, level int")
    measures, frames = C.run_city(nodes, edges, levels, trips, batches=5)
    m = {r.run: r for r in measures.collect()}
    assert m["before"].vehicle_hours < m["in batches"].vehicle_hours < m["all at once"].vehicle_hours
    assert (m["in batches"].routed, m["in batches"].unreachable) == (99, 1)
    assert {r.batch for r in frames.collect()} == set(range(5))


def test_layout_scores(spark):
    nodes, edges = two_ways(spark)
    edges = edges.unionByName(spark.createDataFrame([(3, 1, 0, 1000.0, 72.0, 100.0, "primary")], EDGE))
    roads = Roads.collect(nodes, edges)
    options = spark.createDataFrame([("s", 0, "forward"), ("s", 3, "backward"), ("g", 1, "gap")], "key string, edge_id bigint, role string")
    layouts = spark.createDataFrame([(s, g) for s in ("twoway", "forward", "backward") for g in ("open", "closed")], "s string, g string")
    got = {r.layout: r for r in C.score_layouts(layouts, options, roads, [(0, 1, 10.0)] * 30).collect()}
    assert got["s=forward,g=closed"].vehicle_hours < got["s=twoway,g=closed"].vehicle_hours
    assert got["s=twoway,g=open"].vehicle_hours < got["s=twoway,g=closed"].vehicle_hours
    assert got["s=backward,g=closed"].unreachable == 30 and got["s=backward,g=open"].unreachable == 0


def test_plans_leave_out_what_traps_or_loses(spark):
    nodes, edges = two_ways(spark)
    rows = [(3, 1, 0, 1000.0, 72.0, 100.0, "primary"), (4, 0, 5, 300.0, 20.0, 500.0, "residential"), (5, 5, 0, 300.0, 20.0, 500.0, "residential")]
    nodes = nodes.unionByName(spark.createDataFrame([(5, 90.399, 23.75)], "node_id bigint, lon double, lat double"))
    edges = edges.unionByName(spark.createDataFrame(rows, EDGE))
    roads = Roads.collect(nodes, edges)
    options = spark.createDataFrame([("s", 0, "forward"), ("s", 3, "backward"), ("t", 4, "forward"), ("t", 5, "backward")], "key string, edge_id bigint, role string")
    layouts = spark.createDataFrame([(s, t) for s in ("twoway", "forward", "backward") for t in ("twoway", "forward")], "s string, t string")
    best, facts = C.plan(layouts, options, roads, [(0, 1, 10.0)] * 30, {"s": "twoway", "t": "twoway"}, hub=0)
    # a one-way dead end traps its junction; forward on s leaves no way back to the hub
    scored = {r.layout: r for r in C.score_layouts(layouts, options, roads, [(0, 1, 10.0)] * 30, hub=0).collect()}
    assert scored["s=twoway,t=forward"].trapped == 1 and scored["s=twoway,t=twoway"].trapped == 0 and scored["s=forward,t=twoway"].trapped > 0
    left = [k for k, r in scored.items() if r.trapped == 0 and r.unreachable == 0 and k != "s=twoway,t=twoway"]
    assert sorted(r.layout for r in best.collect()) == sorted(left) and facts["layouts_scored"] == len(left)
    assert facts["baseline_hours"] == scored["s=twoway,t=twoway"].vehicle_hours and facts["vehicles"] == 300.0


def tile(alpha=0):
    image = np.zeros((256, 256, 4), np.uint8)
    image[..., 3] = alpha
    image[10:14] = (22, 224, 152, 255)
    return png.encode(image)


def test_verdicts():
    good = tile()
    assert fetch.verdict(good) == "ok"
    assert fetch.verdict(good[:50]) == "too_small"
    assert fetch.verdict(b"<html>" + b"x" * 100) == "not_png"
    assert fetch.verdict(good[:-10]) == "truncated"
    assert fetch.verdict(good[:60] + b"\0\0\0\0" + good[64:]) == "decode_error"
    assert fetch.verdict(png.encode(np.random.default_rng(0).integers(0, 9, (8, 8, 4)).astype(np.uint8))) == "size_8x8"
    assert fetch.verdict(tile(255)) == "opaque"


def test_fetch_retries_and_gives_up(spark):
    good = tile()

    class Web:
        def __init__(self):
            self.seen = {}

        def __call__(self, url):
            self.seen[url] = self.seen.get(url, 0) + 1
            if url == "t/1/1" and self.seen[url] < 3:
                return 503, b""
            if url == "t/2/1":
                return 404, b""
            if url == "t/3/1":
                return 200, b"short"
            return 200, good

    targets = spark.createDataFrame([(x, 1) for x in range(4)], "x bigint, y bigint").coalesce(1)
    got = {r.x: r for r in fetch.fetch_tiles(targets, "t/{x}/{y}", Web(), rate=1e6, retries=2, sleep=lambda s: None).collect()}
    assert [(got[x].reason, got[x].tries) for x in range(4)] == [("ok", 1), ("ok", 3), ("http_404", 1), ("too_small", 3)]


def test_a_run_of_refusals_stops_the_job(spark):
    targets = spark.range(40).select(F.col("id").alias("x"), F.lit(0).cast("bigint").alias("y")).coalesce(1)
    with pytest.raises(Exception, match="refusals in a row"):
        fetch.fetch_tiles(targets, "{x}", lambda u: (403, b""), rate=1e6, sleep=lambda s: None).collect()


def test_capture_fills_gaps(spark):
    expected = spark.range(9).select((F.col("id") % 3).alias("x"), F.floor(F.col("id") / 3).alias("y"))
    calls = []

    def sweep(targets):
        calls.append(targets.count())
        content = F.when((F.col("x") == 1) & (F.col("y") == 1) & F.lit(len(calls) < 3), F.lit(None)).otherwise(F.lit(b"x"))
        return targets.select("x", "y", content.cast("binary").alias("content"))

    got, manifest = fetch.capture(expected, sweep, lambda t: t.select("x", "y"))
    assert calls == [9, 1, 1] and got.count() == 9 and manifest["status"] == "ok"
    audit = got.select("x", "y", F.sha2("content", 256).alias("sha256"))
    assert fetch.tampered(got, audit).count() == 0
    assert fetch.tampered(got.withColumn("content", F.when(F.col("x") == 0, F.lit(b"y")).otherwise(F.col("content"))), audit).count() == 3


def test_pending(spark):
    c = spark.createDataFrame([("a", "2026-09-17"), ("b", "2026-09-18"), ("c", "2026-09-19")], "name string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert [r.name for r in fetch.pending(c, c.where("name = 'b'"), "2026-09-17", "2026-09-19").collect()] == ["c", "a"]


def test_layouts_are_scored_with_the_graph_as_a_table(spark, monkeypatch):
    nodes, edges = two_ways(spark)
    rows = [(3, 1, 0, 1000.0, 72.0, 100.0, "primary"), (4, 0, 5, 300.0, 20.0, 500.0, "residential"), (5, 5, 0, 300.0, 20.0, 500.0, "residential")]
    nodes = nodes.unionByName(spark.createDataFrame([(5, 90.399, 23.75)], "node_id bigint, lon double, lat double"))
    edges = edges.unionByName(spark.createDataFrame(rows, EDGE))
    options = spark.createDataFrame([("s", 0, "forward"), ("s", 3, "backward"), ("t", 4, "forward"), ("t", 5, "backward"), ("g", 1, "gap")], "key string, edge_id bigint, role string")
    layouts = spark.createDataFrame([("twoway", "twoway", "open"), ("forward", "forward", "open"), ("backward", "twoway", "closed")], "s string, t string, g string")
    want = {r.layout: r for r in C.score_layouts(layouts, options, Roads.collect(nodes, edges), [(0, 1, 10.0)] * 30, batches=1, hub=0).collect()}
    monkeypatch.setattr(Roads, "collect", None)
    trips = spark.range(30).select(F.col("id").alias("trip"), F.lit(0).cast("bigint").alias("origin"), F.lit(1).cast("bigint").alias("destination"), F.lit(10.0).alias("vehicles"))
    hub = spark.createDataFrame([(0,)], "node bigint")
    got = {r.layout: r for r in C.score_layouts_by_joins(layouts, options, edges, trips, batches=1, hub=hub).collect()}
    assert set(got) == set(want) and len({r.trapped for r in want.values()}) > 1 and len({r.unreachable for r in want.values()}) > 1
    for k, r in want.items():
        assert (got[k].unreachable, got[k].trapped) == (r.unreachable, r.trapped) and got[k].vehicle_hours == pytest.approx(r.vehicle_hours, rel=1e-9), k
