"""Smaller operators and readers."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lanewise.functions import geo, traffic
from lanewise.operators import city as C
from lanewise.operators import demand as D
from lanewise.operators import graph as G
from lanewise.operators import history as H
from lanewise.operators import layers as Y
from lanewise.operators import lines as L
from lanewise.operators import planning as P
from lanewise.operators import tiles as T
from lanewise.sources import files as S


def test_elements_read_twice_keep_the_last_file(spark, tmp_path):
    node = lambda lon: {"type": "node", "id": 1, "lon": lon, "lat": 23.8}
    way = {"type": "way", "id": 2, "nodes": [1, 3], "tags": {"highway": "primary"}}
    (tmp_path / "a.json").write_text(json.dumps({"elements": [node(1.0), way]}))
    (tmp_path / "b.json").write_text(json.dumps({"elements": [node(2.0)]}))
    got = {(r.type, r.id): r for r in S.read_elements(spark, f"{tmp_path}/*.json").collect()}
    assert len(got) == 2 and got["node", 1].lon == 2.0 and got["way", 2].tags == {"highway": "primary"} and got["way", 2].nodes == [1, 3]


def test_manifest_grid_and_georeference(spark):
    m = spark.createDataFrame([("c", (98451, 98452, 56635, 56635))], "name string, tile_range struct<x0:int,x1:int,y0:int,y1:int>")
    tiles = S.expected_from_manifest(m)
    assert sorted((r.x, r.y) for r in tiles.collect()) == [(98451, 56635), (98452, 56635)]
    box = {"north": 23.9, "south": 23.6, "west": 90.3, "east": 90.6}
    assert S.georeferenced(tiles, 17, box).count() == 0
    assert S.georeferenced(tiles, 17, box | {"west": 90.5}).count() == 2


def test_styled_and_url(spark):
    r = S.styled(spark.createDataFrame([(25.0,), (105.0,)], "weight double")).orderBy("weight").collect()
    assert [(x.color, x.width) for x in r] == [("#16e098", 2.0), ("#a92727", 4.5)]
    t = spark.createDataFrame([(17, 1, 2)], "z int, x int, y int")
    assert t.select(S.tile_url("https://t/%d/%d/%d.png", "z", "x", "y").alias("u")).first().u == "https://t/17/1/2.png"


def test_status(spark):
    df = spark.createDataFrame([(True, True), (False, True), (True, False)], "a boolean, c boolean")
    got = df.select(T.status({"palette": F.col("a"), "coverage_full": F.col("c")}, ["palette"]).alias("s")).collect()
    assert [r.s for r in got] == ["ok", "failed", "partial"]


def test_rules(spark):
    core = spark.createDataFrame([(1,), (2,)], "node bigint")
    assert [r.node for r in P.nobody_trapped(core, core.where("node = 1")).collect()] == [2]
    exits = spark.createDataFrame([(1, 2), (1, 3)], "enter bigint, leave bigint")
    assert [tuple(r) for r in P.journeys_lost(exits, exits.limit(1)).collect()] == [(1, 3)]
    scores = spark.createDataFrame([("a", 9.0, 0), ("b", 8.0, 1), ("c", 10.0, 0)], "layout string, vehicle_hours double, unreachable long")
    assert [(r.layout, r.change_pct) for r in P.ranked(scores, 10.0).collect()] == [("a", -10.0), ("c", 0.0)]


def test_gates(spark):
    at = "node bigint, lon double, lat double, flow double"
    a = spark.createDataFrame([(1, 90.40, 23.75, 10.0), (2, 90.41, 23.75, 20.0)], at)
    b = spark.createDataFrame([(3, 90.42, 23.75, 30.0), (4, 90.4001, 23.75, 10.0)], at)
    reach = spark.createDataFrame([(1, 3), (1, 4), (2, 3)], "enter bigint, leave bigint")
    got = {(r.enter, r.leave): r.vehicles for r in D.gate_demand(a, b, reach).collect()}
    assert got == {(1, 3): pytest.approx(7.5), (2, 3): pytest.approx(15.0)}  # 1 and 4 are too near


def test_scenario_names_and_savings(spark):
    df = spark.createDataFrame([(1,), (5,)], "r int")
    assert [x.n for x in df.select(H.scenario_name(F.col("r"), 5).alias("n")).collect()] == ["lightest", "heaviest"]
    assert df.select(H.scenario_name(F.col("r"), 7).alias("n")).first().n == "1 of 7 (1 = lightest)"
    s = df.select(Y.saved_share(F.lit(100.0), F.lit(130.0), F.lit(120.0)).alias("s"), Y.saved_share(F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("z")).first()
    assert s.s == pytest.approx(1 / 3) and s.z is None


def test_stepping_wraps(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "ts int")
    assert sorted(map(tuple, Y.stepping(df).collect())) == [(1, 3, 2), (2, 1, 3), (3, 2, 1)]


def test_observed_weights_do_not_drift(spark):
    edges = spark.createDataFrame([(0, 0, 1), (1, 1, 2)], "edge_id bigint, u bigint, v bigint")
    seen = spark.createDataFrame([(0, 85.0)], "edge_id bigint, weight double")
    found = G.spread(edges, spark.createDataFrame([(0, 2)], "edge_id bigint, rung int"))
    table = L.complete_table(edges, seen, found)
    assert L.drifted(seen, table).count() == 0
    assert [(r.weight, r.source, r.method, r.hops) for r in table.orderBy("edge_id").collect()] == [(85.0, "observed", "observed", 0), (85.0, "predicted", "adjacent", 1)]
    assert L.drifted(seen, table.withColumn("weight", F.lit(1.0))).count() == 1


def test_worst_claims_and_zone_demand(spark):
    nodes = spark.createDataFrame([(i, 90.40 + i % 2 / 20, 23.70 + i // 2 / 20) for i in range(4)], "node_id bigint, lon double, lat double")
    edges = spark.createDataFrame([(i, i, (i + 1) % 4) for i in range(4)], "edge_id bigint, u bigint, v bigint")
    zones = G.zone_grid({"west": 90.40, "east": 90.45, "south": 23.70, "north": 23.75}, 2, 2, nodes)
    assert sorted((r.zone, r.node) for r in zones.collect()) == [(i, i) for i in range(4)]
    levels = spark.createDataFrame([(0, 3)], "edge_id bigint, level int")
    drawn = C.zone_demand(nodes, edges, levels, zones, {"west": 90.40, "east": 90.4501, "south": 23.70, "north": 23.7501}, 500)
    per = {r.i: r["count"] for r in drawn.groupBy("i").count().collect()}
    assert sum(per.values()) == 500 and per[0] == max(per.values())


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(0, 130, allow_nan=False), min_size=1, max_size=30))
def test_ladder_properties(weights):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(w,) for w in weights], "w double")
    w = F.col("w")
    for r in df.select("w", traffic.snap(w).alias("s"), traffic.to_class(w).alias("c"), traffic.demote(w).alias("d"), traffic.delay_factor(w / 100).alias("f")).collect():
        assert abs(r.s - r.w) == min(abs(x - r.w) for x in traffic.LADDER)
        assert traffic.LADDER[r.c - 1] == r.s and 25 <= r.d <= 85 and r.f >= 1


@settings(max_examples=15, deadline=None)
@given(st.floats(-179, 179), st.floats(-80, 80), st.integers(1, 20))
def test_tile_round_trip_property(lon, lat, z):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    x, y = geo.lon_to_tx(F.lit(lon), z), geo.lat_to_ty(F.lit(lat), z)
    r = spark.range(1).select(geo.tx_to_lon(x, z).alias("lon"), geo.ty_to_lat(y, z).alias("lat")).first()
    assert r.lon == pytest.approx(lon, abs=1e-8) and r.lat == pytest.approx(lat, abs=1e-8)


def test_neighbour_rank_by_sums_equals_pairs(spark):
    import random

    rng = random.Random(3)
    rows = [(i, rng.randrange(12), rng.randrange(12), rng.randrange(9)) for i in range(60)]
    edges = spark.createDataFrame(rows, "edge_id bigint, u bigint, v bigint, class_rank int")
    got = {r.edge_id: r.mean_rank for r in G.mean_neighbour_rank(edges).collect()}
    for i, u, v, rank in rows:
        near = [r for j, a, b, r in rows if j != i and {a, b} & {u, v}]
        assert got[i] == pytest.approx(sum(near) / len(near) if near else rank)


def test_rows_are_numbered_in_order(spark):
    from lanewise.operators.aggregates import numbered

    df = spark.range(1000).selectExpr("(id * 377) % 1000 AS k").repartition(7)
    assert all(r.k == r.nth for r in numbered(df, "k").collect())


def test_stale_stages_follow_their_inputs(spark):
    from lanewise.operators import batch as B

    captures = spark.createDataFrame([(c,) for c in "abcd"], "capture string")
    times = [(None, "graph", 5)] + [(c, "capture", 10) for c in "abcd"]
    times += [("a", "decode", 11), ("a", "impute", 12), ("a", "layers", 13), ("b", "decode", 9), ("b", "impute", 12), ("b", "layers", 13), ("c", "decode", 11), ("c", "layers", 10)]
    written = spark.createDataFrame(times, "capture string, name string, at long")
    got = {(r.capture, r.stage): r.reason for r in B.stale_stages(captures, written).collect()}
    assert got == {("b", "decode"): "older", ("b", "impute"): "input", ("b", "layers"): "input", ("c", "impute"): "missing", ("c", "layers"): "input", **{("d", s): "missing" for s in ("decode", "impute", "layers")}}
    only = {(r.capture, r.stage) for r in B.stale_stages(captures, written, only=("layers",)).collect()}
    assert only == {("d", "layers")}
    assert B.stale_stages(captures, written, force=True).count() == 12

    ran = []

    def run(stage):
        def one(capture):
            if (capture, stage) == ("d", "decode"):
                raise ValueError("no tiles")
            ran.append((capture, stage))
            return f"{stage} done"

        return one

    done = B.run_batch(spark, B.stale_stages(captures, written), {s: run(s) for s, _ in B.STAGES})
    assert ran == [("b", "decode"), ("b", "impute"), ("b", "layers"), ("c", "impute"), ("c", "layers")]
    assert {(r.capture, r.stage): r.detail for r in done.where("not ok").collect()} == {
        ("d", "decode"): "ValueError: no tiles", ("d", "impute"): "an earlier stage failed", ("d", "layers"): "an earlier stage failed",
    }


def test_layers_results_and_frames_are_written(spark, tmp_path):
    from lanewise.operators import batch as B

    features = spark.createDataFrame([('{"a": 1}',), ('{"b": 2}',)], "feature string")
    B.write_layers({"one": (features, {"title": "One"}), "none": (features.where("false"), {})}, f"{tmp_path}/layers", {"graph_id": "x"})
    index = {r.id: r for r in B.read_index(spark, f"{tmp_path}/layers").collect()}
    assert (index["one"].features, index["none"].features, index["one"].entry, index["one"].facts) == (2, 0, '{"title": "One"}', '{"graph_id": "x"}')
    assert spark.read.text(f"{tmp_path}/layers/one.geojson").count() == 2

    steps = spark.createDataFrame([(0, 1.0)], "step int, hours double")
    for run, rows in (("a", steps), ("b", steps), ("a", steps.union(steps))):
        B.write_result(rows, f"{tmp_path}/results", "city", run)
    got = spark.read.parquet(f"{tmp_path}/results").groupBy("simulation", "run").count().collect()
    assert sorted(map(tuple, got)) == [("city", "a", 2), ("city", "b", 1)]

    frames = spark.createDataFrame([("c1", 1, 0), ("c1", 2, 7), ("c2", 1, 3)], "capture string, line int, code int")
    assert B.publish(frames, f"{tmp_path}/frames").count() == 2
    assert B.publish(frames, f"{tmp_path}/frames").count() == 0
    changed = frames.withColumn("code", F.when(F.col("capture") == "c2", 4).otherwise(F.col("code")))
    assert [r.capture for r in B.publish(changed, f"{tmp_path}/frames").collect()] == ["c2"]
    assert sorted((r.capture, r.line, r.code) for r in spark.read.parquet(f"{tmp_path}/frames").collect()) == [("c1", 1, 0), ("c1", 2, 7), ("c2", 1, 4)]


def test_simulation_requests():
    from lanewise.operators import viewer as V

    assert V.simulation_request({"task": "city", "trips": "300"}) == {"task": "city", "day": "tuesday", "time": "17:00", "trips": 300, "batches": 10, "vehicles": 10.0, "model": "knn"}
    assert V.simulation_request({"task": "history"}) == {"task": "history"}
    bad = [{"task": "x"}, {}, {"task": "forecast", "scenarios": 1}, {"task": "city", "time": "25:00"}, {"task": "city", "day": "today"}, {"task": "city", "trips": "many"}, {"task": "city", "vehicles": 0.5},
           {"task": "diversion"}, {"task": "diversion", "capture": "dhaka-2026-09-17T0841Z", "minutes": 5}, {"task": "changes", "max_changes": 4}, {"task": "changes", "area": "elsewhere"}]
    for body in bad:
        with pytest.raises(ValueError):
            V.simulation_request(body)
    asked = {"task": "diversion", "capture": "dhaka-2026-09-17T0841Z"}
    assert V.simulation_request(asked)["minutes"] == 90
    with pytest.raises(ValueError, match="processed"):
        V.simulation_request(asked, lambda name: False)


def test_what_a_viewer_shows(spark):
    from lanewise.operators import viewer as V

    lines = spark.createDataFrame([(1, 2, 0), (2, 6, 5), (3, 8, 1), (4, 1, 7)], "line int, class_rank int, code int")
    shown = lambda *a: sorted(r.line for r in V.visible(lines, *a).collect())
    assert (shown(8), shown(6), shown(6, "observed"), shown(6, "predicted")) == ([1, 2, 3, 4], [1, 2, 4], [1], [2, 4])
    nodes = spark.createDataFrame([(1, True), (2, False), (3, None)], "node int, cut boolean")
    assert [r.node for r in V.junctions(nodes).orderBy("node").collect()] == [2, 3] and V.junctions(nodes, False).count() == 3

    captures = spark.createDataFrame([(c, f"t{c}") for c in "abcd"], "name string, captured_utc string")
    tables = spark.createDataFrame([("a", "a.csv", True), ("b", "b.csv", False)], "name string, path string, has_hops boolean")
    got = {r.name: r.source for r in V.frame_sources(captures, tables, "tc").collect()}
    assert got == {"a": "a.csv", "b": None, "c": "served", "d": None}
    index = {r.name: (r.state, r.ready) for r in V.frames_index(captures, tables, spark.createDataFrame([("a", "v1"), ("b", "v1")], "name string, version string"), "v1").collect()}
    assert index == {"a": ("processed", True), "b": ("stale", False), "c": ("waiting", False), "d": ("waiting", False)}

    times = spark.createDataFrame([(c, i, c != "d") for i, c in enumerate("abcdef")], "name string, ts int, processed boolean")
    ahead = lambda at, n: [r.name for r in V.frames_ahead(times, at, n).orderBy("step").collect()]
    assert ahead("c", 3) == ["e", "f", "a"] and ahead("c", 60) == ["e", "f", "a", "b", "c"] and ahead("x", 3) == []

    frame = spark.createDataFrame([(1, 0), (2, 6), (3, 5)], "line int, code int")
    edges = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (3, 13)], "line int, edge_id int")
    step = spark.createDataFrame([(10, 1), (11, 3), (12, 0)], "edge_id int, level int")
    assert sorted(map(tuple, V.simulated_frame(frame, edges, step).collect())) == [(1, 3), (2, 4), (3, 5)]


def test_paths_of_layers():
    from lanewise.operators import viewer as V

    assert V.safe_layer("output/layers/a.geojson") and V.safe_layer("capture:dhaka-1/a.geojson")
    assert not any(V.safe_layer(k) for k in ("output/../a.geojson", "output/a.json", "other/a.geojson", "capture:../a.geojson", "output//a.geojson", "output/a\\..\\b.geojson", ""))


def test_styles_and_cached_samples(spark, tmp_path):
    from lanewise.operators import decode as X
    from lanewise.operators import viewer as V

    point = "array<struct<lon:double,lat:double>>"
    edges = spark.createDataFrame([(1, 0, 1, 85.0, 4, True, [(90.4, 23.8), (90.401, 23.8)])], f"edge_id bigint, u bigint, v bigint, length_m double, class_rank int, oneway boolean, geometry {point}")
    assert V.link_style(edges).first()[1:] == (0.5, 1.0, 0.5)
    assert V.junction_style(spark.createDataFrame([(1, 20, 2)], "node int, degree int, best_class int")).first()[1:] == (1.0, 0.25)
    first = X.cached_samples(edges, str(tmp_path)).orderBy("n").collect()
    assert first == X.sample_points(edges).orderBy("n").collect() == X.cached_samples(edges, str(tmp_path)).orderBy("n").collect()
    X.cached_samples(edges, str(tmp_path), step_m=9.0)
    X.cached_samples(edges.withColumn("length_m", F.lit(1.0)), str(tmp_path))
    assert len(list(tmp_path.iterdir())) == 3


def test_files_are_copied_and_checked(spark, tmp_path):
    from lanewise.sources import files as S

    (tmp_path / "from/sub").mkdir(parents=True)
    (tmp_path / "to").mkdir()
    (tmp_path / "from/a.json").write_text("one")
    (tmp_path / "from/sub/b.json").write_text("two")
    got = {r.file: (r.copied, r.same) for r in S.copy_listed(spark, f"{tmp_path}/from", f"{tmp_path}/to", ["a.json", "sub/b.json", "c.json"]).collect()}
    assert got == {"a.json": (True, True), "sub/b.json": (True, True), "c.json": (False, False)}
    (tmp_path / "to/sub/.b.json.crc").unlink()
    (tmp_path / "to/sub/b.json").write_text("2.0")
    left, right = S.fingerprints(spark, f"{tmp_path}/from"), S.fingerprints(spark, f"{tmp_path}/to")
    assert [r.file for r in S.may_go(left.where("file NOT LIKE '%.crc'"), right).collect()] == ["a.json"]


def test_a_cluster_needs_a_shared_folder():
    from lanewise.materialise import shared_folder

    def session(master, **conf):
        return type("Session", (), {"conf": conf, "sparkContext": type("Context", (), {"master": master})})

    assert shared_folder(session("yarn", **{"spark.checkpoint.dir": "hdfs://x/shared/"})) == "hdfs://x/shared"
    assert shared_folder(session("local[2]"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session("local-cluster[3,2,1024]"))
