"""Tables along a curve, kept history, as-of stream, sketches and quartered sources."""

import datetime as dt
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lanewise.operators import areas as R
from lanewise.operators import graph as G
from lanewise.operators import history as H
from lanewise.operators import sketches as K
from lanewise.sources import quarters as U
from lanewise.streaming.history_state import HistoryState


@pytest.fixture(scope="module")
def town(spark, tmp_path_factory):
    r = random.Random(1)
    nodes = [(i, r.uniform(89, 92), r.uniform(22, 25)) for i in range(3000)] + [(5000, 179.99, 0.0), (5001, -179.99, 0.01), (5002, 10.0, 89.99), (5003, None, None)]
    near = sorted(nodes[:3000], key=lambda n: (round(n[1], 1), n[2]))
    edges = [(k, a[0], b[0]) for k, (a, b) in enumerate(zip(near, near[1:]))] + [(9000, 5000, 5001), (9001, 5002, 5002), (9002, 1, 77777)]
    n = spark.createDataFrame(nodes, "node_id bigint, lon double, lat double")
    e = spark.createDataFrame(edges, "edge_id bigint, u bigint, v bigint")
    path = str(tmp_path_factory.mktemp("curve"))
    R.write_graph_by_curve(n, e, path, files=12, row_group_bytes=4096)
    return n, e, path


@pytest.mark.parametrize("disc", [(90.4, 23.8, 20_000.0), (91.9, 22.1, 60_000.0), (180.0, 0.0, 5_000.0), (0.0, 90.0, 3_000.0), (90.4, 23.8, 0.0), (90.5, 23.5, 3e7)])
def test_areas_by_curve(spark, town, disc):
    n, e, path = town
    want = {r["edge_id"] for r in G.within(n, e, *disc).collect()}
    assert {r["edge_id"] for r in R.edges_in_disc(spark, path, *disc).collect()} == want
    from lanewise.functions import geo

    inside = n.where("lon IS NOT NULL").where(geo.haversine_m(F.col("lon"), F.col("lat"), F.lit(disc[0]), F.lit(disc[1])) <= disc[2])
    assert {r["node_id"] for r in R.nodes_in_disc(spark, path, *disc).collect()} == {r["node_id"] for r in inside.collect()}


def test_a_small_disc_reads_few_row_groups(spark, town, tmp_path):
    path = town[2]
    plan = R.nodes_in_disc(spark, path, 90.4, 23.8, 10_000.0)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(curve," in plan[plan.index("PushedFilters") :]
    import glob
    import math

    dy = 10_000 / 110_000
    spans = R.covering(90.4 - dy / math.cos(math.radians(24)), 23.8 - dy, 90.4 + dy / math.cos(math.radians(24)), 23.8 + dy)
    groups = hit = 0
    for f in glob.glob(f"{path}/nodes/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        at = meta.schema.names.index("curve")
        for k in range(meta.num_row_groups):
            s = meta.row_group(k).column(at).statistics
            groups += 1
            hit += any(s.min <= b and a <= s.max for a, b in spans) if s.has_min_max else 0
    assert groups >= 12 and hit <= groups / 4


def test_coverings_hold_their_box(spark):
    r = random.Random(3)
    rows = []
    for _ in range(40):
        w, s = r.uniform(-180, 179), r.uniform(-90, 89)
        box = (w, s, min(180, w + r.uniform(0, 20)), min(90, s + r.uniform(0, 20)))
        spans = R.covering(*box)
        assert 0 < len(spans) <= R.MOST_INTERVALS and all(a <= b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
        rows += [(r.uniform(box[0], box[2]), r.uniform(box[1], box[3]), [list(x) for x in spans]) for _ in range(10)]
    df = spark.createDataFrame(rows, "lon double, lat double, spans array<array<bigint>>").withColumn("k", R.curve_key(F.col("lon"), F.col("lat")))
    assert df.where(~F.exists("spans", lambda x: (F.col("k") >= x[0]) & (F.col("k") <= x[1]))).count() == 0


# History

START = dt.datetime(2026, 3, 2, 1)


def some_readings(spark, captures=30, seed=0):
    r = random.Random(seed)
    rows = [(START + dt.timedelta(hours=7 * c, minutes=c), k, r.randrange(4), 1) for c in range(captures) for k in range(6) if r.random() < 0.7]
    return spark.createDataFrame(rows, "ts timestamp, edge_id bigint, level int, painted int")


def table(df):
    return sorted((r["edge_id"], str(r["weekend"]), -1 if r["hour"] is None else r["hour"], r["n"], round(r["mean_level"], 9)) for r in df.collect())


def test_batches_count_once(spark, tmp_path):
    r = some_readings(spark)
    part = lambda k: r.where(F.pmod(F.hash("ts"), F.lit(4)) == k)
    state = HistoryState(spark, f"file://{tmp_path}/state")
    assert state.profile().count() == 0 and state.compact() is None
    for number in (0, 1, 1, 2):
        state.fold(part(number), number)
    assert state.compact() == 2 == state.compact()
    state.fold(part(1), 1)  # held by the base already
    (tmp_path / "state/batch/n9").mkdir()  # broken off
    for _ in range(2):
        state.fold(part(3), 3)
    assert table(state.profile()) == table(H.hour_profile(r, H.captures_of(r)))


def test_a_capture_in_two_batches_is_one(spark, tmp_path):
    r = some_readings(spark, 10)
    state = HistoryState(spark, f"file://{tmp_path}/state")
    for k in (0, 1):
        state.fold(r.where(F.col("edge_id") % 2 == k), k)
    assert table(state.profile()) == table(H.hour_profile(r, H.captures_of(r)))


def test_a_stream_of_batches(spark, tmp_path):
    r = some_readings(spark, 20)
    r.repartition(4).write.parquet(f"{tmp_path}/in")
    state = HistoryState(spark, f"file://{tmp_path}/state")
    stream = lambda: spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    state.follow(stream(), f"{tmp_path}/check").awaitTermination()
    state.follow(stream(), f"{tmp_path}/other").awaitTermination()  # all batches again
    assert table(state.profile()) == table(H.hour_profile(r, H.captures_of(r)))


@pytest.mark.parametrize("days", [21, 2])
def test_as_of_stream_finds_what_pairs_find(spark, days):
    r = random.Random(days)
    at = lambda n, first: sorted({START + dt.timedelta(days=r.randrange(days) + first, minutes=r.choice([0, 5, 715, 1435, r.randrange(1440)])) for _ in range(n)})
    df = lambda ts: H.captures_of(spark.createDataFrame([(t,) for t in ts], "ts timestamp"))
    train, asked = df(at(60, 0)), df(at(80, 21))
    rows = lambda x: sorted(tuple(r) for r in x.select("asked", "ts", "gap").collect())
    assert rows(H.as_of_captures(train, asked)) == rows(H.same_time_captures(train, asked))
    plan = H.as_of_captures(train, asked)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert H.as_of_captures(train.limit(0), asked).count() == 0 == H.as_of_captures(train, asked.limit(0)).count()


# Sketches


def test_sketches_over_ranges_of_days(spark, tmp_path):
    r = random.Random(8)
    rows = [(f"2026-01-{1 + k % 9:02d}", "ab"[k % 3 == 0], r.gauss(0, 1) if k % 2 else 5.0) for k in range(30_000)] + [("2026-01-01", "a", None)]
    df = spark.createDataFrame(rows, "day string, kind string, weight double").withColumn("day", F.to_date("day"))
    path = f"file://{tmp_path}/s"
    K.keep_by_day(K.sketch(df, ["day", "kind"]), path)
    K.keep_by_day(K.sketch(df.where("day = '2026-01-03'"), ["day", "kind"]), path)  # again: replaces itself
    for first, last in ((None, None), ("2026-01-03", "2026-01-05")):
        part = df.where(F.col("day").between(first or "2026-01-01", last or "2026-01-31"))
        found = K.quantiles(K.over_days(spark, path, first, last, ["kind"]), [0.01, 0.3, 0.5, 0.99])
        assert {(r["kind"], r["n"]) for r in found.collect()} == {(r["kind"], r["n"]) for r in part.where("weight IS NOT NULL").groupBy("kind").agg(F.count("*").alias("n")).collect()}
        errors = K.rank_errors(found.select("kind", "n", "rank", "value"), part, ["kind"], "weight").collect()
        assert len(errors) == 8 and max(r["error"] for r in errors) < 0.01


# Quartering


def test_boxes_are_quartered_where_a_source_refuses(spark):
    def transport(mirror, box):
        if mirror == "down":
            raise OSError("no answer")
        if box["east"] - box["west"] > 2.5:
            raise ValueError("too big")
        if box["west"] < 1.5 and box["north"] > 6.5:
            raise ValueError("never")
        inside = [k for k in range(64) if box["west"] <= k % 8 + 0.5 < box["east"] and box["south"] <= k // 8 + 0.5 < box["north"]]
        # a way on the border comes with every box that it touches
        return [{"type": "node", "id": k, "lon": k % 8 + 0.5, "lat": k // 8 + 0.5} for k in inside] + [{"type": "way", "id": 1, "nodes": [3, 4], "tags": {"highway": "primary"}}]

    found, boxes = U.fetch_elements(spark, {"north": 8, "south": 0, "east": 8, "west": 0}, transport, ["down", "up"], tries=1, most_depth=2)
    states = {(r["depth"], r["state"]): r["n"] for r in boxes.groupBy("depth", "state").agg(F.count("*").alias("n")).collect()}
    assert states == {(0, "cut"): 1, (1, "cut"): 4, (2, "done"): 15, (2, "failed"): 1}
    rows = found.collect()
    assert sorted(r["id"] for r in rows if r["type"] == "node") == [k for k in range(64) if not (k % 8 < 2 and k // 8 >= 6)]
    (way,) = [r for r in rows if r["type"] == "way"]
    assert way["nodes"] == [3, 4] and way["tags"] == {"highway": "primary"}
    assert "never" in boxes.where("state = 'failed'").first()["detail"] and boxes.where("state = 'done'").first()["detail"] == "up"


def test_quartered_points(spark):
    r = random.Random(4)
    rows = [(min(7.99, abs(r.gauss(0, 1.5))), min(7.99, abs(r.gauss(0, 1.5)))) for _ in range(500)] + [(0.1, 0.1)] * 30 + [(99.0, -5.0)]
    box = {"west": 0.0, "east": 8.0, "south": 0.0, "north": 8.0}
    got = {(x["level"], x["x"], x["y"]): x["n"] for x in U.quartered(spark.createDataFrame(rows, "lon double, lat double"), box, 9, depth=5).collect()}

    def cut(points, level, x, y):
        if len(points) <= 9 or level == 5:
            return {(level, x, y): len(points)} if points else {}
        out, w = {}, 8 / 2 ** (level + 1)
        for p in points:
            out.setdefault((2 * x + (p[0] >= (2 * x + 1) * w), 2 * y + (p[1] >= (2 * y + 1) * w)), []).append(p)
        return {k: v for (a, b), ps in out.items() for k, v in cut(ps, level + 1, a, b).items()}

    assert got == cut([(min(max(a, 0), 7.999), min(max(b, 0), 7.999)) for a, b in rows], 0, 0, 0)
    assert max(got.values()) > 9  # thirty copies, at the last depth
