"""Pivot neighbours and stored samples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.operators import decode as X
from lanewise.operators import neighbours as N
from lanewise.operators import sample_store as Z
from lanewise.sources import png


def points(spark, x, ids=None):
    rows = [(int(k), v.tolist()) for k, v in zip(range(len(x)) if ids is None else ids, x)]
    return spark.createDataFrame(rows, "id bigint, features array<double>")


def brute(x, q, k):
    out = {}
    for name, v in q:
        d = ((x - v) ** 2).sum(axis=1)
        out[name] = [(int(i), float(d[i])) for i in np.lexsort((np.arange(len(x)), d))[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("q", "rank").collect():
        out.setdefault(r["q"], []).append((r["id"], r["d2"]))
        assert r["rank"] == len(out[r["q"]])
    return out


@pytest.fixture(scope="module")
def clusters():
    """Forty clusters, one with a third of all points, copies included."""
    r = np.random.default_rng(2)
    centre = r.normal(size=(40, 6)) * 30
    x = np.concatenate([centre[r.integers(0, 40, 2400)], np.repeat(centre[:1], 1200, axis=0)]) + r.normal(size=(3600, 6))
    x[100:140] = x[100]
    return x


def test_clustered_points_need_a_third_of_the_distances(spark, clusters):
    q = [(k, clusters[k]) for k in range(0, len(clusters), 37)]
    got = N.neighbours_by_pivots(points(spark, clusters).repartition(5), points(spark, np.array([v for _, v in q]), [k for k, _ in q]).withColumnRenamed("id", "q"), 5, pivots=40, block=64).cache()
    assert found(got) == brute(clusters, q, 5)
    seen = got.groupBy("q").agg(F.max("seen").alias("n")).agg(F.sum("n")).first()[0]
    assert seen < len(q) * len(clusters) / 3


def test_points_without_clusters(spark):
    x = np.random.default_rng(5).normal(size=(300, 20))
    q = [(k, v) for k, v in enumerate(np.random.default_rng(6).normal(size=(40, 20)) * 3)]
    got = N.neighbours_by_pivots(points(spark, x), points(spark, np.array([v for _, v in q])).withColumnRenamed("id", "q"), 7, pivots=8, block=32)
    assert found(got) == brute(x, q, 7)


def test_fewer_points_than_asked_for_and_none(spark):
    x = np.array([[0.0], [0.0], [5.0]])
    q = points(spark, np.array([[1.0], [9.0]])).withColumnRenamed("id", "q")
    assert found(N.neighbours_by_pivots(points(spark, x), q, 9)) == brute(x, [(0, np.array([1.0])), (1, np.array([9.0]))], 9)
    assert N.neighbours_by_pivots(points(spark, x).limit(0), q, 2).count() == 0
    assert N.neighbours_by_pivots(points(spark, x), q.limit(0), 2).count() == 0


def test_more_queries_than_a_block_takes_at_once(spark, clusters):
    got = found(N.nearest_join(points(spark, clusters), 2, pivots=16, block=256))
    assert len(got) == len(clusters)
    for k in range(0, len(clusters), 97):
        d = ((clusters - clusters[k]) ** 2).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(len(d)), d)) if i != k][:2]
        assert [i for i, _ in got[k]] == order


# Stored samples

COLOURS = {1: (17, 214, 143, 255), 0: (0, 0, 0, 0)}


def tile(cls):
    from lanewise.functions import palette

    image = np.zeros((256, 256, 4), np.uint8)
    if cls:
        image[...] = (*next(rgb for c, rgb in palette.PALETTE if c == cls), 255)
    return png.encode(image)


@pytest.fixture(scope="module")
def town(spark):
    point = lambda lon, lat: {"lon": lon, "lat": lat}
    lines = [(k, [point(90.3 + 0.01 * k, 23.7), point(90.3 + 0.01 * k + 0.02, 23.75)]) for k in range(12)]
    lines += [(50, []), (51, None)]
    return spark.createDataFrame(lines, "edge_id bigint, geometry array<struct<lon:double,lat:double>>")


def all_tiles(store, paint):
    return [(r["tx"], r["ty"], tile(paint(r["tx"], r["ty"]))) for r in store.packed().select("tx", "ty").collect() if paint(r["tx"], r["ty"]) is not None]


def test_stored_samples_decode_as_fresh_ones(spark, town, tmp_path):
    store = Z.store_samples(town, f"file://{tmp_path}", 14, step_m=200, buckets=4)
    paint = lambda x, y: None if (x + y) % 6 == 0 else (x + 2 * y) % 5
    tiles = spark.createDataFrame([*all_tiles(store, paint), (0, 0, b"damaged")], "x int, y int, content binary")
    fresh = X.edge_votes(X.classify_samples(X.sample_points(town, step_m=200), tiles, 14))
    got = Z.decode_capture(store, tiles)
    assert got.columns == fresh.columns and got.count() == 12
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, fresh.collect()))


def test_many_captures_at_once(spark, town, tmp_path):
    store = Z.store_samples(town, f"file://{tmp_path}", 14, step_m=200, buckets=4)
    paints = {"a": lambda x, y: 1 + x % 4, "b": lambda x, y: None if x % 2 else 3, "c": lambda x, y: 0}
    rows = [(c, *t) for c, paint in paints.items() for t in all_tiles(store, paint)]
    tiles = spark.createDataFrame(rows, "capture string, x int, y int, content binary")
    many = {c: sorted(tuple(r)[1:] for r in Z.decode_captures(store, tiles).where(F.col("capture") == c).collect()) for c in paints}
    for c in paints:
        alone = Z.decode_capture(store, tiles.where(F.col("capture") == c)).where("coverage > 0")
        assert many[c] == sorted(map(tuple, alone.collect()))
    assert many["a"] and many["b"] and not many["c"]


def test_no_shuffle_of_samples(spark, town, tmp_path):
    store = Z.store_samples(town, f"file://{tmp_path}", 14, step_m=200, buckets=4)
    tiles = spark.createDataFrame(all_tiles(store, lambda x, y: 2), "x int, y int, content binary").hint("merge")
    plan = Z.tile_join(store, tiles)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1 and "Bucketed: true" in plan
    below = plan[: plan.index("Scan parquet")]
    assert "Exchange" not in below  # what stands above the samples' scan has none


def test_samples_are_written_once(spark, town, tmp_path):
    folder = f"file://{tmp_path}"
    first = Z.store_samples(town, folder, 14, step_m=200, buckets=4)
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    spark.sql(f"DROP TABLE {first.table}")  # as in a new session
    again = Z.store_samples(town, folder, 14, step_m=200, buckets=4)
    assert {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")} == before
    assert again.packed().count() > 0 and again.counts().count() == 12
    other = Z.store_samples(town.where("edge_id < 3"), folder, 14, step_m=200, buckets=4)
    assert other.table != first.table and other.counts().count() == 3


def test_samples_of_a_full_tile_lie_in_many_buckets(spark, town, tmp_path):
    """A tile with more samples than a slot holds is decoded in several tasks, to the same rows."""
    lines = town.where("edge_id < 50").withColumn("edge_id", F.explode(F.array(*[F.col("edge_id") * 100 + k for k in range(40)])))
    store = Z.store_samples(lines.repartition(30), f"file://{tmp_path}", 12, step_m=100, buckets=8, slot=300)
    lie = store.packed().select("tx", "ty", "slot", F.input_file_name().alias("file")).distinct()
    fullest = lie.groupBy("tx", "ty").agg(F.count_distinct("slot").alias("slots"), F.count_distinct("file").alias("files")).orderBy(F.desc("files")).first()
    assert fullest.slots > 4 and fullest.files > 2
    places = sorted((r.tx, r.ty) for r in store.packed().select("tx", "ty").distinct().collect())
    tiles = spark.createDataFrame([(x, y, tile(k % 4 and 1 + (x + y) % 4)) for k, (x, y) in enumerate(places)], "x int, y int, content binary")
    fresh = X.edge_votes(X.classify_samples(X.sample_points(lines, step_m=100), tiles, 12))
    assert sorted(map(tuple, Z.decode_capture(store, tiles).collect())) == sorted(map(tuple, fresh.collect()))


def test_places_of_bent_lines(spark, tmp_path):
    """Packed places are those of the samples laid by expressions, also on one point and equal points; open ones have none."""
    rng = np.random.default_rng(5)
    point = lambda lon, lat: {"lon": None if lon is None else float(lon), "lat": float(lat)}
    lines = [(k, [point(90.4 + x, 23.7 + y) for x, y in np.cumsum(rng.normal(size=(int(rng.integers(2, 9)), 2)) * 1e-3, axis=0)]) for k in range(60)]
    lines += [(100, [point(90.4, 23.7)]), (101, [point(90.4, 23.7)] * 3), (102, [point(None, 23.7), point(90.4, 23.7)]), (103, []), (104, None)]
    lines = spark.createDataFrame(lines, "edge_id bigint, geometry array<struct<lon:double,lat:double>>")
    want = X.place_samples(X.sample_points(lines, 5.0, 10.0), 17).select("tx", "ty", "edge_id", "i", "j").where("tx IS NOT NULL").collect()
    store = Z.store_samples(lines, f"file://{tmp_path}", 17, buckets=4)
    got = [(r.tx, r.ty, e, p >> 16 & 0xFFFF, p & 0xFFFF) for r in store.packed().collect() for e, p in zip(np.repeat(r.edges, r["sizes"]).tolist(), r.places)]
    assert sorted(got) == sorted(map(tuple, want)) and len({x[2] for x in got}) == 62
    sizes = {}
    for r in want:
        sizes[r.edge_id] = sizes.get(r.edge_id, 0) + 1
    assert {r.edge_id: r.n_samples for r in store.counts().collect()} == sizes


@pytest.mark.parametrize("window", [0, 1, 2])
def test_a_tile_asked_often_is_classified_once(window):
    from lanewise.functions import palette

    rng = np.random.default_rng(2)
    fills = np.array([(0, 0, 0, 0), *((*rgb, 255) for _, rgb in palette.PALETTE)], np.uint8)
    image = fills[rng.integers(0, len(fills), (64, 64))]
    seen, content = X.SeenClasses(window), png.encode(image)
    for n in (10, 300, 5000, 10):
        i, j = rng.integers(0, 64, n), rng.integers(0, 64, n)
        assert seen(content, i, j).tolist() == X.seen_classes(image, i, j, window).tolist()
    assert seen.map is not None
    assert seen(content, np.array([200]), np.array([3])).tolist() == X.seen_classes(image, np.array([200]), np.array([3]), window).tolist()
    assert seen(b"damaged", np.arange(3), np.arange(3)).tolist() == [0, 0, 0] and seen.map is None


def test_points_are_sent_to_groups_and_not_to_blocks(spark, clusters, monkeypatch):
    """A point travels once for each group on either side, and is found exactly."""
    monkeypatch.setattr(N, "_visit", None)
    x = np.concatenate([clusters[:700], np.repeat(clusters[:1], 60, axis=0)])
    joined = N.nearest_join(points(spark, x), 3, pivots=8, block=32, cell=200)
    want = {}
    for name, v in enumerate(x):
        d = ((x - v) ** 2).sum(axis=1)
        want[name] = [(int(i), float(d[i])) for i in np.lexsort((np.arange(len(x)), d)) if i != name][:3]
    assert found(joined) == want
    far = np.random.default_rng(8).normal(size=(90, 70)) + 1e6  # products alone would be too rough
    d = [((far - v) ** 2).sum(axis=1) for v in far]
    assert found(N.nearest_join(points(spark, far), 2, block=16)) == {q: [(int(i), float(e[i])) for i in np.lexsort((np.arange(90), e)) if i != q][:2] for q, e in enumerate(d)}
    assert N.nearest_join(points(spark, x[:2]), 5).count() == 2 and N.nearest_join(points(spark, x).limit(0), 2).count() == 0
