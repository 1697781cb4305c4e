import json
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.operators import decode as X
from lanewise.operators import lines as L
from lanewise.operators import tiles as T
from lanewise.sources import files as S
from lanewise.sources import png
from lanewise.streaming import captures as C

Z, LON, LAT = 17, 90.4063, 23.7358
GREEN = (22, 224, 152, 255)


def pixel(lon, lat):
    n = 256 * 2**Z
    return (lon + 180) / 360 * n, (1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * n


def test_png_round_trip_and_filters():
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (9, 7, 4)).astype(np.uint8)
    data = png.encode(image)
    assert np.array_equal(png.decode(data), image) and png.encode(image) == data
    assert png.decode(data[:-20]) is None and png.decode(b"<html>") is None and png.decode(None) is None
    # all five filters, by filtering rows by hand
    h, w, u = 9, 7, 4
    raw = image.reshape(h, w * u).astype(int)
    body = b""
    for i in range(h):
        a = np.concatenate([np.zeros(u, int), raw[i, :-u]])
        b = raw[i - 1] if i else np.zeros(w * u, int)
        c = np.concatenate([np.zeros(u, int), b[:-u]])
        pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        pred = [0 * a, a, b, (a + b) // 2, np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))][i % 5]
        body += bytes([i % 5]) + ((raw[i] - pred) % 256).astype(np.uint8).tobytes()
    import struct

    other = png.MAGIC + png._chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + png._chunk(b"IDAT", zlib.compress(body)) + png._chunk(b"IEND", b"")
    assert np.array_equal(png.decode(other), image)


@pytest.fixture(scope="module")
def capture(tmp_path_factory):
    """One tile with a green line to the left of an eastbound road."""
    root = tmp_path_factory.mktemp("capture")
    (root / "tiles").mkdir()
    px, py = pixel(LON, LAT)
    tx, ty = int(px // 256), int(py // 256)
    image = np.zeros((256, 256, 4), np.uint8)
    row = int(py - ty * 256)
    image[row - 6 : row - 2] = GREEN
    (root / "tiles" / f"z{Z}_{tx}_{ty}.png").write_bytes(png.encode(image))
    (root / "tiles" / "z16_1_1.png").write_bytes(png.encode(image))
    (root / "manifest.json").write_text(json.dumps({"name": "dhaka-2026-09-17T0841Z", "captured_utc": "2026-09-17T08:41:05Z", "zoom": Z, "tile_px": 256, "status": "ok"}))
    west, east = tx * 360 / 2**Z - 180, (tx + 1) * 360 / 2**Z - 180
    return root, (tx, ty), (west + (east - west) * 0.1, west + (east - west) * 0.9)


def road(spark, lons, lat):
    point = "array<struct<lon:double,lat:double>>"
    rows = [(1, [(lons[0], lat), (lons[1], lat)]), (2, [(lons[1], lat), (lons[0], lat)]), (3, [(lons[0], lat - 0.0005), (lons[1], lat - 0.0005)])]
    return spark.createDataFrame(rows, f"edge_id bigint, geometry {point}")


def test_decode_a_painted_tile(spark, capture):
    root, (tx, ty), lons = capture
    tiles = S.read_tiles(spark, f"{root}/tiles", Z)
    assert [(r.z, r.x, r.y) for r in tiles.collect()] == [(Z, tx, ty)]
    got = {r.edge_id: r for r in X.decode_capture(road(spark, lons, LAT), tiles, Z).collect()}
    assert (got[1].cls, got[1].weight, got[1].vc_ratio, got[1].source) == (1, 25.0, 0.25, "observed") and got[1].coverage > 0.8
    for other in (2, 3):  # the other direction looks to the other side
        assert (got[other].cls, got[other].coverage, got[other].source) == (0, 0.0, "none")


def test_votes(spark):
    seen = spark.createDataFrame([(1, c) for c in (1, 1, 3, 3, 0)] + [(2, c) for c in (2, 0, 0, 0, 0)], "edge_id bigint, cls int")
    a, b = X.edge_votes(seen).orderBy("edge_id").collect()
    assert (a.cls, a.weight, a.f_green, a.f_red, a.coverage) == (3, 85.0, 0.4, 0.4, 0.8)  # shares add up to the coverage
    assert (b.cls, b.source) == (0, "none")


def test_pyramid_keeps_the_most_opaque(spark):
    a, b = np.zeros((4, 4, 4), np.uint8), np.zeros((4, 4, 4), np.uint8)
    a[0, 0] = (1, 2, 3, 50)
    a[1, 1] = (9, 9, 9, 200)
    a[2, 2] = a[2, 3] = (7, 7, 7, 90)
    a[2, 3, 0] = 8
    b[3, 3] = (5, 5, 5, 255)
    tiles = spark.createDataFrame([(3, 4, 6, bytearray(png.encode(a))), (3, 5, 7, bytearray(png.encode(b)))], "z int, x int, y int, content binary")
    got = {r.z: r for r in X.pyramid(tiles, 1, tile_px=4).collect() if r.z < 3}
    parent = png.decode(bytes(got[2].content))
    assert (got[2].x, got[2].y) == (2, 3)
    assert parent[0, 0].tolist() == [9, 9, 9, 200] and parent[1, 1].tolist() == [7, 7, 7, 90] and parent[3, 3].tolist() == [5, 5, 5, 255]
    assert (got[1].x, got[1].y) == (1, 1)


def test_clean_tile_keeps_traffic_only():
    image = np.zeros((2, 2, 4), np.uint8)
    image[0, 0], image[0, 1], image[1, 0] = GREEN, (90, 90, 90, 255), [round(255 - 0.3 * (255 - c)) for c in (209, 53, 43)] + [255]
    out = png.decode(X.clean_tile(png.encode(image)))
    assert out[0, 0].tolist() == list(GREEN) and out[0, 1, 3] == 0 and out[1, 1, 3] == 0 and 60 < out[1, 0, 3] < 95


def test_audit_and_coverage(spark, capture):
    root, (tx, ty), _ = capture
    expected = spark.createDataFrame([(tx, ty), (tx + 1, ty)], "x bigint, y bigint")
    rows = {r.x: r for r in X.audit_tiles(expected, S.read_tiles(spark, f"{root}/tiles", Z)).collect()}
    assert rows[tx].status == "ok" and rows[tx].traffic_frac == pytest.approx(4 / 256) and rows[tx + 1].status == "missing"
    c = T.coverage(expected, expected.limit(1)).first()
    assert (c.expected, c.missing, c.coverage_pct) == (2, 1, 50.0)
    assert T.coverage(expected.where("false"), expected).first().coverage_pct == 100.0


def test_manifests(spark, capture):
    root, _, _ = capture
    m = S.read_manifests(spark, str(root))
    r = m.first()
    assert (r.series, str(r.ts), r.zoom) == ("test", "2026-09-17 08:41:05", Z)
    assert S.newest_captures(m, 3).count() == 1


def test_weight_tables_and_history(spark, tmp_path):
    table = spark.createDataFrame([(1, 25.0, "observed"), (2, 85.0, "predicted")], "edge_id bigint, weight double, source string")
    for folder, name, t in (("a", "dhaka-2026-09-17T0841Z", table), ("b", "dhaka-2026-09-17T0841Z", table.where("edge_id = 1")), ("b", "dhaka-2026-09-17T0849Z", table)):
        (tmp_path / folder).mkdir(exist_ok=True)
        t.toPandas().to_csv(tmp_path / folder / f"{name}.csv.gz", index=False)
    h = S.read_history(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert sorted((r.capture[-5:], r.edge_id, r.level, r.painted) for r in h.collect()) == [("0841Z", 1, 0, 1), ("0841Z", 2, 2, 0), ("0849Z", 1, 0, 1), ("0849Z", 2, 2, 0)]
    S.write_readings(h, str(tmp_path / "readings"))
    assert S.read_readings(spark, str(tmp_path / "readings"), "2026-09-17", "2026-09-17").count() == 4
    assert S.read_readings(spark, str(tmp_path / "readings"), "2026-09-18").count() == 0


def test_graph_document(spark, tmp_path):
    doc = {"graph_id": "g", "nodes": {"1": [90.4, 23.8], "-2": [90.41, 23.8]}, "edges": [{"id": 0, "u": 1, "v": -2, "length_m": 100.0, "highway": "primary", "lanes": 2, "oneway": False, "capacity_vph": 2400.0, "free_flow_kmph": 36.0, "geometry": [[90.4, 23.8], [90.41, 23.8]]}]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    nodes, edges = S.read_graph(spark, str(tmp_path / "g.json"))
    assert nodes.count() == 2 and edges.first().free_flow_s == pytest.approx(10.0)
    S.write_graph(nodes, edges, str(tmp_path / "out"))
    n2, e2 = S.load_graph(spark, str(tmp_path / "out"))
    assert sorted(n2.collect()) == sorted(nodes.collect()) and e2.collect() == edges.collect()
    f = json.loads(L.features(edges, "highway").first().feature)
    assert f["geometry"]["coordinates"] == [[90.4, 23.8], [90.41, 23.8]] and f["properties"] == {"edge_id": 0, "highway": "primary"}


def test_fingerprints_compare(spark, tmp_path):
    for side, names in (("l", {"a": "1", "b": "2", "c": "3"}), ("r", {"a": "1", "b": "x", "d": "4"})):
        (tmp_path / side).mkdir()
        for n, t in names.items():
            (tmp_path / side / n).write_text(t)
    got = S.compare(S.fingerprints(spark, f"{tmp_path}/l"), S.fingerprints(spark, f"{tmp_path}/r"))
    assert sorted((r.file, r.difference) for r in got.collect()) == [("b", "changed"), ("c", "missing"), ("d", "extra")]


def test_config_problems():
    good = {"zoom": 17, "tile_px": 256, "bbox": {"north": 2, "south": 1, "east": 2, "west": 1}, "rate": 50, "workers": 8, "tolerance": 50, "min_free_gb": 5}
    assert S.validate_config(good) == []
    assert S.validate_config(good | {"zoom": 99, "rate": "fast"} | {"bbox": {}}) == ["zoom is out of range", "bbox is malformed", "rate is malformed"]
    assert len(S.quadrants(good["bbox"])) == 4


def test_packed_codes_round_trip(spark):
    lines = spark.createDataFrame([(i, i % 8) for i in range(25)], "edge_id bigint, code int")
    packed = L.packed_codes(lines, 10)
    back = L.unpacked_codes(packed.withColumnRenamed("bucket", "key")).select((F.col("key") * 10 + F.col("pos")).alias("e"), "level")
    assert sorted(map(tuple, back.collect())) == [(i, i % 8) for i in range(25)]


def test_streams(spark, tmp_path):
    rows = [("a", f"2026-09-17 08:{m:02d}:00", 1, 2, True) for m in (0, 8, 8, 55)]
    df = spark.createDataFrame(rows, "capture string, ts string, edge_id bigint, level int, painted boolean").withColumns({"ts": F.to_timestamp("ts"), "level": F.col("level").cast("tinyint")})
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    q = C.publish(C.stream_readings(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state")
    q.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
    stream = C.stream_readings(spark, f"{tmp_path}/in")
    for name, out in (("hours", C.hourly_levels(stream)), ("runs", C.runs(stream))):
        q = out.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert spark.table("hours").first().n == 4
    assert sorted(r.captures for r in spark.table("runs").collect()) == [1, 3]


def test_blocked_sources(spark, tmp_path):
    status = [403] * 3 + [200] + [403] * 30
    spark.createDataFrame([("s", i, x) for i, x in enumerate(status)], "source string, seq bigint, status int").coalesce(1).write.parquet(f"{tmp_path}/log")
    log = spark.readStream.schema("source string, seq bigint, status int").parquet(f"{tmp_path}/log")
    q = C.blocked(log).writeStream.format("memory").queryName("blocked").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("blocked").collect()] == [("s", 28, 25)]


def test_points_along_lines(spark):
    """Against walking every line in small steps."""
    import math
    import random

    rng = random.Random(5)
    lines = [[(90.4 + rng.random() / 500, 23.8 + rng.random() / 500) for _ in range(rng.choice([2, 3, 5]))] for _ in range(25)]
    lines += [[(90.4, 23.8)], [(90.4, 23.8), (90.4, 23.8)], [(90.4, 23.8), (90.4, 23.8), (90.4001, 23.8)], [], None]
    rows = [(i, x) for i, x in enumerate(lines)]
    got = {}
    for r in X.sample_points(spark.createDataFrame(rows, "edge_id bigint, geometry array<struct<lon:double,lat:double>>")).collect():
        got.setdefault(r.edge_id, []).append(r)
    assert set(got) == {i for i, x in rows if x}

    def metres(p, q):
        a = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[0] - p[0]) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(a))

    for i, points in got.items():
        line, found = lines[i] if len(lines[i]) > 1 else lines[i] * 2, sorted(points, key=lambda r: r.n)
        legs = [metres(p, q) for p, q in zip(line, line[1:])]
        total = sum(legs)
        trim = min(10.0, 0.3 * total)
        assert len(found) == max(2, int((total - 2 * trim) // 5) + 1)
        for k, r in enumerate(found):
            want, at = trim + k * (total - 2 * trim) / (len(found) - 1), 0.0
            near = min(abs(at_ + metres(line[j], (r.lon, r.lat)) - want) for j, at_ in [(j, sum(legs[:j])) for j in range(len(legs))])
            assert near < 1e-3
            assert any((r.dlon, r.dlat) == (q[0] - p[0], q[1] - p[1]) for p, q in zip(line, line[1:]))


def test_every_edge_has_a_row(spark, capture):
    root, _, lons = capture
    edges = road(spark, lons, LAT).unionByName(spark.createDataFrame([(9, None)], "edge_id bigint, geometry array<struct<lon:double,lat:double>>"))
    got = {r.edge_id: r for r in X.decode_capture(edges, S.read_tiles(spark, f"{root}/tiles", Z), Z).collect()}
    assert set(got) == {1, 2, 3, 9} and (got[9].cls, got[9].n_samples, got[9].source, got[9].coverage) == (0, 0, "none", 0.0)


def test_weights_of_both_models_in_one_folder(spark, tmp_path):
    from lanewise import schemas
    from lanewise.sources import files as S

    old, new = ([c.split()[0] for c in x.split(", ")] for x in (schemas.OBSERVED, schemas.COMPLETE))
    row = ["2026-01-01T00:00:00Z", "7", "2", "55.0", "0", "1", "0", "0", "0.9", "0.55", "4", "observed"]
    write = lambda name, head, rows: (tmp_path / name).write_text("\n".join(map(",".join, [head, *rows])) + "\n")
    write("a.csv", old, [row, [*row[:1], "8", *row[2:]], row[:5], [*row[:3], "heavy", *row[4:]]])
    write("b.csv", new, [[*row[:1], "9", *row[2:11], "predicted", "spread", "3"], [*row, "spread", "many"], [*row, "x", "1", "2", "3"]])
    for _ in range(2):
        got = S.read_weights(spark, str(tmp_path)).orderBy("edge_id")
        assert got.columns == new
        assert [(r.edge_id, r.weight, r.source, r.method, r.hops) for r in got.collect()] == [(7, 55.0, "observed", None, None), (8, 55.0, "observed", None, None), (9, 55.0, "predicted", "spread", 3)]
        (tmp_path / "b.csv").rename(tmp_path / "0.csv") if (tmp_path / "b.csv").exists() else None
    assert {r["file"][-5:]: (r["rows"], r["damaged"]) for r in S.damaged_weights(spark, str(tmp_path)).collect()} == {"a.csv": (4, 2), "0.csv": (3, 2)}
    (tmp_path / "0.csv").unlink()
    assert S.read_weights(spark, str(tmp_path)).columns == old
