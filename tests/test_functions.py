import math

import pytest
from pyspark.sql import functions as F

from lanewise.functions import clock, geo, palette, traffic


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tile_of_the_anchor_point(spark):
    lon, lat = F.lit(90.4063), F.lit(23.7358)
    assert (value(spark, F.floor(geo.lon_to_tx(lon, 17))), value(spark, F.floor(geo.lat_to_ty(lat, 17)))) == (98451, 56635)


def test_tile_maths_round_trip(spark):
    px = geo.lonlat_to_pixel(F.lit(90.4), F.lit(23.8), 17)
    back = value(spark, geo.pixel_to_lonlat(px["px"], px["py"], 17))
    assert back.lon == pytest.approx(90.4, abs=1e-9) and back.lat == pytest.approx(23.8, abs=1e-9)


def test_lengths_and_directions(spark):
    line = F.array(*[F.struct(F.lit(90.4 + i / 100).alias("lon"), F.lit(23.8).alias("lat")) for i in range(3)])
    one = value(spark, geo.haversine_m(F.lit(90.4), F.lit(23.8), F.lit(90.42), F.lit(23.8)))
    assert value(spark, geo.polyline_length_m(line)) == pytest.approx(one, rel=1e-6)
    assert value(spark, geo.polyline_length_m(F.slice(line, 1, 1))) == 0.0
    assert [value(spark, geo.compass(F.lit(0.0), F.lit(0.0), F.lit(float(x)), F.lit(float(y)))) for x, y in ((0, 1), (1, 1), (1, 0), (-1, -1))] == ["north", "north-east", "east", "south-west"]


def test_bpr_calibration(spark):
    at = lambda vc: value(spark, traffic.delay_factor(F.lit(vc)))
    assert at(1.05) == pytest.approx(4)
    assert at(0.25) < 1.05 and 1.1 < at(0.55) < 1.5 and 2.0 < at(0.85) < 3.0
    assert at(5.0) == at(2.0)
    assert value(spark, traffic.bpr_time(F.lit(10.0), F.lit(5.0), F.lit(0.0))) == math.inf


def test_halfway_weights(spark):
    assert [value(spark, traffic.to_class(F.lit(w))) for w in (40.0, 70.0, 95.0)] == [1, 2, 3]
    assert [value(spark, traffic.level_of_weight(F.lit(w))) for w in (40.0, 70.0, 95.0)] == [1, 2, 3]
    assert [value(spark, traffic.demote(F.lit(w))) for w in (25.0, 55.0, 85.0, 105.0, 70.0)] == [25, 25, 55, 85, 40]


def test_classes(spark):
    assert [value(spark, traffic.class_rank(F.lit(h))) for h in ("motorway_link", "service", "path", None)] == [0, 8, 5, 5]


# Pixels and the class each is expected to have.
PIXELS = [
    ((22, 224, 152, 255), 1), ((4, 156, 101, 255), 1), ((255, 207, 67, 255), 2), ((209, 53, 43, 255), 3), ((169, 39, 39, 255), 4), ((112, 35, 35, 255), 4),
    ((22, 224, 152, 100), 0), ((255, 255, 255, 255), 0), ((128, 128, 128, 255), 0), ((0, 0, 255, 255), 0),
]


def test_palette_columns_and_arrays_agree(spark):
    import numpy as np

    from lanewise.operators.decode import classify_array

    rng = np.random.default_rng(0)
    px = [p for p, _ in PIXELS] + [tuple(int(x) for x in row) for row in rng.integers(0, 256, (400, 4))]
    for _, (r, g, b) in palette.PALETTE:
        px += [tuple(round(255 - t * (255 - c)) for c in (r, g, b)) + (255,) for t in (0.2, 0.45, 0.6, 0.8)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(px)], "i int, r int, g int, b int, a int")
    got = [r.c for r in palette.matched(df).select("i", palette.class_of_match().alias("c")).orderBy("i").collect()]
    assert got[: len(PIXELS)] == [c for _, c in PIXELS]
    assert got == classify_array(np.array(px, dtype=np.uint8)).tolist()


def test_clock(spark):
    assert [value(spark, clock.hour_label(F.lit(h))) for h in (0, 9, 12, 13)] == ["12 am", "9 am", "12 pm", "1 pm"]
    assert str(value(spark, clock.capture_time(F.lit("dhaka-2026-09-17T0841Z")))) == "2026-09-17 08:41:00"
    assert value(spark, clock.capture_time(F.lit("test-capture"))) is None
    assert [value(spark, clock.circular_gap(F.lit(a), F.lit(b))) for a, b in ((1430, 10), (10, 1430), (700, 710))] == [20, 20, 10]
    assert str(value(spark, clock.target_time(F.lit("Tuesday"), F.lit("19:00")))) == "2026-09-22 13:00:00"
    f = value(spark, clock.time_features(F.lit(0), F.lit(True)))
    assert f[2] == 3.0


def test_ring_and_box(spark):
    r = value(spark, geo.ring(F.lit(90.4), F.lit(23.8), 500.0))
    assert len(r) == 65 and r[0].lon == pytest.approx(r[-1].lon)
    box = value(spark, geo.parse_box(F.lit("23.9,23.7,90.5,x")))
    assert (box.north, box.west) == (23.9, None)
