"""Queries of the column functions: geometry, levels, colours and clocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock, geo, palette, traffic
from . import adapters as A
from .registry import query, rounded

_TY = "(1 - ln(tan(radians({lat})) + 1 / cos(radians({lat}))) / pi()) / 2 * 131072E0"
_HAV = (
    "2 * 6371000E0 * asin(sqrt(least(greatest(power(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) "
    "* power(sin(radians({d} - {c}) / 2), 2), 0), 1)))"
)


def hav(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return _HAV.format(a=lat1, b=lat2, c=lon1, d=lon2)


@query(
    f"""SELECT node_id, round((lon + 180) / 360 * 131072E0, 6) AS tx, round({_TY.format(lat="lat")}, 6) AS ty,
    round((lon + 180) / 360 * 131072E0 * 256, 4) AS px, round({_TY.format(lat="lat")} * 256, 4) AS py,
    round(lon, 6) AS lon_back, round(lat, 9) AS lat_back, round(156543.03392E0 * cos(radians(lat)) / 131072E0, 6) AS m_per_px,
    CAST(floor((lon + 180) / 360 * 131072E0) AS INTEGER) AS tile_x,
    round(floor((lon + 180) / 360 * 131072E0) / 131072E0 * 360 - 180, 6) AS west,
    round((floor((lon + 180) / 360 * 131072E0) + 0.5E0) / 131072E0 * 360 - 180, 6) AS centre_lon,
    round((lon - 90.4E0) * 111320E0 * cos(radians(23.8E0)), 4) AS east_m, round((lat - 23.8E0) * 110540E0, 4) AS north_m,
    CAST(least(greatest(trunc((lat - 23.711736E0) / 0.031725E0), 0), 5) * 6
      + least(greatest(trunc((lon - 90.326774E0) / 0.028817333333E0), 0), 5) AS INTEGER) AS cell
    FROM nodes""",
    ("nodes",),
)
def tile_xy_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = F.col("lon"), F.col("lat")
    px = geo.lonlat_to_pixel(lon, lat, 17)
    back = geo.pixel_to_lonlat(px["px"], px["py"], 17)
    tile = F.floor(geo.lon_to_tx(lon, 17)).cast("int")
    near = geo.local_xy(lon, lat, F.lit(90.4), F.lit(23.8))
    box = {"west": 90.326774, "east": 90.326774 + 6 * 0.028817333333, "south": 23.711736, "north": 23.711736 + 6 * 0.031725}
    return A.nodes(spark, sf_dir).select(
        "node_id", rounded(geo.lon_to_tx(lon, 17)).alias("tx"), rounded(geo.lat_to_ty(lat, 17)).alias("ty"),
        rounded(px["px"], 4).alias("px"), rounded(px["py"], 4).alias("py"), rounded(back["lon"]).alias("lon_back"), rounded(back["lat"], 9).alias("lat_back"),
        rounded(geo.metres_per_pixel(lat, 17)).alias("m_per_px"), tile.alias("tile_x"),
        rounded(geo.tile_bounds(tile, F.lit(0), 17)["west"]).alias("west"), rounded(geo.tile_centre(tile, F.lit(0), 17)["lon"]).alias("centre_lon"),
        rounded(near["x"], 4).alias("east_m"), rounded(near["y"], 4).alias("north_m"), geo.grid_cell(lon, lat, box, 6).alias("cell"),
    )


@query(
    f"""SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM
    (SELECT unnest(range(CAST(floor((90.326774E0 + 180) / 360 * 131072E0) AS BIGINT), CAST(floor((90.499678E0 + 180) / 360 * 131072E0) AS BIGINT) + 1)) AS x),
    (SELECT unnest(range(CAST(floor({_TY.format(lat="23.902086E0")}) AS BIGINT), CAST(floor({_TY.format(lat="23.711736E0")}) AS BIGINT) + 1)) AS y)"""
)
def expected_tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.tiles import expected_tiles

    return expected_tiles(spark, A.BOX, 17)


@query(
    f"""SELECT e.edge_id, round({hav("a.lon", "a.lat", "b.lon", "b.lat")}, 4) AS metres,
    round(((degrees(atan2((b.lon - a.lon) * cos(radians(a.lat)), b.lat - a.lat)) + 360) % 360), 4) AS bearing,
    CASE CAST(floor((((degrees(atan2((b.lon - a.lon) * cos(radians(a.lat)), b.lat - a.lat)) + 360) % 360) + 22.5) / 45) AS INTEGER) % 8
      WHEN 0 THEN 'north' WHEN 1 THEN 'north-east' WHEN 2 THEN 'east' WHEN 3 THEN 'south-east' WHEN 4 THEN 'south'
      WHEN 5 THEN 'south-west' WHEN 6 THEN 'west' ELSE 'north-west' END AS heading
    FROM edges e JOIN nodes a ON e.u = a.node_id JOIN nodes b ON e.v = b.node_id""",
    ("nodes", "edges"),
)
def haversine_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = A.nodes(spark, sf_dir)
    a = ends.select(F.col("node_id").alias("u"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"))
    b = ends.select(F.col("node_id").alias("v"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    four = [F.col(c) for c in ("lon1", "lat1", "lon2", "lat2")]
    line = F.array(F.struct(four[0].alias("lon"), four[1].alias("lat")), F.struct(four[2].alias("lon"), four[3].alias("lat")))
    return A.edges(spark, sf_dir).join(a, "u").join(b, "v").select(
        "edge_id", rounded(geo.polyline_length_m(line), 4).alias("metres"), rounded(geo.bearing(*four), 4).alias("bearing"), geo.compass(*four).alias("heading")
    )


@query(
    "SELECT * FROM (VALUES "
    + ", ".join(f"({i}, '{n}', {c}, {s}, {k})" for i, (n, c, s, k) in enumerate(traffic.ROAD_CLASSES))
    + ") AS t(class_rank, highway, cap_per_lane, speed, lanes)"
)
def class_rank_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.road_classes(spark)


@query(
    """SELECT highway, count(*) AS roads, CAST(min(class_rank) AS INTEGER) AS class_rank, round(avg(capacity_vph), 4) AS capacity,
    round(sum(free_flow_s), 4) AS free_flow_s, round(avg(CASE WHEN oneway THEN 1.0 ELSE 0.0 END), 6) AS oneway_share FROM edges GROUP BY highway""",
    ("edges",),
)
def road_class_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.edges(spark, sf_dir).withColumns({
        "rank": traffic.class_rank(F.concat("highway", F.lit("_link"))),
        "cap": traffic.capacity_of(F.col("highway"), traffic.class_value(F.col("highway"), 3)),
        "free": traffic.free_flow_s(F.col("length_m"), traffic.class_value(F.col("highway"), 2)),
    })
    return e.groupBy("highway").agg(
        F.count("*").alias("roads"), F.min("rank").alias("class_rank"), rounded(F.avg("cap"), 4).alias("capacity"),
        rounded(F.sum("free"), 4).alias("free_flow_s"), rounded(F.avg(F.col("oneway").cast("int"))).alias("oneway_share"),
    )


_ALPHA = "(3E0 / power(1.05E0, 4))"
_DELAY = f"(1 + {_ALPHA} * power(least({{vc}}, 2E0), 4))"


@query(
    f"""SELECT e.highway, count(*) AS roads, round(avg({_DELAY.format(vc="l.vc")}), 6) AS delay,
    round(sum(l.vc * e.capacity_vph * e.free_flow_s * {_DELAY.format(vc="l.vc")}) / 3600, 4) AS vehicle_hours,
    round(avg(CASE WHEN l.vc > 1 THEN 1.0 ELSE 0.0 END), 6) AS over_capacity
    FROM edges e LEFT JOIN today t USING (edge_id),
    LATERAL (SELECT CASE coalesce(t.level, 0) WHEN 0 THEN 0.25E0 WHEN 1 THEN 0.55E0 WHEN 2 THEN 0.85E0 ELSE 1.05E0 END AS vc) l
    GROUP BY e.highway""",
    ("edges", "today"),
)
def bpr_delay_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delay, vehicle-hours and share over capacity per road class, from today's levels."""
    vc = traffic.level_load(F.coalesce("level", F.lit(0)))
    load = F.col("vc") * F.col("capacity_vph")
    return (
        A.edges(spark, sf_dir).join(A.today(spark, sf_dir), "edge_id", "left").withColumn("vc", vc)
        .groupBy("highway")
        .agg(
            F.count("*").alias("roads"), rounded(F.avg(traffic.delay_factor(F.col("vc")))).alias("delay"),
            rounded(F.sum(load * traffic.bpr_time(F.col("free_flow_s"), load, F.col("capacity_vph"))) / 3600, 4).alias("vehicle_hours"),
            rounded(F.avg((F.col("vc") > 1).cast("int"))).alias("over_capacity"),
        )
    )


def _lin(x: str, xs: tuple, ys: tuple) -> str:
    out = f"{float(ys[-1])}E0"
    for i in range(len(xs) - 1, 0, -1):
        out = f"CASE WHEN {x} < {xs[i]} THEN ({x} - {xs[i - 1]}) * ({ys[i] - ys[i - 1]}E0 / {xs[i] - xs[i - 1]}E0) + {ys[i - 1]}E0 ELSE {out} END"
    return f"(CASE WHEN {x} <= {xs[0]} THEN {float(ys[0])}E0 ELSE {out} END)"


_RUNGS = (25, 55, 85, 105)


@query(
    f"""SELECT weight, CASE WHEN weight <= 40 THEN 1 WHEN weight <= 70 THEN 2 WHEN weight <= 95 THEN 3 ELSE 4 END AS cls,
    CASE WHEN weight < 40 THEN 0 WHEN weight < 70 THEN 1 WHEN weight < 95 THEN 2 ELSE 3 END AS level,
    CASE WHEN weight <= 40 THEN 25E0 WHEN weight <= 70 THEN 55E0 WHEN weight <= 95 THEN 85E0 ELSE 105E0 END AS snapped,
    round({_lin("weight", _RUNGS, (25, 25, 55, 85))}, 6) AS demoted, weight / 100 AS vc,
    round(60 * {_DELAY.format(vc="weight / 100")}, 6) AS travel_s,
    CASE WHEN weight / 100 < 0.4 THEN 0 WHEN weight / 100 < 0.7 THEN 1 WHEN weight / 100 < 0.95 THEN 2 ELSE 3 END AS load_level,
    round(1 + 2.5E0 / power(1.2E0, 4) * power({_lin("weight", _RUNGS, (20, 50, 90, 120))} / 100, 4), 6) AS user_delay,
    CASE WHEN weight <= 25 THEN '#16e098' WHEN weight <= 55 THEN '#ffcf43' WHEN weight <= 85 THEN '#d1352b' ELSE '#a92727' END AS ramp
    FROM weights""",
    ("weights",),
)
def ladder_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("weight")
    return A.weights(spark, sf_dir).select(
        "weight", traffic.to_class(w).alias("cls"), traffic.level_of_weight(w).alias("level"), traffic.snap(w).alias("snapped"),
        rounded(traffic.demote(w)).alias("demoted"), traffic.vc_ratio(w).alias("vc"), rounded(traffic.travel_time_s(F.lit(60.0), w)).alias("travel_s"),
        traffic.load_level(w / 100).alias("load_level"), rounded(traffic.user_delay(w, (20.0, 50.0, 90.0, 120.0), 3.5)).alias("user_delay"),
        traffic.ramp_colour(w).alias("ramp"),
    )


def _channel(k: int) -> str:
    return f"CAST(round_even({_lin('weight', _RUNGS, tuple(c[k] for c in traffic.RAMP))}, 0) AS INTEGER)"


@query("SELECT weight, format('#{:02x}{:02x}{:02x}', " + ", ".join(_channel(k) for k in range(3)) + ") AS hex FROM weights", ("weights",))
def hex_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.weights(spark, sf_dir).select("weight", traffic.to_hex(F.col("weight")).alias("hex"))


@query(
    """SELECT CAST(count(*) AS BIGINT) AS n, round(avg(w), 1) AS mean, round(median(w), 1) AS median_w,
    count(*) FILTER (w < 40) AS green, count(*) FILTER (w >= 40 AND w < 70) AS yellow, count(*) FILTER (w >= 70 AND w < 95) AS red, count(*) FILTER (w >= 95) AS darkred
    FROM (SELECT CAST(20 + o_orderkey % 91 AS DOUBLE) AS w FROM orders)"""
)
def weight_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.aggregates import weight_summary as summary

    return summary(spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("CAST(20 + o_orderkey % 91 AS DOUBLE) AS weight"))


_REFS = "(VALUES " + ", ".join(f"({k}, {c}, {r}, {g}, {b})" for k, (c, (r, g, b)) in enumerate(palette.PALETTE)) + ") AS ref(k, cls, rr, rg, rb)"
_SHARE = "(CASE WHEN 255 - {v} > 8 THEN (255 - {p}) * (1 / (255 - {v})::DOUBLE) END)"
_T = [_SHARE.format(v=v, p=p) for v, p in (("rr", "r"), ("rg", "g"), ("rb", "b"))]
_PIXEL_CLASSES = f"""
, keyed AS (SELECT row_number() OVER () AS i, * FROM pixels),
fits AS (
  SELECT i, r, g, b, a, k, cls, (r - rr) * (r - rr) + (g - rg) * (g - rg) + (b - rb) * (b - rb) AS d2,
    list_sum(list_filter([{", ".join(_T)}], lambda t: t IS NOT NULL)) * (1 / len(list_filter([{", ".join(_T)}], lambda t: t IS NOT NULL))::DOUBLE) AS mean, list_filter([{", ".join(_T)}], lambda t: t IS NOT NULL) AS ts
  FROM keyed, {_REFS}
), scored AS (
  SELECT *, CASE WHEN list_max(list_transform(ts, lambda t: abs(t - mean))) < 0.08 AND mean >= 0 AND mean <= 1 THEN mean ELSE 0 END AS t FROM fits
), best AS (
  SELECT i, any_value(r) AS r, any_value(g) AS g, any_value(b) AS b, any_value(a) AS a, min(d2) AS d2, arg_min(cls, d2 * 100 + k) AS near,
    max(t) AS t, first(cls ORDER BY t DESC, k) AS mixed FROM scored GROUP BY i
)"""


@query(
    _PIXEL_CLASSES
    + """ SELECT CAST(CASE WHEN a <= 128 THEN 0 WHEN d2 < 2500 THEN near WHEN t >= 0.4 THEN mixed ELSE 0 END AS INTEGER) AS decoder,
    CAST(CASE WHEN a <= 128 THEN 0 WHEN d2 <= 2500 THEN near WHEN t >= 0.4 THEN mixed ELSE 0 END AS INTEGER) AS collector,
    CAST(CASE WHEN a <= 128 THEN 0 WHEN d2 < 2500 THEN near WHEN t >= 0.15 THEN mixed ELSE 0 END AS INTEGER) AS clean, count(*) AS n
    FROM best GROUP BY 1, 2, 3""",
    ("pixels",),
)
def pixel_nearest_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = palette.class_of_match
    counts = palette.encoded(A.pixels(spark, sf_dir)).groupBy("_near", "_mix", (F.col("a") > 128).alias("opaque")).agg(F.count("*").alias("n"))
    found = palette.decoded(counts).withColumn("a", F.when(F.col("opaque"), 255).otherwise(0))
    return found.groupBy(c().alias("decoder"), c(closed=True).alias("collector"), c(casing=palette.CASING_CLEAN).alias("clean")).agg(F.sum("n").alias("n"))


@query(
    _PIXEL_CLASSES + " SELECT CAST(mixed AS INTEGER) AS cls, round(t, 3) AS t, count(*) AS n FROM best WHERE d2 >= 2500 AND t > 0 GROUP BY 1, 2",
    ("pixels",),
)
def casing_blend_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = palette.encoded(A.pixels(spark, sf_dir)).groupBy("_near", "_mix").agg(F.count("*").alias("n"))
    # a filter would be pushed below the counts and repeat the match there
    mixes = F.when((F.col("d2") >= 2500) & (F.col("t") > 0), F.col("n"))
    return palette.decoded(counts).groupBy(F.col("mixed").alias("cls"), rounded("t", 3).alias("t")).agg(F.sum(mixes).alias("n")).where("n IS NOT NULL")


@query(
    """SELECT r // 8 * 8 + 4 AS r, g // 8 * 8 + 4 AS g, b // 8 * 8 + 4 AS b, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
    FROM pixels WHERE a > 200 AND greatest(r, g, b) - least(r, g, b) > 40 GROUP BY 1, 2, 3 ORDER BY n DESC, 1, 2, 3 LIMIT 12""",
    ("pixels",),
)
def dominant_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.tiles import dominant_colours as top

    return top(A.pixels(spark, sf_dir), 12).select(*[F.col(c).cast("bigint").alias(c) for c in "rgb"], "n", rounded("share").alias("share"))


_LOCAL = "(ts + INTERVAL 6 HOUR)"


@query(
    f"""SELECT DISTINCT ts, CAST(hour({_LOCAL}) * 60 + minute({_LOCAL}) AS INTEGER) AS minute_of_day, CAST(isodow({_LOCAL}) - 1 AS INTEGER) AS weekday,
    isodow({_LOCAL}) IN (5, 6) AS weekend, strftime(ts, 'dhaka-%Y-%m-%dT%H%MZ') AS name, strftime({_LOCAL}, '%A %I:%M %p') AS label,
    strftime({_LOCAL}, '%a %-d %b') AS day, date_trunc('day', {_LOCAL}) - INTERVAL 6 HOUR AS day_start,
    round(sin(2 * pi() * (hour({_LOCAL}) * 60 + minute({_LOCAL})) / 1440), 6) + 0 AS sin_t, round(cos(2 * pi() * (hour({_LOCAL}) * 60 + minute({_LOCAL})) / 1440), 6) + 0 AS cos_t,
    CASE WHEN hour({_LOCAL}) % 12 = 0 THEN 12 ELSE hour({_LOCAL}) % 12 END || CASE WHEN hour({_LOCAL}) < 12 THEN ' am' ELSE ' pm' END AS hour_label
    FROM readings""",
    ("readings",),
)
def minute_weekend_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    f = clock.time_features(clock.minute_of_day(ts), clock.weekend(ts))
    return A.readings(spark, sf_dir).select("ts").distinct().select(
        "ts", clock.minute_of_day(ts).alias("minute_of_day"), clock.weekday(ts).alias("weekday"), clock.weekend(ts).alias("weekend"),
        clock.capture_name(ts).alias("name"), clock.time_label(ts).alias("label"), clock.day_label(ts).alias("day"), clock.day_start(ts).alias("day_start"),
        (rounded(f[0]) + 0).alias("sin_t"), (rounded(f[1]) + 0).alias("cos_t"), clock.hour_label(F.hour(clock.local(ts))).alias("hour_label"),
    )


@query("SELECT strftime(ts, 'dhaka-%Y-%m-%dT%H%MZ') AS name, ts FROM (SELECT DISTINCT ts FROM readings)", ("readings",))
def capture_name_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = A.readings(spark, sf_dir).select(clock.capture_name(F.col("ts")).alias("name")).distinct()
    return names.select("name", clock.capture_time(F.col("name")).alias("ts"))


@query(
    """SELECT CAST(d AS INTEGER) AS hops, CAST(p AS INTEGER) AS per_rung, CAST(CASE WHEN d <= 1 THEN 0 ELSE ceil((d - 1) / p) END AS INTEGER) AS lost
    FROM range(0, 12) a(d), range(1, 4) b(p)"""
)
def rungs_lost_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.range(12).select(F.col("id").cast("int").alias("hops"), F.explode(F.array(*[F.lit(p) for p in (1, 2, 3)])).alias("per_rung"))
    lost = F.lit(None)
    for p in (1, 2, 3):
        lost = F.when(F.col("per_rung") == p, traffic.rungs_lost(F.col("hops"), p)).otherwise(lost)
    return d.withColumn("lost", lost.cast("int"))
