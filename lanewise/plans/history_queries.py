"""Queries over captures and readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo
from ..materialise import scratch
from ..operators import history as H
from ..operators.aggregates import majority
from ..streaming.history_state import HistoryState
from . import adapters as A
from .registry import query, rounded

_L = "(ts + INTERVAL 6 HOUR)"
_CAPS = f""", caps AS (
  SELECT ts, CAST(hour({_L}) * 60 + minute({_L}) AS INTEGER) AS minute, CAST(isodow({_L}) - 1 AS INTEGER) AS weekday,
    isodow({_L}) IN (5, 6) AS weekend, CAST({_L} AS DATE) AS day
  FROM (SELECT DISTINCT ts FROM readings)
)"""
_SPLIT = """, split AS (
  SELECT CASE WHEN epoch(max(ts)) - epoch(min(ts)) >= 13 * 86400 THEN epoch(max(ts)) - 7 * 86400
    ELSE epoch(min(ts)) + (epoch(max(ts)) - epoch(min(ts))) * 0.7 END AS s FROM caps
), parted AS (
  SELECT caps.*, CASE WHEN epoch(ts) < s THEN 'train' WHEN (row_number() OVER (PARTITION BY epoch(ts) >= s ORDER BY ts) - 1) % 3 = 0 THEN 'test' ELSE 'skip' END AS part
  FROM caps, split
), train AS (SELECT * FROM parted WHERE part = 'train'), asked AS (SELECT * FROM parted WHERE part = 'test')"""
_KNN = """, pairs AS (
  SELECT a.ts AS asked, t.ts, round(
    power(sin(2 * pi() * a.minute / 1440) - sin(2 * pi() * t.minute / 1440), 2) + power(cos(2 * pi() * a.minute / 1440) - cos(2 * pi() * t.minute / 1440), 2)
    + power(3 * (a.weekend::INT - t.weekend::INT), 2), 9) AS d2 FROM asked a, train t
), near AS (SELECT asked, ts FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY d2, ts DESC) AS r FROM pairs) WHERE r <= 6),
votes AS (
  SELECT asked, edge_id, level, count(*) AS n FROM readings JOIN near USING (ts) GROUP BY asked, edge_id, level
  UNION ALL SELECT asked, edge_id, 0, (SELECT count(*) FROM near x WHERE x.asked = v.asked) - count(*) FROM (SELECT asked, edge_id FROM readings JOIN near USING (ts)) v GROUP BY asked, edge_id
), knn AS (
  SELECT asked, edge_id, level FROM (
    SELECT asked, edge_id, level, row_number() OVER (PARTITION BY asked, edge_id ORDER BY sum(n) DESC, level DESC) AS r
    FROM votes GROUP BY asked, edge_id, level) WHERE r = 1
)"""
_SAME = """, same AS (
  SELECT asked, ts, gap FROM (
    SELECT a.ts AS asked, t.ts, least(abs(a.minute - t.minute), 1440 - abs(a.minute - t.minute)) AS gap,
      row_number() OVER (PARTITION BY a.ts ORDER BY CASE WHEN a.weekday = t.weekday THEN 0 ELSE 1 END,
        least(abs(a.minute - t.minute), 1440 - abs(a.minute - t.minute)), t.ts DESC) AS r
    FROM asked a JOIN train t ON a.weekday = t.weekday OR a.weekend = t.weekend) WHERE r = 1
)"""


def _parts(spark: SparkSession, sf_dir: str):
    r = A.readings(spark, sf_dir)
    caps = H.with_split(H.captures_of(r))
    return r, caps.where("part = 'train'"), caps.where("part = 'test'")


@query(
    """SELECT edge_id, ts, CAST(min(folder) AS INTEGER) AS folder FROM (
      SELECT edge_id, ts, 0 AS folder FROM readings WHERE level >= 2 UNION ALL SELECT edge_id, ts, 1 FROM readings) GROUP BY 1, 2""",
    ("readings",),
)
def readings_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = A.readings(spark, sf_dir).select("edge_id", "ts", "level")
    return H.union_first([r.where("level >= 2").drop("level").withColumn("folder", F.lit(0)), r.drop("level").withColumn("folder", F.lit(1))], ["edge_id", "ts"])


_HOLES = ", kept AS (SELECT * FROM caps WHERE ts IN (SELECT ts FROM readings WHERE level = 3 AND painted = 0))"


def _thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures with holes: those in which a dark road isn't painted."""
    return H.captures_of(A.readings(spark, sf_dir).where("level = 3 AND painted = 0"))


@query(
    _CAPS + _HOLES + """ SELECT CAST(day AS VARCHAR) AS day, before, minute, minute - before AS gap FROM (
      SELECT *, lag(minute) OVER (PARTITION BY day ORDER BY minute) AS before FROM kept) WHERE minute - before > 60""",
    ("readings",),
)
def gap_over_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.gaps(_thinned(spark, sf_dir), 60).withColumn("day", F.col("day").cast("string"))


@query(
    _CAPS + _HOLES + """ SELECT CAST(day AS VARCHAR) AS day, coalesce(max(gap), 0) AS longest, count(*) AS captures FROM (
      SELECT day, minute - lag(minute) OVER (PARTITION BY day ORDER BY minute) AS gap FROM kept) GROUP BY day""",
    ("readings",),
)
def longest_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.longest_gap(_thinned(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


@query(
    _CAPS + _HOLES + """, span AS (SELECT min(date_trunc('day', ts + INTERVAL 6 HOUR)) - INTERVAL 6 HOUR AS a, max(date_trunc('day', ts + INTERVAL 6 HOUR)) + INTERVAL 18 HOUR AS b FROM kept)
    SELECT ts, round((epoch(ts) - epoch(a)) / (epoch(b) - epoch(a)), 9) AS position, coalesce(epoch(ts) - epoch(lag(ts) OVER (ORDER BY ts)) > 5400, false) AS gap_before FROM kept, span""",
    ("readings",),
)
def timeline_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.timeline(_thinned(spark, sf_dir), 90).withColumn("position", rounded("position", 9))


@query(
    _CAPS + _HOLES + """ SELECT count(*) AS captures, min(ts) AS first, max(ts) AS last FROM (
      SELECT ts, sum(new) OVER (ORDER BY ts) AS s FROM (SELECT ts, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) < INTERVAL 90 MINUTE THEN 0 ELSE 1 END AS new FROM kept)) GROUP BY s""",
    ("readings",),
)
def capture_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.sessions(_thinned(spark, sf_dir), 90)


_PROFILE = (
    _CAPS + """, sums AS (SELECT r.edge_id, c.weekend, c.minute // 60 AS hour, sum(r.level) AS s FROM readings r JOIN caps c USING (ts) GROUP BY GROUPING SETS ((1), (1, 2, 3))),
    sizes AS (SELECT weekend, minute // 60 AS hour, count(*) AS n FROM caps GROUP BY GROUPING SETS ((), (1, 2)))
    SELECT edge_id, CAST(s.weekend AS INTEGER) AS weekend, CAST(s.hour AS INTEGER) AS hour, n, round(s / n, 6) AS mean_level
    FROM sums s JOIN sizes z ON s.weekend IS NOT DISTINCT FROM z.weekend AND s.hour IS NOT DISTINCT FROM z.hour"""
)


@query(_PROFILE, ("readings",))
def hour_profile_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = A.readings(spark, sf_dir)
    return H.hour_profile(r, H.captures_of(r)).withColumns({"mean_level": rounded("mean_level"), "weekend": F.col("weekend").cast("int")})


@query(_PROFILE, ("readings",))
def hour_profile_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same profile from kept sums: three batches of captures, one of them twice."""
    r = A.readings(spark, sf_dir)
    state = HistoryState(spark, scratch(spark))
    for number in (0, 1, 1, 2):
        state.fold(r.where(F.pmod(F.dayofyear("ts"), F.lit(3)) == number), number)
        if number == 1:
            state.compact()
    return state.profile().withColumns({"mean_level": rounded("mean_level"), "weekend": F.col("weekend").cast("int")})


@query(_CAPS + _SPLIT + _SAME + " SELECT asked, ts, CAST(gap AS INTEGER) AS gap FROM same", ("readings",))
def as_of_same_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest earlier capture of the time of day, from one sorted stream."""
    _, train, asked = _parts(spark, sf_dir)
    return H.as_of_captures(train, asked).withColumn("gap", F.col("gap").cast("int"))


@query(_CAPS + _SPLIT + " SELECT part, count(*) AS captures, min(ts) AS first, max(ts) AS last FROM parted GROUP BY part", ("readings",))
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    caps = H.with_split(H.captures_of(A.readings(spark, sf_dir)))
    return caps.groupBy("part").agg(F.count("*").alias("captures"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query(_CAPS + _SPLIT + _SAME + " SELECT asked, ts, CAST(gap AS INTEGER) AS gap FROM same", ("readings",))
def same_time_last_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, train, asked = _parts(spark, sf_dir)
    return H.same_time_captures(train, asked)


@query(_CAPS + _SPLIT + _KNN + " SELECT asked, edge_id, CAST(level AS INTEGER) AS level FROM knn", ("readings",))
def knn_time_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, train, asked = _parts(spark, sf_dir)
    return H.knn_forecast(r, train, asked)


@query(
    _CAPS + _SPLIT + _KNN + _SAME + """, truth AS (SELECT r.ts AS asked, r.edge_id, r.level AS truth FROM readings r JOIN asked a ON r.ts = a.ts WHERE painted = 1),
    guesses AS (
      SELECT 'clear' AS model, asked, truth, 0 AS guess FROM truth
      UNION ALL SELECT 'knn', t.asked, truth, coalesce(k.level, 0) FROM truth t LEFT JOIN knn k ON t.asked = k.asked AND t.edge_id = k.edge_id
      UNION ALL SELECT 'same time', t.asked, truth, coalesce(r.level, 0) FROM truth t JOIN same s ON t.asked = s.asked LEFT JOIN readings r ON r.ts = s.ts AND r.edge_id = t.edge_id
    ) SELECT model, CAST(h AS INTEGER) AS hour, count(*) AS counted, round(avg(CASE WHEN guess = truth THEN 1.0 ELSE 0.0 END), 4) AS right_level,
      round(avg(CASE WHEN guess < truth THEN 1.0 ELSE 0.0 END), 4) AS too_green
      FROM (SELECT *, hour(asked + INTERVAL 6 HOUR) AS h FROM guesses) GROUP BY GROUPING SETS ((model), (model, h))""",
    ("readings",),
)
def forecast_score_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, train, asked = _parts(spark, sf_dir)
    return H.score(r, {"clear": H.always_clear(r, asked), "knn": H.knn_forecast(r, train, asked), "same time": H.same_time_forecast(r, train, asked)})


@query(
    """SELECT road, CAST(level AS INTEGER) AS level, CAST(milder AS INTEGER) AS milder FROM (
      SELECT edge_id AS road, first(level ORDER BY n DESC, level DESC) AS level, first(level ORDER BY n DESC, level) AS milder
      FROM (SELECT edge_id, level, count(*) AS n FROM readings GROUP BY 1, 2) GROUP BY 1)""",
    ("readings",),
)
def edge_vote_tie_worse(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = A.readings(spark, sf_dir).withColumnRenamed("edge_id", "road")
    return majority(r, ["road"]).join(majority(r, ["road"], worse=False).withColumnRenamed("level", "milder"), "road")


_CELLS = """, cells AS (
  SELECT e.edge_id, CAST(least(greatest(trunc((n.lat - 23.711736E0) / 0.03807E0), 0), 4) * 5 + least(greatest(trunc((n.lon - 90.326774E0) / 0.0345808E0), 0), 4) AS INTEGER) AS cell
  FROM edges e JOIN nodes n ON e.u = n.node_id
), sizes AS (SELECT cell, count(*) AS roads FROM cells GROUP BY cell)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = {"west": 90.326774, "east": 90.326774 + 5 * 0.0345808, "south": 23.711736, "north": 23.711736 + 5 * 0.03807}
    n = A.nodes(spark, sf_dir).select(F.col("node_id").alias("u"), geo.grid_cell(F.col("lon"), F.col("lat"), box, 5).alias("cell"))
    return A.edges(spark, sf_dir).join(n, "u").select("edge_id", "cell")


@query(
    _CELLS + """, sums AS (SELECT ts, cell, sum(level) AS s FROM readings JOIN cells USING (edge_id) GROUP BY ts, cell)
    SELECT t.ts, CAST(k.cell AS INTEGER) AS cell, round(coalesce(s, 0) / greatest(coalesce(roads, 0), 1), 6) AS mean_level
    FROM (SELECT DISTINCT ts FROM readings) t CROSS JOIN range(25) k(cell) LEFT JOIN sums ON sums.ts = t.ts AND sums.cell = k.cell LEFT JOIN sizes ON sizes.cell = k.cell""",
    ("nodes", "edges", "readings"),
)
def scenario_cell_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.cell_features(A.readings(spark, sf_dir), _cells(spark, sf_dir), 25).withColumn("mean_level", rounded("mean_level"))


@query(None)
def traffic_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures in five groups by their pattern over the grid, described and named."""
    return H.scenarios(A.readings(spark, sf_dir), _cells(spark, sf_dir), 25)[0]


_GROUPS = """, groups AS (SELECT ts, weekday AS grp FROM caps), lv AS (SELECT ts, avg(level) AS m FROM readings GROUP BY ts),
per AS (SELECT c.*, g.grp, lv.m, CAST(c.minute // 60 AS INTEGER) AS hour FROM caps c JOIN groups g USING (ts) JOIN lv USING (ts)),
hrs AS (SELECT grp, hour, count(*) AS n, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, hour) AS r FROM per GROUP BY grp, hour)"""


@query(
    _CAPS + _GROUPS + """, facts AS (SELECT grp, count(*) AS captures, avg(m) AS m, avg(weekend::INT) AS w FROM per GROUP BY grp)
    SELECT f.grp AS "group", f.captures, round(f.captures / (SELECT count(*) FROM caps), 3) AS share, round(f.m, 4) AS mean_level, round(f.w, 4) AS weekend_share,
      (SELECT string_agg(hour::VARCHAR, ',' ORDER BY r) FROM hrs WHERE hrs.grp = f.grp AND r <= 3) AS top_hours,
      (SELECT string_agg(coalesce(n, 0)::VARCHAR, ',' ORDER BY h) FROM range(24) t(h) LEFT JOIN hrs ON hrs.hour = h AND hrs.grp = f.grp) AS histogram,
      CAST(row_number() OVER (ORDER BY round(f.m, 4), f.grp) AS INTEGER) AS rank FROM facts f""",
    ("readings",),
)
def scenario_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = A.readings(spark, sf_dir)
    caps = H.captures_of(r)
    groups = caps.select("ts", F.col("weekday").alias("group"))
    return H.scenario_profile(caps, groups, r.groupBy("ts").agg(F.avg("level").alias("mean_level")))


@query(_CAPS + _GROUPS + ' SELECT grp AS "group", hour, n, CAST(r AS INTEGER) AS place FROM hrs WHERE r <= 3', ("readings",))
def top_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    caps = H.captures_of(A.readings(spark, sf_dir))
    counts = caps.groupBy(F.col("weekday").alias("group"), F.floor(F.col("minute") / 60).cast("int").alias("hour")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("group").orderBy(F.desc("n"), "hour")
    return counts.withColumn("place", F.row_number().over(w)).where("place <= 3")


@query(
    "SELECT ts, edge_id, level FROM (SELECT *, lag(level) OVER (PARTITION BY edge_id ORDER BY ts) AS b FROM readings) WHERE level IS DISTINCT FROM b",
    ("readings",),
)
def frame_code_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.changed(A.readings(spark, sf_dir).select("ts", "edge_id", "level"))


@query(
    """SELECT user_id, coalesce(max(run), 0) AS longest_streak FROM (
      SELECT user_id, i, count(*) FILTER (event_type = 'error') AS run FROM (
        SELECT user_id, event_type, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS i FROM events)
      GROUP BY user_id, i) GROUP BY user_id"""
)
def block_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", (F.col("event_type") == "error").alias("bad"))
    return H.longest_streak(log, ["user_id"], "event_id", "bad")


@query(
    _CAPS + """ SELECT CAST(day AS VARCHAR) AS day, count(DISTINCT ts) AS captures, round(avg(painted), 6) AS painted_share,
      CASE WHEN count(DISTINCT ts) < 18 THEN 'short' WHEN avg(painted) < 0.75 THEN 'sparse' ELSE 'ok' END AS health
      FROM readings JOIN caps USING (ts) GROUP BY day""",
    ("readings",),
)
def daily_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = A.readings(spark, sf_dir)
    share, n = F.avg("painted"), F.count_distinct("ts")
    return r.join(H.captures_of(r).select("ts", "day"), "ts").groupBy(F.col("day").cast("string").alias("day")).agg(
        n.alias("captures"), rounded(share).alias("painted_share"), F.when(n < 18, "short").when(share < 0.75, "sparse").otherwise("ok").alias("health")
    )
