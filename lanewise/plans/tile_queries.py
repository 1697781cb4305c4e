"""Queries over tiles and decoded samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, palette
from ..operators import decode as X
from ..operators import tiles as T
from . import adapters as A
from .columns import _PIXEL_CLASSES, _TY
from .registry import query, rounded

_GRID = f""", expected AS (SELECT x, y FROM
  (SELECT unnest(range(CAST(floor((90.326774E0 + 180) / 360 * 131072E0) AS BIGINT), CAST(floor((90.499678E0 + 180) / 360 * 131072E0) AS BIGINT) + 1)) AS x),
  (SELECT unnest(range(CAST(floor({_TY.format(lat="23.902086E0")}) AS BIGINT), CAST(floor({_TY.format(lat="23.711736E0")}) AS BIGINT) + 1)) AS y)
), got AS (SELECT DISTINCT CAST(floor((lon + 180) / 360 * 131072E0) AS BIGINT) AS x, CAST(floor({_TY.format(lat="lat")}) AS BIGINT) AS y FROM nodes)"""


def _tiles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    at = A.nodes(spark, sf_dir).select(F.floor(geo.lon_to_tx(F.col("lon"), 17)).alias("x"), F.floor(geo.lat_to_ty(F.col("lat"), 17)).alias("y")).distinct()
    return T.expected_tiles(spark, A.BOX, 17), at


@query(
    _GRID + """ SELECT count(*) AS expected, count(g.x) AS received, count(*) - count(g.x) AS missing, round(count(g.x) * 100.0 / count(*), 2) AS coverage_pct
    FROM expected e LEFT JOIN got g ON e.x = g.x AND e.y = g.y""",
    ("nodes",),
)
def tile_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.coverage(*_tiles(spark, sf_dir))


@query(_GRID + " SELECT x, y FROM expected EXCEPT SELECT x, y FROM got", ("nodes",))
def missing_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.missing_tiles(*_tiles(spark, sf_dir))


@query(
    _GRID + """, gap AS (SELECT x, y FROM expected EXCEPT SELECT x, y FROM got)
    SELECT e.x, e.y, count(*) AS neighbours FROM gap e JOIN got g ON abs(e.x - g.x) + abs(e.y - g.y) = 1 GROUP BY 1, 2 HAVING count(*) >= 3""",
    ("nodes",),
)
def gap_fill_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected, got = _tiles(spark, sf_dir)
    return T.gap_tiles(T.missing_tiles(expected, got), got)


@query(
    _PIXEL_CLASSES.replace("row_number() OVER () AS i, * FROM pixels", "row_number() OVER () AS i, * FROM tiled").replace(", keyed AS", """, tiled AS (
      SELECT l_suppkey AS tile, (l_orderkey * 37 + l_partkey * 11) % 256 AS r, (l_partkey * 53 + l_suppkey * 7) % 256 AS g, (l_orderkey * 5 + l_suppkey * 91) % 256 AS b,
        (l_orderkey + l_linenumber) % 256 AS a FROM lineitem), keyed AS""")
    + """, told AS (SELECT k.tile, b.*, CASE WHEN b.a <= 128 THEN 0 WHEN d2 <= 2500 THEN near WHEN t >= 0.4 THEN mixed ELSE 0 END AS cls,
        b.a > 128 AND greatest(b.r, b.g, b.b) - least(b.r, b.g, b.b) > 40 AS coloured FROM best b JOIN keyed k USING (i))
    SELECT tile, count(*) AS pixels, round(avg((a > 128)::INT), 6) AS opaque_frac, round(avg((cls > 0)::INT), 6) AS traffic_frac, count(*) FILTER (coloured) AS coloured,
      round(coalesce(avg((cls > 0)::INT) FILTER (coloured), 1), 6) AS matched FROM told GROUP BY tile""",
    ("pixels",),
)
def tile_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_suppkey AS tile", *A.PIXEL)
    s = T.tile_statistics(px, ["tile"])
    return s.withColumns({c: rounded(c) for c in ("opaque_frac", "traffic_frac", "matched")})


@query(
    """WITH seen AS (SELECT l_orderkey AS edge_id, CAST(l_quantity AS BIGINT) % 5 AS cls FROM lineitem),
    per AS (SELECT edge_id, CAST(count(*) AS INTEGER) AS n, count(*) FILTER (cls > 0) AS s, count(*) FILTER (cls = 1) AS c1, count(*) FILTER (cls = 2) AS c2, count(*) FILTER (cls = 3) AS c3, count(*) FILTER (cls = 4) AS c4 FROM seen GROUP BY 1),
    top AS (SELECT *, CASE WHEN s > 0 AND s / n >= 0.25 THEN CASE greatest(c1, c2, c3, c4) WHEN c4 THEN 4 WHEN c3 THEN 3 WHEN c2 THEN 2 ELSE 1 END ELSE 0 END AS cls FROM per)
    SELECT edge_id, cls, CASE cls WHEN 1 THEN 25E0 WHEN 2 THEN 55E0 WHEN 3 THEN 85E0 WHEN 4 THEN 105E0 ELSE 0E0 END AS weight, round(c1 / n, 4) AS f_green, round(c2 / n, 4) AS f_orange,
      round(c3 / n, 4) AS f_red, round(c4 / n, 4) AS f_darkred, round(s / n, 4) AS coverage, n AS n_samples, CASE WHEN cls > 0 THEN 'observed' ELSE 'none' END AS source FROM top"""
)
def coverage_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decoder's vote and coverage rule over one sample per line item."""
    seen = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey AS edge_id", "CAST(l_quantity AS BIGINT) % 5 AS cls")
    return X.edge_votes(seen).drop("vc_ratio")


@query(
    """SELECT tile, CASE WHEN n < 67 THEN 'too_small' WHEN opaque THEN 'opaque' ELSE 'ok' END AS verdict FROM (
      SELECT l_suppkey AS tile, count(*) AS n, min((l_orderkey + l_linenumber) % 256) > 128 AS opaque FROM lineitem GROUP BY 1)"""
)
def tile_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refusals of tiles by size and opacity; the bytes are a header padded to the tile's pixel count."""
    px = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_suppkey AS tile", *A.PIXEL).groupBy("tile").agg(F.count("*").alias("n"), (F.min("a") > 128).alias("opaque"))
    head, end = F.unhex(F.lit("89504E470D0A1A0A")), F.unhex(F.lit("49454E44AE426082"))
    body = F.repeat(F.lit("x"), F.greatest(F.col("n") - 16, F.lit(0)).cast("int")).cast("binary")
    side = F.lit(256)
    return px.select("tile", T.tile_verdict(F.concat(head, body, end), side, side, F.col("opaque")).alias("verdict"))


@query(
    _PIXEL_CLASSES + " SELECT CAST(d2 // 500 * 500 AS BIGINT) AS d2, CAST(near AS INTEGER) AS near, count(*) AS n FROM best GROUP BY 1, 2",
    ("pixels",),
)
def pixel_reference_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far pixels lie from the palette, in steps of 500."""
    return palette.matched(A.pixels(spark, sf_dir)).groupBy((F.floor(F.col("d2") / 500) * 500).alias("d2"), "near").agg(F.count("*").alias("n"))
