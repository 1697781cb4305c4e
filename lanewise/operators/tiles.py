"""Tiles: the expected grid, coverage, audits, gaps and pixel statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo, palette


def expected_tiles(spark: SparkSession, box: dict, z: int) -> DataFrame:
    """All tiles ``(x, y)`` that a box touches: columns by rows, both exploded."""
    x0, x1, y0, y1 = geo.tile_range(box, z)
    return spark.range(x0, x1 + 1).select(F.col("id").alias("x"), F.explode(F.sequence(F.lit(y0).cast("bigint"), F.lit(y1).cast("bigint"))).alias("y"))


def missing_tiles(expected: DataFrame, received: DataFrame) -> DataFrame:
    return expected.join(received, ["x", "y"], "left_anti")


def coverage(expected: DataFrame, received: DataFrame) -> DataFrame:
    """Expected, received and missing counts and the percentage (100 of none)."""
    got = expected.join(received.select("x", "y").distinct().withColumn("got", F.lit(1)), ["x", "y"], "left")
    n, have = F.count("*"), F.count("got")
    return got.agg(
        n.alias("expected"), have.alias("received"), (n - have).alias("missing"),
        F.round(F.coalesce(have * 100.0 / F.when(n > 0, n), F.lit(100.0)), 2).alias("coverage_pct"),
    )


def gap_tiles(empty: DataFrame, traffic: DataFrame, least: int = 3) -> DataFrame:
    """Empty tiles of whose four neighbours at least ``least`` carry traffic."""
    sides = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    near = traffic.select("x", "y", F.explode(sides).alias("s")).select((F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"))
    return near.join(empty, ["x", "y"], "left_semi").groupBy("x", "y").agg(F.count("*").alias("neighbours")).where(F.col("neighbours") >= least)


def dominant_colours(pixels: DataFrame, top: int = 12) -> DataFrame:
    """The most frequent clearly coloured shades, with their share of all such."""
    four = [F.col(c) for c in "rgba"]
    counts = pixels.where(palette.coloured(*four, least_alpha=200)).groupBy(*[palette.quantise(F.col(c)).alias(c) for c in "rgb"]).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.orderBy(F.desc("n"), "r", "g", "b").limit(top).join(F.broadcast(total)).withColumn("share", F.col("n") / F.col("total")).drop("total")


def tile_statistics(pixels: DataFrame, by: list[str]) -> DataFrame:
    """Per tile: opaque share, traffic share, coloured pixels and the share of
    those that match the palette (1 of none)."""
    cls = palette.class_of_match(closed=True)
    col = palette.coloured(*[F.col(c) for c in "rgba"])
    n, c = F.count("*"), F.count_if(col)
    return palette.matched(pixels).groupBy(*by).agg(
        n.alias("pixels"), (F.count_if(F.col("a") > 128) / n).alias("opaque_frac"), (F.count_if(cls > 0) / n).alias("traffic_frac"),
        c.alias("coloured"), F.coalesce(F.count_if(col & (cls > 0)) / F.when(c > 0, c), F.lit(1.0)).alias("matched"),
    )


def palette_ok(coloured: Column, matched: Column, least: float = 0.8, least_px: int = 1000) -> Column:
    return (coloured < least_px) | (matched >= least)


def status(checks: dict[str, Column], critical: list[str]) -> Column:
    """'failed' if a critical check fails, 'partial' if coverage does, else 'ok'."""
    bad = F.lit(False)
    for name in critical:
        bad = bad | ~checks[name]
    return F.when(bad, "failed").when(~checks["coverage_full"], "partial").otherwise("ok")


def tile_verdict(content: Column, width: Column, height: Column, opaque: Column, tile_px: int = 256) -> Column:
    """Why a tile is refused, or 'ok'; width null means that it didn't decode."""
    return (
        F.when(F.length(content) < 67, "too_small")
        .when(F.substring(content, 1, 8) != F.unhex(F.lit("89504E470D0A1A0A")), "not_png")
        .when(~F.hex(content).contains("49454E44AE426082"), "truncated")
        .when(width.isNull(), "decode_error")
        .when((width != tile_px) | (height != tile_px), F.format_string("size_%dx%d", width, height))
        .when(opaque, "opaque")
        .otherwise("ok")
    )


def stride_sample(tiles: DataFrame, most: int = 200) -> DataFrame:
    """The corners and about ``most`` tiles at equal steps in order of place.

    Ranks are taken per column and offset by the columns before it, so no task
    holds all tiles."""
    total = tiles.count()
    every = max(1, total // most)
    columns = tiles.groupBy("x").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("x")) - F.col("n"))
    ranked = tiles.withColumn("in_column", F.row_number().over(Window.partitionBy("x").orderBy("y"))).join(columns, "x")
    edge = tiles.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    corner = F.col("x").isin(F.col("x0"), F.col("x1")) & F.col("y").isin(F.col("y0"), F.col("y1"))
    return ranked.join(F.broadcast(edge)).where(corner | ((F.col("before") + F.col("in_column") - 1) % every == 0)).select("x", "y")
