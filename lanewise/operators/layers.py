"""Map layers, capture lists and small reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo, traffic


def coverage_bands(weights: DataFrame) -> DataFrame:
    """Observed edges by how much of them was coloured."""
    band = traffic.band(F.col("coverage"), (0.5, 0.75, 1.0), ("half", "most", "full", "full"))
    return weights.where("source = 'observed'").groupBy(band.alias("band")).agg(F.count("*").alias("edges"), F.round(F.avg("coverage"), 4).alias("mean_coverage"))


def zone_stats(members: DataFrame) -> DataFrame:
    """Members and mean weight per zone ``(zone, weight)``; the busiest first."""
    per = members.groupBy("zone").agg(F.count("*").alias("members"), F.round(F.avg("weight"), 4).alias("mean_weight"))
    return per.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean_weight"), "zone")))


def legend(spark: SparkSession, free_kmph: float = 50.0) -> DataFrame:
    """Weight, ratio, delay and effective speed of each rung."""
    rows = [(i, x) for i, x in enumerate(traffic.LADDER)]
    d = traffic.delay_factor(F.col("weight") / 100)
    return spark.createDataFrame(rows, "level int, weight double").select(
        "level", "weight", (F.col("weight") / 100).alias("vc"), F.round(d, 6).alias("delay"), F.round(free_kmph / d, 6).alias("kmph"), traffic.delay_colour(d).alias("colour")
    )


def upper_medians(values: DataFrame, by: list[str], order: str, value: str, newest: int = 12) -> DataFrame:
    """The upper median of the newest values of each group."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    top = values.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= newest)
    lists = top.groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("v"))  # ``newest`` values at most
    return lists.select(*by, F.element_at("v", (F.floor(F.size("v") / 2) + 1).cast("int")).alias("median"), F.size("v").alias("n"))


def named_streets(vertices: DataFrame, names: DataFrame, places: int = 7) -> DataFrame:
    """The most frequent name on each edge's vertices, the first seen on ties.

    ``vertices(edge_id, pos, lon, lat)`` meet ``names(lon, lat, name)`` on rounded
    coordinates, so it is an equi-join."""
    key = lambda: [F.round("lon", places).alias("kx"), F.round("lat", places).alias("ky")]
    both = vertices.select("edge_id", "pos", *key()).join(names.select("name", *key()).distinct(), ["kx", "ky"])
    counts = both.groupBy("edge_id", "name").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return counts.groupBy("edge_id").agg(F.max_by("name", F.struct("n", -F.col("first"), "name")).alias("name"))


def midpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Middle of each edge and its metres from the mean node."""
    a = nodes.select(F.col("node_id").alias("u"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"))
    b = nodes.select(F.col("node_id").alias("v"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    mean = nodes.agg(F.avg("lon").alias("lon0"), F.avg("lat").alias("lat0"))
    m = edges.join(a, "u").join(b, "v").join(F.broadcast(mean)).withColumns({"lon": (F.col("lon1") + F.col("lon2")) / 2, "lat": (F.col("lat1") + F.col("lat2")) / 2})
    at = geo.local_xy(F.col("lon"), F.col("lat"), F.col("lon0"), F.col("lat0"))
    return m.select("edge_id", "lon", "lat", at["x"].alias("x"), at["y"].alias("y"), "class_rank")


def processed_index(captures: DataFrame, tables: DataFrame) -> DataFrame:
    """Captures with a table of the current model, of an old one, or of none;
    ``tables(name, has_hops)``."""
    t = tables.groupBy("name").agg(F.bool_or("has_hops").alias("current"))
    state = F.when(F.col("current"), "processed").when(F.col("current").isNotNull(), "stale").otherwise("waiting")
    return captures.join(t, "name", "left").withColumn("state", state).drop("current")


def stepping(captures: DataFrame, order: str = "ts") -> DataFrame:
    """The capture before and after each one, round the ends."""
    w = Window.orderBy(order)  # one row per capture
    ends = captures.agg(F.min(order).alias("_a"), F.max(order).alias("_b"))
    return captures.join(F.broadcast(ends)).select(
        order, F.coalesce(F.lag(order).over(w), "_b").alias("previous"), F.coalesce(F.lead(order).over(w), "_a").alias("next")
    )


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Roads whose level differs at any step of two timelines, with how often."""
    both = a.join(b.withColumnRenamed("level", "other"), ["step", "edge_id"], "full_outer")
    apart = ~F.coalesce("level", F.lit(0)).eqNullSafe(F.coalesce("other", F.lit(0)))
    return both.groupBy("edge_id").agg(F.count_if(apart).alias("steps")).where("steps > 0")


def level_histogram(levels: DataFrame, by: list[str]) -> DataFrame:
    """Roads at each level, a column per level."""
    out = levels.groupBy(*by).pivot("level", [0, 1, 2, 3]).agg(F.count(F.lit(1)))
    return out.select(*by, *[F.coalesce(str(k), F.lit(0)).alias(n) for k, n in enumerate(("green", "yellow", "red", "darkred"))])


def saved_share(before: Column, all_at_once: Column, batched: Column) -> Column:
    """Share of the added delay that batching saves; null if nothing was added."""
    added = all_at_once - before
    return (all_at_once - batched) / F.when(added > 0, added)


def top_stretches(loads: DataFrame, top: int) -> DataFrame:
    """The roads most over capacity."""
    return loads.withColumn("vc", F.col("volume") / F.when(F.col("capacity_vph") > 0, F.col("capacity_vph"))).orderBy(F.desc_nulls_last("vc"), "edge_id").limit(top)
