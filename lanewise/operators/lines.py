"""What a viewer draws: lines with their levels, tables completed from the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import traffic
from .graph import pair_key


def complete_table(edges: DataFrame, observed: DataFrame, found: DataFrame) -> DataFrame:
    """Every edge of the graph with its observed or predicted weight.

    ``observed(edge_id, weight)`` stays as it is; ``found`` is a spread."""
    names = F.array(F.lit("observed"), F.lit("adjacent"), F.lit("spread"), F.lit("assumed_clear"))
    return (
        edges.select("edge_id").join(observed.select("edge_id", F.col("weight").alias("seen")), "edge_id", "left").join(found, "edge_id", "left")
        .select(
            "edge_id", F.coalesce("seen", "weight", F.lit(traffic.LADDER[0])).alias("weight"),
            F.when(F.col("seen").isNotNull(), "observed").otherwise("predicted").alias("source"),
            F.element_at(names, F.when(F.col("seen").isNotNull(), 0).otherwise(F.coalesce("method", F.lit(3))) + 1).alias("method"),
            F.coalesce("hops", F.lit(-1)).alias("hops"),
        )
    )


def drifted(before: DataFrame, after: DataFrame) -> DataFrame:
    """Observed weights that differ afterwards; empty if all is well."""
    return before.join(after.select("edge_id", F.col("weight").alias("now")), "edge_id", "left").where(~F.col("weight").eqNullSafe(F.col("now")))


def lines_best(edges: DataFrame, table: DataFrame) -> DataFrame:
    """One row per street: the heavier direction, observed before predicted, the
    first edge on ties; ``code`` is the level, plus 4 if predicted."""
    order = F.struct((F.col("source") == "observed").cast("int"), F.col("weight"), -F.col("edge_id"))
    best = edges.join(table, "edge_id").groupBy(*pair_key()).agg(F.max_by(F.struct("edge_id", "weight", "source"), order).alias("x")).select("a", "b", "x.*")
    level = traffic.level_of_weight(F.col("weight"))
    return best.withColumn("code", level + F.when(F.col("source") == "observed", 0).otherwise(4))


def packed_codes(lines: DataFrame, bucket: int = 100_000) -> DataFrame:
    """Codes as digit strings in edge order, a string for every ``bucket`` ids."""
    return lines.groupBy(F.floor(F.col("edge_id") / bucket).alias("bucket")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("edge_id", F.col("code").cast("string").alias("c")))), lambda x: x["c"]), "").alias("codes")
    )


def unpacked_codes(strings: DataFrame) -> DataFrame:
    """``(key, pos, level)`` of digit strings ``(key, codes)``."""
    digits = F.transform(F.sequence(F.lit(1), F.length("codes")), lambda k: F.substr("codes", k, F.lit(1)))
    return strings.where(F.length("codes") > 0).select("key", F.posexplode(digits).alias("pos", "c")).select("key", "pos", F.col("c").cast("int").alias("level"))


def method_counts(table: DataFrame) -> DataFrame:
    return table.rollup("source", "method").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 4).alias("mean_weight"))


def features(edges: DataFrame, *props: str) -> DataFrame:
    """One GeoJSON feature per edge with a ``geometry`` array of points."""
    line = F.struct(F.lit("LineString").alias("type"), F.transform("geometry", lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"))
    return edges.select("edge_id", F.to_json(F.struct(F.lit("Feature").alias("type"), line.alias("geometry"), F.struct("edge_id", *props).alias("properties"))).alias("feature"))


def side_streets(edges: DataFrame, levels: DataFrame, top: int) -> DataFrame:
    """The busiest streets of small classes with one edge each way."""
    small = edges.where(F.col("highway").isin("tertiary", "unclassified", "residential", "living_street"))
    load = traffic.actual_load(F.coalesce("level", F.lit(0)), F.col("capacity_vph"))
    pairs = small.join(levels, "edge_id", "left").groupBy(*pair_key()).agg(
        F.count("*").alias("n"), F.count_if(F.col("u") < F.col("v")).alias("there"), F.sum(load).alias("load"), F.min("edge_id").alias("edge_id")
    )
    return pairs.where("n = 2 AND there = 1").orderBy(F.desc("load"), "a", "b").limit(top).select("a", "b", "edge_id", "load")


def numbered_names(options: DataFrame) -> DataFrame:
    """'(block n)' after names that occur more than once."""
    w = Window.partitionBy("name")
    n = F.row_number().over(w.orderBy("key"))
    return options.withColumn("name", F.when(F.count("*").over(w) > 1, F.concat("name", F.lit(" (block "), n.cast("string"), F.lit(")"))).otherwise(F.col("name")))


def reveal_rank(distances: DataFrame, buckets: int = 1000) -> DataFrame:
    """Share of streets nearer than each one, by way of counts in buckets of
    distance, so no task sorts all streets."""
    top = distances.agg(F.max("cost").alias("top"))
    d = distances.join(F.broadcast(top)).withColumn("bucket", F.floor(F.col("cost") / F.greatest("top", F.lit(1e-9)) * buckets))
    sizes = d.groupBy("bucket").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("before", F.sum("n").over(Window.orderBy("bucket")) - F.col("n"))
    total = distances.agg(F.count("*").alias("total"))
    inside = F.rank().over(Window.partitionBy("bucket").orderBy("cost")) - 1
    return d.withColumn("inside", inside).join(F.broadcast(sizes.select("bucket", "before")), "bucket").join(F.broadcast(total)).select(
        "node", F.round((F.col("before") + F.col("inside")) / F.greatest(F.col("total") - 1, F.lit(1)), 3).alias("reveal")
    )
