"""Quantiles from mergeable sketches, kept per day and put together for any range.

An exact median holds every value of its group in one task. A KLL sketch holds a few
thousand, adds up with others in any order, and its ranks are off by a bounded share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size of a sketch: with 1,000 a rank is off by 0.3 % of the rows or less, 99 times in 100.
SIZE = 1000


def sketch(values: DataFrame, by: list[str], value: str = "weight", size: int = SIZE) -> DataFrame:
    """``(*by, n, low, high, total, sketch)`` of a column; nulls are left out."""
    v = F.col(value).cast("double")
    rows = values.where(v.isNotNull())
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.sum(v).alias("total"), F.kll_sketch_agg_double(v, F.lit(size)).alias("sketch")
    )


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches put together over everything but ``by``."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"), F.kll_merge_agg_double("sketch").alias("sketch")
    )


def quantiles(sketches: DataFrame, ranks: list[float]) -> DataFrame:
    """A row for each sketch and rank: its columns without the sketch, ``rank`` and the
    ``value`` up to which that share of the rows lies."""
    keys = [c for c in sketches.columns if c != "sketch"]
    at = lambda r: F.struct(F.lit(float(r)).alias("rank"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(r))).alias("value"))
    return sketches.select(*keys, F.explode(F.array(*[at(r) for r in ranks])).alias("x")).select(*keys, "x.*")


def keep_by_day(sketches: DataFrame, path: str) -> None:
    """Write sketches that have a ``day``; a day that is written again is replaced,
    others stay."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def over_days(spark: SparkSession, path: str, first: str | None, last: str | None, by: list[str]) -> DataFrame:
    """The kept sketches of a range of days, both ends included, put together; only
    those days' files are read."""
    kept = spark.read.parquet(path)
    day = F.col("day").cast("date")
    if first:
        kept = kept.where(day >= F.lit(first).cast("date"))
    if last:
        kept = kept.where(day <= F.lit(last).cast("date"))
    return merged(kept, by)


def rank_errors(found: DataFrame, values: DataFrame, by: list[str], value: str) -> DataFrame:
    """How far the true rank of each ``value`` of ``found`` is from its ``rank``:
    the columns of ``found`` and ``error``. Values that occur often have a range of
    ranks, of which the nearest counts."""
    v = values.select(*by, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    # a few ranks a group stand against its values: no shuffle of those, but of counts
    met = v.join(F.broadcast(found), by)
    low, up = F.count_if(F.col("_v") < F.col("value")) / F.col("n"), F.count_if(F.col("_v") <= F.col("value")) / F.col("n")
    counted = met.groupBy(*found.columns).agg(low.alias("_low"), up.alias("_up")) if found.columns else met
    error = F.when(F.col("rank") < F.col("_low"), F.col("_low") - F.col("rank")).when(F.col("rank") > F.col("_up"), F.col("rank") - F.col("_up")).otherwise(0.0)
    return counted.select(*found.columns, error.alias("error"))
