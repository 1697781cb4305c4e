"""Aggregates over weights, roads and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..materialise import cut


def weight_summary(weights: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Count, mean, median and the number in each rung's band."""
    w = F.col("weight")
    inside = lambda a, b: F.count_if((w >= a) & (w < b))
    return weights.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.round(F.avg(w), 1).alias("mean"), F.round(F.percentile(w, 0.5), 1).alias("median_w"),
        F.count_if(w < 40).alias("green"), inside(40, 70).alias("yellow"), inside(70, 95).alias("red"), F.count_if(w >= 95).alias("darkred"),
    )


def majority(values: DataFrame, by: list[str], level: str = "level", worse: bool = True) -> DataFrame:
    """The most frequent level of each group; a tie goes to the worse (or the
    milder) one."""
    counts = values.groupBy(*by, level).agg(F.count("*").alias("_n"))
    tie: Column = F.col(level) if worse else -F.col(level)
    return counts.groupBy(*by).agg(F.max_by(level, F.struct("_n", tie)).alias(level))


def numbered(rows: DataFrame, order: str, name: str = "nth") -> DataFrame:
    """``rows`` with their place by ``order``, from 0: ranges of it are sorted in
    parallel and counted, and what stands before a range is added."""
    low = (1 << 33) - 1  # a number holds its partition above and its place there below
    sorted_ = cut(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted_.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row per partition
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return sorted_.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(low)).drop("_part", "_at", "_before")
