"""Captures as a stream: ingestion, hourly levels, runs and blocked sources."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import schemas


def stream_readings(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """New reading files (Parquet) as they arrive."""
    return spark.readStream.schema(schemas.READINGS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once(readings: DataFrame, late: str = "2 hours") -> DataFrame:
    """A reading that comes twice within the watermark counts once."""
    return readings.withWatermark("ts", late).dropDuplicatesWithinWatermark(["edge_id", "ts"])


def hourly_levels(readings: DataFrame, late: str = "2 hours") -> DataFrame:
    """Tumbling hours: mean level and painted share per road."""
    return readings.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "edge_id").agg(
        F.avg("level").alias("mean_level"), F.avg(F.col("painted").cast("int")).alias("painted_share"), F.count("*").alias("n")
    ).select(F.col("window.start").alias("hour"), "edge_id", "mean_level", "painted_share", "n")


def runs(readings: DataFrame, gap: str = "25 minutes", late: str = "2 hours") -> DataFrame:
    """Session windows: runs of captures of a road without a longer gap."""
    return readings.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "edge_id").agg(F.count("*").alias("captures")).select(
        F.col("session_window.start").alias("first"), F.col("session_window.end").alias("until"), "edge_id", "captures"
    )


def blocked(log: DataFrame, limit: int = 25) -> DataFrame:
    """Sources with ``limit`` refusals in a row: ``log(source, seq, status)``.

    The streak per source is the state; a success resets it. A row comes out
    when a streak reaches the limit."""

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        hits = []
        # frames are pieces of one batch's rows, in no order
        every = pd.concat([frame[["seq", "status"]] for frame in frames], ignore_index=True).sort_values("seq")
        for seq, status in every.itertuples(index=False):
            streak = streak + 1 if status == 403 else 0
            if streak == limit:
                hits.append((key[0], int(seq), streak))
        state.update((streak,))
        yield pd.DataFrame(hits, columns=["source", "seq", "streak"])

    return log.groupBy("source").applyInPandasWithState(watch, "source string, seq bigint, streak int", "streak int", "append", GroupStateTimeout.NoTimeout)


def publish(readings: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Append de-duplicated readings to Parquet by day; the sink is exactly once."""
    day = once(readings).withColumn("day", F.to_date("ts"))
    writer = day.writeStream.format("parquet").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def finished(stream: DataFrame, folder: str) -> DataFrame:
    """All that a stream yields over what is there now, read back from Parquet."""
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append")
    writer.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
