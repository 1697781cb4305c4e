"""A history that is kept up to date: what a batch of readings adds, once.

Mean levels are sums over counts, so batches add up. Each batch writes its sums and
its captures under its own number and replaces what is there under it: a batch that
runs again after a failure counts once. Batches are put together now and then, and a
batch that the base holds already is left out.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock
from ..operators.history import captures_of, profile_of_sums

SUMS = "edge_id bigint, weekend boolean, hour int, s bigint"
CAPTURES = "ts timestamp, minute int, weekend boolean"


def batch_sums(readings: DataFrame) -> DataFrame:
    """Sums of levels per road, kind of day and hour of ``readings(edge_id, ts, level)``."""
    ts = F.col("ts")
    keyed = readings.select(F.col("edge_id").cast("bigint").alias("edge_id"), clock.weekend(ts).alias("weekend"), F.floor(clock.minute_of_day(ts) / 60).cast("int").alias("hour"), "level")
    return keyed.groupBy("edge_id", "weekend", "hour").agg(F.sum("level").cast("bigint").alias("s"))


class HistoryState:
    """Sums and captures in ``folder``, which all executors reach.

    ``fold`` is a ``foreachBatch`` function. A reading may be in one batch only (see
    ``streaming.captures.once``); a capture may be spread over several."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _numbers(self, kind: str) -> list[int]:
        """Numbers below a folder whose writes are complete."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath() for s in fs.listStatus(path)]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(m[1]) for p in names if (m := re.fullmatch(r"n(\d+)", p.getName())) and fs.exists(done(f"{p.toString()}/captures/_SUCCESS")))

    def _write(self, at: str, sums: DataFrame, captures: DataFrame) -> None:
        sums.write.mode("overwrite").parquet(f"{at}/sums")
        captures.write.mode("overwrite").parquet(f"{at}/captures")  # last: its mark makes the number count

    def fold(self, readings: DataFrame, number: int) -> None:
        """Add a batch, or replace it; a batch that the base holds changes nothing."""
        base = self._numbers("base")
        if base and number <= base[-1]:
            return
        captures = captures_of(readings).select("ts", "minute", "weekend")
        self._write(f"{self.folder}/batch/n{number}", batch_sums(readings), captures)

    def parts(self) -> tuple[DataFrame, DataFrame]:
        """Sums and distinct captures of the newest base and all batches after it."""
        base = self._numbers("base")[-1:]
        at = [f"{self.folder}/base/n{k}" for k in base]
        at += [f"{self.folder}/batch/n{k}" for k in self._numbers("batch") if not base or k > base[0]]
        read = lambda kind, schema: self.spark.read.schema(schema).parquet(*[f"{p}/{kind}" for p in at]) if at else self.spark.createDataFrame([], schema)
        sums = read("sums", SUMS).groupBy("edge_id", "weekend", "hour").agg(F.sum("s").alias("s"))
        return sums, read("captures", CAPTURES).distinct()

    def compact(self) -> int | None:
        """Put all batches together as a new base; earlier files stay for readers that
        have begun. Returns the number of the last batch in it."""
        numbers = self._numbers("batch")
        base = self._numbers("base")
        if not numbers or (base and base[-1] >= numbers[-1]):
            return base[-1] if base else None
        sums, captures = self.parts()
        self._write(f"{self.folder}/base/n{numbers[-1]}", sums, captures)
        return numbers[-1]

    def profile(self) -> DataFrame:
        """``history.hour_profile`` of all batches, without a reading being read again."""
        return profile_of_sums(*self.parts())

    def follow(self, readings: DataFrame, checkpoint: str):
        """Fold a stream of readings, as far as it goes now."""
        writer = readings.writeStream.foreachBatch(lambda df, n: self.fold(df, n)).option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start()
