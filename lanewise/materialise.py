"""Cutting lineage between rounds of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where the
    session names none and runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or tempfile.mkdtemp(prefix="lanewise-")).rstrip("/")


def scratch(spark: SparkSession) -> str:
    """The name of a new folder there, for tables that a result reads. It goes when
    the driver ends, if nothing has removed it before."""
    top = f"{shared_folder(spark)}/lanewise-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(top)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return f"{top}/t"


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def small_batches(df: DataFrame) -> None:
    """Set the limit on the bytes of an Arrow batch to 4 MiB where the session has the
    default of 64 MiB, which every task holds several times."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) in ("67108864b", "67108864", "64m", "64MB"):
        conf.set(key, f"{4 << 20}b")


class Rounds:
    """Tables of an iterative search, written to one folder and read back.

    Unlike a checkpoint, which keeps the size that was estimated for its plan, a table
    has the size that it has. Estimates multiply with each join, so after some rounds
    of joins they have more digits than can be reckoned with, and nothing that is
    small is seen to be. ``close`` keeps the result and removes the folder."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, scratch(spark), 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(path := f"{self.folder}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self, result: DataFrame) -> DataFrame:
        out = cut(result)
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        return out
