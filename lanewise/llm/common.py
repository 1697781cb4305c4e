"""Helpers that the corpus operators share: row batches, checkpoints and components.

Nothing here keeps more than one Arrow batch or one run of equal keys in memory.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are unpacked to Python objects at once.
BATCH_ROWS = 512
#: Bytes of an Arrow batch between an executor and its Python workers.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage.

    The folder is the one in ``spark.checkpoint.dir``; only where the session
    names none and runs on one machine (tests) a temporary folder is set.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; on a cluster there is nothing to take its place."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or tempfile.mkdtemp(prefix="lanewise-")


def file_order(docs: DataFrame) -> tuple[Column, Column] | None:
    """The order in which ``docs``, read from files that Spark wrote, was written:
    a column that orders the files and the place of a row in its file. None for a
    table that isn't read from such files."""
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return None
    name = F.col("_metadata.file_name")
    return F.concat(F.lpad(F.regexp_extract(name, r"part-(\d+)", 1), 12, "0"), F.lit(" "), name), F.col("_metadata.row_index")


def small_batches(df: DataFrame) -> None:
    """Set the limit on the bytes of an Arrow batch to ``BATCH_BYTES`` where the
    session has the default of 64 MiB, which every task holds several times."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) in ("67108864b", "67108864", "64m", "64MB"):
        conf.set(key, f"{BATCH_BYTES}b")


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with small batches."""
    small_batches(df)
    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a per-task set-up: ``make()`` runs once a task and
    returns the function that is applied to slices of ``BATCH_ROWS`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                yield apply(batch.slice(at, BATCH_ROWS))

    return map_rows(df, run, schema)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow string column as UTF-8 bytes, without a decode."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Components of the undirected graph ``edges(a, b)`` as ``(node, component)``.

    ``component`` is the smallest node of the component. Alternates the large-
    and small-star steps, each of which replaces the links of a node by links
    to the smallest neighbour; the edge table never grows, hot nodes are
    joined (AQE splits them), and every round is checkpointed. Loops
    (``a = b``) and null ends are ignored; no edges give an empty table.
    """
    edges = cut(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    before = None
    for _ in range(most_rounds):
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("a", "b", "m")
        edges = cut(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", "m"))
            .distinct()
        )
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    # settled: every node but the smallest has one link, to the smallest
    return nodes.join(edges.withColumnRenamed("a", "node"), "node", "left").select(
        "node", F.coalesce("b", "node").alias("component")
    )
