"""Which stages of which captures have to run, running them, and publishing.

A stage writes one output per capture from the outputs of other stages or from
sources. What has to run is a join over tables of what was written when; only
the captures to run reach the driver, as jobs.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import traffic
from ..materialise import cut

#: The stages in order, and what each is made from.
STAGES = (("decode", ("graph", "capture")), ("impute", ("decode", "graph")), ("layers", ("impute", "graph")))


def stale_stages(captures: DataFrame, written: DataFrame, stages=STAGES, only: tuple[str, ...] | None = None, force: bool = False) -> DataFrame:
    """``(capture, stage, position, reason)`` of what has to run.

    ``written(capture, name, at)`` holds the times of outputs and sources; a null
    capture stands for all of them (the graph). A stage is up to date if it was
    written no earlier than each of its inputs that exists and none of these has
    to run; else the reason is ``missing``, ``older`` or ``input``. ``only``
    restricts the stages that run (inputs that stay stale don't count then);
    ``force`` runs them all."""
    names = [n for n, _ in stages if only is None or n in only]
    times = captures.select("capture")
    for k in sorted({x for n, ins in stages for x in (n, *ins)}):
        at = written.where(F.col("name") == k)
        own = at.where("capture IS NOT NULL").groupBy("capture").agg(F.max("at").alias(f"own_{k}"))
        every = at.where("capture IS NULL").agg(F.max("at").alias(f"all_{k}"))
        times = times.join(own, "capture", "left").join(F.broadcast(every)).withColumn(f"at_{k}", F.coalesce(f"own_{k}", f"all_{k}")).drop(f"own_{k}", f"all_{k}")
    reasons: dict[str, Column] = {}
    for n, ins in stages:
        if n not in names:
            reasons[n] = F.lit(None).cast("string")
            continue
        older = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"at_{n}") < F.col(f"at_{i}"), F.lit(False)) for i in ins])
        waits = reduce(lambda a, b: a | b, [reasons[i].isNotNull() for i in ins if i in reasons], F.lit(False))
        reasons[n] = F.when(F.col(f"at_{n}").isNull(), "missing").when(older, "older").when(waits, "input").otherwise(F.lit("forced") if force else F.lit(None).cast("string"))
    rows = F.array(*[F.struct(F.lit(n).alias("stage"), F.lit(k).alias("position"), reasons[n].alias("reason")) for k, (n, _) in enumerate(stages)])
    return times.select("capture", F.explode(rows).alias("r")).select("capture", "r.*").where("reason IS NOT NULL")


def run_batch(spark: SparkSession, work: DataFrame, run: dict[str, Callable[[str], object]]) -> DataFrame:
    """Run the stages of ``work(capture, stage, position)`` capture by capture:
    ``(capture, stage, ok, detail, seconds)``.

    A stage that fails ends its capture and no other. What a stage does is a Spark
    job of its own; the driver holds one row for each."""
    done, broken = [], set()
    for r in work.orderBy("capture", "position").toLocalIterator():
        if r["capture"] in broken:
            done.append((r["capture"], r["stage"], False, "an earlier stage failed", 0.0))
            continue
        start = time.time()
        try:
            detail, ok = str(run[r["stage"]](r["capture"]) or ""), True
        except Exception as e:
            detail, ok = f"{type(e).__name__}: {str(e)[:200]}", False
            broken.add(r["capture"])
        done.append((r["capture"], r["stage"], ok, detail, round(time.time() - start, 3)))
    return spark.createDataFrame(done, "capture string, stage string, ok boolean, detail string, seconds double")


def write_layers(layers: dict[str, tuple[DataFrame, dict]], path: str, facts: dict) -> DataFrame:
    """Write each layer ``(features, entry)`` as GeoJSON lines below ``path`` and
    the index last, so that an index names only what is there.

    ``features(feature)`` are GeoJSON texts. The index has a row per layer: its
    id, file, number of features and the entry's own fields, with the ``facts``
    they all share (graph, capture, time)."""
    rows = []
    for name, (features, entry) in layers.items():
        file = f"{name}.geojson"
        features.select("feature").write.mode("overwrite").text(f"{path}/{file}")
        count = features.sparkSession.read.text(f"{path}/{file}").count()
        rows.append((name, file, count, json.dumps(entry, sort_keys=True), json.dumps(facts, sort_keys=True)))
    spark = next(iter(layers.values()))[0].sparkSession
    index = spark.createDataFrame(rows, "id string, file string, features long, entry string, facts string")
    index.coalesce(1).write.mode("overwrite").json(f"{path}/index")
    return index


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The layers of an index with their current number of features."""
    return spark.read.schema("id string, file string, features long, entry string, facts string").json(f"{path}/index")


def write_result(steps: DataFrame, path: str, name: str, run: str) -> None:
    """Add a simulation's steps under its name and run; a run written again
    replaces itself and nothing else."""
    out = steps.withColumns({"simulation": F.lit(name), "run": F.lit(run)})
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("simulation", "run").parquet(path)


def frame(lines: DataFrame, table: DataFrame) -> DataFrame:
    """One capture as a viewer plays it: ``(line, code)``, the level of each line
    and 4 more where it is predicted; lines without a weight are clear."""
    level = traffic.level_of_weight(F.coalesce("weight", F.lit(traffic.LADDER[0])))
    return lines.select("line", "edge_id").join(table.select("edge_id", "weight", "source"), "edge_id", "left").select(
        "line", (level + F.when(F.col("source") == "observed", 0).otherwise(4)).alias("code")
    )


def publish(frames: DataFrame, path: str) -> DataFrame:
    """Publish frames ``(capture, line, code)`` that aren't published yet, or that
    were published from another state: ``(capture, state)`` of those written.

    ``state`` is a combination of the hashes of a capture's codes, whatever their
    order. A capture is a partition, so one is replaced whole or not at all."""
    spark = frames.sparkSession
    state = frames.groupBy("capture").agg(F.hex(F.bit_xor(F.xxhash64("line", "code"))).alias("state"))
    try:
        old = spark.read.parquet(path).select("capture", "state").distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        old = spark.createDataFrame([], "capture string, state string")
    new = cut(state.join(old, ["capture", "state"], "left_anti").select("capture", "state"))
    fresh = frames.join(F.broadcast(new), "capture")
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("capture").parquet(path)
    return new
