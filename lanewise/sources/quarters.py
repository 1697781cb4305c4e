"""A map source that refuses what is too big: boxes are quartered where it fails.

The state is a table of boxes. A round asks for all open boxes, each in a task of its
own, every mirror in turn; boxes that no mirror answers are cut in four and are open
in the next round. What came is merged by type and id, since a way on the border of
two boxes comes twice.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..materialise import Rounds

BOX = "north double, south double, east double, west double, depth int"
#: Asks a mirror for a box: elements as dicts; an exception is a failure.
Transport = Callable[[str, dict], list[dict]]


def quarter(boxes: DataFrame) -> DataFrame:
    """The four quarters of each box, one level deeper."""
    y, x = (F.col("north") + F.col("south")) / 2, (F.col("east") + F.col("west")) / 2
    part = lambda n, s, e, w: F.struct(n.alias("north"), s.alias("south"), e.alias("east"), w.alias("west"), (F.col("depth") + 1).alias("depth"))
    n, s, e, w = (F.col(c) for c in ("north", "south", "east", "west"))
    return boxes.select(F.explode(F.array(part(n, y, x, w), part(n, y, e, x), part(y, s, x, w), part(y, s, e, x))).alias("b")).select("b.*")


def ask(boxes: DataFrame, transport: Transport, mirrors: list[str], tries: int = 2) -> DataFrame:
    """``boxes`` with ``elements`` (JSON texts), null where no mirror answered, and
    ``detail``: the mirror that did, or the last failures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(box: dict) -> tuple[list[str] | None, str]:
            errors = []
            for mirror in mirrors:
                for _ in range(tries):
                    try:
                        return [json.dumps(x) for x in transport(mirror, box)], mirror
                    except Exception as e:  # whatever a mirror does, the next is asked
                        errors.append(f"{mirror}: {type(e).__name__} {e}"[:200])
            return None, "; ".join(errors[-4:])

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                found, detail = one(row.to_pylist()[0])
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([found], pa.list_(pa.string())), pa.array([detail])], [*row.schema.names, "elements", "detail"])

    return boxes.repartition("north", "west", "depth").mapInArrow(run, f"{BOX}, elements array<string>, detail string")


def fetch_elements(spark: SparkSession, box: dict, transport: Transport, mirrors: list[str], tries: int = 2, most_depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """All elements of a box, and the boxes with how they went.

    ``(type, id, lon, lat, nodes, tags)``, one row for each type and id, and
    ``(north, south, east, west, depth, state, detail)``: ``done``, ``cut`` (quartered)
    or ``failed`` (at ``most_depth``). Whoever asks decides what a failed box means;
    nothing that came is lost by it."""
    tables = Rounds(spark)
    sides = [float(box[k]) for k in ("north", "south", "east", "west")]
    open_ = spark.createDataFrame([(*sides, 0)], BOX)
    log = []
    while True:
        asked = tables.keep(ask(open_, transport, mirrors, tries))
        log.append(asked)
        open_ = quarter(asked.where(F.col("elements").isNull() & (F.col("depth") < most_depth)))
        if open_.isEmpty():
            break
    every = reduce(DataFrame.unionByName, log)
    state = F.when(F.col("elements").isNotNull(), "done").when(F.col("depth") < most_depth, "cut").otherwise("failed")
    boxes = every.select("north", "south", "east", "west", "depth", state.alias("state"), "detail")
    parsed = every.where("elements IS NOT NULL").select(F.explode("elements").alias("e")).select(F.from_json("e", schemas.ELEMENTS).alias("x")).select("x.*")
    found = parsed.groupBy("type", "id").agg(*[F.any_value(c).alias(c) for c in ("lon", "lat", "nodes", "tags")])
    boxes = spark.createDataFrame(boxes.collect(), boxes.schema)  # a row for each box that was asked for
    return tables.close(found), boxes


def quartered(points: DataFrame, box: dict, most: int, depth: int = 12) -> DataFrame:
    """A box quartered until no part has more than ``most`` of ``points(lon, lat)``:
    ``(level, x, y, n)`` of the parts that have any, ``x`` from the west and ``y`` from
    the south. Points outside belong to the parts at the edge; parts at ``depth`` may
    have more.

    Points are counted once, in the finest parts; larger ones are sums of those, and a
    part is cut if it has too many, so it stays if its parent was cut and it wasn't."""
    side = 1 << depth
    place = lambda v, low, high: F.least(F.greatest(F.floor((v - low) / (high - low) * side), F.lit(0)), F.lit(side - 1)).cast("bigint")
    fine = points.groupBy(place(F.col("lon"), box["west"], box["east"]).alias("x"), place(F.col("lat"), box["south"], box["north"]).alias("y")).agg(F.count("*").alias("n"))
    up = lambda c, k: F.shiftright(F.col(c), k)
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")
    back = F.lit(depth) - F.col("level")
    at: Callable[[str], Column] = lambda c: F.call_function("shiftright", F.col(c), back)
    counts = fine.select("x", "y", "n", levels).groupBy("level", at("x").alias("x"), at("y").alias("y")).agg(F.sum("n").alias("n"))
    parents = counts.select((F.col("level") + 1).alias("level"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("n").alias("above"))
    met = counts.withColumns({"px": up("x", 1), "py": up("y", 1)}).join(parents, ["level", "px", "py"], "left")
    stays = (F.col("n") <= most) | (F.col("level") == depth)
    return met.where(stays & (F.col("above").isNull() | (F.col("above") > most))).select("level", "x", "y", "n")
