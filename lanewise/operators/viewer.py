"""What a map asks for: which lines and layers to show, where a capture's frame
comes from, what to load next, and whether a request may run."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Captures that are loaded ahead of the one shown.
AHEAD = 60
# Tasks of a simulation with the ranges of their numbers, whether
# whole, and the values of their choices; each with the default.
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
TASKS: dict[str, dict[str, tuple]] = {
    "history": {},
    "forecast": {"scenarios": (5, 2, 10)},
    "city": {"day": ("tuesday", DAYS), "time": ("17:00", r"([01]?\d|2[0-3]):[0-5]\d"), "trips": (2000, 50, 20000), "batches": (10, 1, 50), "vehicles": (10.0, 1.0, 200.0), "model": ("knn", ("knn", "logistic"))},
    "diversion": {"capture": ("", r"[a-z]+-\d{4}-\d{2}-\d{2}T\d{4}Z"), "minutes": (90, 15, 240)},
    "changes": {"area": ("farmgate", ("farmgate", "mohakhali")), "max_changes": (2, 1, 3)},
}


def simulation_request(body: dict[str, Any], processed: Callable[[str], bool] = lambda name: True) -> dict[str, Any]:
    """The request with its defaults, or a ``ValueError`` that names what is out
    of range. A diversion's capture must be ``processed``."""
    task = body.get("task")
    if task not in TASKS:
        raise ValueError(f"task must be one of {', '.join(TASKS)}")
    out = {"task": task}
    for name, (default, *limits) in TASKS[task].items():
        given = body.get(name, default)
        try:
            value = type(default)(given)
        except (TypeError, ValueError):
            raise ValueError(f"{name} is malformed") from None
        if len(limits) == 2:
            fits, wanted = limits[0] <= value <= limits[1], f"{limits[0]} to {limits[1]}"
        elif isinstance(limits[0], str):
            fits, wanted = bool(re.fullmatch(limits[0], value)), "of its form"
        else:
            fits, wanted = value in limits[0], f"one of {', '.join(limits[0])}"
        if not fits:
            raise ValueError(f"{name} must be {wanted}")
        out[name] = value
    if task == "diversion" and not processed(out["capture"]):
        raise ValueError("capture must be a processed one")
    return out


def visible(lines: DataFrame, least_class: int, which: str = "all") -> DataFrame:
    """Lines of big enough classes (a lower rank is bigger), of ``all`` sources or
    of the ``observed`` or ``predicted`` ones only; a code of 4 or more is predicted."""
    shown = lines.where(F.col("class_rank") <= least_class)
    return shown if which == "all" else shown.where((F.col("code") < 4) == (which == "observed"))


def junctions(nodes: DataFrame, hide_cuts: bool = True) -> DataFrame:
    """Nodes, without those that only cut a long road (``cut`` is true)."""
    return nodes.where(~F.coalesce("cut", F.lit(False))) if hide_cuts else nodes


def frame_sources(captures: DataFrame, tables: DataFrame, served_slot: str | None = None, served: str = "served") -> DataFrame:
    """``captures(name, captured_utc)`` with the ``source`` of their frame: the
    capture's table if it is of the current model (``tables(name, path, has_hops)``),
    else the served one for the capture it was built from, else null."""
    own = tables.where("has_hops").groupBy("name").agg(F.min("path").alias("own"))
    fallback = F.when(F.col("captured_utc") == F.lit(served_slot), F.lit(served))
    return captures.join(own, "name", "left").select(*captures.columns, F.coalesce("own", fallback).alias("source"))


def frames_index(captures: DataFrame, tables: DataFrame, frames: DataFrame, version: str) -> DataFrame:
    """Per capture whether its table is processed or stale, and whether a frame of
    this version of the lines is ready: ``frames(name, version)``."""
    from .layers import processed_index

    ready = frames.where(F.col("version") == version).select("name").distinct().withColumn("ready", F.lit(True))
    return processed_index(captures, tables).join(ready, "name", "left").withColumn("ready", F.coalesce("ready", F.lit(False)) & (F.col("state") == "processed"))


def frames_ahead(captures: DataFrame, at: str, most: int = AHEAD) -> DataFrame:
    """The next ``most`` processed captures after the one named ``at``, round the
    end of the timeline: ``(name, step)`` from 1. ``captures(name, ts, processed)``."""
    here = captures.where(F.col("name") == at).select(F.col("ts").alias("here")).limit(1)
    later = captures.join(F.broadcast(here)).where("processed").withColumn("wrapped", F.col("ts") <= F.col("here"))
    w = Window.orderBy("wrapped", "ts", "name")  # one row per capture
    return later.withColumn("step", F.row_number().over(w)).where(F.col("step") <= most).select("name", "step")


def simulated_frame(frame: DataFrame, lines: DataFrame, levels: DataFrame) -> DataFrame:
    """``frame(line, code)`` with the levels of one step painted over: a line takes
    the worst level of its edges and stays observed or predicted as it is.
    ``lines(line, edge_id)``, ``levels(edge_id, level)``."""
    over = lines.join(levels, "edge_id").groupBy("line").agg(F.max("level").alias("level"))
    kind = F.when(F.col("code") >= 4, 4).otherwise(0)
    return frame.join(over, "line", "left").select("line", F.coalesce(F.col("level") + kind, "code").cast("int").alias("code"))


def link_style(edges: DataFrame, lengths: tuple[float, float] = (20.0, 150.0)) -> DataFrame:
    """Colour keys of links, as shares in [0, 1]: by class, by direction, by length."""
    low, high = lengths
    share = F.least(F.greatest((F.col("length_m") - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return edges.select("edge_id", (F.col("class_rank") / 8.0).alias("by_class"), F.when(F.col("oneway"), 1.0).otherwise(0.0).alias("by_direction"), share.alias("by_length"))


def junction_style(facts: DataFrame) -> DataFrame:
    """Colour keys of junctions, in [0, 1]: by degree up to eight, and by best class."""
    return facts.select("node", (F.least("degree", F.lit(8)) / 8.0).alias("by_degree"), (F.col("best_class") / 8.0).alias("by_class"))


def safe_layer(key: str) -> str | None:
    """The path of a layer below its root, or None for anything else: a relative
    name ending in .geojson without steps upwards."""
    root, _, rest = key.partition("/")
    parts = rest.split("/")
    sound = root == "output" or re.fullmatch(r"capture:[A-Za-z0-9_.-]+", root) and ".." not in root
    return key if sound and rest.endswith(".geojson") and all(p not in ("", ".", "..") and "\\" not in p for p in parts) else None
