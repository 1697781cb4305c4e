"""Traffic levels, weights and travel times as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALPHA, BETA, MOST_VC = 3.0 / 1.05**4, 4.0, 2.0
# Weights of green, yellow, red and dark red, what each becomes a
# rung lower, the loads that levels stand for, and the colours drawn.
LADDER = (25.0, 55.0, 85.0, 105.0)
DEMOTED = (25.0, 25.0, 55.0, 85.0)
LEVEL_LOAD = (0.25, 0.55, 0.85, 1.05)
RAMP = ((22, 224, 152), (255, 207, 67), (209, 53, 43), (169, 39, 39))
RAMP_HEX = ("#16e098", "#ffcf43", "#d1352b", "#a92727")
# Road classes, biggest first: capacity per lane, free speed, lanes.
ROAD_CLASSES = (
    ("motorway", 1900, 80, 3), ("trunk", 1600, 60, 3), ("primary", 1200, 50, 2), ("secondary", 1000, 40, 2), ("tertiary", 800, 35, 2),
    ("unclassified", 600, 30, 1), ("residential", 500, 25, 1), ("living_street", 300, 15, 1), ("service", 300, 15, 1),
)
UNCLASSIFIED = 5


def delay_factor(vc: Column, alpha: float = ALPHA, beta: float = BETA) -> Column:
    return 1.0 + F.pow(F.least(vc, F.lit(MOST_VC)), F.lit(beta)) * alpha


def bpr_time_from_ratio(free_flow_s: Column, vc: Column, alpha: float = ALPHA, beta: float = BETA) -> Column:
    return free_flow_s * delay_factor(vc, alpha, beta)


def bpr_time(free_flow_s: Column, volume: Column, capacity: Column, alpha: float = ALPHA, beta: float = BETA) -> Column:
    """Infinite where there is no capacity."""
    vc = volume / F.when(capacity > 0, capacity)
    return F.when(capacity <= 0, F.lit(float("inf"))).otherwise(bpr_time_from_ratio(free_flow_s, vc, alpha, beta))


def interp(x: Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Piecewise-linear, clamped at both ends."""
    out = F.lit(float(ys[-1]))
    for i in range(len(xs) - 1, 0, -1):
        slope = (ys[i] - ys[i - 1]) / (xs[i] - xs[i - 1])
        out = F.when(x < xs[i], (x - xs[i - 1]) * slope + ys[i - 1]).otherwise(out)
    return F.when(x <= xs[0], F.lit(float(ys[0]))).otherwise(out)


def demote(weight: Column) -> Column:
    return interp(weight, LADDER, DEMOTED)


def vc_ratio(weight: Column) -> Column:
    return weight / 100.0


def band(x: Column, bounds: Sequence[float], values: Sequence) -> Column:
    """The value of the first bound that ``x`` doesn't exceed, else the last."""
    out = F.lit(values[len(bounds)])
    for b, v in reversed(list(zip(bounds, values))):
        out = F.when(x <= b, F.lit(v)).otherwise(out)
    return out


def step(x: Column, bounds: Sequence[float]) -> Column:
    """How many bounds ``x`` reaches."""
    return sum((F.when(x >= b, 1).otherwise(0) for b in bounds), F.lit(0))


def to_class(weight: Column) -> Column:
    """Nearest rung 1 to 4; halfway goes to the lower one."""
    return band(weight, (40.0, 70.0, 95.0), (1, 2, 3, 4))


def snap(weight: Column) -> Column:
    return band(weight, (40.0, 70.0, 95.0), LADDER)


def level_of_weight(weight: Column) -> Column:
    """Level 0 to 3; halfway goes to the higher one."""
    return step(weight, (40.0, 70.0, 95.0))


def load_level(vc: Column) -> Column:
    return step(vc, (0.4, 0.7, 0.95))


def level_load(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LEVEL_LOAD]), level.cast("int") + 1)


def actual_load(level: Column, capacity: Column) -> Column:
    return level_load(level) * capacity


def travel_time_s(free_flow_s: Column, weight: Column) -> Column:
    return bpr_time_from_ratio(free_flow_s, weight / 100.0)


def to_hex(weight: Column) -> Column:
    """Colour on the ramp, channels rounded half to even."""
    channels = [F.bround(interp(weight, LADDER, [c[k] for c in RAMP]), 0).cast("int") for k in range(3)]
    return F.format_string("#%02x%02x%02x", *channels)


def ramp_colour(weight: Column) -> Column:
    return band(weight, LADDER, (*RAMP_HEX, RAMP_HEX[-1]))


def rungs_lost(hops: Column, per_rung: int) -> Column:
    return F.when(hops <= 1, F.lit(0)).otherwise(F.ceil((hops - 1) / per_rung)).cast("int")


def user_delay(weight: Column, rungs: Sequence[float], jam: float, beta: float = BETA) -> Column:
    """A viewer's own scale: rung weights remapped, delay at dark red is ``jam``;
    no cap on the ratio."""
    alpha = min(max((jam - 1) / (rungs[-1] / 100) ** beta, 0.0), 1e4)
    return 1.0 + F.pow(interp(weight, LADDER, rungs) / 100.0, F.lit(beta)) * alpha


def delay_colour(delay: Column) -> Column:
    return band(delay, (1.4, 2.2, 3.5), RAMP_HEX)


def base_class(highway: Column) -> Column:
    return F.replace(F.coalesce(highway, F.lit("")), F.lit("_link"), F.lit(""))


def class_rank(highway: Column) -> Column:
    """0 for a motorway to 8 for service; unknown ranks as unclassified."""
    rank = F.array_position(F.array(*[F.lit(c) for c, *_ in ROAD_CLASSES]), base_class(highway)) - 1
    return F.when(rank < 0, F.lit(UNCLASSIFIED)).otherwise(rank).cast("int")


def class_value(highway: Column, which: int) -> Column:
    """Column ``which`` of the class table: 1 capacity per lane, 2 speed, 3 lanes."""
    return F.element_at(F.array(*[F.lit(row[which]) for row in ROAD_CLASSES]), class_rank(highway) + 1)


def free_flow_s(length_m: Column, kmph: Column) -> Column:
    return length_m / (kmph / 3.6)


def road_classes(spark: SparkSession) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(ROAD_CLASSES)]
    return spark.createDataFrame(rows, "class_rank int, highway string, cap_per_lane int, speed int, lanes int")


def capacity_of(highway: Column, lanes: Column) -> Column:
    return class_value(highway, 1) * lanes
