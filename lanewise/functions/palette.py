"""Traffic colours of map pixels as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Class and reference colours, fill first.
PALETTE = (
    (1, (22, 224, 152)), (1, (4, 156, 101)),
    (2, (255, 207, 67)), (2, (245, 192, 37)),
    (3, (209, 53, 43)), (3, (242, 78, 66)), (3, (152, 66, 58)),
    (4, (169, 39, 39)), (4, (112, 35, 35)),
)
TOLERANCE, CASING_LEAST, CASING_CLEAN = 50.0, 0.4, 0.15
SPREAD, NEAR_WHITE = 0.08, 8


def distance2(r: Column, g: Column, b: Column, ref: Sequence[int]) -> Column:
    square = lambda c, k: (c - ref[k]) * (c - ref[k])
    return square(r, 0) + square(g, 1) + square(b, 2)


def nearest(r: Column, g: Column, b: Column) -> Column:
    """16 times the squared distance to the nearest reference plus its place; the
    least of these is the first of the nearest. Numbers, not structs, keep the
    generated code small."""
    return F.least(*[distance2(r, g, b, ref) * 16 + k for k, (_, ref) in enumerate(PALETTE)])


#: Steps in which shares are told apart.
FINE = 1e12


def casing_blend(r: Column, g: Column, b: Column) -> Column:
    """The largest share of a reference in a mix with white, 0 where channels
    disagree: 16 times its steps plus 15 minus the place, so ties go to the first."""

    def one(ref: Sequence[int]) -> Column:
        # channels near white say nothing
        shares = [(255 - c) * (1.0 / (255 - v)) for c, v in zip((r, g, b), ref) if 255 - v > NEAR_WHITE]
        mean = sum(shares[1:], shares[0]) * (1.0 / len(shares))
        apart = [F.abs(s - mean) for s in shares]
        fits = (mean >= 0) & (mean <= 1)
        for x in apart:
            fits = fits & (x < SPREAD)
        return F.when(fits, mean).otherwise(0.0)

    return F.greatest(*[F.floor(one(ref) * FINE) * 16 + (15 - k) for k, (_, ref) in enumerate(PALETTE)])


def class_of(k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c, _ in PALETTE]), k + 1)


def encoded(pixels: DataFrame) -> DataFrame:
    """The pixels with ``_near`` and ``_mix``, from which ``decoded`` reads the
    match. Counting by these two first computes them once and keeps the code small."""
    rgb = [F.coalesce(F.col(c).cast("int"), F.lit(255)) for c in "rgb"]
    return pixels.withColumns({"_near": nearest(*rgb), "_mix": casing_blend(*rgb)})


def decoded(found: DataFrame) -> DataFrame:
    """``d2`` and ``near`` of the nearest reference, ``t`` and ``mixed`` of the best mix with white."""
    return found.withColumns({
        "d2": F.shiftright("_near", 4), "near": class_of(F.col("_near").bitwiseAND(15).cast("int")),
        "t": F.shiftright("_mix", 4) / FINE, "mixed": class_of((15 - F.col("_mix").bitwiseAND(15)).cast("int")),
    }).drop("_near", "_mix")


def matched(pixels: DataFrame) -> DataFrame:
    """``pixels(r, g, b, a)`` with ``d2``, ``near``, ``t`` and ``mixed``."""
    return decoded(encoded(pixels))


def class_of_match(tolerance: float = TOLERANCE, closed: bool = False, casing: float = CASING_LEAST) -> Column:
    """Class 1 to 4, or 0, from the columns of ``matched``. ``closed`` accepts a
    pixel right at the tolerance, as the collector does and the decoder doesn't."""
    hit = F.col("d2") <= tolerance**2 if closed else F.col("d2") < tolerance**2
    return F.when(F.col("a") <= 128, 0).when(hit, F.col("near")).when(F.col("t") >= casing, F.col("mixed")).otherwise(0)


def coloured(r: Column, g: Column, b: Column, a: Column, least_alpha: int = 128) -> Column:
    return (a > least_alpha) & (F.greatest(r, g, b) - F.least(r, g, b) > 40)


def quantise(c: Column, unit: int = 8) -> Column:
    return F.floor(c / unit).cast("int") * unit + unit // 2
