"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time, piecewise linear on
equally spaced knots. Its integral is the source's weight. Targets share the
words of all documents by weight; a target stops at ``most_repeats`` times the
size of its source and the excess is shared again by weight.

Within a source the documents form one stream of words, in the order of a hash
of their id and text. The stream is repeated until the target is met. The place of a
document copy in that stream is a cumulative demand; inverting the integral of
the schedule gives the time at which the source asks for it, and so its training
position. ``curriculum`` range-sorts the copies by position.

Prefix sums over a source, however large, are taken in two levels: by 4,096
hash cells, then within a cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Knots of the default schedules, as multiples of the weight: early, level, late.
SHAPES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
#: Weights in turn, by the code-point order of the sources.
WEIGHTS = (1, 2, 3)
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    """Words (runs without ASCII white space); null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def _order_hash(id_col: str, text_col: str) -> Column:
    """Of id and text, so that rows without an id, or with one id, are spread too."""
    none = F.lit("")
    text = F.coalesce(F.md5(F.col(text_col).cast("binary")), none)
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), none), F.lit(" "), text).cast("binary"))


def default_schedule(rank: Column) -> Column:
    """Knots for the source of that rank (from 0)."""
    turn = rank % len(WEIGHTS)
    out = None
    for i, w in enumerate(WEIGHTS):
        knots = F.array(*[F.lit(w * x) for x in SHAPES[i]])
        out = F.when(turn == i, knots) if out is None else out.when(turn == i, knots)
    return out


def targets(cells: DataFrame, schedule=default_schedule, most_repeats: int = 3) -> DataFrame:
    """One row per source: its size, schedule and target.

    ``cells(skey, source, cell, words)`` are sums by source and hash cell. Works on
    one row per source; the two windows without keys run over those rows only.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    sources = (
        cells.groupBy("skey", "source").agg(F.sum("words").alias("source_size"))
        .withColumn("rank", F.row_number().over(rank) - 1)
        .withColumn("knots", schedule(F.col("rank")))
        .withColumn("steps", F.size("knots") - 1)
        # integral of the schedule up to each knot
        .withColumn(
            "areas",
            F.expr(
                "aggregate(sequence(0, steps - 1), array(0D), (a, i) -> "
                "concat(a, array(element_at(a, -1) + (knots[i] + knots[i + 1]) / 2 / steps)))"
            ),
        )
        .withColumn("weight", F.element_at("areas", -1))
        .withColumn("cap", (F.col("source_size") * most_repeats).cast("double"))
    )
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    so_far = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(0, Window.unboundedFollowing)
    every = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = (
        sources.withColumn("left", F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("cap").over(so_far), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(rest))
        .withColumn("fits", F.col("left") * F.col("weight") <= F.col("cap") * F.col("open"))
        .withColumn("first", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), "rank", "left", "open"))).over(every))
    )
    level = F.col("first.left") * F.col("weight") / F.col("first.open")
    before = F.struct(F.col("cap") / F.col("weight"), F.col("rank")) < F.struct(F.col("first.col1"), F.col("first.rank"))
    return levels.select(
        "skey", "source", "source_size", "knots", "areas", "steps",
        F.when(before, F.col("cap")).otherwise(level).alias("target"),
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    schedule=default_schedule,
    most_repeats: int = 3,
    keep: list[Column] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``(id, size, source, source_size, target,
    copies, taken, demand, knots, areas, steps)`` and ``keep``.

    A document is taken once for every whole repeat of its source, and once
    more while the middle of it lies before the rest of the target, so a source
    misses its target by half a document at most. Null is a source of its own
    and comes last; a null or empty text has size 0; rows with one id are
    ordered by size and text, so reruns agree; an empty table gives an empty one.
    """
    slim = docs.select(
        F.col(id_col).alias("id"),
        word_count(text_col).alias("size"),
        F.col(source_col).alias("source"),
        # never null, so that windows and joins share one partitioning
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("null")).alias("skey"),
        _order_hash(id_col, text_col).alias("h"),
        F.xxhash64(F.col(text_col)).alias("tie"),
        *(keep or []),
    )
    if not keep:
        slim = cut(slim)
    slim = slim.withColumn("cell", F.substring("h", 1, 3))
    by = ["skey", "cell"]
    cells = cut(slim.groupBy("skey", "source", "cell").agg(F.sum("size").alias("words")))
    goal = targets(cells, schedule, most_repeats).drop("source")
    ahead = Window.partitionBy("skey").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0))).drop("words")
    facts = cells.drop("source").join(goal, "skey")
    within = Window.partitionBy(*by).orderBy("h", "id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    numbered = slim.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    more = (F.col("demand") + F.col("size") / 2 <= F.col("target") - F.col("whole") * F.col("source_size")) & (F.col("whole") < most_repeats)
    joined = numbered.join(facts, by)
    extra = [c for c in slim.columns if c not in ("id", "size", "source", "skey", "h", "tie", "cell")]
    return (
        joined.withColumn("demand", F.col("ahead") + F.col("inside"))
        .withColumn("whole", whole)
        .withColumn("copies", F.col("whole") + F.when(more & (F.col("source_size") > 0), 1).otherwise(0))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select("id", "size", "source", "source_size", "target", "copies", "taken", "demand", "knots", "areas", "steps", *extra)
    )


def position_of(copy: Column) -> Column:
    """Training time in [0, 1] at which a source asks for that copy (from 0) of a
    document: the integral of its schedule, inverted at the copy's middle.

    With ``_y`` the part of the whole integral that lies before and ``a`` the
    knots' integrals, the segment is found by counting and the quadratic inside
    it is solved for the time."""
    share = (copy * F.col("source_size") + F.col("demand") + F.col("size") / 2) / F.greatest(F.col("target"), F.lit(1.0))
    y = F.least(F.lit(1.0), share) * F.element_at("areas", -1)
    # the last knot whose integral isn't beyond; element numbers are from 1
    at = F.least(F.col("steps"), F.greatest(F.lit(1), F.size(F.filter("areas", lambda a: a <= y))))
    rest, here, there = y - F.element_at("areas", at), F.element_at("knots", at), F.element_at("knots", at + 1)
    below = here + F.sqrt(F.greatest(F.lit(0.0), here * here + 2 * (there - here) * F.col("steps") * rest))
    return (at - 1) / F.col("steps") + F.when(below > 0, 2 * rest / below).otherwise(0.0)


def curriculum(docs: DataFrame, **options) -> DataFrame:
    """The copies of ``mix_sources`` with ``copy`` (from 0) and ``position``,
    range-sorted by training position. Documents that aren't taken are left out."""
    copies = mix_sources(docs, **options).where("copies > 0").withColumn("copy", F.explode(F.expr("sequence(0, copies - 1)")))
    return copies.withColumn("position", position_of(F.col("copy"))).orderBy("position", "id", "copy")


def curriculum_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of ``mix_sources``, range-sorted by the training position of
    their first copy: ``position`` and ``last_position``, null for documents that
    aren't taken, which come last."""
    mixed = mix_sources(docs, **options)
    place = lambda copy: F.when(F.col("copies") > 0, position_of(copy))
    placed = mixed.withColumn("position", place(F.lit(0))).withColumn("last_position", place(F.col("copies") - 1))
    return placed.orderBy(F.asc_nulls_last("position"), "id")
