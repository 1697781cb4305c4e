"""Captures over time: dedup, gaps, profiles, forecasts and their scores.

A reading is ``(ts, edge_id, level, painted)``. A capture is all readings of one
``ts``. Capture tables (one row per ``ts``) are small beside readings: a year at
one a minute has half a million rows. What is broadcast here is such a table
cut to the captures asked for, never the readings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import clock
from .aggregates import majority


def union_first(folders: list[DataFrame], key: list[str]) -> DataFrame:
    """Rows of all folders; of rows with one key the earliest folder's stay.

    Only the keys are ranked, so whole rows are shuffled once, for the join."""
    marked = [df.withColumn("_folder", F.lit(i)) for i, df in enumerate(folders)]
    rows = marked[0]
    for df in marked[1:]:
        rows = rows.unionByName(df)
    first = rows.groupBy(*key).agg(F.min("_folder").alias("_first"))
    return rows.join(first, key).where("_folder = _first").drop("_folder", "_first")


def dense_levels(readings: DataFrame, edges: DataFrame, captures: DataFrame) -> DataFrame:
    """A row for every capture and road; roads not listed are level 0, unpainted."""
    every = edges.select("edge_id").join(F.broadcast(captures.select("ts")))
    return every.join(readings, ["edge_id", "ts"], "left").select(
        "ts", "edge_id", F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("painted", F.lit(0)).alias("painted")
    )


def captures_of(readings: DataFrame) -> DataFrame:
    """One row per capture with its local calendar."""
    ts = F.col("ts")
    return readings.select("ts").distinct().select(
        "ts", clock.minute_of_day(ts).alias("minute"), clock.weekday(ts).alias("weekday"), clock.weekend(ts).alias("weekend"), clock.local(ts).cast("date").alias("day")
    )


def gaps(captures: DataFrame, limit: int) -> DataFrame:
    """Neighbouring captures of one local day more than ``limit`` minutes apart."""
    before = F.lag("minute").over(Window.partitionBy("day").orderBy("minute"))
    return captures.withColumn("before", before).where(F.col("minute") - F.col("before") > limit).select("day", "before", "minute", (F.col("minute") - F.col("before")).alias("gap"))


def longest_gap(captures: DataFrame) -> DataFrame:
    before = F.lag("minute").over(Window.partitionBy("day").orderBy("minute"))
    return captures.withColumn("gap", F.col("minute") - before).groupBy("day").agg(F.coalesce(F.max("gap"), F.lit(0)).alias("longest"), F.count("*").alias("captures"))


def timeline(captures: DataFrame, limit_minutes: int = 25) -> DataFrame:
    """Each capture's place in [0, 1] over whole local days, and whether a gap
    lies before it. Neighbours are found per day and joined at the day's ends."""
    ts = F.col("ts")
    span = captures.agg(F.min(clock.day_start(ts)).alias("a"), (F.max(clock.day_start(ts)) + F.expr("INTERVAL 1 DAY")).alias("b"))
    days = captures.groupBy("day").agg(F.max("ts").alias("last"))
    days = days.withColumn("earlier", F.lag("last").over(Window.orderBy("day"))).select("day", "earlier")
    inside = captures.withColumn("prev", F.lag("ts").over(Window.partitionBy("day").orderBy("ts"))).join(days, "day")
    seconds = lambda x, y: x.cast("double") - y.cast("double")
    prev = F.coalesce("prev", "earlier")
    return inside.join(F.broadcast(span)).select(
        "ts", (seconds(ts, F.col("a")) / seconds(F.col("b"), F.col("a"))).alias("position"),
        F.coalesce(seconds(ts, prev) > limit_minutes * 60, F.lit(False)).alias("gap_before"),
    )


def default_split(captures: DataFrame) -> DataFrame:
    """One row ``split``: the last 7 days of 13 or more, else the last 30 %."""
    a, b = F.min("ts").cast("double"), F.max("ts").cast("double")
    return captures.agg(F.when(b - a >= 13 * 86400, b - 7 * 86400).otherwise(a + (b - a) * 0.7).alias("split"))


def with_split(captures: DataFrame, every: int = 3) -> DataFrame:
    """Captures marked ``part``: train, test (every third of the later ones, in
    time order) or skip."""
    late = captures.join(F.broadcast(default_split(captures))).withColumn("late", F.col("ts").cast("double") >= F.col("split"))
    nth = F.row_number().over(Window.partitionBy("late").orderBy("ts")) - 1
    return late.withColumn("nth", nth).select(
        *captures.columns, F.when(~F.col("late"), "train").when(F.col("nth") % every == 0, "test").otherwise("skip").alias("part")
    )


def hour_profile(readings: DataFrame, captures: DataFrame) -> DataFrame:
    """Mean level per road, and per road, kind of day and hour, in one pass.

    Means are over the ``captures`` of that kind of day and hour, ``n`` of them: a
    road that a capture doesn't list is level 0 there and counts. Hours in which a
    road is never listed have a mean of 0 and no row; unseen hours have none."""
    ts = F.col("ts")
    keyed = readings.select("edge_id", clock.weekend(ts).alias("weekend"), F.floor(clock.minute_of_day(ts) / 60).cast("int").alias("hour"), "level")
    return profile_of_sums(keyed.groupBy("edge_id", "weekend", "hour").agg(F.sum("level").alias("s")), captures)


def profile_of_sums(sums: DataFrame, captures: DataFrame) -> DataFrame:
    """``hour_profile`` from ``sums(edge_id, weekend, hour, s)`` of levels, which add
    up over any split of the readings."""
    counts = captures.groupBy("weekend", F.floor(F.col("minute") / 60).cast("int").alias("hour")).agg(F.count("*").alias("n"))
    # at most 48 rows, and the row of all captures
    sizes = counts.unionByName(captures.agg(F.count("*").alias("n")).select(F.lit(None).cast("boolean").alias("weekend"), F.lit(None).cast("int").alias("hour"), "n"))
    # partial sums came first: the grouping sets expand one row per road, day kind and hour
    both = sums.groupingSets([["edge_id"], ["edge_id", "weekend", "hour"]], "edge_id", "weekend", "hour").agg(F.sum("s").alias("s"))
    at = sizes.select(F.col("weekend").alias("w"), F.col("hour").alias("h"), "n")
    return both.join(F.broadcast(at), F.col("weekend").eqNullSafe(F.col("w")) & F.col("hour").eqNullSafe(F.col("h"))).select(
        "edge_id", "weekend", "hour", "n", (F.col("s") / F.col("n")).alias("mean_level")
    )


def nearest_captures(train: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The ``k`` training captures nearest to each asked time by time features;
    ties go to the latest. Both sides are capture tables; the asked one is small."""
    f = clock.time_features(F.col("minute"), F.col("weekend"))
    a = asked.select(F.col("ts").alias("asked"), f.alias("fa"))
    t = train.select("ts", f.alias("ft"))
    d2 = F.aggregate(F.zip_with("fa", "ft", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    pairs = t.join(F.broadcast(a)).withColumn("d2", F.round(d2, 9))
    w = Window.partitionBy("asked").orderBy("d2", F.desc("ts"))
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("asked", "ts", "rank", "d2")


def knn_forecast(readings: DataFrame, train: DataFrame, asked: DataFrame, k: int = 6) -> DataFrame:
    """Majority level of the nearest captures, per asked time and road; a tie goes
    to the worse level. A capture that doesn't list a road votes 0 for it; roads
    that none of them lists are level 0 and have no row."""
    near = nearest_captures(train, asked, k)
    near = near.join(near.groupBy("asked").agg(F.count("*").alias("voters")), "asked")
    votes = readings.join(F.broadcast(near), "ts")  # k rows for each asked time
    counts = votes.groupBy("asked", "edge_id").agg(F.max("voters").alias("voters"), *[F.count_if(F.col("level") == lv).alias(f"c{lv}") for lv in (1, 2, 3)])
    zeros = F.col("voters") - F.col("c1") - F.col("c2") - F.col("c3")
    best = F.greatest(*[F.struct((zeros if lv == 0 else F.col(f"c{lv}")).alias("n"), F.lit(lv).alias("level")) for lv in range(4)])
    return counts.select("asked", "edge_id", best["level"].alias("level"))


def same_time_captures(train: DataFrame, asked: DataFrame) -> DataFrame:
    """As-of join: the training capture of the same weekday (else of the same kind
    of day) with the smallest circular gap in minutes; ties go to the latest."""
    a = asked.select(F.col("ts").alias("asked"), F.col("minute").alias("m"), F.col("weekday").alias("d"), F.col("weekend").alias("e"))
    gap = clock.circular_gap(F.col("minute"), F.col("m"))
    order = F.struct(F.when(F.col("weekday") == F.col("d"), 0).otherwise(1), gap, -F.col("ts").cast("double"))
    return (
        train.join(F.broadcast(a), (F.col("weekday") == F.col("d")) | (F.col("weekend") == F.col("e")))
        .groupBy("asked").agg(F.min_by(F.struct("ts", gap.alias("gap")), order).alias("x")).select("asked", "x.ts", "x.gap")
    )


def as_of_captures(train: DataFrame, asked: DataFrame) -> DataFrame:
    """``same_time_captures`` as a sorted stream instead of pairs of captures.

    Per weekday, and per kind of day for weekdays without training captures, the
    minutes of both sides stand in one order, the day's ends wrapped round; the last
    training capture before a minute and the next after it are carried along. Of the
    captures of one minute only the latest can be an answer, so a window sees minutes
    of a day and not captures; asked times meet their minute's answer by a join."""
    day = 1440

    def nearest(by: str) -> DataFrame:
        known = train.groupBy(by, "minute").agg(F.max("ts").alias("ts"))
        turns = F.explode(F.array(*[F.lit(k * day) for k in (-1, 0, 1)]))
        stops = known.select(by, "minute", "ts", turns.alias("turn")).select(by, (F.col("minute") + F.col("turn")).alias("at"), F.struct((F.col("minute") + F.col("turn")).alias("at"), "ts").alias("stop"))
        points = asked.select(by, F.col("minute").alias("at")).distinct().withColumn("stop", F.lit(None).cast(stops.schema["stop"].dataType))
        w = Window.partitionBy(by).orderBy("at")
        both = points.withColumn("asks", F.lit(True)).unionByName(stops.withColumn("asks", F.lit(False)))
        near = both.withColumns({
            "back": F.last("stop", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
            "next": F.first("stop", ignorenulls=True).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing)),
        }).where(F.col("asks") & F.col("back").isNotNull())
        offer = lambda c: F.struct(F.abs(F.col("at") - F.col(f"{c}.at")).alias("gap"), (-F.col(f"{c}.ts").cast("double")).alias("late"), F.col(f"{c}.ts").alias("ts"))
        best = F.least(offer("back"), offer("next"))
        return near.select(by, F.col("at").alias("minute"), F.struct(best["ts"].alias("ts"), best["gap"].alias("gap")).alias(f"by_{by}"))

    a = asked.select(F.col("ts").alias("asked"), "minute", "weekday", "weekend")
    found = a.join(nearest("weekday"), ["weekday", "minute"], "left").join(nearest("weekend"), ["weekend", "minute"], "left")
    return found.withColumn("x", F.coalesce("by_weekday", "by_weekend")).where("x IS NOT NULL").select("asked", "x.ts", "x.gap")


def same_time_forecast(readings: DataFrame, train: DataFrame, asked: DataFrame) -> DataFrame:
    return readings.join(F.broadcast(same_time_captures(train, asked)), "ts").select("asked", "edge_id", "level")


def always_clear(readings: DataFrame, asked: DataFrame) -> DataFrame:
    return readings.join(F.broadcast(asked.select("ts")), "ts").select(F.col("ts").alias("asked"), "edge_id", F.lit(0).alias("level"))


def forecasts(readings: DataFrame, edges: DataFrame, train: DataFrame, asked: DataFrame) -> dict[str, DataFrame]:
    """Every forecaster's ``(asked, edge_id, level)`` for the asked captures."""
    from .learning import logistic_forecast

    rows = readings.join(F.broadcast(asked.select("ts")), "ts").select("ts", "edge_id", "level")
    return {
        "clear": always_clear(readings, asked), "same time": same_time_forecast(readings, train, asked), "knn": knn_forecast(readings, train, asked),
        "logistic": logistic_forecast(readings, edges, train, rows).select(F.col("ts").alias("asked"), "edge_id", F.col("predicted").alias("level")),
    }


def score(readings: DataFrame, forecasts: dict[str, DataFrame]) -> DataFrame:
    """Hits and too-green shares per model, over all hours (``hour`` null) and by
    hour. Only roads painted in the tested capture count; no guess is level 0."""
    truth = readings.where("painted = 1").select(F.col("ts").alias("asked"), "edge_id", F.col("level").alias("truth"))
    parts = None
    for name, guess in forecasts.items():
        tested = truth.join(F.broadcast(guess.select("asked").distinct()), "asked")
        both = tested.join(guess, ["asked", "edge_id"], "left").select(F.lit(name).alias("model"), "asked", "truth", F.coalesce("level", F.lit(0)).alias("guess"))
        parts = both if parts is None else parts.unionByName(both)
    hour = F.floor(clock.minute_of_day(F.col("asked")) / 60).cast("int")
    sums = parts.groupBy("model", hour.alias("hour")).agg(
        F.count("*").alias("counted"), F.count_if(F.col("guess") == F.col("truth")).alias("hits"), F.count_if(F.col("guess") < F.col("truth")).alias("green")
    )
    n = F.sum("counted")
    return sums.groupingSets([["model"], ["model", "hour"]], "model", "hour").agg(
        n.alias("counted"), F.round(F.sum("hits") / n, 4).alias("right_level"), F.round(F.sum("green") / n, 4).alias("too_green")
    )


def cell_features(readings: DataFrame, cells: DataFrame, n_cells: int) -> DataFrame:
    """Mean level per capture and grid cell, a row for every cell from 0; roads
    without a reading are level 0, and so are cells without roads.

    ``cells(edge_id, cell)``; sums are taken before the division by the cell's roads."""
    roads = cells.groupBy("cell").agg(F.count("*").alias("roads"))
    sums = readings.join(cells, "edge_id").groupBy("ts", "cell").agg(F.sum("level").alias("s"))
    every = readings.select("ts").distinct().withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(n_cells - 1))))
    return every.join(sums, ["ts", "cell"], "left").join(F.broadcast(roads), "cell", "left").select(
        "ts", "cell", (F.coalesce("s", F.lit(0)) / F.greatest(F.coalesce("roads", F.lit(0)), F.lit(1))).alias("mean_level")
    )


def scenarios(readings: DataFrame, cells: DataFrame, n_cells: int, k: int = 5, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Captures grouped by their pattern over the grid: the profile of each group,
    lightest first, with its name, and ``(ts, rank)``."""
    from ..materialise import cut
    from .learning import kmeans, kmeans_starts

    f = cell_features(readings, cells, n_cells)
    points = cut(f.groupBy("ts").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "mean_level"))), lambda x: x["mean_level"]).alias("features")))
    points = points.withColumn("id", F.unix_micros("ts"))
    found, _ = kmeans(points, kmeans_starts(points, k, seed))
    groups = cut(points.join(found, "id").select("ts", F.col("cluster").alias("group"), F.expr("aggregate(features, 0D, (s, x) -> s + x) / size(features)").alias("mean_level")))
    profile = scenario_profile(captures_of(readings), groups.select("ts", "group"), groups.select("ts", "mean_level"))
    profile = cut(profile.withColumn("name", scenario_name(F.col("rank"), profile.select("group").distinct().count())))
    return profile, groups.join(F.broadcast(profile.select("group", "rank")), "group").select("ts", "rank")


def scenario_profile(captures: DataFrame, groups: DataFrame, levels: DataFrame, top: int = 3) -> DataFrame:
    """Per group: captures, share, mean level, weekend share, the most common
    hours and a 24-bin histogram; ranked by mean level."""
    per = captures.join(groups, "ts").join(levels, "ts", "left").withColumn("hour", F.floor(F.col("minute") / 60).cast("int"))
    hours = per.groupBy("group", "hour").agg(F.count("*").alias("n"))
    best = hours.withColumn("r", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("n"), "hour"))).groupBy("group").agg(
        F.array_sort(F.collect_list(F.when(F.col("r") <= top, F.struct("r", "hour")))).alias("best"),
        F.map_from_entries(F.collect_list(F.struct("hour", "n"))).alias("bins"),
    )
    facts = per.groupBy("group").agg(F.count("*").alias("captures"), F.avg("mean_level").alias("mean_level"), F.avg(F.col("weekend").cast("int")).alias("weekend_share"))
    total = captures.agg(F.count("*").alias("total"))
    return facts.join(best, "group").join(F.broadcast(total)).select(
        "group", "captures", F.round(F.col("captures") / F.col("total"), 3).alias("share"), F.round("mean_level", 4).alias("mean_level"),
        F.round("weekend_share", 4).alias("weekend_share"), F.array_join(F.transform("best", lambda x: x["hour"].cast("string")), ",").alias("top_hours"),
        F.array_join(F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.try_element_at("bins", h), F.lit(0)).cast("string")), ",").alias("histogram"),
        F.row_number().over(Window.orderBy(F.round("mean_level", 4), "group")).alias("rank"),
    )


def scenario_name(rank, k: int):
    """Five fixed names for five groups, else 'r of k'; rank 1 is the lightest."""
    # Names of five groups.
    names = F.array(*[F.lit(n) for n in ("lightest", "light", "moderate", "heavy", "heaviest")])
    return F.element_at(names, rank) if k == 5 else F.concat(rank.cast("string"), F.lit(f" of {k} (1 = lightest)"))


def changed(frames: DataFrame) -> DataFrame:
    """Roads whose level differs from the frame before: what a player repaints."""
    before = F.lag("level").over(Window.partitionBy("edge_id").orderBy("ts"))
    return frames.withColumn("before", before).where(~F.col("level").eqNullSafe(F.col("before"))).drop("before")


def sessions(captures: DataFrame, limit_minutes: int = 25) -> DataFrame:
    """Runs of captures without a longer gap: one row per run."""
    return captures.groupBy(F.session_window("ts", f"{limit_minutes} minutes").alias("w")).agg(
        F.count("*").alias("captures"), F.min("ts").alias("first"), F.max("ts").alias("last")
    ).drop("w")


def longest_streak(log: DataFrame, by: list[str], order: str, bad: str) -> DataFrame:
    """The longest run of bad entries per key (a blocked source shows as one)."""
    w = Window.partitionBy(*by).orderBy(order)
    island = F.sum(F.when(F.col(bad), 0).otherwise(1)).over(w)
    return log.withColumn("_i", island).groupBy(*by, "_i").agg(F.count_if(F.col(bad)).alias("run")).groupBy(*by).agg(F.max("run").alias("longest_streak"))
