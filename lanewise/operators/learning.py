"""Nearest neighbours, clusters and logistic models on feature arrays.

Points are ``(id, features ARRAY<DOUBLE>, label)``. Neighbour searches compare a
stated set of queries, in blocks, with all points: the block is what is sent
around, and each task keeps ``k`` candidates a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..materialise import cut, small_batches

#: Queries compared at once with a batch of points.
BLOCK = 2048
#: Points of a batch and queries of a block that meet in one matrix.
POINTS_AT_ONCE, QUERIES_AT_ONCE = 256, 256


def distance2(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def standardised(points: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """Features minus mean over the population's deviation (1 where that is 0);
    both are those of ``like`` if given (training points, say)."""
    each = (points if like is None else like).select(F.posexplode("features").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    sd = F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))
    stats = each.agg(F.array_sort(F.collect_list(F.struct("pos", "m", sd.alias("s")))).alias("stats"))  # a row of the dimension
    return points.join(F.broadcast(stats)).withColumn("features", F.zip_with("features", "stats", lambda x, t: (x - t["m"]) / t["s"])).drop("stats")


def nearest_of_batches(batches: Iterator[pa.RecordBatch], q: np.ndarray, x: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The ``k`` nearest of all points ``(id, features)`` to each row of ``x``."""
    best_d, best_i = np.full((len(q), 0), np.inf), np.zeros((len(q), 0), np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, POINTS_AT_ONCE):
            part = batch.slice(at, POINTS_AT_ONCE)
            ids = part.column(0).to_numpy()
            p = np.asarray(part.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(len(ids), -1)
            new_d, new_i = [], []
            for first in range(0, len(q), QUERIES_AT_ONCE):
                rows = slice(first, first + QUERIES_AT_ONCE)
                d = np.stack([((p - v) ** 2).sum(axis=1) for v in x[rows]])
                all_d, all_i = np.hstack([best_d[rows], d]), np.hstack([best_i[rows], np.broadcast_to(ids, d.shape)])
                order = np.lexsort((all_i, all_d), axis=1)[:, :k]
                new_d.append(np.take_along_axis(all_d, order, 1))
                new_i.append(np.take_along_axis(all_i, order, 1))
            best_d, best_i = np.concatenate(new_d), np.concatenate(new_i)
    if m := best_d.shape[1]:
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, m)), pa.array(best_i.ravel()), pa.array(best_d.ravel())], ["q", "id", "d2"])


def neighbours(points: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """The ``k`` nearest points of each query ``(q, features)``: ``(q, id, d2, rank)``.

    Queries come to the driver block by block; each block is broadcast and every
    task returns its ``k`` best per query, so what is shuffled grows with queries
    times tasks and not with points. A task's matrices are of ``QUERIES_AT_ONCE`` by
    ``POINTS_AT_ONCE``, whatever the size of block and batch. Ties go to the lower id;
    a query is matched with points of its own id too."""
    spark = points.sparkSession
    n = max(1, -(-queries.count() // block))
    kept = points.select(F.col("id").cast("bigint").alias("id"), F.col("features").cast("array<double>").alias("features"))
    out = None
    for i in range(n):
        # one block is on the driver and the executors at a time
        frame = (queries if n == 1 else queries.where(F.pmod(F.xxhash64("q"), F.lit(n)) == i)).select("q", "features").toPandas()
        if not len(frame):
            continue
        sent = spark.sparkContext.broadcast((frame["q"].to_numpy(np.int64), np.stack(frame["features"].to_numpy()).astype(np.float64)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            return nearest_of_batches(batches, *sent.value, k)

        small_batches(kept)
        part = kept.mapInArrow(run, "q bigint, id bigint, d2 double")
        if n > 1:
            part = cut(part)
            sent.destroy()
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "q bigint, id bigint, d2 double")
    w = Window.partitionBy("q").orderBy("d2", "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_classify(points: DataFrame, queries: DataFrame, k: int, weighted: bool = True) -> DataFrame:
    """``(q, label)``: votes by 1 / distance, or equal ones; ties go to the lower label."""
    near = neighbours(points, queries, k).join(points.select("id", "label"), "id")
    vote = 1.0 / (F.sqrt("d2") + 1e-9) if weighted else F.lit(1.0)
    sums = near.groupBy("q", "label").agg(F.sum(vote).alias("w"))
    return sums.groupBy("q").agg(F.max_by("label", F.struct("w", -F.col("label"))).alias("label"))


def knn_regress(points: DataFrame, queries: DataFrame, k: int, weighted: bool = True) -> DataFrame:
    near = neighbours(points, queries, k).join(points.select("id", "label"), "id")
    w = 1.0 / (F.sqrt("d2") + 1e-6) if weighted else F.lit(1.0)
    return near.groupBy("q").agg((F.sum(w * F.col("label")) / F.sum(w)).alias("value"))


def accuracy(found: DataFrame, truth: DataFrame) -> DataFrame:
    return found.join(truth.withColumnRenamed("label", "truth"), "q").agg(F.avg((F.col("label") == F.col("truth")).cast("int")).alias("accuracy"), F.count("*").alias("n"))


def kmeans(points: DataFrame, centres: list[list[float]], rounds: int = 100, tolerance: float = 1e-4) -> tuple[DataFrame, list[list[float]]]:
    """Lloyd's rounds from given centres: ``(id, cluster, d2)`` and the centres.

    Centres are literals in the plan; a round is one aggregation with partial
    sums. Ties go to the lower cluster; an empty cluster keeps its centre."""
    centres = [list(map(float, c)) for c in centres]
    points = points.select("id", F.col("features").cast("array<double>").alias("features"))

    def nearest(cs: list[list[float]]) -> Column:
        return F.least(*[F.struct(distance2("features", F.array(*[F.lit(x) for x in c])).alias("d2"), F.lit(i).alias("cluster")) for i, c in enumerate(cs)])

    dims = len(centres[0])
    for _ in range(rounds):
        sums = points.withColumn("n", nearest(centres)).groupBy("n.cluster").agg(*[F.avg(F.col("features")[j]).alias(f"x{j}") for j in range(dims)]).collect()
        moved = [list(c) for c in centres]
        for r in sums:
            moved[r["cluster"]] = [r[f"x{j}"] for j in range(dims)]
        shift = max(sum((a - b) ** 2 for a, b in zip(c, m)) ** 0.5 for c, m in zip(centres, moved))
        centres = moved
        if shift < tolerance:
            break
    return points.withColumn("n", nearest(centres)).select("id", "n.cluster", "n.d2"), centres


def kmeans_starts(points: DataFrame, k: int, seed: int = 0) -> list[list[float]]:
    """Centres to start from: a point at random, then points drawn in proportion
    to the squared distance from the nearest centre. A draw is one aggregation:
    the least of exponential variables with those rates, by hashed uniform
    numbers. Fewer distinct points than ``k`` give fewer centres."""
    points = points.select("id", F.col("features").cast("array<double>").alias("features"))
    centres: list[list[float]] = []
    for n in range(k):
        unit = (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(n)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
        far = F.least(*[distance2("features", F.array(*[F.lit(x) for x in c])) for c in centres], F.lit(float("inf"))) if centres else F.lit(1.0)
        drawn = points.withColumn("far", far).where("far > 0").agg(F.min_by("features", F.struct(-F.ln(unit) / F.col("far"), "id")).alias("c")).first()["c"]
        if drawn is None:
            break
        centres.append(list(drawn))
    return centres


def kmeans_mllib(points: DataFrame, k: int, seed: int = 0, rounds: int = 100) -> DataFrame:
    """Clusters with k-means|| starts: ``(id, cluster)``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = points.withColumn("v", array_to_vector(F.col("features").cast("array<double>")))
    model = KMeans(k=k, seed=seed, maxIter=rounds, tol=1e-4, featuresCol="v", predictionCol="cluster").fit(data)
    return model.transform(data).select("id", "cluster")


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))


def logistic_descent(points: DataFrame, rate: float = 0.1, epochs: int = 500, l2: float = 1e-3) -> tuple[list[float], float, list[float]]:
    """Full-batch gradient descent from zero for labels 0 and 1: weights, bias
    and losses. Each epoch is one aggregation; the penalty spares the bias."""
    points = points.select(F.col("features").cast("array<double>").alias("features"), F.col("label").cast("double").alias("y")).cache()
    dims = len(points.first()["features"])
    w, b, losses = [0.0] * dims, 0.0, []
    for _ in range(epochs):
        z = F.lit(b)
        for j, x in enumerate(w):
            z = z + F.col("features")[j] * x
        rows = points.withColumn("p", sigmoid(z))
        e = F.col("p") - F.col("y")
        loss = F.avg(-F.col("y") * F.ln(F.col("p") + 1e-12) - (1 - F.col("y")) * F.ln(1 - F.col("p") + 1e-12))
        r = rows.agg(F.avg(e).alias("b"), loss.alias("loss"), *[F.avg(e * F.col("features")[j]).alias(f"g{j}") for j in range(dims)]).first()
        w = [x - rate * (r[f"g{j}"] + l2 * x) for j, x in enumerate(w)]
        b -= rate * r["b"]
        losses.append(r["loss"])
    points.unpersist()
    return w, b, losses


def logistic_ovr(train: DataFrame, test: DataFrame, rounds: int = 100, l2: float = 1e-3) -> DataFrame:
    """One model per label, the highest probability wins: ``(id, label, predicted)``."""
    from pyspark.ml.classification import LogisticRegression, OneVsRest
    from pyspark.ml.functions import array_to_vector

    vec = lambda df: df.select("id", F.col("label").cast("double").alias("label"), array_to_vector(F.col("features").cast("array<double>")).alias("features"))
    model = OneVsRest(classifier=LogisticRegression(maxIter=rounds, regParam=l2, standardization=False)).fit(vec(train))
    return model.transform(vec(test)).select("id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("predicted"))


def level_features(rows: DataFrame, readings: DataFrame, captures: DataFrame) -> DataFrame:
    """``rows(ts, edge_id, level)`` with features for a level forecast: the road's
    mean, its mean for the kind of day and hour (the road's mean where no capture
    is of that kind), and the time's place on the day.

    Means are learnt from the ``captures`` given, the training ones, and from
    ``readings`` of those captures only."""
    from ..functions import clock
    from .history import hour_profile

    p = hour_profile(readings.join(F.broadcast(captures.select("ts")), "ts", "left_semi"), captures)
    road = p.where("hour IS NULL").select("edge_id", F.col("mean_level").alias("overall"))
    cell = p.where("hour IS NOT NULL").select("edge_id", "weekend", "hour", F.col("mean_level").alias("profile"))
    seen = captures.select("weekend", F.floor(F.col("minute") / 60).cast("int").alias("hour")).distinct().withColumn("seen", F.lit(0.0))
    ts = F.col("ts")
    r = rows.withColumns({"weekend": clock.weekend(ts), "hour": F.floor(clock.minute_of_day(ts) / 60).cast("int"), "minute": clock.minute_of_day(ts)})
    both = r.join(road, "edge_id", "left").join(cell, ["edge_id", "weekend", "hour"], "left").join(F.broadcast(seen), ["weekend", "hour"], "left")
    f = F.concat(F.array(F.coalesce("overall", F.lit(0.0)), F.coalesce("profile", "seen", "overall", F.lit(0.0))), clock.time_features(F.col("minute"), F.col("weekend")))
    return both.select("ts", "edge_id", F.col("level").alias("label"), f.alias("features"))


def descend_classes(x: np.ndarray, y: np.ndarray, classes: int, rate: float, epochs: int, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """One logistic model per class against the rest, by full-batch gradient
    descent from zero, all classes in one step: weights and biases."""
    hot = (y[:, None] == np.arange(classes)).astype(float)
    w, b = np.zeros((x.shape[1], classes)), np.zeros(classes)
    for _ in range(epochs):
        miss = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - hot
        w -= rate * (x.T @ miss / len(x) + l2 * w)
        b -= rate * miss.mean(axis=0)
    return w, b


def logistic_forecast(
    readings: DataFrame, edges: DataFrame, train: DataFrame, asked: DataFrame, samples: int = 200_000, epochs: int = 300, rate: float = 0.5, seed: int = 0
) -> DataFrame:
    """Levels of ``asked(ts, edge_id, level)`` by one-vs-rest models on profiles
    of the ``train`` captures: ``(ts, edge_id, label, predicted)``.

    The models are fitted on about ``samples`` pairs of a training capture and a
    road, drawn by a hash from all such pairs (a road that a capture doesn't list
    is level 0 in it); this sample, a few MB, is what comes to the driver."""
    pairs = train.count() * edges.count()
    if not pairs:
        return asked.select("ts", "edge_id", F.col("level").alias("label"), F.lit(0).alias("predicted"))
    draw = F.pmod(F.xxhash64("ts", "edge_id", F.lit(seed)), F.lit(1 << 30)) < min(1.0, samples / pairs) * (1 << 30)
    drawn = edges.select("edge_id").join(F.broadcast(train.select("ts"))).where(draw)
    known = readings.select("ts", "edge_id", "level")
    sample = drawn.join(known, ["ts", "edge_id"], "left").select("ts", "edge_id", F.coalesce("level", F.lit(0)).alias("level"))
    learn = level_features(sample, readings, train).select("features", "label").toPandas()
    x, y = np.stack(learn["features"].to_numpy()) if len(learn) else np.zeros((1, 5)), learn["label"].to_numpy() if len(learn) else np.zeros(1)
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd == 0] = 1.0
    w, b = descend_classes((x - mean) / sd, y, 4, rate, epochs)
    f = F.col("features")
    z = [sum(((f[j] - float(mean[j])) / float(sd[j]) * float(w[j, c]) for j in range(x.shape[1])), F.lit(float(b[c]))) for c in range(4)]
    best = F.greatest(*[F.struct(v.alias("z"), F.lit(-c).alias("c")) for c, v in enumerate(z)])
    return level_features(asked, readings, train).select("ts", "edge_id", "label", (-best["c"]).alias("predicted"))
