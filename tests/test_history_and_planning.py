from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lanewise.operators import history as H
from lanewise.operators import learning as M
from lanewise.operators import planning as P
from lanewise.operators.aggregates import majority


def test_vote_ties_go_to_the_worse_level(spark):
    votes = [(0, 0), (0, 1), (0, 1), (0, 2), (1, 3), (1, 3), (1, 0), (1, 0), (2, 2), (2, 2), (2, 2), (2, 0), (3, 1), (3, 1), (3, 2), (3, 2)]
    df = spark.createDataFrame(votes, "road int, level int")
    assert [r.level for r in majority(df, ["road"]).orderBy("road").collect()] == [1, 3, 2, 2]
    assert [r.level for r in majority(df, ["road"], worse=False).orderBy("road").collect()] == [1, 0, 2, 1]


def test_layouts_against_all_combinations(spark):
    from itertools import product

    domains = {"p": ["x", "y", "z"], "q": ["x", "y"], "r": ["y", "z"], "s": ["x", "z"]}
    differ = lambda a, b: ((a, b), lambda c: c[a] != c[b])
    problem = P.Problem(domains, [differ("p", "q"), differ("q", "r"), differ("p", "s"), (("r",), lambda c: c["r"] != "z")])
    fits = lambda n: lambda v: (n < 2 or v[0] != v[1]) and (n < 3 or (v[1] != v[2] and v[2] != "z")) and (n < 4 or v[0] != v[3])
    parts = [[v for v in product(*list(domains.values())[:n]) if all(fits(k)(v) for k in range(1, n + 1))] for n in range(5)]
    assert sorted(map(tuple, problem.solve(spark).collect())) == sorted(parts[4])
    for n, row in enumerate(problem.search_counts(spark).orderBy("position").collect()):
        tried = len(parts[n]) * len(list(domains.values())[n])
        assert (row.tried, row.crossed_out) == (tried, tried - len(parts[n + 1]))
        assert row.dead_ends == len(set(parts[n]) - {v[:n] for v in parts[n + 1]})
    none = P.Problem(domains, [(("q",), lambda c: c["q"] == "neither")])
    assert none.solve(spark).count() == 0 and none.search_counts(spark).where("variable = 'q'").first().dead_ends == 3


def at(text):
    return datetime.fromisoformat(text)


def readings(spark, rows):
    return spark.createDataFrame([(at(t), e, v, p) for t, e, v, p in rows], "ts timestamp, edge_id bigint, level int, painted int")


def test_first_folder_wins(spark):
    a = spark.createDataFrame([(1, "a"), (2, "a")], "k int, x string")
    b = spark.createDataFrame([(2, "b"), (3, "b")], "k int, x string")
    assert sorted(map(tuple, H.union_first([a, b], ["k"]).select("k", "x").collect())) == [(1, "a"), (2, "a"), (3, "b")]


def test_unlisted_roads_are_clear(spark):
    r = readings(spark, [("2026-09-17T00:00", 1, 3, 1)])
    dense = H.dense_levels(r, spark.range(3).withColumnRenamed("id", "edge_id"), H.captures_of(r))
    assert sorted((x.edge_id, x.level, x.painted) for x in dense.collect()) == [(0, 0, 0), (1, 3, 1), (2, 0, 0)]


def test_gaps_and_streaks(spark):
    caps = H.captures_of(readings(spark, [(f"2026-09-17T0{h}:{m:02d}", 0, 0, 1) for h, m in ((0, 0), (0, 8), (1, 0), (1, 20))]))
    assert [(r.gap) for r in H.gaps(caps, 20).collect()] == [52]
    assert H.longest_gap(caps).first().longest == 52
    assert H.sessions(caps, 25).count() == 2
    log = spark.createDataFrame([("s", i, x) for i, x in enumerate([1, 1, 0, 1, 1, 1])], "k string, n int, b int").withColumn("b", F.col("b") == 1)
    assert H.longest_streak(log, ["k"], "n", "b").first().longest_streak == 3


def test_same_time_prefers_the_weekday_then_the_gap_then_the_latest(spark):
    # Thursdays 10 and 3 September, Wednesday 9; asked: Thursday 17
    train = H.captures_of(readings(spark, [("2026-09-03T05:00", 0, 0, 1), ("2026-09-10T05:00", 0, 0, 1), ("2026-09-09T05:05", 0, 0, 1), ("2026-09-10T06:00", 0, 0, 1)]))
    asked = H.captures_of(readings(spark, [("2026-09-17T05:05", 0, 0, 1)]))
    r = H.same_time_captures(train, asked).first()
    assert (r.ts, r.gap) == (at("2026-09-10T05:00"), 5)


def test_midnight_is_near_on_the_circle(spark):
    train = H.captures_of(readings(spark, [("2026-09-16T17:50", 0, 0, 1), ("2026-09-16T06:00", 0, 0, 1)]))
    asked = H.captures_of(readings(spark, [("2026-09-16T18:10", 0, 0, 1)]))
    assert H.nearest_captures(train, asked, 1).first().ts == at("2026-09-16T17:50")


def test_scores_count_painted_roads_only(spark):
    r = readings(spark, [("2026-09-17T05:00", 1, 2, 1), ("2026-09-17T05:00", 2, 3, 0), ("2026-09-17T05:00", 3, 0, 1)])
    row = H.score(r, {"clear": H.always_clear(r, H.captures_of(r))}).where("hour IS NULL").first()
    assert (row.counted, row.right_level, row.too_green) == (2, 0.5, 0.5)


def blobs(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [(k * 60 + i, [float(x) for x in rng.normal(c, 0.3, 2)], k) for k, c in enumerate(((0, 0), (5, 5), (0, 5))) for i in range(60)]
    return spark.createDataFrame(rows, "id bigint, features array<double>, label int")


def test_kmeans_finds_blobs(spark):
    p = blobs(spark)
    found, centres = M.kmeans(p, [[1.0, 1.0], [4.0, 4.0], [1.0, 4.0]])
    assert found.agg(F.sum("d2")).first()[0] < 60
    assert found.join(p, "id").groupBy("cluster").agg(F.count_distinct("label").alias("n")).agg(F.max("n")).first()[0] == 1
    same = M.kmeans_mllib(p, 3).join(p, "id").groupBy("cluster").agg(F.count_distinct("label").alias("n"))
    assert same.agg(F.max("n")).first()[0] == 1


def test_knn_and_logistic_on_blobs(spark):
    p = blobs(spark)
    q = p.select(F.col("id").alias("q"), "features", "label")
    assert M.accuracy(M.knn_classify(p, q, 5), q).first().accuracy > 0.98
    near = M.neighbours(p, q, 3, block=50)  # several blocks
    assert near.count() == 180 * 3 and near.where("rank = 1").agg(F.max("d2")).first()[0] == 0.0
    out = M.logistic_ovr(p, p)
    assert out.where("label = predicted").count() > 0.97 * 180
    two = p.where("label < 2")
    w, b, losses = M.logistic_descent(two, rate=0.5, epochs=25)
    assert losses[-1] < losses[0] and w[0] > 0 and w[1] > 0
    with pytest.raises(Exception):
        M.kmeans(p, [])


def test_standardised_uses_the_population(spark):
    p = spark.createDataFrame([(0, [1.0, 5.0]), (1, [3.0, 5.0])], "id bigint, features array<double>")
    assert [r.features for r in M.standardised(p).orderBy("id").collect()] == [[-1.0, 0.0], [1.0, 0.0]]


def test_profiles_count_captures_that_dont_list_a_road(spark):
    r = readings(spark, [("2026-09-17T05:00", 1, 3, 1), ("2026-09-17T05:10", 2, 1, 1), ("2026-09-17T05:20", 2, 1, 1), ("2026-09-17T06:00", 2, 2, 1)])
    got = {(x.edge_id, x.hour): (x.n, x.mean_level) for x in H.hour_profile(r, H.captures_of(r)).collect()}
    assert got == {(1, None): (4, 0.75), (2, None): (4, 1.0), (1, 11): (3, 1.0), (2, 11): (3, pytest.approx(2 / 3)), (2, 12): (1, 2.0)}


def test_captures_that_dont_list_a_road_vote_clear(spark):
    train = [("2026-09-16T05:00", 1, 3, 1), ("2026-09-16T05:01", 2, 1, 1), ("2026-09-16T05:02", 2, 1, 1), ("2026-09-16T05:03", 1, 3, 1), ("2026-09-16T05:04", 3, 2, 1)]
    r = readings(spark, train)
    asked = H.captures_of(readings(spark, [("2026-09-17T05:02", 0, 0, 1)]))
    # road 1: 3, 3 and three times clear; road 2: 1, 1 and three times clear
    assert {x.edge_id: x.level for x in H.knn_forecast(r, H.captures_of(r), asked, 5).collect()} == {1: 0, 2: 0, 3: 0}
    tied = H.knn_forecast(readings(spark, train[:2]), H.captures_of(readings(spark, train[:2])), asked, 2)
    assert {x.edge_id: x.level for x in tied.collect()} == {1: 3, 2: 1}


def test_forecast_learns_from_training_captures_only(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(f"2026-09-{d:02d}T{h:02d}:00", e, int(min(3, max(1, round(h / 8 + e % 2 + rng.normal(0, 0.3))))), 1) for d in range(1, 10) for h in range(0, 24, 3) for e in range(4) if rng.random() < 0.8]
    r = readings(spark, rows)
    caps = H.with_split(H.captures_of(r))
    train, asked = caps.where("part = 'train'"), r.join(caps.where("part = 'test'").select("ts"), "ts").select("ts", "edge_id", "level")
    edges = spark.range(6).withColumnRenamed("id", "edge_id")
    got = {(x.ts, x.edge_id): x.predicted for x in M.logistic_forecast(r, edges, train, asked).collect()}
    # other levels in the tested captures change nothing
    late = r.join(caps.where("part <> 'train'").select("ts"), "ts", "left_semi").withColumn("level", F.lit(3))
    early = r.join(train.select("ts"), "ts", "left_semi")
    again = {(x.ts, x.edge_id): x.predicted for x in M.logistic_forecast(early.unionByName(late), edges, train, asked).collect()}
    assert got == again and len(got) == asked.count()

    # against whole tables by hand
    times = sorted({x.ts for x in train.collect()})
    level = {(x.ts, x.edge_id): x.level for x in r.collect()}
    local = lambda t: (t.hour + 6) % 24
    weekend = {x.ts: x.weekend for x in caps.collect()}
    dense = {(t, e): level.get((t, e), 0) for t in times for e in range(6)}
    overall = {e: np.mean([dense[t, e] for t in times]) for e in range(6)}

    def features(t, e):
        same = [dense[x, e] for x in times if local(x) == local(t) and weekend[x] == weekend[t]]
        a = 2 * np.pi * local(t) * 60 / 1440
        return [overall[e], np.mean(same) if same else overall[e], np.sin(a), np.cos(a), 3.0 * weekend[t]]

    x, y = np.array([features(t, e) for t, e in dense]), np.array(list(dense.values()))
    mean, sd = x.mean(axis=0), np.where(x.std(axis=0) == 0, 1, x.std(axis=0))
    score = []
    for c in range(4):
        w, b = np.zeros(5), 0.0
        for _ in range(300):
            p = 1 / (1 + np.exp(-((x - mean) / sd @ w + b)))
            w, b = w - 0.5 * ((x - mean).T / sd[:, None] @ (p - (y == c)) / len(y) + 1e-3 * w), b - 0.5 * (p - (y == c)).mean()
        score.append((w, b))
    for (t, e), found in got.items():
        z = [(np.array(features(t, e)) - mean) / sd @ w + b for w, b in score]
        assert found == int(np.argmax(z)) or sorted(z)[-1] - sorted(z)[-2] < 1e-9


def test_starts_are_drawn_by_distance(spark):
    p = blobs(spark)
    firsts = [M.kmeans_starts(p, 3, seed) for seed in range(8)]
    one_each = sum(len({(round(x / 5), round(y / 5)) for x, y in c}) == 3 for c in firsts)
    assert one_each >= 6 and all(len(c) == 3 for c in firsts)
    same = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(5)], "id bigint, features array<double>, label int")
    assert M.kmeans_starts(same, 3) == [[1.0, 2.0]]


def test_scenarios_tell_patterns_apart(spark):
    rows = [(f"2026-09-{d:02d}T{h:02d}:00", e, 3 if h < 12 else 1, 1) for d in range(1, 6) for h in range(0, 24, 2) for e in range(4) if e % 2 == (h < 12)]
    r = readings(spark, rows)
    cells = spark.createDataFrame([(e, e) for e in range(4)], "edge_id bigint, cell int")
    profile, groups = H.scenarios(r, cells, 9, k=2)
    got = profile.orderBy("rank").collect()
    assert [(x.captures, x.mean_level, x.name) for x in got] == [(30, round(2 / 9, 4), "1 of 2 (1 = lightest)"), (30, round(6 / 9, 4), "2 of 2 (1 = lightest)")]
    assert all((x.rank == 2) == (x.ts.hour < 12) for x in groups.collect())


def test_descent_of_table_and_array_agree(spark):
    import numpy as np

    two = blobs(spark).where("label < 2")
    w, b, losses = M.logistic_descent(two, rate=0.5, epochs=8)
    rows = two.collect()
    x, y = np.array([r.features for r in rows]), np.array([r.label for r in rows])
    want_w, want_b = M.descend_classes(x, y, 2, 0.5, 8)
    assert np.allclose(w, want_w[:, 1]) and abs(b - want_b[1]) < 1e-9 and losses == sorted(losses, reverse=True)
