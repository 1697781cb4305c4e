"""Sharding and mixing."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from lanewise.llm import mixing as M
from lanewise.llm import sharding as H


def check_shards(got, shards):
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert set(slots) <= set(range(shards))


def test_sharding_query(spark, data, small):
    from lanewise.llm.queries import op3_lpt_sharding

    got = op3_lpt_sharding(spark, data).collect()
    texts = dict(small)
    assert sorted(r.doc_id for r in got) == sorted(texts)
    check_shards(got, 40)
    shard_of, loads = defaultdict(set), defaultdict(int)
    for r in got:
        b = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(b) + 16, zlib.crc32(b), "bytes", None)
        shard_of[texts[r.doc_id]].add(r.shard)
        loads[r.shard] += r.size
    fair = sum(loads.values()) / 40
    sizes = defaultdict(int)
    for r in got:
        sizes[texts[r.doc_id]] += r.size
    assert all(len(s) == 1 for t, s in shard_of.items() if sizes[t] <= fair)
    assert max(loads.values()) <= max(fair * 1.02, max(sizes.values()))


def test_hot_group_is_split_and_sizes_stay_near_equal(spark):
    rows = [(i, "the same text of the hot group") for i in range(2000)] + [(10_000 + i, f"text {i} " + "x" * (i % 97)) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = H.assign_shards(docs, shards=8).collect()
    check_shards(got, 8)
    loads = np.bincount([r.shard for r in got], [r.size for r in got], 8)
    assert loads.max() / loads.mean() < 1.02 and loads.min() / loads.mean() > 0.98
    again = {(r.id, r.slot): r.shard for r in H.assign_shards(docs, shards=8).collect()}
    assert again == {(r.id, r.slot): r.shard for r in got}


def test_sharding_edge_cases(docs, rows, none):
    got = H.assign_shards(docs, shards=4).collect()
    assert len(got) == len(rows)
    check_shards(got, 4)
    empty = [r for r in got if r.id == 4]
    assert [(r.size, r.crc) for r in empty] == [(16, 0)]
    assert H.assign_shards(none, shards=4).count() == 0


def brute_schedule(runs, shards):
    loads, out = [0.0] * shards, []
    for size, count in runs:
        took = [0] * shards
        for _ in range(count):
            k = min(range(shards), key=lambda j: (loads[j], j))
            took[k] += 1
            loads[k] += size
        out.append(took)
    return out


def test_schedule_is_longest_first():
    assert H.schedule([(5, 1), (4, 1), (3, 3)], 2) == [[1, 0], [0, 1], [1, 2]]
    rng = np.random.default_rng(2)
    for _ in range(300):
        shards = int(rng.integers(1, 9))
        runs = [(int(s), int(rng.choice([1, 2, 7, 60, 200]))) for s in sorted(rng.integers(1, 90, 6), reverse=True)]
        got, want = H.schedule(runs, shards), brute_schedule(runs, shards)
        # of shards with one load any may come first; the loads must agree run by run
        a = b = np.zeros(shards)
        for (size, _), x, y in zip(runs, got, want):
            a, b = np.sort(a + size * np.array(x)), np.sort(b + size * np.array(y))
            assert a.tolist() == b.tolist()


def test_groups_are_scheduled_by_size(spark):
    """No group of any size is more than its own size from the least-loaded shard."""
    rng = np.random.default_rng(6)
    rows = [(i, "x" * int(rng.pareto(1.1) * 50)) for i in range(3000)]
    got = H.assign_shards(spark.createDataFrame(rows, "doc_id bigint, text string"), shards=7).collect()
    check_shards(got, 7)
    loads = np.bincount([r.shard for r in got], [r.size for r in got], 7)
    text, group = dict(rows), defaultdict(int)
    for r in got:
        group[text[r.id]] += r.size
    assert loads.max() - loads.min() <= min(group.values()) + 0.001 * loads.max()


def test_repeated_rows_of_one_id_are_dealt_evenly(spark):
    rows = [(1, "the one text")] * 10_000 + [(None, "another text")] * 5_000 + [(i, f"text {i}") for i in range(100)]
    got = H.assign_shards(spark.createDataFrame(rows, "doc_id bigint, text string"), shards=8).collect()
    check_shards(got, 8)
    loads = np.bincount([r.shard for r in got], [r.size for r in got], 8)
    assert loads.max() / loads.mean() < 1.02 and loads.min() / loads.mean() > 0.98


def test_slots_follow_an_order(spark):
    from pyspark.sql import functions as F

    rows = [(i, f"text {i % 400} " + "x" * (i % 31)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    place = (F.col("doc_id") * 7919) % 2003
    got = H.assign_shards(docs, shards=5, order=(F.floor(place / 100), place), keep=[place.alias("place")]).collect()
    check_shards(got, 5)
    for s in range(5):
        places = [r.place for r in sorted((r for r in got if r.shard == s), key=lambda r: r.slot)]
        assert places == sorted(places) and len(places) > 300


def fill(sizes):
    """Water filling by repeated resharing, as the contract words it."""
    weights = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, open_, goal = float(sum(sizes.values())), set(sizes), {}
    while open_:
        w = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / w > 3 * sizes[s]]
        if not over:
            return goal | {s: left * weights[s] / w for s in open_}
        for s in over:
            goal[s] = 3.0 * sizes[s]
            left -= goal[s]
            open_.discard(s)
    return goal


def test_targets_and_takings(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(0, 60)), None if i % 13 == 0 else f"s{i % 5 if i % 3 else 0}") for i in range(3000)]
    rows += [(5000 + i, "tiny words", "zz") for i in range(3)] + [(7000, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = M.mix_sources(docs).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += len(r[1].split())
    goal = fill(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(goal[r.source]) and r.source_size == sizes[r.source]
        assert r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in goal.items():
        assert abs(taken[s] - t) <= 60
    again = {(r.id, r.size, r.taken) for r in M.mix_sources(docs.repartition(7)).collect()}
    assert again == {(r.id, r.size, r.taken) for r in got}


def test_positions_follow_the_schedules(spark):
    rows = [(i, "five words are in here", "abc"[i % 3]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = M.curriculum(docs).collect()
    places = [r.position for r in got]
    assert places == sorted(places) and 0 <= places[0] and places[-1] <= 1
    early = defaultdict(list)
    for r in got:
        early[r.source].append(r.position <= 0.5)
    share = {s: np.mean(v) for s, v in early.items()}
    # integrals of the default schedules up to the middle: 0.625, 0.5, 0.375
    assert share["a"] == pytest.approx(0.625, abs=0.01) and share["b"] == pytest.approx(0.5, abs=0.01) and share["c"] == pytest.approx(0.375, abs=0.01)


def test_mixing_edge_cases(docs, rows, none):
    got = M.mix_sources(docs).collect()
    assert len(got) == len(rows)
    assert {r.size for r in got if r.id in (3, 4, 5)} == {0}
    assert M.mix_sources(none).count() == 0
    assert M.curriculum(none).count() == 0 and M.curriculum_documents(none).count() == 0
    assert M.curriculum_documents(docs).count() == len(rows)


def area(knots, t):
    """Integral of a piecewise-linear schedule up to ``t``, by small steps."""
    at = np.linspace(0, t, 20001)
    return np.trapezoid(np.interp(at, np.linspace(0, 1, len(knots)), knots), at)


def test_a_position_is_where_the_integral_meets_the_demand(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "w " * int(rng.integers(0, 40)), "abcd"[int(rng.integers(0, 4))]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for r in M.curriculum(df).collect():
        share = min(1.0, (r.copy * r.source_size + r.demand + r["size"] / 2) / max(r.target, 1.0))
        assert area(r.knots, r.position) == pytest.approx(share * r.areas[-1], abs=1e-6)
    got = M.curriculum_documents(df).collect()
    by_copy = defaultdict(list)
    for r in M.curriculum(df).collect():
        by_copy[r.id].append(r.position)
    for r in got:
        assert (r.position, r.last_position) == ((min(by_copy[r.id]), max(by_copy[r.id])) if r.copies else (None, None))
    places = [r.position for r in got if r.position is not None]
    assert places == sorted(places) and all(r.position is None for r in got[len(places):])
