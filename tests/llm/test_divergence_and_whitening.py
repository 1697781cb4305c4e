"""The audit of sources and the whitening of embeddings."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from lanewise.llm import divergence as V
from lanewise.llm import whitening as W


def audit_by_hand(rows, least=3, most=200):
    """All terms of a language against all pairs of its sources."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for g, _, w in docs if g == lang for t in set(w))
        kept = [t for t in df if df[t] >= least]
        counts = {s: Counter(t for g, x, w in docs if (g, x) == (lang, s) for t in w if df[t] >= least) for g, s, _ in docs if g == lang}
        whole = sum(counts.values(), Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))
        f = lambda a, b: (a - b) * (a - b) // b
        for s, c in counts.items():
            pairs = [(o, sum(f(p(c, t), p(d, t)) for t in kept)) for o, d in counts.items() if o != s]
            terms = [(t, f(p(c, t), p(whole, t))) for t in kept if c[t] and p(c, t) > p(whole, t)]
            for part, found, n in (("pair", pairs, len(pairs)), ("term", terms, most)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(found[:n], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_audit_by_hand(spark):
    r = np.random.default_rng(4)
    words = ["Alpha", "beta", "Gamma", "été", "漢", "x1y", "Ä", "delta's", "rare", "z"]
    rows = [(str(r.choice(["en", "de"])), f"s{r.integers(5)}", " ".join(r.choice(words, r.integers(0, 9), p=[0.3, 0.2, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05]))) for _ in range(120)]
    rows += [(None, None, "alone alone alone"), (None, "q", None), ("en", "empty", ""), ("fr", "a", "un"), ("fr", "b", "deux")]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    want = audit_by_hand(rows)
    assert rows_of(V.audit_sources(df)) == want
    # a sketch that is far too small discards less and changes nothing
    assert rows_of(V.audit_sources(df, width=8, depth=1)) == want
    assert rows_of(V.audit_sources(df, least_docs=1, most_terms=2)) == audit_by_hand(rows, 1, 2)


def test_sketch_never_underestimates():
    r = np.random.default_rng(1)
    sketch, truth = V.Sketch(3, 64, 2), Counter()
    for _ in range(20):
        counts = {f"t{k}".encode(): int(n) for k, n in zip(r.integers(0, 90, 10), r.integers(1, 3, 10))}
        sketch.add(b"en", counts)
        truth.update(counts)
    terms = list(truth)
    assert all(sketch.possible(b"en", terms)[[truth[t] >= 3 for t in terms]])
    big = V.Sketch(3, 1 << 16, 3)
    big.add(b"en", {b"once": 1, b"often": 9})
    assert big.possible(b"en", [b"once", b"often", b"never"]).tolist() == [False, True, False]


def test_shares_are_exact(spark):
    rows = [(0, 1), (5, 7), (10**9, 3 * 10**9 + 1), (8 * 10**12, 9 * 10**13), (89_999_999_999_998, 9 * 10**13)]
    got = spark.createDataFrame(rows, "n bigint, total bigint").select("n", "total", V.share(*map(V.F.col, ("n", "total"))).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (r.n + 1) // r.total for r in got]


def test_audit_edge_cases(spark, docs, rows, none):
    assert rows_of(V.audit_sources(docs)) == audit_by_hand([(r[2], r[3], r[1]) for r in rows])
    assert V.audit_sources(none).count() == 0


def test_tasks_hand_on_before_the_end(spark, monkeypatch):
    rows = [("en", f"s{k % 3}", f"common word{k % 7} w{k}") for k in range(60)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    held = V.HELD
    try:
        V.HELD = 5
        assert rows_of(V.audit_sources(df)) == audit_by_hand(rows)
    finally:
        V.HELD = held


def whitened_by_hand(vectors, components=4):
    good = [v for v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(256 * float(np.float32(c))) for c in v] for v in good]
    fit = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, total = len(fit), fit.sum(axis=0)
    y = (n * fit - total).astype(float) / n
    v = y.T @ y / n
    e, axes = np.linalg.eigh(v)
    order = np.argsort(-e)[:components]
    y = (np.array(x) - np.array([s / n for s in total])) @ axes[:, order] / np.sqrt(e[order])
    return n, [int(((n * np.array(r, dtype=object) - total) ** 2).sum()) for r in x], np.abs(y), e[order] / np.trace(v)


@pytest.mark.parametrize("side", [3, 16, 37])
def test_whitening_by_hand(spark, side, monkeypatch):
    r = np.random.default_rng(side)
    v = (r.normal(size=(300, side)) * np.linspace(3, 0.5, side)).astype(np.float32)
    vectors = [*v.tolist(), *v[:20].tolist(), *[v[0].tolist()] * 100]
    bad = [None, [None] + [0.0] * (side - 1), [float("nan")] * side, [float("inf")] + [0.0] * (side - 1), [], [1.0] * (side + 1), [3e38] * side]
    df = spark.createDataFrame([(k, x, "id", "x") for k, x in enumerate([*vectors, *bad])], "vec_id bigint, embedding array<float>, id string, x string")
    got = W.whiten(df.repartition(7)).collect()
    n, deviation, y, explained = whitened_by_hand(vectors)
    k = min(4, side)
    assert len(got) == len(vectors) * k
    for r in got:
        assert r.n == n == 300 and int(r.deviation) == deviation[r.id]
        assert abs(abs(r.whitened) - y[r.id, r.component - 1]) < 1e-9
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
    sign = {(r.id, r.component): r.whitened for r in got}
    assert all(sign[0, c] == sign[300, c] == sign[330, c] for c in range(1, k + 1))


def test_row_blocks_and_big_numbers(spark):
    W_rows = W.BLOCK_ROWS
    try:
        W.BLOCK_ROWS = 7
        r = np.random.default_rng(0)
        v = r.normal(size=(100, 20)) * 1e7
        df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id bigint, embedding array<double>")
        got = W.whiten(df).collect()
        x = np.floor(256 * v).astype(np.int64).astype(object)
        n, s = 100, x.sum(axis=0)
        want = [int(((n * row - s) ** 2).sum()) for row in x]
        assert all(int(r.deviation) == want[r.id] for r in got) and max(want) > 2**63
    finally:
        W.BLOCK_ROWS = W_rows


def test_whitening_without_variance(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert W.whiten(spark.createDataFrame([], schema)).count() == 0
    assert W.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    same = W.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], schema)).collect()
    assert len(same) == 4 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.n == 1 and r.deviation == 0 for r in same)
    flat = W.whiten(spark.createDataFrame([(i, [float(i), 0.0]) for i in range(5)], schema)).collect()
    assert {(r.component, r.whitened is None) for r in flat} == {(1, False), (2, True)} and all(r.identity_error < 1e-9 for r in flat)


def test_whitening_query(spark, data):
    from lanewise.llm.queries import op13_tiled_whitening

    rows = [tuple(r) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = op13_tiled_whitening(spark, data).collect()
    n, deviation, y, explained = whitened_by_hand([v for _, v in rows])
    place = {k: i for i, (k, _) in enumerate(rows)}
    assert len(got) == 4 * len(rows)
    for r in got:
        i = place[r.vec_id]
        assert r.n == n and r.deviation == deviation[i] and abs(abs(r.whitened) - y[i, r.component - 1]) < 1e-8
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-6 and r.identity_error < 1e-8
