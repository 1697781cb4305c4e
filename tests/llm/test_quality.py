import zlib

import numpy as np

from lanewise.llm import quality as Q


def test_held_out_accuracy(spark, data):
    """Labels of held-out rows are never seen; sf0.01 has a few hundred others."""
    from lanewise.llm.queries import op10_nbsvm_quality

    where = data.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{where}/labels.parquet").collect()}
    got = op10_nbsvm_quality(spark, where).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    tested = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert len(tested) > 50
    assert np.mean([p == q for p, q in tested]) >= 0.93


def test_labels_of_held_out_rows_do_not_matter(spark, data):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    turned = labels.withColumn("quality", F.when(Q.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = Q.train(docs, labels), Q.train(docs.repartition(3), turned)
    assert np.array_equal(a.coef, b.coef) and (a.bias, a.slope, a.shift) == (b.bias, b.slope, b.shift)


def test_descent_reaches_the_dual_optimum():
    """Against projected gradient ascent on the same dual problem."""
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 40, 6)).astype(np.int32) for _ in range(60)]
    y = np.where([np.mean(x) > 19 for x in rows], 1.0, -1.0)
    r = Q.log_count_ratios(rows, y)
    c = 0.5
    coef, bias = Q.descend(rows, y, r, c, 400)
    x = np.zeros((60, 41))
    for i, idx in enumerate(rows):
        x[i, idx] = r[idx] / len(idx) ** 0.5
    x[:, 40] = 1
    cap = np.where(y > 0, c / (2 * (y > 0).mean()), c / (2 * (y < 0).mean()))
    k = (x @ x.T) * y[:, None] * y[None, :]
    a = np.zeros(60)
    for _ in range(20_000):
        a = np.clip(a + (1 - k @ a) / np.linalg.norm(k, 2), 0, cap)
    w = x.T @ (a * y)
    primal = lambda w: 0.5 * w @ w + (cap * np.maximum(0, 1 - y * (x @ w))).sum()
    got = np.append(np.divide(coef[:40], r[:40], out=np.zeros(40), where=r[:40] != 0), bias)
    assert primal(got) <= primal(w) * 1.001


def test_features_see_whole_texts():
    text = ("plain words " * 50_000).encode()
    assert not np.array_equal(Q.features(text), Q.features(text + b"LAST!!"))
    assert len(Q.features(None)) == len(Q.features(b"")) >= 1


def test_one_class_or_none_gives_a_constant():
    for labels, least in (([], 0.5), ([1, 1, 1], 0.79), ([0, 0], 0.2)):
        m = Q.fit([Q.features(b"a b c")] * len(labels), labels)
        assert m.score(Q.features(b"x")) == m.score(Q.features(b"")) and abs(m.score(Q.features(b"x")) - least) < 0.06


def test_edge_cases(spark, docs, rows, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (3, 0, 0), (8, 1, 0), (None, 1, 0), (6, None, None)], "doc_id bigint, quality int, toxic int")
    model = Q.train(docs, labels)
    got = Q.score_documents(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    kept = Q.keep_quality(docs, model, least=0.0)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert Q.score_documents(none, model).count() == 0
    assert Q.train(none, labels.where("false")).score(Q.features(b"x")) == 0.5


class Plain:
    """The whole model over dicts and single numbers, without arrays of features."""

    MASK = (1 << 64) - 1

    def __init__(self, texts, labels):
        self.rows = [self.slots(t) for t in texts]
        self.y = [1 if x else -1 for x in labels]

    def slots(self, text):
        mix, bits = 0x9E3779B97F4A7C15, 18
        salted = lambda h, kind: ((((h ^ zlib.crc32(kind.encode())) * mix) & self.MASK) >> (64 - bits))
        kind = lambda b: "A" if 65 <= b <= 90 else "a" if 97 <= b <= 122 else "0" if 48 <= b <= 57 else "u" if b >= 128 else chr(b)
        words = (text or "").encode().lower().split()
        shapes = ["".join(map(kind, w)) for w in (text or "").encode().split()]
        out = {salted(zlib.crc32(w), "word") for w in words}
        for name, items in (("pair", words), ("shape", [(s[:2] + s[-2:]).encode() for s in shapes])):
            out |= {salted((zlib.crc32(a) * mix + zlib.crc32(b)) & self.MASK, name) for a, b in zip(items, items[1:])}
        again, longest, run = 0, 1, 1
        for a, b in zip(words, words[1:]):
            run = run + 1 if a == b else 1
            again, longest = again + (a == b), max(longest, run)
        marks = [f"l{len(words).bit_length()}"] + [f"r{k}" for k in range(2, min(longest, 8) + 1)] + [f"q{k}" for k in range(1, 9) if words and 16 * again >= k * len(words)]
        return sorted(out | {zlib.crc32(m.encode()) % (1 << bits) for m in marks})

    def ratios(self, rows, y):
        import math

        up, down = {}, {}
        for row, label in zip(rows, y):
            for j in row:
                (up if label > 0 else down)[j] = (up if label > 0 else down).get(j, 0) + 1
        a, b = sum(up.values()) + (1 << 18), sum(down.values()) + (1 << 18)
        return lambda j: math.log((1 + up.get(j, 0)) / a) - math.log((1 + down.get(j, 0)) / b)

    def hinge(self, rows, y, epochs):
        r = self.ratios(rows, y)
        x = [{j: r(j) / max(1, len(row)) ** 0.5 for j in row} for row in rows]
        share = {s: sum(v == s for v in y) / len(y) for s in (1, -1)}
        w, bias, alpha, rng = {}, 0.0, [0.0] * len(y), np.random.default_rng(7)
        for _ in range(epochs):
            worst = 0.0
            for i in rng.permutation(len(y)):
                g = y[i] * (sum(w.get(j, 0.0) * v for j, v in x[i].items()) + bias) - 1
                new = min(1 / (2 * share[y[i]]), max(0.0, alpha[i] - g / (sum(v * v for v in x[i].values()) + 1)))
                worst = max(worst, abs(new - alpha[i]))
                for j, v in x[i].items():
                    w[j] = w.get(j, 0.0) + (new - alpha[i]) * y[i] * v
                bias += (new - alpha[i]) * y[i]
                alpha[i] = new
            if worst < 1e-3:
                break
        return lambda row: sum(w.get(j, 0.0) * r(j) for j in row) / max(1, len(row)) ** 0.5 + bias

    def fit(self):
        import math

        held = [0.0] * len(self.y)
        for k in range(3):
            inside = [i for i in range(len(self.y)) if i % 3 != k]
            margin = self.hinge([self.rows[i] for i in inside], [self.y[i] for i in inside], 6)
            for i in range(k, len(self.y), 3):
                held[i] = margin(self.rows[i])
        margin = self.hinge(self.rows, self.y, 12)
        up, down = self.y.count(1), self.y.count(-1)
        t = [(up + 1) / (up + 2) if v > 0 else 1 / (down + 2) for v in self.y]
        spread = float(np.std(held))
        a, b = 0.0, 0.0
        for _ in range(40_000):  # plain gradient descent on the smoothed loss
            p = [1 / (1 + math.exp(-(a * h / spread + b))) for h in held]
            ga = sum((p_ - t_) * h / spread for p_, t_, h in zip(p, t, held)) + 1e-2 * a
            gb = sum(p_ - t_ for p_, t_ in zip(p, t))
            a, b = a - 0.02 * ga, b - 0.02 * gb
            if abs(ga) + abs(gb) < 1e-9:
                break
        return lambda text: 1 / (1 + math.exp(-max(-30.0, min(30.0, a / spread * margin(self.slots(text)) + b))))


def test_scores_against_plain_loops(spark, data, small):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    order = lambda d: (zlib.crc32(str(d).encode()), str(d))
    learnt = sorted((d for d, _ in small if d in labels and zlib.crc32(str(d).encode()) % 4 != 2), key=order)[:60]
    text = dict(small)
    for t in list(text.values())[:50]:
        assert Q.features(t.encode()).tolist() == Plain([], []).slots(t)
    docs = spark.createDataFrame(small, "doc_id bigint, text string")
    model = Q.train(docs, spark.createDataFrame([(d, labels[d]) for d in learnt], "doc_id bigint, quality int"))
    want = Plain([text[d] for d in learnt], [labels[d] for d in learnt]).fit()
    got = {r.id: r.score for r in Q.score_documents(docs, model).collect()}
    assert len(got) == len(text) and max(abs(got[d] - want(t)) for d, t in text.items()) < 1e-3


def test_sample_keeps_to_its_features(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(100))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    seen = []
    fit, Q.fit = Q.fit, lambda rows, labels: seen.append(sum(map(len, rows))) or fit(rows, labels)
    try:
        Q.train(docs, labels)
        Q.train(docs, labels, most_features=2_000)
    finally:
        Q.fit = fit
    assert seen[0] > 4_000 and 1_000 < seen[1] <= 2_000
