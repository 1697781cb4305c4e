"""Quality classifier: a linear model on naive Bayes support vectors.

Features are indicators of hashed n-grams: words, word pairs, pairs of word
shapes (the classes of the first and last two bytes of a word), lengths of runs
of one word, the share of words that repeat the one before, and the order of
magnitude of the length. An indicator is scaled by the
log-count ratio of the two classes; a hinge-loss model is fitted to the scaled
indicators by dual coordinate descent. Margins become scores by a logistic map
fitted on margins of held-back folds of the sample.

The model is fitted on the driver, on at most ``most_rows`` labelled rows: the
first by a hash of the id. Every row is scored in one pass without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BATCH_ROWS, cut, map_batches, map_rows, utf8

BITS = 18
#: Byte classes: A upper, a lower, 0 digit, u beyond ASCII; white space and marks stay.
SHAPE = bytes(
    65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 else 48 if 48 <= b <= 57 else 117 if b >= 128 else b for b in range(256)
)


#: Keeps the kinds of features apart; pairs mix two hashes by an odd multiplier.
SALT = {k: np.uint64(zlib.crc32(k.encode())) for k in ("word", "pair", "shape")}
MIX = np.uint64(0x9E3779B97F4A7C15)


def _hashes(items: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, items), dtype=np.uint64, count=len(items))


def _slots(h: np.ndarray, kind: str) -> np.ndarray:
    return ((h ^ SALT[kind]) * MIX) >> np.uint64(64 - BITS)


def features(text: bytes | None) -> np.ndarray:
    """Sorted distinct indices below ``2 ** BITS``; a text of none has its length only."""
    text = text or b""
    words = _hashes(text.lower().split())
    shapes = _hashes([s[:2] + s[-2:] for s in text.translate(SHAPE).split()])
    same = words[1:] == words[:-1]
    longest = 1
    if same.any():
        ends = np.flatnonzero(np.concatenate(([True], ~same, [True])))
        longest = int(np.diff(ends).max())
    again = int(same.sum())
    marks = [b"l%d" % len(words).bit_length()]
    marks += [b"r%d" % k for k in range(2, min(longest, 8) + 1)]
    marks += [b"q%d" % k for k in range(1, 9) if 16 * again >= k * len(words) > 0]
    parts = [_hashes(marks) & np.uint64((1 << BITS) - 1), _slots(words, "word")]
    parts += [_slots(x[:-1] * MIX + x[1:], kind) for x, kind in ((words, "pair"), (shapes, "shape"))]
    return np.unique(np.concatenate(parts)).astype(np.int32)


@dataclass
class Model:
    """``margin = sum(coef[features]) / sqrt(n) + bias``; score by the logistic map."""

    coef: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, idx: np.ndarray) -> float:
        return float(self.coef[idx].sum(dtype=np.float64)) / max(1, len(idx)) ** 0.5 + self.bias

    def score(self, idx: np.ndarray) -> float:
        z = min(30.0, max(-30.0, self.slope * self.margin(idx) + self.shift))
        return 1.0 / (1.0 + float(np.exp(-z)))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    up, down = np.full(1 << BITS, alpha), np.full(1 << BITS, alpha)
    for idx, label in zip(rows, y):
        (up if label > 0 else down)[idx] += 1
    return np.log(up / up.sum()) - np.log(down / down.sum())


def descend(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, c: float, epochs: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; classes weigh alike."""
    w, bias = np.zeros(1 << BITS), 0.0
    scale = np.array([max(1, len(x)) ** -0.5 for x in rows])
    norm = np.array([(r[x] ** 2).sum() * s * s + 1.0 for x, s in zip(rows, scale)])
    share = max(1e-9, float((y > 0).mean())), max(1e-9, float((y < 0).mean()))
    cap = np.where(y > 0, c / (2 * share[0]), c / (2 * share[1]))
    alpha, rng = np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            x = rows[i]
            rx = r[x] * scale[i]
            g = y[i] * (float(w[x] @ rx) + bias) - 1
            new = min(cap[i], max(0.0, alpha[i] - g / norm[i]))
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                worst = max(worst, abs(new - alpha[i]))
                w[x] += step * rx
                bias += step
                alpha[i] = new
        if worst < 1e-3 * c:
            break
    return w * r, bias


def logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic map: Newton steps, halved until the loss
    falls, on smoothed targets and margins scaled to unit spread."""
    up, down = float((y > 0).sum()), float((y < 0).sum())
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    spread = float(margins.std()) or 1.0
    x = np.column_stack([margins / spread, np.ones(len(margins))])
    beta = np.array([0.0, float(np.log((up + 1) / (down + 1)))])

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((np.logaddexp(0, z) - t * z).sum() + 5e-3 * b[0] ** 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (p - t) + np.array([1e-2 * beta[0], 0.0])
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step, now = np.linalg.solve(hess, grad), loss(beta)
        while loss(beta - step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        beta = beta - step
        if np.abs(step).max() < 1e-8:
            break
    return max(1e-3, float(beta[0])) / spread, float(beta[1])


def fit(rows: list[np.ndarray], labels: list[int], c: float = 1.0, epochs: int = 12, folds: int = 3) -> Model:
    """With no rows, or one class, every score is the smoothed share of label 1."""
    y = np.where(np.asarray(labels, dtype=int) > 0, 1.0, -1.0)
    if not len(y) or abs(y.sum()) == len(y):
        p = (float((y > 0).sum()) + 1) / (len(y) + 2)
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 1.0, float(np.log(p / (1 - p))))
    held, fold = np.zeros(len(y)), np.arange(len(y)) % folds
    for k in range(folds):
        inside = [i for i in range(len(y)) if fold[i] != k]
        part = [rows[i] for i in inside]
        r = log_count_ratios(part, y[inside])
        coef, bias = descend(part, y[inside], r, c, max(2, epochs // 2))
        for i in np.flatnonzero(fold == k):
            held[i] = Model(coef, bias, 1, 0).margin(rows[i])
    r = log_count_ratios(rows, y)
    coef, bias = descend(rows, y, r, c, epochs)
    return Model(coef.astype(np.float32), bias, *logistic(held, y))


def held_out(id_col: str) -> Column:
    """Rows whose labels are never learnt; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    most_rows: int = 8192, most_features: int = 1 << 25,
) -> Model:
    """Fit on at most ``most_rows`` labelled documents that are not held out: the
    first by a hash of the id, as far as they have ``most_features`` features in
    all (of 4 bytes each on the driver; a text has ``2 ** BITS`` at most).

    An id labelled twice counts as the lower label, an id with several texts
    with one of them. Null ids and null labels are left out.
    """
    sample = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(label_col)).cast("int").alias("label"))
        .orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id")
        .limit(most_rows)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("id", "label", "text")

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            idx = [features(t).tobytes() for t in utf8(batch.column(2))]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(idx, pa.binary())], ["id", "label", "idx"])

        return apply

    kind = texts.schema["id"].dataType.simpleString()
    found = map_batches(texts, make, f"id {kind}, label int, idx binary").groupBy("id").agg(F.min("label").alias("label"), F.min("idx").alias("idx"))
    order = Window.orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id")  # over the sample only
    found = cut(found.select("id", "label", "idx", (F.octet_length("idx") / 4).cast("bigint").alias("n")))
    fits = found.select("id", F.sum("n").over(order).alias("so_far")).where(F.col("so_far") <= most_features)
    found = found.join(F.broadcast(fits), "id")
    rows = sorted(found.collect(), key=lambda r: (zlib.crc32(str(r["id"]).encode()), str(r["id"])))
    return fit([np.frombuffer(bytes(r["idx"]), np.int32) for r in rows], [r["label"] for r in rows])


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``(id, score DOUBLE)``; null reads as empty."""
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = sent.value

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = [m.score(features(t)) for t in utf8(batch.column(1))]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["id", "score"])

        return apply

    return map_batches(picked, make, f"id {picked.schema['id'].dataType.simpleString()}, score double")


def keep_quality(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, all columns unchanged."""
    at = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for whole in batches:
            for k in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(k, BATCH_ROWS)
                yield batch.filter(pa.array([m.score(features(t)) >= least for t in utf8(batch.column(at))], pa.bool_()))

    return map_rows(docs, run, docs.schema)
