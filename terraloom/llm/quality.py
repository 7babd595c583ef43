"""Quality classifier by positive-unlabelled learning.

A small network scores dense features of a text.  It is trained by minimising the
non-negative unbiased risk: trusted positives (label 1) and unlabelled documents are
the only inputs, with a class prior that is estimated from the same samples by the
best-bin estimator.  One pass over all texts writes the features; the training sample
(bounded by ``SAMPLE`` positives, unlabelled and labelled rows each) and the scores
are both read from that table.  The labelled training rows then calibrate the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .labels import held_out, sampled_ids
from .runtime import ship_by_value, written

SAMPLE = 10_000
THRESHOLD = 0.3
HIDDEN, EPOCHS, BATCH, RATE = 16, 60, 512, 0.01

_CLASSES = (
    np.isin(np.arange(256), np.arange(65, 91)),
    np.isin(np.arange(256), np.arange(97, 123)),
    np.isin(np.arange(256), np.arange(48, 58)),
    np.arange(256) >= 128,
    np.arange(256) == 10,
    np.isin(np.arange(256), [44, 46]),
    np.isin(np.arange(256), [33, 63]),
    np.arange(256) == 124,
    np.isin(np.arange(256), [35, 36, 37, 38, 42]),
    np.isin(np.arange(256), [60, 62, 123, 125, 91, 93, 61, 59, 47, 92, 95]),
)
N_FEATURES = len(_CLASSES) + 9


def features(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Dense features of each text of a chunk; an empty text has zeros."""
    n = len(off) - 1
    out = np.zeros((n, N_FEATURES), np.float32)
    size = np.diff(off)
    some = np.maximum(size, 1)
    for k, cls in enumerate(_CLASSES):
        run = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(cls[raw], out=run[1:])
        out[:, k] = np.diff(run[off]) / some
    s, e, doff = T.words(raw, off, T.NOT_SPACE)
    count = np.diff(doff)
    many = np.maximum(count, 1)
    h = T.word_hashes(raw, s, e, T.BYTE_CODE)
    doc = np.repeat(np.arange(n), count)

    def by_doc(x, at=doc):
        return np.bincount(at, weights=x, minlength=n) if len(at) else np.zeros(n)

    length = (e - s).astype(np.float64)
    first_upper = _CLASSES[0][raw[s]] if len(s) else np.zeros(0, bool)
    same = np.zeros(len(h), bool)
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((h, doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    g = T.gram_hashes(h, 3)
    ok = T.inside(doff, 3, len(g))
    gd, gh = doc[: len(g)][ok], g[ok]
    gorder = np.lexsort((gh, gd))
    gnew = np.ones(len(gh), bool)
    gnew[1:] = (gh[gorder][1:] != gh[gorder][:-1]) | (gd[gorder][1:] != gd[gorder][:-1])
    grams = np.maximum(np.bincount(gd, minlength=n) if len(gd) else np.zeros(n), 1)
    k = len(_CLASSES)
    mean = by_doc(length) / many
    out[:, k] = np.log1p(size)
    out[:, k + 1] = np.log1p(count)
    out[:, k + 2] = mean / 10
    out[:, k + 3] = np.sqrt(np.maximum(by_doc(length**2) / many - mean**2, 0)) / 10
    out[:, k + 4] = by_doc(first_upper) / many
    out[:, k + 5] = by_doc(same) / many
    out[:, k + 6] = by_doc(new, doc[order]) / many
    out[:, k + 7] = by_doc(gnew, gd[gorder]) / grams
    out[:, k + 8] = by_doc(length == 1) / many
    return out


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, raw, off in T.rows(batch.column(1)):
            x = pa.array(features(raw, off).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * N_FEATURES), x)], names=["doc_id", "x"])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Best-bin estimate: the smallest upper bound of P(u >= t) / P(p >= t) over thresholds t."""
    t = np.sort(positive)[::-1]
    p = np.arange(1, len(t) + 1) / len(t)
    u = 1 - np.searchsorted(np.sort(unlabelled), t, "left") / len(unlabelled)
    slack = np.sqrt(np.log(4 / 0.1) / (2 * len(unlabelled))) + np.sqrt(np.log(4 / 0.1) / (2 * len(t)))
    best = int(np.argmin((u + slack) / p))
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


class Model:
    """One hidden layer; fitted with the non-negative risk of Kiryo and others (2017)."""

    def __init__(self, d: int):
        rng = np.random.Generator(np.random.PCG64(7))
        self.w = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self.mean, self.scale, self.a, self.b = np.zeros(d), np.ones(d), 1.0, 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.tanh(((x - self.mean) / self.scale) @ self.w[0] + self.w[1])
        return z @ self.w[2] + self.w[3][0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.a * self.logits(x) + self.b)

    def _step(self, x: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
        z = np.tanh(x @ self.w[0] + self.w[1])
        back = slope[:, None] * self.w[2] * (1 - z**2)
        return [x.T @ back, back.sum(0), z.T @ slope, np.array([slope.sum()])]

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = EPOCHS) -> Model:
        rng = np.random.Generator(np.random.PCG64(11))
        self.mean, self.scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
        p, u = (positive - self.mean) / self.scale, (unlabelled - self.mean) / self.scale
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            order = rng.permutation(len(u))
            for at in range(0, len(u), BATCH):
                xu, xp = u[order[at : at + BATCH]], p[rng.integers(0, len(p), min(BATCH, len(p)))]
                out = lambda x: np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3][0]
                sp, su = _sigmoid(out(xp)), _sigmoid(out(xu))
                # Sigmoid loss: l(z, +) = sigmoid(-z), l(z, -) = sigmoid(z).
                negative = su.mean() - prior * sp.mean()
                gp, gu = sp * (1 - sp) / len(sp), su * (1 - su) / len(su)
                if negative >= 0:
                    grads = [a + b for a, b in zip(self._step(xp, -2 * prior * gp), self._step(xu, gu), strict=True)]
                else:
                    grads = [a + b for a, b in zip(self._step(xp, prior * gp), self._step(xu, -gu), strict=True)]
                t += 1
                for k, g in enumerate(grads):
                    g = g + 1e-4 * self.w[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.w[k] -= RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Model:
        """Platt scaling by Newton steps, with the usual smoothed targets."""
        if len(y) and 0 < y.sum() < len(y):
            self.a, self.b = platt(self.logits(x), y)
        return self


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that calibrate logits; ``y`` has a label of each, or two columns: how many of each are 0 and are 1."""
    c0, c1 = (y[:, 0], y[:, 1]) if y.ndim > 1 else (1.0 - (y > 0), 1.0 * (y > 0))
    n0, n1, n = c0.sum(), c1.sum(), c0 + c1
    target = c1 * ((n1 + 1) / (n1 + 2)) + c0 * (1 / (n0 + 2))
    scale = max(float(np.abs(z).max()), 1e-9)
    w, x = np.array([1.0, 0.0]), np.stack([z / scale, np.ones_like(z)], 1)

    def loss(w: np.ndarray) -> float:
        t = x @ w
        return float((n * np.logaddexp(0, t) - target * t).sum() + 5e-4 * (w @ w))

    for _ in range(50):
        p = _sigmoid(x @ w)
        g = x.T @ (n * p - target) + 1e-3 * w
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), g)
        now, size = loss(w), 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    w[0] /= scale
    return float(max(w[0], 1e-6)), float(w[1])


def train(positive: np.ndarray, unlabelled: np.ndarray, labelled: np.ndarray, y: np.ndarray) -> Model | None:
    """None without positives or unlabelled rows."""
    if not len(positive) or not len(unlabelled):
        return None
    half_p, half_u = len(positive) // 2 or 1, len(unlabelled) // 2 or 1
    # For the prior: tell half of the positives from half of the unlabelled, judge on the other halves.
    first = Model(positive.shape[1]).fit(positive[:half_p], unlabelled[:half_u], 0.5, 15)
    rest_p, rest_u = positive[half_p:], unlabelled[half_u:]
    prior = class_prior(first.logits(rest_p if len(rest_p) else positive), first.logits(rest_u if len(rest_u) else unlabelled))
    return Model(positive.shape[1]).fit(positive, unlabelled, prior).calibrate(labelled, y)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted (1 if score >= ``THRESHOLD``).

    A null text counts as empty and gets the score of all-zero features.  Labels that
    are null, or of held-out ids, are not used; of an id labelled twice the larger
    label holds.  Without trusted positives every score is 0.5.  Other columns are not
    read.
    """
    ship_by_value()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    table = written(rows.mapInArrow(T.lean(_feature_rows), "doc_id long, x array<float>").withColumn("held_out", held_out()), "quality-features")
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("y"))
    usable = table.where(~F.col("held_out"))
    labelled = usable.join(known, "doc_id")

    def fetch(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        got = sampled_ids(df, SAMPLE).select("x", "y").toArrow()
        x = got.column("x").combine_chunks()
        flat = x.flatten().to_numpy(zero_copy_only=False) if len(x) else np.zeros(0)
        return flat.reshape(-1, N_FEATURES).astype(np.float64), got.column("y").to_numpy().astype(np.float64)

    positive, _ = fetch(labelled.where("y = 1"))
    unlabelled, _ = fetch(usable.withColumn("y", F.lit(0)))
    all_x, all_y = fetch(labelled)
    model = train(positive, unlabelled, all_x, all_y)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES).astype(np.float64)
            score = np.full(len(x), 0.5) if model is None else model.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return table.select("doc_id", "x", "held_out").mapInArrow(T.lean(kernel), "doc_id long, held_out boolean, score double, predicted int")
