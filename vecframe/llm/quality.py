"""Quality classifier: naive Bayes features, a linear hinge-loss model on them.

A text's features are n-gram indicators, hashed: byte n-grams, and n-grams
of word shapes, where a shape also says whether the word repeats one of the
two before it.  An indicator's value is its log-count ratio between the
classes; a text's vector is scaled to unit length.  Dual coordinate descent fits the
linear model (L1 hinge loss, L2 penalty); a logistic curve on its margins
makes scores.

The fit uses at most FIT_ROWS labelled rows, chosen by a hash of doc_id from the
rows that are not held out; their texts are read one by one and kept as features.
Every document is scored from its whole text, however long, and from nothing else.
Null and empty texts have no features: their score is that of the bias.  Repeated
rows score alike; a doc_id with several labels has the greatest.  With labels of
one class only, or none, every score is that class's share (0.5 with none).
Columns may have any names; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_arrow, held_out, labelled_sample

FIT_ROWS = 6000
BITS = 18
BYTE_GRAMS = (2, 3)
SHAPE_GRAMS = (1, 2, 3, 4)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHAPES = ((re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[0-9]+"), b"0"), (re.compile(rb"([^A-Za-z0-9])\1+"), rb"\1\1"))


def _shape(word: bytes) -> int:
    for pattern, sign in _SHAPES:
        word = pattern.sub(sign, word)
    h = 2166136261
    for c in word:
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return h >> 1 << 1


class Features:
    """Hashed indicators of a text; keeps numbers of words it has seen."""

    def __init__(self, bits: int = BITS, known: int = 300_000):
        self.bits, self.known = bits, known
        self.shapes: list[int] = []
        self.number: dict[bytes, int] = {}
        self.mark = np.zeros(1 << bits, np.int32)

    def _word_codes(self, text: bytes) -> np.ndarray:
        number, shapes = self.number, self.shapes
        if len(number) > self.known:
            number.clear()
            shapes.clear()
        words = text.split()
        ids = np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            n = number.get(w)
            if n is None:
                n = number[w] = len(shapes)
                shapes.append(_shape(w))
            ids[i] = n
        codes = np.array([shapes[i] for i in ids.tolist()], np.uint64)
        again = np.zeros(len(ids), bool)
        again[1:] = ids[1:] == ids[:-1]
        again[2:] |= ids[2:] == ids[:-2]
        return codes | again

    def of(self, text: bytes) -> np.ndarray:
        """The distinct features, in no order."""
        shift = np.uint64(64 - self.bits)
        parts = []
        b = np.frombuffer(text, np.uint8).astype(np.uint64)
        for seed, codes, orders in ((1, b, BYTE_GRAMS), (2, self._word_codes(text), SHAPE_GRAMS)):
            for n in orders:
                if len(codes) >= n:
                    h = np.full(len(codes) - n + 1, seed * 16 + n, np.uint64)
                    for k in range(n):
                        h = (h ^ codes[k : len(codes) - n + 1 + k]) * _MIX
                        h ^= h >> np.uint64(31)
                    parts.append((h * _MIX >> shift).astype(np.int64))
        if not parts:
            return np.zeros(0, np.int64)
        f = np.concatenate(parts)
        order = np.arange(len(f), dtype=np.int32)
        self.mark[f] = order
        return f[self.mark[f] == order]


class Model:
    """Weights of the features (the log-count ratios are in them), and the curve."""

    def __init__(self, ratio, weight, bias, slope, shift, flat=None):
        self.ratio, self.weight, self.bias, self.slope, self.shift, self.flat = ratio, weight, bias, slope, shift, flat

    def margin(self, f: np.ndarray) -> float:
        r = self.ratio[f]
        norm = math.sqrt(float(r @ r))
        return (float(r @ self.weight[f]) / norm if norm else 0.0) + self.bias

    def score(self, f: np.ndarray) -> float:
        if self.flat is not None:
            return self.flat
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * self.margin(f) + self.shift))))


def descend(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, size: int, epochs: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1 hinge loss; the last weight is the bias."""
    weight, bias = np.zeros(size), 0.0
    alpha, square = np.zeros(len(rows)), np.array([float(v @ v) + 1 for _, v in rows])
    rng = np.random.default_rng(seed)
    active = np.arange(len(rows))
    for _ in range(epochs):
        moved = []
        for i in rng.permutation(active).tolist():
            at, v = rows[i]
            slack = y[i] * (float(weight[at] @ v) + bias) - 1
            new = min(max(alpha[i] - slack / square[i], 0.0), cost[i])
            if (d := (new - alpha[i]) * y[i]) != 0:
                alpha[i] = new
                weight[at] += d * v
                bias += d
                moved.append(i)
        if not moved:
            break
    return weight, bias


def curve(margin: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps with a small penalty."""
    x = np.stack([margin, np.ones_like(margin)], 1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 1e-3 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w -= np.clip(np.linalg.solve(h, g), -2, 2)
    return float(w[0]), float(w[1])


def fit(sample: Iterable[tuple[int, str | None, int]], cost: float = 4.0, epochs: int = 12) -> Model:
    """A model from (doc_id, text, label) rows."""
    features, rows, labels, size = Features(), [], [], 1 << BITS
    for _, text, label in sample:
        rows.append(features.of((text or "").encode()).astype(np.int32))
        labels.append(1 if label else 0)
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(size), np.zeros(size), 0.0, 1.0, 0.0, float(y[0]) if len(y) else 0.5)
    folds = np.arange(len(rows)) % 3

    def train(keep: np.ndarray) -> Model:
        counts = np.ones((2, size))
        for i in keep.tolist():
            counts[y[i], rows[i]] += 1
        ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
        share = y[keep].mean()
        scaled = [(rows[i], (r := ratio[rows[i]]) / (math.sqrt(float(r @ r)) or 1.0)) for i in keep.tolist()]
        costs = np.where(y[keep] == 1, 0.5 / share, 0.5 / (1 - share)) * cost
        weight, bias = descend(scaled, 2.0 * y[keep] - 1, costs, size, epochs)
        return Model(ratio, weight, bias, 1.0, 0.0)

    # margins of rows the model has not learnt from, for the curve
    part, whole = train(np.flatnonzero(folds > 0)), train(np.arange(len(rows)))
    out = np.flatnonzero(folds == 0)
    if y[out].min() == y[out].max():
        out = np.arange(len(rows))
    whole.slope, whole.shift = curve(np.array([part.margin(rows[i]) for i in out.tolist()]), y[out])
    return whole


def scorer(model: Model):
    """For append_arrow(): texts to scores; the weights are those of one broadcast."""

    def make():
        features, own = Features(), model.value

        def work(texts):
            return [pa.array([own.score(features.of(t)) for t in texts], pa.float64())]

        return work

    return make


def score(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = FIT_ROWS) -> DataFrame:
    """All columns of docs, and one more, __score: the probability of label 1."""
    model = fit(labelled_sample(docs, labels, target, rows))
    return append_arrow(docs, scorer(docs.sparkSession.sparkContext.broadcast(model)), [("__score", T.DoubleType())])


def digest(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    got = score(docs.select("doc_id", "text"), labels)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"))
