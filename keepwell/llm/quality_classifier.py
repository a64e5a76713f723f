"""Operator 1: a quality classifier by positive-unlabelled learning.

The risk of a classifier g, with class prior p, trusted positives P and
unlabelled texts U, is  p R_P(g, +1) + max(0, R_U(g, -1) - p R_P(g, -1)).  With
the squared loss (m - 1)^2 / 4 of the margin m, and g linear in features of the
text, every term is a function of the first and second moments of the features
over P and over U.  So training is one sum over all texts, exact at any size:
a few thousand numbers reach the driver, which minimises the risk there.

The features are counts of the text, with hinges at fixed knots that let a
linear function bend.  The score is the estimated probability (g + 1) / 2.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.llm.common import fold, map_batches, stored

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
RIDGE = 1e-4
#: Halvings of the interval in which the correction's weight is sought, where the unbiased risk overfits.
HALVINGS = 50

# The features of a text, and the knots of their hinges.
KNOTS = {
    "symbols": (0.02, 0.1, 0.3, 0.6),
    "upper": (0.15, 0.25, 0.4, 0.6),
    "punct": (0.1, 0.2, 0.3, 0.4),
    "bars": (0.02, 0.1, 0.3),
    "digits": (0.05, 0.2, 0.4),
    "repeated": (0.2, 0.4, 0.6, 0.8),
    "dup_lines": (0.2, 0.5, 0.8),
    "distinct": (0.2, 0.4, 0.6, 0.8),
    "short": (0.1, 0.2, 0.3, 0.4),
    "length": (1.4, 1.6, 1.8, 2.0, 2.2),
    "words": (2.0, 3.0, 4.0, 5.0, 6.0),
    "line": (2.0, 3.0, 4.0, 5.0),
    "ends": (0.02, 0.05, 0.1, 0.2),
}
RAW = tuple(KNOTS)
D = 1 + sum(1 + len(k) for k in KNOTS.values())

_ASCII = {name: bytes(chars, "ascii") for name, chars in {"symbols": "#*$%&<>", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "punct": "!\"'(),-./:;=?@[]\\^_`{}~+", "bars": "|", "digits": "0123456789"}.items()}


def raw_features(text: str | None) -> list[float]:
    """The features in the order of RAW; those of an empty text for null."""
    raw = (text or "").encode()
    words = raw.split()
    n, size = len(words), len(raw)
    count = {k: size - len(raw.translate(None, v)) for k, v in _ASCII.items()}
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    distinct = len(set(windows))
    chars = sum(map(len, words))
    root = lambda k, of: (k / of) ** 0.5 if of else 0.0
    return [
        *[root(count[k], size) for k in ("symbols", "upper", "punct", "bars", "digits")],
        root(len(windows) - distinct, len(windows)),
        root(len(lines) - len(set(lines)), len(lines)),
        len(set(words)) / n if n else 0.0,
        sum(len(w) < 4 for w in words) / n if n else 0.0,
        float(np.log(chars / n)) if n else 0.0,
        float(np.log1p(n)),
        float(np.log1p(n / len(lines))) if lines else 0.0,
        raw.count(b".") / n if n else 0.0,
    ]


def expanded(x: np.ndarray) -> np.ndarray:
    """Rows of raw features with the constant and the hinges."""
    cols = [np.ones(len(x))]
    for i, knots in enumerate(KNOTS.values()):
        cols.append(x[:, i])
        cols += [np.maximum(0.0, x[:, i] - k) for k in knots]
    return np.stack(cols, axis=1)


def moments(batches):
    """(i, v) sums over a partition: for the unlabelled and the positive rows their number, first and second moments."""
    total = np.zeros((2, 1 + D + D * D))
    for b in batches:
        phi = expanded(np.frombuffer(b"".join(b.column("x").to_pylist()), np.float32).reshape(-1, len(RAW)).astype(float))
        for k, rows in enumerate((phi, phi[b.column("positive").to_numpy(zero_copy_only=False)])):
            total[k] += np.concatenate([[len(rows)], rows.sum(axis=0), (rows.T @ rows).ravel()])
    flat = total.ravel()
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["i", "v"])


def class_prior(u2: np.ndarray, p1: np.ndarray) -> float:
    """Share of positives in the unlabelled texts by matching Pearson divergence: 1 / (h' G^-1 h).

    h'G^-1 h estimates the mean over positives of p(x | +) / p(x), which is
    1 / prior wherever positives can be told from others.
    """
    h = float(p1 @ np.linalg.solve(u2 + RIDGE * np.eye(D), p1))
    return float(np.clip(1 / max(h, 1e-9), 0.01, 0.99))


def minimise(u1: np.ndarray, u2: np.ndarray, p1: np.ndarray, p2: np.ndarray, prior: float) -> np.ndarray:
    """The weights of least non-negative risk.

    max(0, negative) is the largest k * negative for k from 0 to 1, and for each
    such k the sum with the positive part is convex with its minimum in closed
    form.  So the minimum sought is that for the k at which the estimated risk on
    negatives vanishes; for k = 1, the unbiased risk's, if it is not negative
    there, and for k = 0 if it is nowhere positive.  Its sign is bisected.
    """
    ridge = RIDGE * np.eye(D)
    at = lambda k: np.linalg.solve(((1 - k) * prior * p2 + k * u2) / 2 + ridge, ((1 + k) * prior * p1 - k * u1) / 2)
    negative = lambda w: (w @ u2 @ w + 2 * u1 @ w + 1 - prior * (w @ p2 @ w + 2 * p1 @ w + 1)) / 4
    if negative(at(1.0)) >= 0:
        return at(1.0)
    low, high = 0.0, 1.0
    for _ in range(HALVINGS if negative(at(0.0)) > 0 else 0):
        middle = (low + high) / 2
        low, high = (middle, high) if negative(at(middle)) > 0 else (low, middle)
    return at(low)


def train(features: DataFrame) -> tuple[np.ndarray, float]:
    """(weights, prior) from rows (x, positive); weights that say 'all positive' if there are no positives or no rows."""
    sums = map_batches(features.select("x", "positive"), moments, "i int, v double", rows=10_000).groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    total = np.zeros(2 * (1 + D + D * D))
    total[sums["i"].to_numpy(int)] = sums["v"]
    (u, p) = total.reshape(2, -1)
    if not u[0] or not p[0]:
        return np.eye(D)[0], 1.0
    cut = lambda v: (v[1 : 1 + D] / v[0], v[1 + D :].reshape(D, D) / v[0])
    (u1, u2), (p1, p2) = cut(u), cut(p)
    prior = class_prior(u2, p1)
    return minimise(u1, u2, p1, p2, prior), prior


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text); ``labels`` has doc_id and quality.

    Trusted positives are the rows outside the held-out fold with a label 1,
    unlabelled texts are all rows outside it.  Null texts score as empty ones.
    A null doc_id has no label and counts as the empty text in the fold; of
    several labels of a document one 1 suffices.  Other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def extract(batches):
        for b in batches:
            x = [np.array(raw_features(t), np.float32).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(x, pa.binary())], ["doc_id", "x"])

    features = stored(map_batches(docs.select("doc_id", "text"), extract, f"doc_id {kind}, x binary", rows=500))
    held = fold(F.col("doc_id"), FOLDS) == HELD_OUT
    trusted = labels.filter("quality = 1").select("doc_id").filter(~held).distinct().withColumn("yes", F.lit(True))
    learn = features.filter(~held).join(trusted, "doc_id", "left").select("x", F.coalesce("yes", F.lit(False)).alias("positive"))
    weights, _ = train(learn)

    def score(batches):
        for b in batches:
            x = np.frombuffer(b"".join(b.column("x").to_pylist()), np.float32).reshape(-1, len(RAW)).astype(float)
            s = np.clip((expanded(x) @ weights + 1) / 2, 0, 1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return map_batches(features.select("doc_id", held.alias("held_out"), "x"), score, f"doc_id {kind}, held_out boolean, score double, predicted int", rows=10_000)
