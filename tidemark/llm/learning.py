"""Bounded labelled samples, and calibration of scores to probabilities."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import learnable


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, label, values, per_value: int) -> DataFrame:
    """Rows of docs with a column `y`: up to per_value learnable rows for each label value.

    The choice is by a hash of the id, so it is spread over the corpus, the same
    in every run and independent of partitioning. The chosen ids number at most
    per_value * len(values), which is what makes broadcasting them safe. A row
    without id or label is never chosen; an id labelled twice gets its largest label.
    """
    once = (
        labels.select(F.col(key).alias("k"), F.col(label).alias("y"))
        .where(learnable(F.col("k")) & F.col("y").isNotNull())
        .groupBy("k")
        .agg(F.max("y").alias("y"))
    )
    chosen = None
    for value in values:
        part = once.where(F.col("y") == F.lit(value)).orderBy(F.xxhash64("k"), "k").limit(per_value)
        chosen = part if chosen is None else chosen.unionByName(part)
    return docs.join(F.broadcast(chosen), F.col(key) == F.col("k")).drop("k")


def split_of(keys) -> np.ndarray:
    """True for the fifth of the rows on which scores are calibrated rather than learned."""
    return np.array([(int(k) * 2654435761 >> 7) % 5 == 0 for k in keys], dtype=bool)


def platt(margins: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """(a, b) so that sigmoid(a * margin + b) is a probability; Newton steps on smoothed targets."""
    weight = np.ones(len(y)) if weight is None else weight
    up, down = (weight * y).sum(), (weight * (1 - y)).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * margins + b)
        g = weight * (p - target)
        h = weight * p * (1 - p) + 1e-12
        ga, gb = (g * margins).sum() + 1e-6 * a, g.sum()
        haa, hab, hbb = (h * margins * margins).sum() + 1e-6, (h * margins).sum(), h.sum() + 1e-9
        det = haa * hbb - hab * hab
        if not np.isfinite(det) or abs(det) < 1e-18:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 2.0 / max(abs(da), abs(db), 1e-9))
        a, b = a - step * da, b - step * db
        if max(abs(da), abs(db)) < 1e-7:
            break
    return max(float(a), 1e-3), float(b)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))
