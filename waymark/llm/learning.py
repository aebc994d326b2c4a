"""What the two classifiers share: bounded samples of labelled rows, folds, and a plain Adam step.

Defined cases: labels other than 0 and 1, null labels and null keys are left out; a key with both labels counts as 1; a
key that repeats gives one text to the sample, the first by a hash; no labels give an empty sample.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo the number of folds (null key: fold 0's remainder of the empty text)."""
    return (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text and label: one row for each of at most `most` keys of each class, by the order of a hash.

    The bound is on what is collected to fit a model; nothing else is sampled. Keys come from the labels alone.
    """
    known = labels.where(learn & F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("_label"))
    order = [F.xxhash64(F.col(key), F.lit(11)), F.col(key)]
    picked = known.where("_label = 0").orderBy(*order).limit(most).union(known.where("_label = 1").orderBy(*order).limit(most))
    rows = docs.select(key, text).join(F.broadcast(picked), key)  # at most 2 x most rows are broadcast
    return rows.groupBy(key, "_label").agg(F.min_by(text, F.xxhash64(text)).alias(text))


def class_counts(labels: DataFrame, label: str, learn: Column) -> dict[int, int]:
    """Rows of each class among those to learn from."""
    known = labels.where(learn & F.col(label).isin(0, 1))
    return {r["_label"]: r["count"] for r in known.groupBy(F.col(label).cast("int").alias("_label")).count().collect()}


class Adam:
    """Adam over a dict of arrays, in place."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float = 0.01, decay: float = 1e-4):
        self.weights, self.rate, self.decay, self.step = weights, rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def __call__(self, gradients: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, w in self.weights.items():
            g = gradients[k] + self.decay * w
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            w -= self.rate * (self.m[k] / (1 - 0.9**self.step)) / (np.sqrt(self.v[k] / (1 - 0.999**self.step)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)
