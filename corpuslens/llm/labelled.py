"""Bounded samples of labelled documents and a small logistic calibration, for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import stored


def fold_of(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; null for a null id."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")) % folds


def held_out(folds: int, fold: int) -> Column:
    return F.coalesce(fold_of("doc_id", folds) == fold, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, per_class: dict[int, int]) -> DataFrame:
    """(label, half, text) of at most `per_class` documents of each label, outside the held-out fold; stored.

    Ids are chosen by hash, so the sample is the same in every run.  An id with several
    labels counts as the largest, null labels do not count.  The ids are few by parameter
    and broadcast; the texts stay where they are until they are chosen.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(folds, fold))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    order = F.md5(F.concat_ws(":", F.lit(label), F.col("doc_id")))
    chosen = None
    for value, limit in per_class.items():
        part = known.where(F.col("label") == value).withColumn("_h", order).orderBy("_h").limit(limit).select("doc_id", "label")
        chosen = part if chosen is None else chosen.unionByName(part)
    ids = stored(chosen, "label-sample")
    half = (F.crc32(F.concat(F.lit("half:"), F.col("doc_id").cast("string")).cast("binary")) % 2).cast("int")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return stored(rows.select("label", half.alias("half"), F.coalesce("text", F.lit("")).alias("text")), "label-texts")


class Logistic:
    """Logistic regression on standardised features, fitted by Newton steps with a small ridge."""

    def __init__(self, features: np.ndarray, labels: np.ndarray, ridge: float = 1.0):
        self.mean, self.scale = features.mean(0), features.std(0) + 1e-9
        z = self._design(features)
        self.weights = np.zeros(z.shape[1])
        penalty = ridge * np.eye(z.shape[1])
        penalty[0, 0] = 1e-6
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
            gradient = z.T @ (p - labels) + penalty @ self.weights
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, gradient)
            self.weights -= step
            if np.abs(step).max() < 1e-8:
                break

    def _design(self, features: np.ndarray) -> np.ndarray:
        return np.c_[np.ones(len(features)), (features - self.mean) / self.scale]

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._design(features) @ self.weights, -30, 30)))
