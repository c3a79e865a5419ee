"""Quality by a regularised quadratic discriminant over document statistics.

Each document is described by statistics of its characters, words, repeats and lines, as
logarithms of ratios; statistics of short texts are drawn towards the mean, since few words
say little.  Each class has a mean and a covariance of these; a covariance is shrunk towards
the pooled one and towards its diagonal, and kept as its Cholesky factor.  The score of a
document is the difference of the two log densities, from Mahalanobis distances by forward
substitution, through a logistic calibration.

Class moments and calibration come from at most `PER_CLASS` labelled documents of each
class (a stated sample) outside the held-out fold; texts are turned into statistics where
they are, and only those numbers travel.  Every document is scored by its whole text.

Rows: null and empty texts have the statistics of an empty text; without labels of both
classes every score is the share of good labels, 0 if there are none.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.labelled import Logistic, held_out, labelled_texts

FOLDS, HELD_OUT = 3, 1
PER_CLASS = 20_000
THRESHOLD = 0.5
POOLED, DIAGONAL = 0.3, 0.02  # shares of the pooled covariance and of its diagonal
FEW_WORDS = 10  # weight, in words, of the mean against a text's own statistics
CHUNK = 1 << 20  # bytes compressed at a time
_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 white space, 5 sentence marks, 6 odd signs
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[9, 10, 11, 12, 13, 32]], _CLASS[list(b".,;:?'\"()-")] = 4, 5
_CLASS[list(b"!#$%&*+/<=>@[\\]^_`{|}~")] = 6


def _ratio(part: float, rest: float) -> float:
    return float(np.log((part + 0.5) / (rest + 0.5)))


def _compressed(data: bytes) -> int:
    engine = zlib.compressobj(1)
    return sum(len(engine.compress(data[i : i + CHUNK])) for i in range(0, len(data), CHUNK)) + len(engine.flush())


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text, its number of words last."""
    data = (text or "").encode()
    size = len(data)
    kinds = np.zeros(7, np.int64)
    for i in range(0, size, CHUNK):
        kinds += np.bincount(_CLASS[np.frombuffer(data, np.uint8, min(CHUNK, size - i), i)], minlength=7)
    words = data.split()
    n = len(words)
    lines = data.split(b"\n")
    repeated = sum(a == b for a, b in zip(words, words[1:], strict=False))
    triples = len(set(zip(words, words[1:], words[2:], strict=False)))
    short = sum(len(w) <= 3 for w in words)
    ends = data.count(b". ") + data.count(b".\n") + data.endswith(b".")
    return [
        float(np.log((size + 1) / (n + 1))),
        _ratio(kinds[2], kinds[1]),
        _ratio(kinds[6], size - kinds[6]),
        _ratio(kinds[5], size - kinds[5]),
        _ratio(kinds[3], size - kinds[3]),
        float(np.log((len(set(words)) + 1) / (n + 1))),
        _ratio(repeated, max(n - 1, 0) - repeated),
        float(np.log((triples + 1) / (max(n - 2, 0) + 1))),
        float(np.log((_compressed(data) + 10) / (size + 10))),
        _ratio(short, n - short),
        float(np.log((n + 1) / (ends + 1))),
        float(np.log((len(set(lines)) + 1) / (len(lines) + 1))),
        float(n),
    ]


WIDTH = len(statistics(None))


class Discriminant:
    """Two normal densities over the statistics and a calibration of their log ratio."""

    def __init__(self, statistics: np.ndarray, labels: np.ndarray):
        self.constant = None
        if len(set(labels.tolist())) < 2:
            self.constant = float(labels[0]) if len(labels) else 0.0
            return
        self.mean, self.scale = statistics[:, :-1].mean(0), statistics[:, :-1].std(0) + 1e-6
        z = self._standard(statistics)
        moments = {c: (z[labels == c].mean(0), np.atleast_2d(np.cov(z[labels == c].T, bias=True)), int((labels == c).sum())) for c in (0, 1)}
        pooled = sum(cov * n for _, cov, n in moments.values()) / len(labels)
        self.classes = {}
        for c, (mean, cov, n) in moments.items():
            cov = (1 - POOLED) * cov + POOLED * pooled
            cov = (1 - DIAGONAL) * cov + DIAGONAL * np.diag(np.diag(pooled)) + 1e-4 * np.eye(len(cov))
            factor = np.linalg.cholesky(cov)
            self.classes[c] = (mean, np.linalg.inv(factor), float(np.log(n / len(labels)) - np.log(np.diag(factor)).sum()))
        self.calibration = Logistic(self._evidence(statistics), labels.astype(float), ridge=1e-3)

    def _standard(self, statistics: np.ndarray) -> np.ndarray:
        words = statistics[:, -1:]
        return (statistics[:, :-1] - self.mean) / self.scale * (words / (words + FEW_WORDS))

    def log_ratio(self, statistics: np.ndarray) -> np.ndarray:
        """Log density of class 1 minus that of class 0."""
        z = self._standard(statistics)
        density = {c: top - 0.5 * (((z - mean) @ inverse.T) ** 2).sum(1) for c, (mean, inverse, top) in self.classes.items()}
        return density[1] - density[0]

    def _evidence(self, statistics: np.ndarray) -> np.ndarray:
        return np.arcsinh(self.log_ratio(statistics))[:, None]

    def scores(self, statistics: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(statistics), self.constant)
        return self.calibration.scores(self._evidence(statistics))


def statistics_column():
    @F.pandas_udf("array<double>")
    def described(texts: pd.Series) -> pd.Series:
        return texts.map(statistics)

    return described


def fit(docs: DataFrame, labels: DataFrame) -> Discriminant:
    sample = labelled_texts(docs, labels, "quality", FOLDS, HELD_OUT, {0: PER_CLASS, 1: PER_CLASS})
    rows = sample.select("label", statistics_column()("text").alias("x")).toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), WIDTH)
    order = np.lexsort([*x.T, rows["label"]])  # sums do not depend on the order of arrival
    return Discriminant(x[order], rows["label"].to_numpy()[order])


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (near 1: good) and predicted of every document."""
    model = fit(docs, labels)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array([statistics(t) for t in texts], float).reshape(len(texts), WIDTH)))

    rows = docs.select("doc_id", held_out(FOLDS, HELD_OUT).alias("held_out"), score("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
