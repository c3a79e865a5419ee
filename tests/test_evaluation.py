import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuslens.functions import vectors as VX
from corpuslens.operators import evaluation as E


@pytest.fixture(scope="module")
def matrix():
    return np.random.default_rng(4).normal(size=(60, 8)) @ np.diag([9, 5, 3, 1, 1, 0.5, 0.1, 0.1])


@pytest.fixture(scope="module")
def vectors(spark, matrix):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(matrix)], "key long, vector array<double>")


def test_svd(vectors, matrix):
    u, s, _ = np.linalg.svd(matrix, full_matrices=False)
    got = np.array([r.projected for r in E.truncated_svd(vectors, 3).orderBy("key").collect()])
    assert np.allclose(np.abs(got), np.abs(u[:, :3] * s[:3]), atol=1e-8)
    values, right = E.right_singular_vectors(vectors, 8)
    assert np.allclose(values, s)
    whole = np.array([r.projected for r in E.truncated_svd(vectors, 8).orderBy("key").collect()])
    assert np.allclose(whole @ np.array(right), matrix)
    assert all(max(c, key=abs) > 0 for c in right)


def test_randomised_svd(vectors, matrix):
    u, s, v = np.linalg.svd(matrix, full_matrices=False)
    projected, components, values = E.randomised_svd(vectors, 3, oversample=3, power_steps=3)
    assert np.allclose(values, s[:3], rtol=1e-3)
    whole = np.array([r.reconstructed for r in E.reconstructed(projected, components).orderBy("key").collect()])
    exact = np.linalg.norm(matrix - (u[:, :3] * s[:3]) @ v[:3])
    assert exact <= np.linalg.norm(matrix - whole) + 1e-9 < 1.001 * exact + 1e-8
    right = np.array([r.vector for r in components.orderBy("idx").collect()])
    assert np.allclose(right.T @ right, np.eye(3), atol=1e-9) and all(c[np.abs(c).argmax()] > 0 for c in right.T)


def test_randomised_svd_of_all_components(spark, vectors, matrix):
    projected, components, values = E.randomised_svd(vectors, 100)
    assert len(values) == 8 and np.allclose(values, np.linalg.svd(matrix)[1])
    whole = np.array([r.reconstructed for r in E.reconstructed(projected, components).orderBy("key").collect()])
    assert np.allclose(whole, matrix, atol=1e-10)
    few = spark.createDataFrame([(1, [3.0, 0.0, 4.0]), (2, [0.0, 0.0, 0.0]), (3, [6.0, 0.0, 8.0])], "key long, vector array<double>")
    projected, components, values = E.randomised_svd(few, 2)  # of rank one, with fewer rows than a basis
    again = {r.key: r.reconstructed for r in E.reconstructed(projected, components).collect()}
    assert np.allclose([again[1], again[2], again[3]], [[3, 0, 4], [0, 0, 0], [6, 0, 8]], atol=1e-9)
    assert math.isclose(values[0], math.sqrt(125))
    nothing, none, empty = E.randomised_svd(few.limit(0), 2)
    assert (nothing.count(), none.count(), empty) == (0, 0, [])


def test_pca(vectors, matrix):
    values, axes = np.linalg.eigh(np.cov(matrix.T))
    got = np.array([r.projected for r in E.pca(vectors, 2).orderBy("key").collect()])
    assert np.allclose(np.abs(got), np.abs(matrix @ axes[:, ::-1][:, :2]), atol=1e-8)


def test_unit_vectors_and_cosine(spark, vectors, matrix):
    unit = np.array([r.vector for r in E.l2_normalize(vectors).orderBy("key").collect()])
    assert np.allclose(unit, matrix / np.linalg.norm(matrix, axis=1, keepdims=True))
    pairs = spark.createDataFrame([(0, 1), (2, 2), (3, 999)], "w1 long, w2 long")
    got = {(r.w1, r.w2): r.cos for r in E.cosine_pairs(pairs, vectors).collect()}
    assert set(got) == {(0, 1), (2, 2)} and math.isclose(got[2, 2], 1) and math.isclose(got[0, 1], unit[0] @ unit[1])
    zero = spark.createDataFrame([([0.0, 0.0],)], "v array<double>")
    assert zero.select(VX.cosine(F.col("v"), F.col("v")), VX.l2_normalize(F.col("v"))).first()[:] == (None, [0.0, 0.0])


def test_sparse_times_dense(spark, vectors, matrix):
    coo = spark.createDataFrame([("a", 0, 1.0), ("a", 5, -1.0), ("b", 7, 1.0)], "row string, idx long, v double")
    got = {(r.row, r.j): r.value for r in E.word_vectors(coo, vectors.withColumnRenamed("key", "idx")).collect()}
    assert all(math.isclose(got["a", j], matrix[0, j] - matrix[5, j]) for j in range(8))
    assert all(math.isclose(got["b", j], matrix[7, j]) for j in range(8))


def test_synonyms(spark):
    vectors = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0]), ("d", [1.0, 1.0]), ("b2", [0.9, 0.1])], "key string, vector array<double>"
    )
    questions = spark.createDataFrame(
        [
            (0, "a", ["c", "b", "b2", "d"], 1),  # tie: the first of the equal options wins
            (1, "c", ["a", "b", "d", "b2"], 0),
            (2, "a", ["b", "c", "d", "missing"], 0),
            (3, "missing", ["a", "b", "c", "d"], 0),
        ],
        "qid long, word string, options array<string>, answer int",
    )
    got = {r.qid: (r.answer, r.predicted) for r in E.answer_synonyms(questions, vectors).collect()}
    assert got == {0: ("b", "b"), 1: ("a", "d")}
    assert E.synonym_accuracy(questions, vectors).first()[:] == (2, 50.0)


def test_spearman(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"g": rng.choice(["p", "q"], 300), "x": rng.integers(0, 12, 300), "y": rng.integers(0, 40, 300)})
    frame["y"] += frame["x"] * 2
    frame.loc[frame.index[:5], "y"] = -5
    got = {r.g: (r.n, r.rho) for r in E.spearman(spark.createDataFrame(frame), "x", "y", "g").collect()}
    for g, part in frame.groupby("g"):
        want = np.corrcoef(part["x"].rank(), part["y"].rank())[0, 1]
        assert got[g][0] == len(part) and math.isclose(got[g][1], want, rel_tol=1e-9)
    constant = spark.createDataFrame([("p", 1, 1), ("p", 1, 2)], "g string, x int, y int")
    assert E.spearman(constant, "x", "y", "g").first().rho is None


def test_histogram(vectors, matrix):
    rows = E.value_histogram(vectors, "key", -2, 2, 4).collect()
    got = {}
    for r in rows:
        got[r.key, r.bucket] = r.n
    for key, row in enumerate(matrix):
        edges = [-np.inf, -2, -1, 0, 1, 2, np.inf]
        for b in range(6):
            want = int(((row >= edges[b]) & (row < edges[b + 1])).sum())
            assert got.get((key, b), 0) == want


def test_perplexity_weighs_batches_equally(spark):
    losses = spark.createDataFrame([("v", 0, 1.0), ("v", 0, 3.0), ("v", 1, 4.0)], "dataset string, batch int, loss double")
    assert math.isclose(E.perplexity(losses, "dataset").first().perplexity, math.exp(3.0))


def stop_by_hand(values, threshold=1.0):
    """Epochs 1..n: failures in a row are counted from the second epoch on."""
    patience = 0
    for i in range(1, len(values)):
        if values[i - 1] - values[i] < threshold:
            if patience >= 3:
                return i + 1
            patience += 1
        else:
            patience = 0
    return None


def test_early_stopping(spark):
    rng = np.random.default_rng(2)
    runs = {("m", run): (50 - np.cumsum(rng.normal(0.9, 1.5, 15))).tolist() for run in range(40)}
    rows = [(i, run, e + 1, p) for (i, run), values in runs.items() for e, p in enumerate(values)]
    log = spark.createDataFrame(rows, "id string, run int, epoch int, perplexity double")
    got = {(r.id, r.run): r for r in E.early_stopping(log).collect()}
    stops = set()
    for key, values in runs.items():
        stop = stop_by_hand(values)
        seen = values if stop is None else values[:stop]
        stops.add(stop)
        assert (got[key].stop_epoch, got[key].evaluations) == (stop, len(seen))
        assert math.isclose(got[key].best, min(seen))
    assert None in stops and len(stops) > 2
