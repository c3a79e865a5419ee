"""Word-vector evaluation, projections and experiment logs."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.functions import hashing
from corpuslens.functions import vectors as VX
from corpuslens.operators.ordering import running_total
from corpuslens.session import checkpoint_dir

MAX_FAILURES = 3
SALTS = 16


def word_vectors(coo: DataFrame, matrix: DataFrame) -> DataFrame:
    """``(row, j, value)``: sparse rows ``(row, idx, v)`` times a matrix ``(idx, vector)``.

    The matrix has few rows, each wanted by many words, so each is offered to several tasks.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    cells = matrix.select("idx", "vector", salts).select("idx", "_salt", F.posexplode("vector").alias("j", "e"))
    dealt = coo.withColumn("_salt", F.pmod(F.hash("row"), F.lit(SALTS)))
    return dealt.join(cells, ["idx", "_salt"]).groupBy("row", "j").agg(F.sum(F.col("v") * F.col("e")).alias("value"))


def l2_normalize(vectors: DataFrame, vector: str = "vector") -> DataFrame:
    return vectors.withColumn(vector, VX.l2_normalize(F.col(vector)))


def cosine_pairs(pairs: DataFrame, vectors: DataFrame, a: str = "w1", b: str = "w2") -> DataFrame:
    """Adds `cos` to pairs of keys; pairs with an unknown key are left out."""
    left = vectors.select(F.col("key").alias(a), F.col("vector").alias("_va"))
    right = vectors.select(F.col("key").alias(b), F.col("vector").alias("_vb"))
    found = pairs.join(left, a).join(right, b)
    return found.select(*pairs.columns, VX.cosine(F.col("_va"), F.col("_vb")).alias("cos"))


def answer_synonyms(questions: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(qid, word, answer, predicted)`` for questions whose words are all known.

    The prediction is the option with the highest cosine, the first one on ties.
    """
    options = questions.select("qid", "word", F.size("options").alias("_n"), F.posexplode("options").alias("opt", "option"))
    scored = cosine_pairs(options, vectors, "word", "option")
    best = F.max_by("option", F.struct("cos", -F.col("opt")))
    chosen = scored.groupBy("qid").agg(best.alias("predicted"), F.count("*").alias("_found"), F.max("_n").alias("_n"))
    gold = questions.select("qid", "word", F.col("options")[F.col("answer")].alias("answer"))
    return gold.join(chosen.where("_found = _n"), "qid").select("qid", "word", "answer", "predicted")


def synonym_accuracy(questions: DataFrame, vectors: DataFrame) -> DataFrame:
    """Answered questions and accuracy in percent."""
    right = F.when(F.col("answer") == F.col("predicted"), 1.0).otherwise(0.0)
    return answer_synonyms(questions, vectors).agg(F.count("*").alias("questions"), (F.avg(right) * 100).alias("accuracy"))


def average_ranks(counts: DataFrame, by: str, value: str) -> DataFrame:
    """``(by, value, rank)`` from ``(by, value, _m)`` with counts: ties share their mean rank.

    Works on distinct values with running totals, so a group may be of any size.
    """
    distinct = counts.groupBy(by, value).agg(F.sum("_m").alias("_n"))
    placed = running_total(distinct, by, value, value="_n", name="_start")
    groups = placed.groupBy(by).agg(F.min("_start").alias("_base"), F.sum("_n").alias("_total"))
    rank = F.col("_start") - F.col("_base") + (F.col("_n") + 1) / 2
    return placed.join(groups, by).select(by, value, (rank - (F.col("_total") + 1) / 2).alias(f"_r_{value}"))


def spearman(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """Rank correlation of x and y per group, with average ranks for ties."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    checkpoint_dir(df.sparkSession)
    counts = known.groupBy(by, x, y).agg(F.count("*").alias("_m")).checkpoint()  # read three times
    ranked = counts.join(average_ranks(counts, by, x), [by, x]).join(average_ranks(counts, by, y), [by, y])
    rx, ry, m = F.col(f"_r_{x}"), F.col(f"_r_{y}"), F.col("_m")  # ranks minus their mean
    sums = ranked.groupBy(by).agg(
        F.sum("_m").alias("n"), F.sum(m * rx * ry).alias("_xy"), F.sum(m * rx * rx).alias("_xx"), F.sum(m * ry * ry).alias("_yy")
    )
    spread = F.sqrt("_xx") * F.sqrt("_yy")
    return sums.select(by, "n", F.when(spread > 0, F.col("_xy") / spread).alias("rho"))


def pca(vectors: DataFrame, components: int = 2, vector: str = "vector") -> DataFrame:
    """Projection on the principal components as `projected`.

    Each component's sign is chosen so that its largest entry is positive.  The covariance
    matrix, dimension squared, is on the driver.
    """
    rows = vectors.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = PCA(k=components, inputCol="_v", outputCol="_p").fit(rows)
    signs = [-1.0 if max(c, key=abs) < 0 else 1.0 for c in model.pc.toArray().T.tolist()]
    turned = F.zip_with(vector_to_array("_p"), F.lit(signs), lambda x, sign: x * sign)
    return model.transform(rows).withColumn("projected", turned).drop("_v", "_p", vector)


def right_singular_vectors(vectors: DataFrame, r: int, vector: str = "vector"):
    """The r largest singular values and their right vectors (one array per component).

    Each vector's sign is chosen so that its largest entry is positive.  The driver holds
    r vectors of the dimension.
    """
    dense = vectors.select(array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    svd = RowMatrix(MLUtils.convertVectorColumnsFromML(dense, "v")).computeSVD(r)  # rows stay in the JVM
    components = svd.V.toArray().T.tolist()
    flipped = [[-x for x in c] if max(c, key=abs) < 0 else c for c in components]
    return list(svd.s), flipped


def truncated_svd(vectors: DataFrame, r: int, vector: str = "vector") -> DataFrame:
    """U_r * S_r as `projected`: rows times the right singular vectors, which are one broadcast row."""
    _, components = right_singular_vectors(vectors, r, vector)
    held = vectors.sparkSession.createDataFrame([(components,)], "v array<array<double>>").scalar()
    with_v = vectors.withColumn("_v", held)
    projected = F.transform("_v", lambda c: VX.dot(F.col(vector), c))
    return with_v.withColumn("projected", projected).drop(vector, "_v")


def _times(vector: Column | str, columns: Column) -> Column:
    """A row vector, derived once, times a matrix given by its columns, one array each."""
    return F.transform(F.array(vector), lambda v: F.transform(columns, lambda c: VX.dot(v, c)))[0]


def _right_inverse(rows: DataFrame, vector: str) -> tuple[np.ndarray, Column]:
    """R of the rows' QR decomposition, and the columns of its inverse, by which rows become those of Q.

    The decomposition is one of blocks, a block being a task's rows, whose triangles are
    decomposed again in a tree; only R, as wide as the rows and no longer, comes to the driver.
    """
    dense = rows.select(array_to_vector(F.col(vector)).alias("v"))
    r = RowMatrix(MLUtils.convertVectorColumnsFromML(dense, "v")).tallSkinnyQR().R.toArray()
    return r, F.lit(np.linalg.pinv(r, rcond=1e-12).T.tolist())


def random_columns(spark: SparkSession, dimension: int, count: int, seed: int = 0) -> DataFrame:
    """``(idx, vector)``: a random matrix of numbers between -1 and 1, a row for each dimension, from hashes."""
    number = lambda j: hashing.uniform(seed, F.col("id"), j) * 2 - 1
    return spark.range(dimension).select("id", F.transform(F.sequence(F.lit(0), F.lit(count - 1)), number).alias("vector")).toDF("idx", "vector")


def _held(matrix: DataFrame) -> Column:
    """The columns of a matrix ``(idx, vector)`` as one array of arrays, a value of one row that joins need not be made for."""
    rows = F.sort_array(F.collect_list(F.struct("idx", "vector")))
    by_row = matrix.agg(F.transform(rows, lambda x: x["vector"]).alias("m"))
    turned = F.transform(F.sequence(F.lit(0), F.size(F.col("m")[0]) - 1), lambda j: F.transform("m", lambda row: F.get(row, j)))
    return by_row.select(turned).scalar()


def randomised_svd(
    vectors: DataFrame, r: int, oversample: int = 10, power_steps: int = 2, seed: int = 0, vector: str = "vector"
) -> tuple[DataFrame, DataFrame, list[float]]:
    """U_r * S_r as `projected`, the right singular vectors ``(idx, vector)``, and the r largest singular values.

    The rows' range is found by a random matrix of r + `oversample` columns and sharpened by
    `power_steps` passes back and forth, each orthonormalised by blocked QR.  The driver holds
    factors as wide as that, never one of the dimension or of the rows; a matrix of the dimension
    times the width is a table.  Each component's sign makes its largest entry positive.
    """
    spark = vectors.sparkSession
    checkpoint_dir(spark)
    dimension = vectors.agg(F.max(F.size(vector))).first()[0] or 0
    if not dimension:
        return vectors.withColumn("projected", F.array().cast("array<double>")).drop(vector), spark.createDataFrame([], MATRIX), []
    width = min(dimension, r + oversample)
    rows = vectors.withColumn("_v", F.col(vector).cast("array<double>"))
    basis = random_columns(spark, dimension, width, seed)
    for step in range(power_steps + 1):
        ranged = rows.withColumn("_m", _held(basis)).withColumn("_y", _times("_v", F.col("_m"))).drop("_m")
        _, inverse = _right_inverse(ranged, "_y")
        ranged = ranged.withColumn("_q", _times("_y", inverse))
        across = _transposed_product(ranged, "_v", "_q").checkpoint()
        triangle, inverse = _right_inverse(across, "vector")
        basis = across.select("idx", _times("vector", inverse).alias("vector")).checkpoint()
    left, values, right = np.linalg.svd(triangle.T)
    n = min(r, len(values))
    components = basis.select("idx", _times("vector", F.lit(right[:n].tolist())).alias("vector"))
    entry = [F.col("vector")[j] for j in range(n)]
    largest = components.agg(*[F.max_by(e, F.abs(e)).alias(f"c{j}") for j, e in enumerate(entry)]).first()
    signs = np.where(np.array(largest, float) < 0, -1.0, 1.0)
    components = components.select("idx", F.zip_with("vector", F.lit(signs.tolist()), lambda x, sign: x * sign).alias("vector"))
    scale = left[:, :n] * values[:n] * signs
    projected = ranged.withColumn("projected", _times("_q", F.lit(scale.T.tolist()))).drop(vector, "_v", "_y", "_q")
    return projected, components, values[:n].tolist()


MATRIX = "idx long, vector array<double>"


def _transposed_product(rows: DataFrame, left: str, right: str) -> DataFrame:
    """``(idx, vector)``: the transpose of the rows' `left` vectors times their `right` ones, summed partially in the tasks."""
    width = rows.agg(F.max(F.size(right))).first()[0]
    cells = rows.select(right, F.posexplode(left).alias("idx", "_x"))
    sums = [F.sum(F.col("_x") * F.col(right)[j]).alias(f"s{j}") for j in range(width)]
    return cells.groupBy(F.col("idx").cast("long").alias("idx")).agg(*sums).select("idx", F.array(*[f"s{j}" for j in range(width)]).alias("vector"))


def reconstructed(projected: DataFrame, components: DataFrame) -> DataFrame:
    """`projected` rows times the transposed components: the matrix again, up to the components left out."""
    by_row = F.transform(F.sort_array(F.collect_list(F.struct("idx", "vector"))), lambda x: x["vector"])
    held = components.agg(by_row.alias("m")).scalar()
    return projected.withColumn("_m", held).withColumn("reconstructed", _times("projected", F.col("_m"))).drop("projected", "_m")


def value_histogram(vectors: DataFrame, key: str, low: float, high: float, bins: int, vector: str = "vector") -> DataFrame:
    """``(key, bucket, n)``: bucket 0 and bins+1 hold values outside [low, high)."""
    cells = vectors.select(key, F.explode(vector).alias("v"))
    bucket = F.width_bucket(F.col("v").cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    return cells.groupBy(key, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def perplexity(losses: DataFrame, *by: str, batch: str = "batch", loss: str = "loss") -> DataFrame:
    """exp of the mean of the per-batch mean losses; batches count equally whatever their size."""
    means = losses.groupBy(*by, batch).agg(F.avg(loss).alias("_mean"))
    return means.groupBy(*by).agg(F.exp(F.avg("_mean")).alias("perplexity"))


def early_stopping(log: DataFrame, threshold: float = 1.0, failures: int = MAX_FAILURES) -> DataFrame:
    """``(id, run, evaluations, stop_epoch, best)`` for logs ``(id, run, epoch, perplexity)``.

    An evaluation fails when the perplexity falls by less than `threshold`.  Training
    stops at the first failure that follows `failures` failures in a row; the first
    evaluation has nothing to compare with.  A window holds one run's evaluations.
    """
    run = Window.partitionBy("id", "run").orderBy("epoch")
    gain = F.lag("perplexity").over(run) - F.col("perplexity")
    judged = log.withColumn("_fail", F.when(gain < threshold, 1).otherwise(0))
    streaks = judged.withColumn("_good", F.sum(1 - F.col("_fail")).over(run))
    streak = F.sum("_fail").over(Window.partitionBy("id", "run", "_good").orderBy("epoch"))
    stops = streaks.withColumn("_streak", streak).withColumn(
        "_stop", F.min(F.when(F.col("_streak") > failures, F.col("epoch"))).over(Window.partitionBy("id", "run"))
    )
    seen = stops.where(F.col("_stop").isNull() | (F.col("epoch") <= F.col("_stop")))
    return seen.groupBy("id", "run").agg(
        F.count("*").alias("evaluations"), F.min("_stop").alias("stop_epoch"), F.min("perplexity").alias("best")
    )
