"""A linear baseline on chip features, trained and scored on Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from furrow.operators.scoring import scores, with_prediction
from furrow.session import ship_package


def with_weights(feats: DataFrame, weights: list[float] | None) -> DataFrame:
    """Add ``weight``, the weight of the row's class."""
    if weights is None:
        return feats.withColumn("weight", F.lit(1.0))
    return feats.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("class_idx")))


def train_baseline(feats: DataFrame, weights: list[float] | None = None, max_iter: int = 50) -> PipelineModel:
    """Multinomial logistic regression on ``features`` (array) and ``class_idx``.

    The fit starts from zero and has no random part. The optimiser reads its
    input once per step, so pass features that are stored, not recomputed.
    """
    rows = with_weights(feats, weights).select(
        array_to_vector("features").alias("raw"), F.col("class_idx").cast("double").alias("label"), "weight"
    )
    return Pipeline(
        stages=[
            StandardScaler(inputCol="raw", outputCol="scaled", withMean=True),
            LogisticRegression(
                featuresCol="scaled", labelCol="label", weightCol="weight", family="multinomial", maxIter=max_iter, regParam=1e-3
            ),
        ]
    ).fit(rows)


LEAST_VARIANCE = 1e-6
NEWTON_STEPS = 5
RIDGE = 1.0


def feature_scale(feats: DataFrame) -> list[tuple[float, float]]:
    """Mean and deviation of every feature, in order."""
    tall = feats.select(F.posexplode("features").alias("i", "v")).groupBy("i")
    rows = tall.agg(F.avg("v").alias("mean"), F.sqrt(F.greatest(F.var_pop("v"), F.lit(LEAST_VARIANCE))).alias("sd")).collect()
    return [(r["mean"], r["sd"]) for r in sorted(rows, key=lambda r: r["i"])]


def newton_sums(rows: DataFrame, scale: list[tuple[float, float]], weights: np.ndarray) -> DataFrame:
    """Gradient and Gram block of every class at the given coefficients: ``k, i, j, v``, where
    ``j`` one past the last coefficient is the gradient. Each task sums its rows into one
    block per class, and the blocks are added: classes x coefficients squared numbers per task."""
    ship_package(rows.sparkSession)
    mean, sd = (np.array(side) for side in zip(*scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, n = weights.shape
        total = np.zeros((k, n, n + 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = (batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) - mean) / sd
            x = np.hstack((x, np.ones((len(x), 1))))
            label, own = batch.column("class_idx").to_numpy(), batch.column("weight").to_numpy()
            for c in range(k):
                p = 1.0 / (1.0 + np.exp(-(x @ weights[c])))
                total[c, :, :n] += (x * (own * p * (1.0 - p))[:, None]).T @ x
                total[c, :, n] += x.T @ (own * ((label == c) - p))
        at = np.indices(total.shape).reshape(3, -1)
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)) for a in at] + [pa.array(total.ravel())], names=["k", "i", "j", "v"])

    blocks = rows.select("features", F.col("class_idx").cast("int").alias("class_idx"), "weight").mapInArrow(run, "k int, i int, j int, v double")
    return blocks.groupBy("k", "i", "j").agg(F.sum("v").alias("v"))


def train_linear(
    feats: DataFrame, k: int, class_weights: list[float] | None = None, steps: int = NEWTON_STEPS, ridge: float = RIDGE
) -> tuple[list[list[float]], list[float]]:
    """Weighted logistic regression of each class against the rest by Newton steps:
    (coefficients per class, intercepts) for ``linear_predict``.

    Every step is one aggregate; only its sums, whose number depends on classes and
    features alone, come to the driver. Features are scaled inside, and the ridge,
    which covers the intercept too, keeps separable classes finite. Pass features
    that are stored: each step reads them once.
    """
    scale = feature_scale(feats)
    rows = with_weights(feats, class_weights)
    n = len(scale) + 1
    weights = np.zeros((k, n))
    for _ in range(steps):
        total = np.zeros((k, n, n + 1))
        for r in newton_sums(rows, scale, weights).collect():
            total[r["k"], r["i"], r["j"]] = r["v"]
        for c in range(k):
            weights[c] += np.linalg.solve(total[c, :, :n] + ridge * np.eye(n), total[c, :, n] - ridge * weights[c])
    mean, sd = (np.array(side) for side in zip(*scale))
    raw = weights[:, :-1] / sd
    return raw.tolist(), (weights[:, -1] - raw @ mean).tolist()


def class_moments(feats: DataFrame) -> DataFrame:
    """Mean and variance of every feature per class: one row per class and
    feature, by sums that are combined before the shuffle."""
    tall = feats.select("class_idx", F.posexplode("features").alias("i", "v"))
    return tall.groupBy("class_idx", "i").agg(F.avg("v").alias("mean"), F.greatest(F.var_pop("v"), F.lit(LEAST_VARIANCE)).alias("var"))


def linear_predict(feats: DataFrame, weights: list[list[float]], bias: list[float]) -> DataFrame:
    """Logits ``weights @ features + bias`` of given coefficients, one row of weights per class."""

    def logit(row: list[float], b: float) -> Column:
        pairs = F.zip_with("features", F.array(*[F.lit(float(v)) for v in row]), lambda x, w: x * w)
        return F.aggregate(pairs, F.lit(float(b)), lambda a, v: a + v)

    logits = F.array(*[logit(row, b) for row, b in zip(weights, bias)])
    return with_prediction(feats.select("chip_id", F.col("class_idx").alias("label"), logits.alias("logits")))


def gaussian_predict(feats: DataFrame, moments: list[tuple[int, int, float, float]], k: int) -> DataFrame:
    """Log likelihood of every class under independent normal features, equal
    priors (balanced classes), from the rows of ``class_moments``.

    The moments are one row per class and feature, so they ride along as constants.
    A class without training rows is never predicted.
    """
    n = 1 + max(i for _, i, _, _ in moments)
    mean, var = ({(c, i): m for c, i, m, _ in moments}, {(c, i): v for c, i, _, v in moments})

    def logit(c: int) -> Column:
        if (c, 0) not in mean:
            return F.lit(-1e300)
        known = F.array(*[F.struct(F.lit(mean[c, i]).alias("m"), F.lit(var[c, i]).alias("v")) for i in range(n)])
        parts = F.zip_with("features", known, lambda x, g: (x - g["m"]) * (x - g["m"]) / g["v"] + F.log(g["v"]))
        return F.aggregate(parts, F.lit(0.0), lambda a, v: a + v) * -0.5

    logits = F.array(*[logit(c) for c in range(k)])
    return with_prediction(feats.select("chip_id", F.col("class_idx").alias("label"), logits.alias("logits")))


def predict(model: PipelineModel, feats: DataFrame) -> DataFrame:
    """Logits and predicted class per chip."""
    return with_prediction(
        model.transform(feats.withColumn("raw", array_to_vector("features"))).select(
            "chip_id", F.col("class_idx").alias("label"), vector_to_array("rawPrediction").alias("logits")
        )
    )


def evaluate_model(model: PipelineModel, feats: DataFrame, k: int) -> DataFrame:
    return scores(predict(model, feats), k)
