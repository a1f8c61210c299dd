"""Classifiers that a learning loop trains on labelled vectors."""

from __future__ import annotations

from abc import ABC, abstractmethod
from uuid import uuid4

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.functions.vector import doubles, is_finite
from docsieve.schema import POSITIVE

#: Training values (rows times columns) up to which the solver runs on the driver.
SMALL = 4_000_000


def newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float, tol: float, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Coefficients and intercept that minimise c * sum(weight * loss) + |w|² / 2, until no part of the gradient exceeds ``tol``.

    Newton steps are halved until the objective falls; the objective is strictly convex, so that there is one solution.
    """
    one = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.r_[np.ones(x.shape[1]), 0.0]
    sign = np.where(y, 1.0, -1.0)
    w = np.zeros(one.shape[1])
    cost = lambda w: c * (weight * np.logaddexp(0, -sign * (one @ w))).sum() + (ridge * w * w).sum() / 2
    value = cost(w)
    for _ in range(rounds):
        p = np.exp(-np.logaddexp(0, -(one @ w)))
        slope = c * one.T @ (weight * (p - y)) + ridge * w
        if np.abs(slope).max() <= tol:
            break
        bend = (one * (c * weight * p * (1 - p))[:, None]).T @ one + np.diag(ridge + 1e-12)
        step, size = np.linalg.solve(bend, slope), 1.0
        while (next_ := cost(w - size * step)) > value and size > 1e-9:
            size /= 2
        w, value = w - size * step, next_
    return w[:-1], float(w[-1])


def model_of(spark: SparkSession, coefficients: np.ndarray, intercept: float) -> LogisticRegressionModel:
    """Spark's model with given coefficients, to be applied and saved like any other."""
    values = spark.sparkContext._gateway.new_array(spark._jvm.double, len(coefficients))
    for i, v in enumerate(coefficients.tolist()):
        values[i] = v
    ml = spark._jvm.org.apache.spark.ml
    return LogisticRegressionModel(ml.classification.LogisticRegressionModel(f"logreg-{uuid4().hex[:12]}", ml.linalg.Vectors.dense(values), intercept))


class Classifier(ABC):
    """What a loop needs: to be fitted on labelled rows and to score any rows."""

    @abstractmethod
    def fit(self, rows: DataFrame, vector_col: str = "embedding", label_col: str = "gt") -> Classifier: ...

    @abstractmethod
    def predict(self, rows: DataFrame, vector_col: str = "embedding") -> DataFrame:
        """``rows`` with ``prediction``, the probability of the positive class; null for vectors that are null, of another length or not finite."""


class BalancedLogisticRegression(Classifier):
    """L2-regularised logistic regression whose classes weigh the same.

    ``c`` divides the penalty as usual: the objective is c * sum(weight * loss) + |w|² / 2. As balanced weights sum to
    the number of rows n, that is Spark's objective at a regularisation of 1 / (c * n) without standardisation. Training sets of at most
    ``SMALL`` values are solved on the driver, larger ones by Spark; both stop at the one solution there is.
    """

    def __init__(self, c: float = 1.0, max_iter: int = 10_000, tol: float = 1e-9):
        if c <= 0:
            raise ValueError("c must be positive")
        self.c, self.max_iter, self.tol = c, max_iter, tol
        self.model: LogisticRegressionModel | None = None

    def fit(self, rows: DataFrame, vector_col: str = "embedding", label_col: str = "gt") -> BalancedLogisticRegression:
        label = F.col(label_col)
        known = rows.where(label.isNotNull())
        counts = {r[label_col]: (r["rows"], r["d"]) for r in known.groupBy(label_col).agg(F.count(F.lit(1)).alias("rows"), F.max(F.size(vector_col)).alias("d")).collect()}
        if len(counts) < 2:
            raise ValueError("both classes are needed")
        n, dimension = sum(count for count, _ in counts.values()), max(d for _, d in counts.values())
        weights = {y: n / (2 * count) for y, (count, _) in counts.items()}
        if n * dimension <= SMALL:
            got = known.select(doubles(vector_col).alias("v"), label.cast("boolean").alias("y")).toArrow()
            y = got.column("y").to_numpy(zero_copy_only=False).astype(bool)
            x = got.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(y), dimension)
            self.model = model_of(rows.sparkSession, *newton(x, y, np.where(y, weights[True], weights[False]), self.c, self.tol))
            return self
        ready = known.select(array_to_vector(doubles(vector_col)).alias("features"), label.cast("double").alias("label"), F.when(label, weights[True]).otherwise(weights[False]).alias("weight"))
        self.model = LogisticRegression(regParam=1 / (self.c * n), elasticNetParam=0.0, standardization=False, weightCol="weight", maxIter=self.max_iter, tol=self.tol).fit(ready)
        return self

    def predict(self, rows: DataFrame, vector_col: str = "embedding") -> DataFrame:
        if self.model is None:
            raise ValueError("not fitted")
        fits = is_finite(vector_col, self.model.numFeatures)  # decided here, as a filter may be evaluated after the model
        safe = F.when(fits, doubles(vector_col)).otherwise(F.array_repeat(F.lit(0.0), self.model.numFeatures))
        scored = self.model.transform(rows.withColumn("features", array_to_vector(safe)))
        return scored.withColumn("prediction", F.when(fits, vector_to_array("probability")[1])).drop("features", "rawPrediction", "probability")


def is_positive(prediction: Column) -> Column:
    """Strictly above the threshold; NaN is not."""
    return (prediction > POSITIVE) & ~F.isnan(prediction)


def confidence(prediction: Column) -> Column:
    return F.abs(prediction - POSITIVE)
