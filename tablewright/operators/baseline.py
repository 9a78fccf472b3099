"""Baseline models and what they are worth: least squares, logistic regression, AUC, calibration.

A step of a fit is one aggregate: each task reduces its rows to a matrix as wide as the features, and
Spark adds the matrices up. The driver solves systems of that width and never sees a row. Features are
standardised first, so that units don't decide how well the systems can be solved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import as_double, is_finite
from tablewright.operators.association import average_ranks
from tablewright.operators.scalars import scalar_statistics


@dataclass(frozen=True)
class Model:
    """A linear predictor; `logistic` says that its value is a log odds ratio."""

    target: str
    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float
    rows: int
    steps: int
    converged: bool
    logistic: bool

    def table(self, spark) -> DataFrame:
        """position, feature, coefficient; the intercept comes first, without a feature."""
        rows = [(0, None, self.intercept), *((i, f, c) for i, (f, c) in enumerate(zip(self.features, self.coefficients), 1))]
        return spark.createDataFrame(rows, "position int, feature string, coefficient double")

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """`df` with the predicted value, or the probability; null where a feature is missing. Plain
        column expressions: no Python, no shuffle."""
        value: Column = F.lit(self.intercept)
        for feature, weight in zip(self.features, self.coefficients):
            value = value + _finite(feature) * F.lit(weight)
        return df.withColumn(name, F.lit(1.0) / (F.lit(1.0) + F.exp(-value)) if self.logistic else value)


def _finite(name: str) -> Column:
    number = as_double(name)
    return F.when(is_finite(number), number)


def _complete(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """y, x0, x1, ... as doubles, of the rows that have all of them."""
    for name in (target, *features):
        kind = df.schema[name].dataType
        if not isinstance(kind, (T.NumericType, T.BooleanType)):
            raise ValueError(f"column '{name}' is neither a number nor a boolean")
    numbers = df.select(_finite(target).alias("y"), *[_finite(f).alias(f"x{i}") for i, f in enumerate(features)])
    return numbers.dropna()


def _standard(rows: DataFrame, features: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, means and deviations of the features (1 where a feature is constant)."""
    count, found = scalar_statistics(rows, [f for f in rows.schema.fields if f.name != "y"])
    means = np.array([s["mean"] or 0.0 for s in found])
    spread = np.array([s["stddev"] if s["stddev"] and s["low"] < s["high"] else 1.0 for s in found])
    return count, means, spread


Reduction = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _summed(rows: DataFrame, means: np.ndarray, spread: np.ndarray, reduce: Reduction, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all rows of a matrix that `reduce` makes of standardised features, after a column of
    ones, and targets. A task sends one cell per place, whatever the number of its rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if not batch.num_rows:
                continue
            y, *xs = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            z = np.column_stack([np.ones(len(y)), *[(x - m) / s for x, m, s in zip(xs, means, spread)]])
            total += reduce(z, y)
        i, j = np.indices(shape).reshape(2, -1)
        arrays = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.reshape(-1))]
        yield pa.RecordBatch.from_arrays(arrays, names=["i", "j", "v"])

    found = rows.mapInArrow(add, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros(shape)
    for r in found.collect():  # one per place
        out[r.i, r.j] = r.v
    return out


def _back(weights: np.ndarray, means: np.ndarray, spread: np.ndarray) -> tuple[tuple[float, ...], float]:
    """Weights of standardised features as coefficients of the features, and the intercept."""
    own = weights[1:] / spread
    return tuple(own.tolist()), float(weights[0] - own @ means)


def linear_regression(df: DataFrame, target: str, features: list[str]) -> Model:
    """Least squares by the normal equations of standardised features.

    Rows with a null, NaN or infinite value in a used column are left out. Of features that depend
    on each other the solution of least length is taken; a constant feature weighs nothing. Without
    rows all weights are 0.
    """
    rows = _complete(df, target, features)
    count, means, spread = _standard(rows, features)
    width = len(features) + 1

    def gram(z: np.ndarray, y: np.ndarray) -> np.ndarray:
        return z.T @ np.column_stack([z, y])

    sums = _summed(rows, means, spread, gram, (width, width + 1))
    weights = np.linalg.lstsq(sums[:, :width], sums[:, width], rcond=1e-12)[0]
    coefficients, intercept = _back(weights, means, spread)
    return Model(target, tuple(features), coefficients, intercept, count, 1, True, False)


def logistic_regression(
    df: DataFrame, target: str, features: list[str], l2: float = 0.0, steps: int = 25, tolerance: float = 1e-10
) -> Model:
    """Maximum likelihood by Newton steps, one aggregate each, from weights of 0.

    The target is 0 or 1, or a boolean. `l2` pulls the weights of standardised features to 0; without
    it, classes that a plane divides have no finite solution, and the fit ends after `steps` with
    `converged` false. Rows are left out as in `linear_regression`.
    """
    rows = _complete(df, target, features)
    if rows.filter("y <> 0 AND y <> 1").limit(1).count():
        raise ValueError(f"target '{target}' has values beside 0 and 1")
    count, means, spread = _standard(rows, features)
    width = len(features) + 1
    weights, converged, step = np.zeros(width), False, 0
    ridge = l2 * np.diag([0.0, *[1.0] * len(features)])
    while count and step < steps and not converged:
        current = weights

        def newton(z: np.ndarray, y: np.ndarray) -> np.ndarray:
            p = 1 / (1 + np.exp(-np.clip(z @ current, -700, 700)))
            return np.column_stack([(z * (p * (1 - p))[:, None]).T @ z, z.T @ (y - p)])

        sums = _summed(rows, means, spread, newton, (width, width + 1))
        move = np.linalg.lstsq(sums[:, :width] + ridge, sums[:, width] - ridge @ weights, rcond=1e-12)[0]
        weights = weights + move
        step += 1
        converged = bool(np.abs(move).max() <= tolerance * max(1.0, np.abs(weights).max()))
    coefficients, intercept = _back(weights, means, spread)
    return Model(target, tuple(features), coefficients, intercept, count, step, converged, True)


def _judged(df: DataFrame, score: str, label: str) -> DataFrame:
    """v, the score, and y, 0 or 1, of the rows that have both."""
    number, truth = as_double(score), as_double(label)
    return df.select(F.when(~F.isnan(number), number + F.lit(0.0)).alias("v"), truth.alias("y")).dropna()


def classification_quality(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: rows, positives, auc, brier, log_loss of probabilities against labels 0 and 1.

    The area under the curve is exact, ties count half: equal scores are one row with their counts,
    and ranks come from counts sorted in ranges. It is null if one class is missing. Rows without a
    score or label are left out; the logarithm sees scores within 1e-15 of 0 and 1.
    """
    judged = _judged(df, score, label)
    counts = judged.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    ranked = average_ranks(counts.select(F.lit(0).alias("key"), "v", "n", "pos"))
    p = F.least(F.greatest(F.col("v"), F.lit(1e-15)), F.lit(1 - 1e-15))
    sums = ranked.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("pos"), F.lit(0.0)).alias("positives"),
        F.sum(F.col("pos") * F.col("rank")).alias("ranks"),
        F.sum(F.col("pos") * (1 - F.col("v")) * (1 - F.col("v")) + (F.col("n") - F.col("pos")) * F.col("v") * F.col("v")).alias("squares"),
        F.sum(-(F.col("pos") * F.ln(p) + (F.col("n") - F.col("pos")) * F.ln(1 - p))).alias("loss"),
    )
    pos, neg = F.col("positives"), F.col("rows") - F.col("positives")
    return sums.select(
        "rows",
        pos.cast("bigint").alias("positives"),
        F.when((pos > 0) & (neg > 0), (F.col("ranks") - pos * (pos + 1) / 2) / pos / neg).alias("auc"),
        F.try_divide("squares", "rows").alias("brier"),
        F.try_divide("loss", "rows").alias("log_loss"),
    )


def calibration(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """bin, rows, mean_score, positive_rate for probabilities in `bins` equal widths; empty bins are left out."""
    judged = _judged(df, score, label).filter("v BETWEEN 0 AND 1")
    place = F.least(F.floor(F.col("v") * bins), F.lit(bins - 1)).cast("int")
    return judged.groupBy(place.alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg("v").alias("mean_score"), F.avg("y").alias("positive_rate")
    )
