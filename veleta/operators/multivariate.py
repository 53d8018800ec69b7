"""Cross-sensor consistency: extremely randomised tree regressions and Mahalanobis distance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veleta.fixed_values import SENSORS
from veleta.operators.feature_prep import Scaling, fit_scaling
from veleta.operators.random_cut_trees import RandomCutTrees, Settings, fit_random_cuts
from veleta.operators.series import source_column

MIN_ROWS = 10
RIDGE = 1e-6


def complete(df: DataFrame, sensors: Sequence[str] = SENSORS) -> Column:
    return reduce(lambda a, b: a & b, [F.col(source_column(df, s)).isNotNull() for s in sensors])


def moments(df: DataFrame, cols: Sequence[Column]) -> DataFrame:
    """Means and the sample covariance triangle of the given expressions in one pass."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    return df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.covar_samp(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs],
    )


def mean_and_covariance(df: DataFrame, cols: Sequence[Column]) -> tuple[np.ndarray, np.ndarray]:
    """Collects one row of d + d(d+1)/2 numbers."""
    row, d = moments(df, cols).first(), len(cols)
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)], dtype=float)
    return np.array([row[f"m{i}"] for i in range(d)], dtype=float), cov


def squared_distance(values: Sequence[Column], mean: np.ndarray, inverse: np.ndarray) -> Column:
    """The quadratic form (x - mean)' inverse (x - mean) as one codegen'd expression."""
    diff = [v - F.lit(float(m)) for v, m in zip(values, mean)]
    terms = [
        diff[i] * diff[j] * F.lit(float(inverse[i, j] * (1.0 if i == j else 2.0)))
        for i in range(len(diff))
        for j in range(i, len(diff))
    ]
    return F.greatest(reduce(lambda a, b: a + b, terms), F.lit(0.0))


@dataclass
class Consistency:
    scaling: Scaling
    mean: np.ndarray
    inverse: np.ndarray
    regressors: dict[str, tuple[RandomCutTrees, list[str]]]

    def distance(self, df: DataFrame) -> DataFrame:
        values = [self.scaling.scaled(df, c) for c in self.scaling.cols]
        d2 = squared_distance(values, self.mean, self.inverse)
        return df.withColumn("mahalanobis_distance", F.when(complete(df), F.sqrt(d2)))

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.distance(df)
        for sensor, (model, inputs) in self.regressors.items():
            src = F.col(source_column(df, sensor))
            filled = F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in inputs])
            out = (
                model.transform(out.withColumn("_mv", filled), "_mv")
                .withColumn(f"mv_{sensor}_residual", F.when(complete(df), src - F.col("_mv_pred")))
                .drop("_mv", "_mv_pred")
            )
        return out


def fit_mahalanobis(train: DataFrame) -> Consistency | None:
    cols = [source_column(train, s) for s in SENSORS]
    rows = train.filter(complete(train)).select(*cols)
    n = rows.count()
    if n < MIN_ROWS:
        return None
    scaling = fit_scaling(rows, cols, n)
    mean, cov = mean_and_covariance(rows, [scaling.scaled(rows, c) for c in cols])
    return Consistency(scaling, mean, np.linalg.inv(cov + np.eye(len(cols)) * RIDGE), {})


def fit_consistency(train: DataFrame, trees: int = 50, depth: int = 4, leaf: int = 3) -> Consistency | None:
    """Each sensor from the other four, and the distance of the sensor vector."""
    fitted = fit_mahalanobis(train)
    if fitted is None:
        return None
    rows = train.filter(complete(train))
    sources = [source_column(train, s) for s in SENSORS]
    key = F.xxhash64(*[F.col(c) for c in ("station_id", "timestamp", "seq") if c in rows.columns]).alias("row")
    examples = reduce(DataFrame.unionByName, [
        rows.select(
            F.lit(i).alias("set"), key, F.array(*[F.col(c).cast("double") for c in sources if c != src]).alias("features"), F.col(src).cast("double").alias("label"))
        for i, src in enumerate(sources)])
    models = fit_random_cuts(examples, [Settings("_mv_pred", i, trees, depth, leaf) for i in range(len(sources))])
    for i, sensor in enumerate(SENSORS):
        fitted.regressors[sensor] = (models[i, "_mv_pred"], [c for c in sources if c != sources[i]])
    return fitted
