"""The one-class SVM's gap and share of outliers; the robust covariance against clustered outliers."""

import datetime as dt

import numpy as np
import pytest

from veleta.operators import anomaly as A

KEYS = "station_id STRING, timestamp TIMESTAMP_NTZ, seq LONG, features ARRAY<DOUBLE>"
AT = dt.datetime(2024, 1, 1)


def table(spark, x, parts=3):
    from pyspark.ml.functions import array_to_vector

    rows = [("A", AT + dt.timedelta(hours=i), i, [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, KEYS).repartition(parts).withColumn("vector", array_to_vector("features")).cache()


@pytest.mark.parametrize("seed,nu", [(1, 0.05), (2, 0.2)])
def test_svm_stops_by_its_gap_and_leaves_nu_outside(spark, seed, nu):
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(size=(900, 4)), rng.normal(size=(60, 4)) + 5, np.zeros((40, 4))])
    model = A.fit_ocsvm(table(spark, x), 4, float(x.var()), nu=nu)
    assert model["gap"] <= A.SVM_GAP and model["steps"] < A.SVM_STEPS
    z = A.fourier(model, x)
    height = z @ model["w"]
    assert abs((height < model["rho"]).mean() - nu) <= 0.01
    # the dual's objective, against projected steps of a plain solver
    n, bound = len(x), 1 / (nu * len(x))
    share = np.full(n, 1 / n)
    for _ in range(4000):
        moved = share - 0.5 / n * (z @ (share @ z))
        low, high = moved.min() - bound, moved.max()
        for _ in range(60):  # shares sum to one within their bounds
            middle = (low + high) / 2
            low, high = (middle, high) if np.clip(moved - middle, 0, bound).sum() > 1 else (low, middle)
        share = np.clip(moved - low, 0, bound)
    best = np.linalg.norm(share @ z) ** 2
    assert model["w"] @ model["w"] <= best * (1 + 5e-3)


def test_several_starts_withstand_clustered_outliers(spark):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(size=(700, 3)), rng.normal(size=(300, 3)) * 0.3 + np.array([9.0, 9.0, 9.0])])
    rows = table(spark, x)
    one = A.fit_elliptic(rows, 1000, support=0.6, starts=1)
    many = A.fit_elliptic(rows, 1000, support=0.6)
    assert many["settled"] and np.abs(many["mean"]).max() < 0.25
    assert np.abs(one["mean"]).max() > 1.0  # the start at the whole table's moments stays with the cluster
    d = A.squared_distances(many, x)
    assert d[700:].min() > np.quantile(d[:700], 0.99)
    assert np.allclose(np.linalg.inv(many["inverse"]), np.eye(3), atol=0.35)


def test_covariance_does_not_depend_on_partitions(spark):
    x = np.random.default_rng(9).normal(size=(400, 3))
    a, b = (A.fit_elliptic(table(spark, x, parts), 400) for parts in (1, 5))
    assert np.allclose(a["mean"], b["mean"]) and np.allclose(a["inverse"], b["inverse"]) and a["settled"]


def test_covariance_settles_where_variances_lie_far_apart(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(600, 6)) @ rng.normal(size=(6, 6))
    x[:, 1] = x[:, 0] + rng.normal(scale=1e-3, size=600)
    x[:, 4] = 0.25  # constant
    x[rng.choice(600, 40, replace=False), 5] *= 1e7
    model = A.fit_elliptic(table(spark, x), 600, starts=2)
    assert model["settled"] and model["steps"] < A.C_STEPS
    for before, after in zip(model["logs"][A.TRIAL_STEPS :], model["logs"][A.TRIAL_STEPS + 1 :]):
        assert all(b <= a + 1e-6 for a, b in zip(before, after))
    d = A.squared_distances(model, x)
    assert set(np.argsort(d)[-30:]) <= set(np.flatnonzero(np.abs(x[:, 5]) > 1e4))
    # units do not matter
    units = np.array([1e-4, 1.0, 30.0, 1.0, 5.0, 1e3])
    again = A.fit_elliptic(table(spark, x * units), 600, starts=2)
    assert np.allclose(A.squared_distances(again, x * units), d, rtol=1e-4)
