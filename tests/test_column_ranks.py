"""Order statistics of whole columns without a shuffle of their values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veleta.operators import anomaly as A
from veleta.operators import feature_prep, order_stats


@pytest.fixture(scope="module")
def columns(spark):
    rng = np.random.default_rng(5)
    n = 6000
    frame = pd.DataFrame({"near": rng.normal(size=n), "tied": rng.integers(-5, 5, n) / 2.0, "wide": rng.normal(size=n) * 10.0 ** rng.integers(-300, 300, n)})
    frame = frame.astype(object).where(rng.random(frame.shape) > 0.1, None)
    df = spark.createDataFrame(frame, "near double, tied double, wide double").withColumn("one", F.lit(-0.0))
    odd = F.when(F.col("near") > 1, float("nan")).when(F.col("near") > -1, F.col("tied")).otherwise(float("-inf"))
    return df.withColumns({"none": F.lit(None).cast("double"), "odd": odd}).repartition(5).persist()


def test_whole_columns_shuffle_no_values(columns, monkeypatch):
    monkeypatch.setattr(order_stats, "FEW", 50)
    monkeypatch.setattr(order_stats, "_ranked_quantiles", lambda *a: pytest.fail("values were shuffled"))
    probs = [0.0, 0.05, 0.5, 0.77, 1.0]
    exact = order_stats.quantiles(columns, [], columns.columns, probs, True).first().asDict()
    found = order_stats.quantiles(columns, [], columns.columns, probs, False).first().asDict()
    assert list(found) == list(exact)
    for name, value in exact.items():
        assert found[name] is None if value is None else found[name] == pytest.approx(value, rel=1e-14, nan_ok=True), name


def test_scaling_is_the_same_either_way(columns, monkeypatch):
    cols = ["near", "tied", "wide"]
    small = feature_prep.fit_scaling(columns, cols)
    monkeypatch.setattr(feature_prep, "SMALL_GROUP_ROWS", 0)
    asked = []
    search = feature_prep.column_ranks
    monkeypatch.setattr(feature_prep, "column_ranks", lambda *a: asked.append(a) or search(*a))
    assert feature_prep.fit_scaling(columns, cols) == small
    assert len(asked) == 1  # medians and quartiles in one go

def test_one_class_svm_takes_no_percentile_of_all_rows(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(800, 3))
    df = spark.createDataFrame([(f"s{i % 5}", i, v.tolist()) for i, v in enumerate(x)], "station_id string, seq long, features array<double>").repartition(3)
    monkeypatch.setattr(A, "quantiles", lambda *a: pytest.fail("heights were ordered in one task or shuffled"))
    model = A.fit_ocsvm(df, 3, float(x.var()), 800)
    assert model["gap"] <= A.SVM_GAP
    heights = A.fourier(model, x) @ model["w"]
    assert (heights < model["rho"] - 1e-9).sum() <= 0.05 * 800 + 1
