"""The training job: features, models, labels, health and test metrics."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veleta.fixed_values import CLASSES
from veleta.functions.texts import staged
from veleta.operators import evaluation, labels, qc
from veleta.operators.anomaly import fit_anomaly
from veleta.operators.audit import validate_report
from veleta.operators.decision import DecisionClassifier, fit_decision, fit_faults
from veleta.operators.expected import apply_all, fit_all
from veleta.operators.health import health_scores
from veleta.operators.series import SeriesLayout
from veleta.operators.split import SplitBounds, split_bounds, split_chrono
from veleta.operators.temporal import RETRAIN_WINDOWS, WINDOWS
from veleta.plans.features import clean, fit_features
from veleta.plans.score import Engine
from veleta.session import scratch_dir


@dataclass
class Training:
    engine: Engine
    decision: DecisionClassifier
    faults: DecisionClassifier
    bounds: SplitBounds
    scored: DataFrame

    def test_metrics(self, split: str = "test") -> DataFrame:
        """Per-class report of the decision classifier on the test part, or another."""
        test = self.decision.predict(self.scored.filter(F.col("split") == split))
        return evaluation.class_report(evaluation.confusion_matrix(test, "ground_truth_label", "predicted_class", CLASSES))

    def validation_metrics(self) -> list[tuple[str, str, float, float, float, float]]:
        return [
            (t, m, v["mae"], v["rmse"], v["r2"], model.weights.get(m, 0.0))
            for t, model in self.engine.expected.items()
            for m, v in model.metrics.items()
        ]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later fits start from files."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def train_job(
    observations: DataFrame,
    train: float = 0.60,
    val: float = 0.20,
    consistency: bool = True,
    regressors: dict[str, Callable] | None = None,
    classifiers: dict[str, Callable] | None = None,
    windows: tuple[int, ...] = WINDOWS,
    silver: Callable[[DataFrame], DataFrame] = labels.silver_labels_a,
) -> Training:
    """Fit everything on the chronologically first part; keys must be unique.

    A table without labels gets those of ``silver``.

    Backward-looking features are computed on the whole table before it is split, and the
    feature table is written once, since every fit reads it many times.
    """
    report = validate_report(observations).first()
    if not report["is_valid"]:
        raise ValueError(f"missing columns: {report['missing_columns']}")
    layout = SeriesLayout.measure(observations)
    cleaned = stored(clean(observations, layout), "processed")
    bounds = split_bounds(cleaned, train, val)
    first = split_chrono(cleaned, bounds).filter(F.col("split") == "train")
    features = fit_features(first, cleaned, layout, windows=windows, consistency=consistency)
    table = stored(split_chrono(staged(qc.qc_score(features.transform(cleaned)), "checks"), bounds), "features")
    part = {n: table.filter(F.col("split") == n) for n in ("train", "val")}
    expected = fit_all(part["train"], part["val"], regressors)
    with_expected = stored(apply_all(table, expected), "expected")
    anomaly = fit_anomaly(with_expected.filter(F.col("split") == "train"))
    scored = anomaly.transform(with_expected)
    if not labels.has_labels(observations):
        scored = silver(scored)
    scored = stored(scored, "scored")
    part = {n: scored.filter(F.col("split") == n) for n in ("train", "val")}
    engine = Engine(features, expected, anomaly, health_scores(scored).persist())
    with ThreadPoolExecutor(2) as pool:
        decision = pool.submit(fit_decision, part["train"], part["val"], candidates=classifiers)
        faults = pool.submit(fit_faults, part["train"])
        return Training(engine, decision.result(), faults.result(), bounds, scored)


def retrain_job(observations: DataFrame, **named) -> Training:
    """The training job on stored history: wider windows, parts of 70, 15 and 15 percent, labels from rules and scores."""
    return train_job(observations, 0.70, 0.15, windows=RETRAIN_WINDOWS, silver=labels.silver_labels_b, **named)
