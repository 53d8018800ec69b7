"""Supervised classifiers: decision classes, fault types and probability calibration."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.errors import IllegalArgumentException
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veleta.fixed_values import CLASSES
from veleta.operators import boosted_trees
from veleta.operators.evaluation import class_report, confusion_matrix
from veleta.operators.expected import row_key
from veleta.operators.feature_prep import Scaling, decision_features, feature_select, fit_scaling
from veleta.operators.rules import inferred_fault, map_fault_text

log = logging.getLogger(__name__)


def class_index(label: Column, classes: Sequence[str]) -> Column:
    return F.coalesce(*[F.when(label == c, F.lit(float(i))) for i, c in enumerate(classes)])


def class_name(index: Column, classes: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in classes]), index.cast("int") + 1)


def balanced(df: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Row weight n / (k * n_c); one count per class travels to the driver."""
    counts = {r["_label"]: r["n"] for r in df.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, k = sum(counts.values()), max(len(counts), 1)
    weight = F.coalesce(*[F.when(F.col("_label") == i, F.lit(n / (k * c))) for i, c in counts.items()])
    return df.withColumn("_weight", weight)


def dc_logistic(rows: int):
    return LogisticRegression(
        labelCol="_label", weightCol="_weight", maxIter=100, regParam=1.0 / (0.5 * max(rows, 1)), family="multinomial"
    )


def dc_forest(rows: int):
    return RandomForestClassifier(
        labelCol="_label", weightCol="_weight", numTrees=150, maxDepth=8, minInstancesPerNode=2, seed=42
    )


def dc_boosted(rows: int) -> boosted_trees.Settings:
    """A tree per class and round on softmax gradients; classes share every pass."""
    return boosted_trees.Settings("xgboost", 0, rounds=150, depth=5, rate=0.08, sample=0.8, penalty=1.0, least_weight=1.0)


CANDIDATES: dict[str, Callable] = {
    "logistic_regression": dc_logistic,
    "random_forest": dc_forest,
    "xgboost": dc_boosted,
}


@dataclass
class DecisionClassifier:
    classes: list[str] = field(default_factory=lambda: list(CLASSES))
    scaling: Scaling | None = None
    model: object | None = None
    best: str = ""
    macro_f1: dict[str, float] = field(default_factory=dict)
    failed: dict[str, str] = field(default_factory=dict)

    def predict(self, df: DataFrame) -> DataFrame:
        """``predicted_class`` and ``proba`` (array in class order)."""
        k = len(self.classes)
        if self.model is None:
            uniform = F.array(*[F.lit(1.0 / k)] * k)
            return df.withColumns({"predicted_class": F.lit("UNKNOWN"), "proba": uniform})
        return self._apply(self.model, df)

    def _apply(self, model, df: DataFrame) -> DataFrame:
        scored = model.transform(self.scaling.with_vector(df))
        proba = vector_to_array("probability") if "probability" in scored.columns else F.col("proba")
        named = scored.withColumns({"predicted_class": class_name(F.col("prediction"), self.classes), "proba": proba})
        return named.drop("features", "rawPrediction", "probability", "prediction")


def _macro_f1(predicted: DataFrame, label: str, classes: Sequence[str]) -> float:
    report = class_report(confusion_matrix(predicted, label, "predicted_class", classes), classes)
    return report.filter(F.col("class") == "macro avg").first()["f1"]


def fit_decision(
    train: DataFrame, val: DataFrame, label: str = "ground_truth_label", candidates: dict[str, Callable] | None = None
) -> DecisionClassifier:
    """Best candidate by validation macro-F1; ``train`` and ``val`` should be persisted."""
    fitted = DecisionClassifier()
    train = train.filter(F.col(label).isin(fitted.classes))
    rows = train.count()
    if rows == 0:
        return fitted
    cols = feature_select(train, decision_features(train), 5)
    fitted.scaling = fit_scaling(train, cols, rows)
    labelled = fitted.scaling.with_vector(train).select(
        row_key(train).alias("row"), "features", class_index(F.col(label), fitted.classes).alias("_label"))
    ready = balanced(labelled, fitted.classes).persist()

    def fit(name: str, make: Callable):
        try:
            made = make(rows)
            if isinstance(made, boosted_trees.Settings):
                examples = ready.select(F.lit(0).alias("set"), "row", vector_to_array("features").alias("features"), F.col("_label").alias("label"))
                model = boosted_trees.fit_boosted(examples, [replace(made, classes=len(fitted.classes))])[0, made.name]
            else:
                model = made.fit(ready)
            return model, _macro_f1(fitted._apply(model, val), label, fitted.classes)
        except (IllegalArgumentException, ValueError) as error:  # the data do not allow this fit; lost tasks raise
            log.warning("candidate %s left out: %s", name, error)
            fitted.failed[name] = str(error)

    candidates = candidates or CANDIDATES
    with ThreadPoolExecutor(len(candidates)) as pool:
        found = dict(zip(candidates, pool.map(fit, *zip(*candidates.items()))))
    for name, result in found.items():
        if result is not None:
            fitted.macro_f1[name] = result[1]
            if not fitted.best or result[1] > fitted.macro_f1[fitted.best]:
                fitted.model, fitted.best = result[0], name
    ready.unpersist()
    return fitted


def fit_faults(train: DataFrame, min_rows: int = 5, label: str = "ground_truth_label") -> DecisionClassifier:
    """Forest over labelled faults with enough rows per type; without two types, or descriptions at all, rules decide."""
    if "fault_description" not in train.columns:
        return DecisionClassifier()
    faults = train.filter(F.col(label) == "SENSOR_FAULT").withColumn("_type", map_fault_text(F.col("fault_description")))
    counts = faults.groupBy("_type").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_rows).collect()
    fitted = DecisionClassifier(classes=sorted(r["_type"] for r in counts))
    if len(fitted.classes) < 2:
        return fitted
    faults = faults.filter(F.col("_type").isin(fitted.classes))
    cols = feature_select(faults, decision_features(faults), 2)
    fitted.scaling = fit_scaling(faults, cols)
    labelled = fitted.scaling.with_vector(faults).select("features", class_index(F.col("_type"), fitted.classes).alias("_label"))
    forest = RandomForestClassifier(labelCol="_label", weightCol="_weight", numTrees=100, maxDepth=6, seed=42)
    fitted.model, fitted.best = forest.fit(balanced(labelled, fitted.classes)), "random_forest"
    return fitted


def predict_faults(fitted: DecisionClassifier, df: DataFrame) -> DataFrame:
    if fitted.model is None:
        return df.withColumn("predicted_fault", inferred_fault())
    return fitted.predict(df).withColumnRenamed("predicted_class", "predicted_fault").drop("proba")


@dataclass
class PlattCalibration:
    """One sigmoid per class on its score, then shares."""

    classes: list[str]
    models: dict[str, object]

    def transform(self, df: DataFrame, proba: str = "proba") -> DataFrame:
        parts = []
        for i, c in enumerate(self.classes):
            m = self.models.get(c)
            score = F.col(proba)[i]
            parts.append(F.lit(1.0) / (F.lit(1.0) + F.exp(-(score * float(m.coefficients[0]) + float(m.intercept)))) if m else score)
        raw = F.array(*parts)
        total = F.aggregate(raw, F.lit(0.0), lambda a, b: a + b)
        return df.withColumn(proba, F.transform(raw, lambda p: p / total))


def platt_calibration(val: DataFrame, classes: Sequence[str] = CLASSES, label: str = "ground_truth_label", proba: str = "proba") -> PlattCalibration:
    models = {}
    for i, c in enumerate(classes):
        rows = val.select(array_to_vector(F.array(F.col(proba)[i])).alias("features"), (F.col(label) == c).cast("double").alias("_label"))
        seen = rows.agg(F.min("_label").alias("lo"), F.max("_label").alias("hi")).first()
        if seen["lo"] != seen["hi"]:
            models[c] = LogisticRegression(labelCol="_label", maxIter=100).fit(rows)
    return PlattCalibration(list(classes), models)


