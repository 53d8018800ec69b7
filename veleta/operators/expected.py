"""Expected sensor values: ensembles of regressors weighted by validation error.

Boosted models of all targets grow together, and so do the extremely randomised trees of all targets; other candidates come
from MLlib. Independent fits run side by side from threads, as most of their jobs are small.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.errors import IllegalArgumentException
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veleta.fixed_values import EXPECTED_TARGETS, TARGET_SCALES
from veleta.functions.texts import clip
from veleta.operators import boosted_trees, random_cut_trees
from veleta.operators.evaluation import ev_weights, reg_metrics
from veleta.operators.feature_prep import Scaling, expected_features, feature_select, fit_scaling
from veleta.operators.series import source_column

log = logging.getLogger(__name__)
KEYS = {"labelCol": "_y", "featuresCol": "features"}


def ev_ridge(train: DataFrame, alpha: float = 10.0):
    """Classic ridge: MLlib divides the penalty by the label's deviation and the row count."""
    facts = train.agg(F.stddev_pop("_y").alias("sd"), F.count("_y").alias("n")).first()
    reg = alpha * (facts["sd"] or 0.0) / max(facts["n"], 1)
    return LinearRegression(
        **KEYS, predictionCol="ridge", solver="normal", elasticNetParam=0.0, standardization=False, regParam=reg
    )


def ev_random_forest(train: DataFrame):
    return RandomForestRegressor(
        **KEYS, predictionCol="random_forest", numTrees=100, maxDepth=8, minInstancesPerNode=3,
        featureSubsetStrategy="all", seed=42,
    )


def ev_extra_trees(train: DataFrame | None = None) -> random_cut_trees.Settings:
    return random_cut_trees.Settings("extra_trees", 0, trees=100, depth=8, least_rows=3)


def ev_hist_gbt(train: DataFrame | None = None) -> boosted_trees.Settings:
    return boosted_trees.Settings("hist_gradient_boosting", 0, rounds=100, depth=6, rate=0.08, least_rows=20, leaves=31)


def ev_gbt(train: DataFrame | None = None) -> boosted_trees.Settings:
    return boosted_trees.Settings("gradient_boosting", 0, rounds=50, depth=3, rate=0.08, sample=0.5)


def ev_xgb_like(train: DataFrame | None = None) -> boosted_trees.Settings:
    return boosted_trees.Settings("xgboost", 0, rounds=100, depth=5, rate=0.08, sample=0.8, penalty=1.0, least_weight=1.0)


CANDIDATES: dict[str, Callable] = {
    "ridge": ev_ridge,
    "random_forest": ev_random_forest,
    "extra_trees": ev_extra_trees,
    "hist_gradient_boosting": ev_hist_gbt,
    "gradient_boosting": ev_gbt,
    "xgboost": ev_xgb_like,
}


def combine(weights: dict[str, float], scale: float, prefix: str = "") -> dict[str, Column]:
    """Weighted mean of prediction columns, weighted variance, agreement, disagreement."""
    used = {m: w for m, w in weights.items() if w > 0}
    total = sum(used.values())
    parts = [(F.col(f"{prefix}{m}"), w / total) for m, w in used.items()]

    def added(columns) -> Column:
        return reduce(lambda a, b: a + b, columns)

    mean = added([p * w for p, w in parts])
    variance = added([(p - mean) * (p - mean) * w for p, w in parts])
    agreement = F.lit(1.0) / (F.lit(1.0) + F.sqrt(variance) / (scale * 0.5))
    return {
        "ensemble": mean,
        "variance": variance,
        "agreement": clip(agreement, 0.0, 1.0),
        "disagreement": clip(F.lit(1.0) - agreement, 0.0, 1.0),
    }


@dataclass
class ExpectedValues:
    """Fitted candidates of one target with their validation metrics and weights."""

    target: str
    scaling: Scaling | None = None
    models: dict[str, object] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)
    metrics: dict[str, dict[str, float]] = field(default_factory=dict)
    failed: dict[str, str] = field(default_factory=dict)

    @property
    def best(self) -> str | None:
        return min(self.models, key=lambda m: self.metrics[m]["mae"], default=None)

    def predictions(self, df: DataFrame) -> DataFrame:
        """One column per candidate, named after it, and ``features``."""
        out = self.scaling.with_vector(df)
        for model in self.models.values():
            out = model.transform(out)
        return out

    def add_residuals(self, df: DataFrame) -> DataFrame:
        """``predicted_`` / ``expected_`` values, residual, agreement and candidates."""
        t = self.target
        if not self.models:
            return df.withColumns(
                {f"predicted_{t}": F.lit(None).cast("double"), f"expected_{t}": F.lit(None).cast("double"),
                 f"{t}_residual": F.lit(None).cast("double"), f"expected_{t}_model_agreement": F.lit(1.0),
                 f"expected_{t}_variance": F.lit(0.0), f"expected_{t}_disagreement": F.lit(0.0)}
            )
        src = F.col(source_column(df, t))
        out = self.predictions(df).drop("features")
        renamed = {m: f"{t}_pred_{m}" for m in self.models}
        out = out.withColumnsRenamed(renamed)
        parts = combine(self.weights, TARGET_SCALES[t], f"{t}_pred_")
        return out.withColumns(
            {
                f"predicted_{t}": parts["ensemble"],
                f"expected_{t}": parts["ensemble"],
                f"{t}_residual": src - parts["ensemble"],
                f"expected_{t}_model_agreement": parts["agreement"],
                f"expected_{t}_variance": parts["variance"],
                f"expected_{t}_disagreement": parts["disagreement"],
            }
        )


def row_key(df: DataFrame) -> Column:
    """A number per row from its keys, the same however rows are partitioned."""
    return F.xxhash64(*[F.col(c) for c in ("station_id", "timestamp", "seq") if c in df.columns])


@dataclass
class _Prepared:
    """Rows of one target, ready for every candidate."""

    fitted: ExpectedValues
    source: str
    ready: DataFrame  # row, features, _y
    val: DataFrame
    made: dict[str, object]  # candidates: estimators or settings of trees


def _prepare(target: str, train: DataFrame, val: DataFrame, candidates: dict[str, Callable]) -> _Prepared | ExpectedValues:
    fitted = ExpectedValues(target)
    src = source_column(train, target)
    train, val = train.filter(F.col(src).isNotNull()), val.filter(F.col(src).isNotNull())
    rows = train.count()
    if rows < 5:
        log.warning("too few rows to fit expected values of %s", target)
        return fitted
    if val.limit(2).count() < 2:
        val = train.orderBy(F.col("timestamp").desc()).limit(5)
    cols = feature_select(train, expected_features(train, target), 10)
    fitted.scaling = fit_scaling(train, cols, rows)
    ready = fitted.scaling.with_vector(train).select(row_key(train).alias("row"), "features", F.col(src).alias("_y")).persist()
    return _Prepared(fitted, src, ready, val, {name: make(ready) for name, make in candidates.items()})


def _weigh(p: _Prepared) -> ExpectedValues:
    """Validation metrics and weights of the candidates that were fitted."""
    fitted = p.fitted
    p.ready.unpersist()
    fitted.models = {name: fitted.models[name] for name in p.made if name in fitted.models}
    if fitted.models:
        scored = fitted.predictions(p.val).select(F.col(p.source).alias("_y"), *fitted.models)
        # One row per candidate.
        for r in ev_weights(reg_metrics(scored, "_y", list(fitted.models))).collect():
            fitted.metrics[r["model"]] = {"mae": r["mae"], "rmse": r["rmse"], "r2": r["r2"]}
            fitted.weights[r["model"]] = r["weight"]
    return fitted


def fit_all(
    train: DataFrame, val: DataFrame, candidates: dict[str, Callable] | None = None, targets: Sequence[str] = tuple(EXPECTED_TARGETS),
) -> dict[str, ExpectedValues]:
    """Fit every candidate of every target; one that fails is recorded and left out.

    ``train`` and ``val`` should be written or persisted feature tables: each fit reads them repeatedly.
    """
    with ThreadPoolExecutor(8) as pool:
        prepared = dict(zip(targets, pool.map(lambda t: _prepare(t, train, val, candidates or CANDIDATES), targets)))
        ready = {i: p for i, p in enumerate(prepared.values()) if isinstance(p, _Prepared)}

        def left_out(p: _Prepared, name: str, error: Exception) -> None:
            log.warning("candidate %s of %s left out: %s", name, p.fitted.target, error)
            p.fitted.failed[name] = str(error)
            p.fitted.metrics[name] = {"mae": 999.0, "rmse": 999.0, "r2": -99.0}

        def fit_one(p: _Prepared, name: str) -> None:
            try:
                p.fitted.models[name] = p.made[name].fit(p.ready)
            except (IllegalArgumentException, ValueError) as error:  # the data do not allow this fit; lost tasks raise
                left_out(p, name, error)

        def fit_trees(fit: Callable, kind: type) -> None:
            """Trees of one kind for all targets."""
            settings = [replace(s, set=i) for i, p in ready.items() for s in p.made.values() if isinstance(s, kind)]
            if not settings:
                return
            rows = reduce(DataFrame.unionByName, [
                p.ready.select(F.lit(i).alias("set"), "row", vector_to_array("features").alias("features"), F.col("_y").cast("double").alias("label"))
                for i, p in ready.items()])
            for (i, name), model in fit(rows, settings).items():
                ready[i].fitted.models[name] = model

        trees = [(boosted_trees.fit_boosted, boosted_trees.Settings), (random_cut_trees.fit_random_cuts, random_cut_trees.Settings)]
        work = [pool.submit(fit_trees, *t) for t in trees]
        work += [pool.submit(fit_one, p, name) for p in ready.values() for name, made in p.made.items() if not isinstance(made, tuple(k for _, k in trees))]
        for w in work:
            w.result()
        weighed = dict(zip(ready, pool.map(_weigh, ready.values())))
    return {t: weighed[i] if i in weighed else p for i, (t, p) in enumerate(prepared.items())}


def ev_fit_select(target: str, train: DataFrame, val: DataFrame, candidates: dict[str, Callable] | None = None) -> ExpectedValues:
    return fit_all(train, val, candidates, [target])[target]


def apply_all(df: DataFrame, models: dict[str, ExpectedValues]) -> DataFrame:
    for model in models.values():
        df = model.add_residuals(df)
    return df
