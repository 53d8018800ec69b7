"""Trained models and the whole scoring chain: rows-only checks (survey 2.12-2.14, 2.18, 2.19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from veleta.catalog import common as C
from veleta.fixed_values import DETECTOR_SHORT, EXPECTED_TARGETS
from veleta.operators import anomaly as A
from veleta.operators import decision as D
from veleta.operators import expected as E
from veleta.operators.order_stats import SMALL_GROUP_ROWS, quantiles
from veleta.operators.split import split_chrono
from veleta.plans.train import stored, train_job

QUERIES: dict[str, C.Query] = {}
ORACLES: dict[str, str] = {}
KEYS = ["station_id", "timestamp", "seq"]


def _table(s, d):
    """The feature table, written once per session because every fit reads it repeatedly."""
    return C.once(s, d, "feature_table", lambda: stored(split_chrono(C.grid_features(s, d), C.grid_split(s, d)), "features"))


def _train(s, d):
    return _table(s, d).filter(F.col("split") == "train")


def _candidate(name: str) -> C.Query:
    def query(s, d):
        def fit():
            val = _table(s, d).filter(F.col("split") == "val")
            return E.fit_all(_train(s, d), val, {name: E.CANDIDATES[name]})

        fitted = C.once(s, d, f"ev_{name}", fit)
        columns = [c for t in EXPECTED_TARGETS for c in (f"expected_{t}", f"{t}_residual")]
        return C.rounded(E.apply_all(_table(s, d), fitted).select(*KEYS, *columns))

    return query


for _id, _name in {
    "ev_ridge": "ridge", "ev_random_forest": "random_forest", "ev_extra_trees": "extra_trees",
    "ev_hist_gbt": "hist_gradient_boosting", "ev_gbt": "gradient_boosting", "ev_xgb_like": "xgboost",
}.items():
    QUERIES[_id] = _candidate(_name)


def _ensemble(s, d):
    return C.once(s, d, "anomaly", lambda: A.fit_anomaly(_train(s, d)))


def _detector(name: str) -> C.Query:
    def query(s, d):
        scored = _ensemble(s, d).transform(_table(s, d))
        return C.rounded(scored.select(*KEYS, f"{DETECTOR_SHORT[name]}_anomaly_score"))

    return query


for _id, _name in {
    "ad_isolation_forest": "isolation_forest", "ad_lof": "lof", "ad_ocsvm": "one_class_svm",
    "ad_elliptic": "elliptic_envelope", "ad_mahalanobis": "mahalanobis",
}.items():
    QUERIES[_id] = _detector(_name)
QUERIES["ad_summary"] = lambda s, d: C.rounded(_ensemble(s, d).summary(_table(s, d)))

# Robust z, normalisation, combination and consensus have oracles on scores made from features.
Z = ["temperature_c_robust_z", "relative_humidity_pct_robust_z", "pressure_hpa_robust_z", "wind_speed_kmh_robust_z", "rainfall_mm_robust_z"]
ZMAX = "greatest(" + ", ".join(f"coalesce(abs({z}), 0)" for z in Z) + ")"
QUERIES["ad_robust_z"] = lambda s, d: C.rounded(C.grid_features(s, d).select(*KEYS, *Z).withColumn("z", A.ad_robust_z(C.grid_features(s, d).select(*Z))).select(*KEYS, "z"))
ORACLES["ad_robust_z"] = f"WITH {C.BASED} " + C.rounded_sql(f"SELECT station_id, timestamp, seq, {ZMAX} AS z FROM based", ["z"])
STAND_INS = {"isolation_forest": "temperature_c_robust_z", "lof": "relative_humidity_pct_robust_z", "one_class_svm": "pressure_hpa_robust_z",
             "elliptic_envelope": "wind_speed_kmh_robust_z", "mahalanobis": "wind_speed_kmh_deviation", "robust_zscore": "pressure_hpa_deviation"}


def _normalised(s, d):
    from veleta.operators.baseline import baseline_apply

    m = C.feature_model(s, d)
    rows = baseline_apply(C.grid_clean(s, d), m.baselines, small=m.layout.small_baselines)
    raw = rows.select(*KEYS, *[F.abs(F.col(c)).alias(n) for n, c in STAND_INS.items()])
    small = m.layout.rows * len(STAND_INS) <= SMALL_GROUP_ROWS
    row = C.once(s, d, "stand_in_limits", lambda: quantiles(raw, [], list(STAND_INS), [0.05, 0.95], small).first())
    return raw.select(*KEYS, *[A.ad_normalize(F.col(n), row[f"{n}_q0"], row[f"{n}_q1"]).alias(n) for n in STAND_INS])


NQ = (f"{C.BASED}, raw AS (SELECT station_id, timestamp, seq, {', '.join(f'abs({c}) AS {n}' for n, c in STAND_INS.items())} FROM based), "
      f"lim AS (SELECT {', '.join(f'quantile_cont({n}, 0.05) AS {n}_lo, quantile_cont({n}, 0.95) AS {n}_hi' for n in STAND_INS)} FROM raw), "
      f"nrm AS (SELECT station_id, timestamp, seq, {', '.join(f'least(greatest(({n} - {n}_lo) / greatest({n}_hi - {n}_lo, 1e-6::DOUBLE) * 0.8::DOUBLE + 0.05::DOUBLE, 0), 1) AS {n}' for n in STAND_INS)} FROM raw, lim)")
QUERIES["ad_normalize"] = lambda s, d: C.rounded(_normalised(s, d))
ORACLES["ad_normalize"] = f"WITH {NQ} " + C.rounded_sql("SELECT * FROM nrm", list(STAND_INS))


def _scores():
    return {n: F.col(n) for n in STAND_INS}


QUERIES["ad_combine"] = lambda s, d: C.rounded(_normalised(s, d).select(*KEYS, A.ad_combine(_scores()).alias("combined_anomaly_score")))
ORACLES["ad_combine"] = f"WITH {NQ} " + C.rounded_sql(
    f"SELECT station_id, timestamp, seq, least(greatest({' + '.join(f'{w}::DOUBLE * {n}' for n, w in A.DETECTOR_WEIGHTS.items())}, 0), 1) AS combined_anomaly_score FROM nrm", ["combined_anomaly_score"])
QUERIES["ad_consensus"] = lambda s, d: C.rounded(_normalised(s, d).withColumns(A.ad_consensus(_scores())).drop(*STAND_INS))
_AGREE = "(" + " + ".join(f"({n} >= 0.5)::INT" for n in STAND_INS) + ")"
ORACLES["ad_consensus"] = f"WITH {NQ} " + C.rounded_sql(
    f"SELECT station_id, timestamp, seq, 6 AS anomaly_model_count, {_AGREE} AS anomaly_models_agreeing, {_AGREE} / 6.0::DOUBLE AS anomaly_consensus_score, "
    f"concat({_AGREE}, '/6 models') AS anomaly_model_agreement FROM nrm", ["anomaly_consensus_score"])


# --- classifiers and the whole chain -----------------------------------------------------
# The registered chain is the whole training job: every regressor, every classifier, cross-sensor regressions.
def _training(s, d):
    return C.once(s, d, "training", lambda: train_job(C.grid(s, d)))


def _train_report(s, d):
    return C.rounded(_training(s, d).test_metrics())


def _fit_metrics(s, d):
    rows = _training(s, d).validation_metrics()
    return s.createDataFrame(rows, "target STRING, model STRING, mae DOUBLE, rmse DOUBLE, r2 DOUBLE, weight DOUBLE")


QUERIES["train_job"] = _train_report
QUERIES["ev_fit_select"] = _fit_metrics
QUERIES["score_batch"] = lambda s, d: _training(s, d).engine.score_batch(C.grid(s, d))


def _decided(s, d):
    t = _training(s, d)
    return t.decision.predict(t.scored).select(*KEYS, "split", "ground_truth_label", "predicted_class", "proba")


def _shares(df):
    return df.select(*KEYS, "predicted_class", *[F.round(F.col("proba")[i], 6).alias(f"p{i}") for i in range(3)])


QUERIES["dc_predict"] = lambda s, d: _shares(_decided(s, d))
QUERIES["dc_candidates"] = lambda s, d: s.createDataFrame(
    [(k, float(v), k == _training(s, d).decision.best) for k, v in _training(s, d).decision.macro_f1.items()], "candidate STRING, macro_f1 DOUBLE, chosen BOOLEAN")


def _calibrated(s, d):
    decided = _decided(s, d)
    fitted = C.once(s, d, "platt", lambda: D.platt_calibration(decided.filter(F.col("split") == "val")))
    return _shares(fitted.transform(decided))


QUERIES["platt_calibration"] = _calibrated
QUERIES["fault_classifier"] = lambda s, d: D.predict_faults(_training(s, d).faults, _training(s, d).scored).select(*KEYS, "predicted_fault")
