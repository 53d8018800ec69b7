"""Quality checks, fault rules, weather evidence, labels, fusion and health (survey 2.15-2.19).

Trained scores are not SQL. The fusion queries use an anomaly score made from the features
themselves, so that both engines judge the same evidence.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from veleta.catalog import common as C
from veleta.fixed_values import EXPECTED_TARGETS, QC_BOUNDS, QC_MAX_RATES, SENSORS
from veleta.functions.texts import staged
from veleta.operators import diagnosis as DG
from veleta.operators import fusion as FU
from veleta.operators import labels as L
from veleta.operators import qc as Q
from veleta.operators import rules as R
from veleta.operators import weather as WX
from veleta.operators.health import health_scores

QUERIES: dict[str, C.Query] = {}
ORACLES: dict[str, str] = {}
KEYS = ["station_id", "timestamp", "seq"]
KEY_SQL = "station_id, timestamp, seq"


def _add(name: str, query: C.Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


# --- fault rules -------------------------------------------------------------------------
RULES = f"{C.BASELINE}, temporal AS ({C._temporal_sql('cleaned')}), based AS ({C._based_sql('temporal')}), {C._rules_sql('based')}"


def _grid_ruled(s, d):
    """Rules read baselines only; no neighbours are sought."""
    from veleta.operators.baseline import baseline_apply

    layout = C.grid_layout(s, d)
    rows = R.add_gap_hours(C.grid_clean(s, d), layout)
    return R.apply_fault_rules(baseline_apply(rows, C.grid_baselines(s, d), small=layout.small_baselines), layout)


_add("rule_freeze", lambda s, d: R.rule_freeze(C.grid_clean(s, d), C.grid_layout(s, d)).select(*KEYS, "rule_freeze"),
     f"WITH {RULES} SELECT {KEY_SQL}, rule_freeze FROM ruled")
_add("rule_spike", lambda s, d: R.rule_spike(C.grid_clean(s, d), C.grid_layout(s, d)).select(*KEYS, "rule_spike"),
     f"WITH {RULES} SELECT {KEY_SQL}, rule_spike FROM ruled")


def _drift(s, d):
    from veleta.operators.baseline import baseline_apply

    layout = C.grid_layout(s, d)
    z = baseline_apply(C.grid_clean(s, d), C.grid_baselines(s, d), small=layout.small_baselines)
    return R.rule_drift(z, layout).select(*KEYS, "rule_drift")


_add("rule_drift", _drift, f"WITH {RULES} SELECT {KEY_SQL}, rule_drift FROM ruled")
_add("rule_comm", lambda s, d: R.rule_comm(R.add_gap_hours(C.grid(s, d), C.grid_layout(s, d))).select(*KEYS, "rule_communication"),
     f"WITH {RULES} SELECT {KEY_SQL}, rule_communication FROM ruled")
_add("infer_fault", lambda s, d: _grid_ruled(s, d).select(*KEYS, "rule_any_fault", "inferred_fault"),
     f"WITH {RULES} SELECT {KEY_SQL}, rule_any_fault, inferred_fault FROM ruled")
_add("fault_summary", lambda s, d: R.fault_summary(_grid_ruled(s, d)),
     f"WITH {RULES} SELECT station_id, inferred_fault, count(*) AS observations FROM ruled WHERE rule_any_fault GROUP BY 1, 2")
_add("map_fault_text", lambda s, d: C.obs(s, d).select(*KEYS, R.map_fault_text(F.col("fault_description")).alias("fault")),
     f"""WITH {C.OBS} SELECT {KEY_SQL}, CASE WHEN fault_description = 'None' THEN 'UNKNOWN' WHEN regexp_matches(lower(fault_description), 'drift|calibration') THEN 'DRIFT'
     WHEN regexp_matches(lower(fault_description), 'freeze|zero variance') THEN 'FREEZE' WHEN contains(lower(fault_description), 'spike') THEN 'SPIKE'
     WHEN contains(lower(fault_description), 'communication') THEN 'COMMUNICATION_FAILURE' ELSE 'UNKNOWN' END AS fault FROM obs""")

# --- quality checks ----------------------------------------------------------------------
CHECKS: dict[str, list[tuple[str, float, str]]] = {
    "qc_bounds": [(f"{c}_out_of_bounds", 0.40, f"{c} < {lo} OR {c} > {hi}") for c, (lo, hi) in QC_BOUNDS.items()],
    "qc_rate": [(f"{c}_rate_of_change_high", 0.25, f"abs({c}_delta) > {r}") for c, r in QC_MAX_RATES.items()],
    "qc_deviation": [("temperature_c_large_baseline_deviation", 0.20, "abs(temperature_c_deviation) > 4"),
                     ("pressure_hpa_large_baseline_deviation", 0.20, "abs(pressure_hpa_deviation) > 15")],
    "qc_volatility": [("temperature_c_high_volatility", 0.15, "temperature_c_roll3_std > 4")],
    "qc_robust_z": [(f"{c}_robust_z_high", 0.20, f"abs({c}_robust_z) >= 3.5") for c in EXPECTED_TARGETS],
    "qc_spike": [("spike_detected", 0.35, "rule_spike")],
    "qc_freeze": [("freeze_detected", 0.35, "rule_freeze")],
    "qc_gap": [("temporal_gap", 0.15, "time_since_prev_obs > 3")],
    "qc_duplicate": [("duplicate_timestamp", 0.30, "qf_duplicate_ts")],
    "qc_cross_sensor": [("cross_sensor_rain_humidity_inconsistent", 0.25, "temperature_c IS NOT NULL AND rainfall_mm > 10 AND relative_humidity_pct < 25")],
}


def _penalty_sql(checks) -> str:
    return " + ".join(f"CASE WHEN {c} THEN {p}::DOUBLE ELSE 0 END" for _, p, c in checks)


def _violations_sql(checks) -> str:
    return "concat_ws(', ', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, _, c in checks) + ")"


for _group, _checks in CHECKS.items():
    _add(_group, lambda s, d, g=_group: C.rounded(Q.apply_group(C.grid_features(s, d), g).select(*KEYS, f"{g}_penalty", f"{g}_violations")),
         f"WITH {C.FEATURES} " + C.rounded_sql(
             f"SELECT {KEY_SQL}, {_penalty_sql(_checks)} AS {_group}_penalty, {_violations_sql(_checks)} AS {_group}_violations FROM feat", [f"{_group}_penalty"]))
ALL_CHECKS = [c for checks in CHECKS.values() for c in checks]
QCED = (f"{C.FEATURES}, qced AS (SELECT *, round(least({_penalty_sql(ALL_CHECKS)}, 1), 4) AS statistical_anomaly_score, "
        f"{_violations_sql(ALL_CHECKS)} AS qc_violations FROM feat)")


def _qced(s, d):
    return staged(Q.qc_score(C.grid_features(s, d)), "checks")


_add("qc_score",
     lambda s, d: C.rounded(_qced(s, d).select(*KEYS, "statistical_anomaly_score", "qc_violations", "qc_passed", F.size("qc_evidence").alias("n_evidence"))),
     f"WITH {QCED} " + C.rounded_sql(
         f"SELECT {KEY_SQL}, statistical_anomaly_score, qc_violations, qc_violations = '' AS qc_passed, "
         "CASE WHEN qc_violations = '' THEN 0 ELSE len(string_split(qc_violations, ', '))::INT END AS n_evidence FROM qced", ["statistical_anomaly_score"]))

# --- evidence that fusion needs ----------------------------------------------------------
Z = [f"{c}_robust_z" for c in SENSORS]
ZMAX = "greatest(" + ", ".join(f"coalesce(abs({z}), 0)" for z in Z) + ")"
SCORE = f"least({ZMAX} / 7.31::DOUBLE, 1)"
EVIDENCE = {
    "combined_anomaly_score": (f"least(greatest({', '.join(f'coalesce(abs({z}), 0D)' for z in Z)}) / 7.31D, 1D)", f"({SCORE})::DOUBLE"),
    "anomaly_models_agreeing": (f"cast(floor(least(greatest({', '.join(f'coalesce(abs({z}), 0D)' for z in Z)}) / 7.31D, 1D) * 6D) AS INT)", f"floor({SCORE} * 6)::INT"),
    "anomaly_model_count": ("6", "6"),
    "temperature_c_residual": ("temperature_c_clean - 24D", "temperature_c_clean - 24::DOUBLE"),
    **{f"expected_{t}_model_agreement": (f"1D / (1D + abs({t}_robust_z))", f"1 / (1 + abs({t}_robust_z))") for t in EXPECTED_TARGETS},
}


def _evidence(s, d):
    return _qced(s, d).selectExpr("*", *[f"{v[0]} AS {k}" for k, v in EVIDENCE.items()])


EV = f"{QCED}, ev AS (SELECT *, {', '.join(f'{v[1]} AS {k}' for k, v in EVIDENCE.items())} FROM qced)"

RAIN, WIND = "coalesce(rainfall_mm, 0)", "coalesce(wind_speed_kmh, 0)"
TEMP, RH, PRES = "coalesce(temperature_c, 25)", "coalesce(relative_humidity_pct, 50)", "coalesce(pressure_hpa, 1013)"
POINTS = {
    "wx_rain": f"CASE WHEN {RAIN} >= 25 THEN 0.50 WHEN {RAIN} >= 10 THEN 0.35 WHEN {RAIN} > 1 THEN 0.20 ELSE 0 END",
    "wx_wind": f"CASE WHEN {WIND} >= 45 THEN 0.45 WHEN {WIND} >= 30 THEN 0.30 WHEN {WIND} >= 22 THEN 0.15 ELSE 0 END",
    "wx_temp_extreme": f"CASE WHEN {TEMP} >= 44 AND {RH} <= 45 THEN 0.50 WHEN {TEMP} >= 40 AND {RH} <= 55 THEN 0.35 "
                       f"WHEN {TEMP} <= 5 AND {TEMP} >= -20 THEN 0.45 WHEN {TEMP} <= 10 AND {TEMP} >= -20 THEN 0.30 ELSE 0 END",
    "wx_thermo": f"CASE WHEN {RAIN} >= 5 AND {RH} >= 75 THEN 0.30 ELSE 0 END + CASE WHEN {RAIN} >= 5 AND {RH} >= 75 AND "
                 f"(coalesce(temperature_c_residual, 0) < -2 OR ({TEMP} < 30 AND {RH} >= 80)) THEN 0.20 ELSE 0 END + "
                 f"CASE WHEN {PRES} < 1004 AND ({RAIN} >= 5 OR {WIND} >= 25) THEN 0.25 ELSE 0 END",
    "wx_spatial": "CASE WHEN neighbor_agreement_score < 2 THEN 0.35 WHEN neighbor_agreement_score < 4 THEN 0.15 ELSE 0 END",
    "wx_front": "CASE WHEN temperature_c_delta < -1.5 AND relative_humidity_pct_delta > 5 THEN 0.25 ELSE 0 END + CASE WHEN pressure_hpa_delta < -1.5 THEN 0.20 ELSE 0 END",
}
for _part, _sql in POINTS.items():
    _add(_part, lambda s, d, p=_part: C.rounded(WX.points_of(_evidence(s, d), p).select(*KEYS, f"{p}_points")),
         f"WITH {EV} " + C.rounded_sql(f"SELECT {KEY_SQL}, ({_sql})::DOUBLE AS {_part}_points FROM ev", [f"{_part}_points"]))
TOTAL = " + ".join(f"({p})::DOUBLE" for p in POINTS.values())
DISQ = "p0"
for _flag in ("rule_freeze", "rule_spike", "rule_communication"):
    DISQ = f"CASE WHEN {_flag} THEN least(({DISQ}) * 0.15::DOUBLE, 0.10::DOUBLE) ELSE {DISQ} END"
HARD = "(rule_freeze OR rule_spike OR rule_communication)"
WXS = (f"{EV}, wx0 AS (SELECT *, {TOTAL} AS p0 FROM ev), wx1 AS (SELECT *, {DISQ} AS pd FROM wx0), "
       f"wx AS (SELECT *, greatest(least(pd, 1), CASE WHEN {HARD} THEN 0 WHEN ({RAIN} >= 15 AND {RH} >= 70) OR {WIND} >= 38 OR ({TEMP} >= 42 AND {RH} <= 50) THEN 0.65::DOUBLE "
       f"WHEN ({RAIN} >= 8 AND {RH} >= 65) OR {WIND} >= 28 OR ({TEMP} >= 40 AND {RH} <= 55) THEN 0.45::DOUBLE ELSE 0 END) AS genuine_event_score FROM wx1)")
N_WX = " + ".join([
    f"({RAIN} > 1)::INT", f"({WIND} >= 22)::INT", f"(({POINTS['wx_temp_extreme']}) > 0)::INT", f"({RAIN} >= 5 AND {RH} >= 75)::INT",
    f"({RAIN} >= 5 AND {RH} >= 75 AND (coalesce(temperature_c_residual, 0) < -2 OR ({TEMP} < 30 AND {RH} >= 80)))::INT",
    f"({PRES} < 1004 AND ({RAIN} >= 5 OR {WIND} >= 25))::INT", "coalesce(neighbor_agreement_score < 4, false)::INT",
    "coalesce(temperature_c_delta < -1.5 AND relative_humidity_pct_delta > 5, false)::INT", "coalesce(pressure_hpa_delta < -1.5, false)::INT",
    "rule_freeze::INT", "rule_spike::INT", "rule_communication::INT"])


def _points_after_disqualify(s, d):
    rows = _evidence(s, d)
    signals = WX.Signals.of(rows)
    total = sum((part(signals)[0] for part in WX.PARTS.values()), F.lit(0.0))
    return C.rounded(rows.withColumn("_p", total).select(*KEYS, WX.disqualified(F.col("_p"), signals).alias("points")))


_add("wx_disqualify", _points_after_disqualify, f"WITH {WXS} " + C.rounded_sql(f"SELECT {KEY_SQL}, pd AS points FROM wx", ["points"]))
_add("wx_score",
     lambda s, d: C.rounded(WX.wx_score(_evidence(s, d)).select(*KEYS, "genuine_event_score", F.size("genuine_event_evidence").alias("n_evidence"))),
     f"WITH {WXS} " + C.rounded_sql(f"SELECT {KEY_SQL}, round_even(genuine_event_score, 4) AS genuine_event_score, ({N_WX})::INT AS n_evidence FROM wx", ["genuine_event_score"]))

# --- fault evidence ----------------------------------------------------------------------
PRELIM = "(combined_anomaly_score > 0.35 OR statistical_anomaly_score > 0.35 OR rule_any_fault)"
SEVERE = f"(({RAIN} >= 10 AND {RH} >= 70) OR {WIND} >= 35 OR ({TEMP} >= 40 AND {RH} <= 55) OR ({TEMP} <= 8 AND {TEMP} >= -20))"
FE = (f"{WXS}, fe0 AS (SELECT *, CASE WHEN NOT {PRELIM} THEN 'quiet' WHEN rule_spike THEN 'spike' WHEN rule_freeze THEN 'freeze' WHEN rule_drift THEN 'drift' "
      f"WHEN rule_communication THEN 'comm' WHEN statistical_anomaly_score >= 0.5 AND NOT {SEVERE} THEN 'check' ELSE 'none' END AS cause FROM wx), "
      "fe AS (SELECT *, CASE cause WHEN 'spike' THEN 'SPIKE' WHEN 'freeze' THEN 'FREEZE' WHEN 'drift' THEN 'DRIFT' WHEN 'check' THEN 'DRIFT' "
      "WHEN 'comm' THEN 'COMMUNICATION_FAILURE' ELSE 'NONE' END AS fault_type, CASE cause WHEN 'spike' THEN 0.95::DOUBLE WHEN 'freeze' THEN 0.92::DOUBLE "
      "WHEN 'drift' THEN 0.88::DOUBLE WHEN 'comm' THEN 0.85::DOUBLE WHEN 'check' THEN 0.80::DOUBLE ELSE 0::DOUBLE END AS fault_confidence, "
      "CASE cause WHEN 'quiet' THEN 0 WHEN 'none' THEN 1 ELSE 1 + (cause = 'freeze' AND relative_humidity_pct_robust_z IS NOT NULL)::INT "
      "+ (cause = 'drift' AND coalesce(abs(temperature_c_residual) > 1.5, false))::INT + coalesce(abs(temperature_c_robust_z) > 2.5, false)::INT "
      "+ (cause <> 'freeze' AND coalesce(abs(relative_humidity_pct_robust_z) > 2.5, false))::INT END AS n_fault FROM fe0)")


def _diagnosed(s, d):
    return DG.fault_evidence(WX.wx_score(_evidence(s, d)), FU.score_prelim())


_add("fault_evidence",
     lambda s, d: C.rounded(_diagnosed(s, d).select(*KEYS, "fault_type", "fault_confidence", F.size("fault_evidence").alias("n_evidence"))),
     f"WITH {FE} " + C.rounded_sql(f"SELECT {KEY_SQL}, fault_type, fault_confidence, n_fault::INT AS n_evidence FROM fe", ["fault_confidence"]))
_add("score_prelim", lambda s, d: _evidence(s, d).select(*KEYS, FU.score_prelim().alias("is_anomaly")),
     f"WITH {EV} SELECT {KEY_SQL}, {PRELIM} AS is_anomaly FROM ev")

# --- fusion ------------------------------------------------------------------------------
AGREE = "((" + " + ".join(f"coalesce(expected_{t}_model_agreement, 1)" for t in EXPECTED_TARGETS) + ") / 3)"
CONFLICT = "(1 - abs(anomaly_models_agreeing / anomaly_model_count::DOUBLE - 0.5) * 2)"
FUSED = (
    f"{FE}, f1 AS (SELECT *, least(greatest(0.45::DOUBLE * combined_anomaly_score + 0.30::DOUBLE * statistical_anomaly_score + 0.25::DOUBLE * greatest(combined_anomaly_score, "
    "CASE WHEN statistical_anomaly_score > 0.5 THEN statistical_anomaly_score ELSE 0 END), 0), 1) AS fs, "
    f"least(greatest(0.35::DOUBLE * (1 - {AGREE}) * CASE WHEN genuine_event_score >= 0.4 THEN 0.3::DOUBLE ELSE 1 END + 0.25::DOUBLE * {CONFLICT} + 0.15::DOUBLE * "
    f"CASE WHEN fault_confidence > 0.5 AND genuine_event_score > 0.5 THEN 0.5 ELSE 0 END, 0.02), 0.95) AS unc, least(greatest(0.5 * {AGREE} + 0.5 * (1 - {CONFLICT}), 0), 1) AS agr FROM fe), "
    "f2 AS (SELECT *, CASE WHEN genuine_event_score >= 0.35 AND fault_type NOT IN ('FREEZE','SPIKE','COMMUNICATION_FAILURE') AND (genuine_event_score >= fault_confidence OR fault_type = 'NONE') THEN 'A' "
    "WHEN (fault_type NOT IN ('NONE','UNKNOWN') AND fault_confidence >= 0.4) OR fault_type IN ('FREEZE','SPIKE','COMMUNICATION_FAILURE') OR (statistical_anomaly_score >= 0.5 AND genuine_event_score < 0.3) THEN 'B' "
    "WHEN fs < 0.4 AND statistical_anomaly_score < 0.35 AND fault_type = 'NONE' THEN 'C' WHEN genuine_event_score >= 0.3 THEN 'D1' WHEN unc > 0.6 THEN 'D2' ELSE 'D3' END AS cs FROM f1), "
    "f3 AS (SELECT *, CASE cs WHEN 'A' THEN least(greatest(0.65::DOUBLE + genuine_event_score * 0.30::DOUBLE - unc * 0.15::DOUBLE, 0.60), 0.98) "
    "WHEN 'B' THEN least(greatest(greatest(fault_confidence, fs) * 0.90::DOUBLE + 0.05::DOUBLE - unc * 0.15::DOUBLE, 0.55), 0.98) WHEN 'C' THEN least(greatest(1 - fs * 1.2::DOUBLE, 0.60), 0.99) "
    "WHEN 'D2' THEN 0.40 ELSE 0.65 END::DOUBLE AS conf, CASE WHEN cs IN ('A','D1') THEN 'GENUINE_EXTREME' WHEN cs = 'B' THEN 'SENSOR_FAULT' WHEN cs = 'D2' THEN 'UNKNOWN' ELSE 'NORMAL' END AS prediction FROM f2), "
    "fused AS (SELECT *, CASE WHEN conf >= 0.8 AND unc <= 0.35 THEN 'HIGH' WHEN conf >= 0.55 AND unc <= 0.55 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_level, "
    "CASE WHEN prediction = 'NORMAL' THEN 'LOW' WHEN prediction = 'GENUINE_EXTREME' THEN CASE WHEN fs >= 0.65 THEN 'HIGH' WHEN fs >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END "
    "WHEN prediction = 'SENSOR_FAULT' AND fault_type IN ('DRIFT','FREEZE') THEN CASE WHEN fs >= 0.85 THEN 'CRITICAL' WHEN fs >= 0.65 THEN 'HIGH' ELSE 'MEDIUM' END "
    "WHEN prediction = 'SENSOR_FAULT' AND fault_type = 'SPIKE' THEN CASE WHEN fs >= 0.85 THEN 'HIGH' ELSE 'MEDIUM' END "
    "ELSE CASE WHEN fs >= 0.85 THEN 'HIGH' WHEN fs >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END END AS severity FROM f3)"
)


def _fused(s, d):
    return FU.fuse(_diagnosed(s, d))


def _fused_columns(*cols):
    def query(s, d):
        return C.rounded(_fused(s, d).select(*KEYS, *cols), 4)

    return query


def _fused_sql(cols: list[str], doubles: list[str]) -> str:
    inner = f"SELECT {KEY_SQL}, {', '.join(cols)} FROM fused"
    return f"WITH {FUSED} " + (C.rounded_sql(inner, doubles, 4) if doubles else inner)


_add("fuse_score", _fused_columns("anomaly_score"), _fused_sql(["round_even(fs, 4) AS anomaly_score"], ["anomaly_score"]))
_add("fuse_uncertainty", _fused_columns("uncertainty_score"), _fused_sql(["round_even(unc, 4) AS uncertainty_score"], ["uncertainty_score"]))
_add("fuse_agreement", _fused_columns("model_agreement"), _fused_sql(["round_even(agr, 4) AS model_agreement"], ["model_agreement"]))
_PROB = ["p_normal", "p_sensor_fault", "p_genuine_extreme"]



def _decision(s, d):
    """Shares are compared to whole percents: at four digits both engines meet exact ties."""
    rows = _fused(s, d)
    return C.rounded(rows.select(*KEYS, "prediction", "confidence", *[(F.floor(F.col(p) * 100 + 0.5013) / 100.0).alias(p) for p in _PROB]), 4)


_add("fuse_decision", _decision,
     _fused_sql(["prediction", "round_even(conf, 4) AS confidence",
                 "floor(round_even(CASE cs WHEN 'A' THEN (1-conf)*0.6 WHEN 'B' THEN (1-conf)*0.7 WHEN 'C' THEN conf WHEN 'D1' THEN 0.15 WHEN 'D2' THEN 0.40 ELSE 0.65 END::DOUBLE, 4) * 100 + 0.5013::DOUBLE) / 100 AS p_normal",
                 "floor(round_even(CASE cs WHEN 'A' THEN (1-conf)*0.4 WHEN 'B' THEN conf WHEN 'C' THEN (1-conf)*0.6 WHEN 'D1' THEN 0.20 WHEN 'D2' THEN 0.35 ELSE 0.15 END::DOUBLE, 4) * 100 + 0.5013::DOUBLE) / 100 AS p_sensor_fault",
                 "floor(round_even(CASE cs WHEN 'A' THEN conf WHEN 'B' THEN (1-conf)*0.3 WHEN 'C' THEN (1-conf)*0.4 WHEN 'D1' THEN 0.65 WHEN 'D2' THEN 0.25 ELSE 0.20 END::DOUBLE, 4) * 100 + 0.5013::DOUBLE) / 100 AS p_genuine_extreme"],
                ["confidence", *_PROB]))
_add("fuse_confidence_level", _fused_columns("confidence_level"), _fused_sql(["confidence_level"], []))
_add("severity", _fused_columns("severity"), _fused_sql(["severity"], []))
_add("fuse_reasons", lambda s, d: _fused(s, d).select(*KEYS, F.size("top_reasons").alias("n_reasons")),
     _fused_sql([f"CASE prediction WHEN 'GENUINE_EXTREME' THEN least(3, {N_WX}) + (anomaly_models_agreeing > 0)::INT "
                 "WHEN 'SENSOR_FAULT' THEN least(3, n_fault) + (anomaly_models_agreeing > 0)::INT + (qc_violations <> '')::INT "
                 "WHEN 'NORMAL' THEN 2 + (anomaly_models_agreeing = 0)::INT ELSE 2 END::INT AS n_reasons"], []))
_add("fuse_action", lambda s, d: _fused(s, d).groupBy("prediction", "shown_fault_type", "recommended_action").agg(F.count(F.lit(1)).alias("n")),
     f"""WITH {FUSED} SELECT prediction, CASE WHEN prediction = 'SENSOR_FAULT' THEN fault_type ELSE 'NONE' END AS shown_fault_type,
     CASE prediction WHEN 'GENUINE_EXTREME' THEN 'Issue meteorological alert. Confirm radar and satellite ground truth.'
     WHEN 'NORMAL' THEN 'Routine monitoring. Data quality verified.' WHEN 'UNKNOWN' THEN 'Collect additional consecutive observations to resolve ambiguity.'
     ELSE CASE fault_type WHEN 'DRIFT' THEN 'Schedule calibration audit. Recalibrate sensor offset baseline.' WHEN 'FREEZE' THEN 'Inspect transducer hardware for physical blockage or power stall.'
     WHEN 'SPIKE' THEN 'Transient spike detected. Verify line noise or transient surge.' WHEN 'COMMUNICATION_FAILURE' THEN 'Check telemetry modem, solar power budget, and cellular link.'
     ELSE 'Inspect station telemetry and dispatch field maintenance if error persists.' END END AS recommended_action, count(*) AS n FROM fused GROUP BY ALL""")
_add("score_coverage", lambda s, d: _fused(s, d).select(*KEYS, "model_coverage", "model_coverage_ratio"),
     f"WITH {C.GRID} SELECT {KEY_SQL}, '6/6 active' AS model_coverage, 1.0::DOUBLE AS model_coverage_ratio FROM grid")


def _correction(s, d):
    """Estimates are rounded to cents of a degree, so they are checked to half a cent."""
    rows = _fused(s, d).withColumn("expected_temperature_c", F.col("temperature_c_baseline"))
    fixed = rows.select(*KEYS, "temperature_c_baseline", FU.score_correction(rows)["temperature_c"].alias("c"))
    near = (F.abs(F.col("c.estimated") - F.col("temperature_c_baseline")) < 0.0051) & F.coalesce(
        F.abs(F.col("c.observed") - F.col("c.estimated") - F.col("c.residual")) < 0.0051, F.lit(True))
    return C.rounded(fixed.filter(F.col("c").isNotNull()).select(*KEYS, F.col("c.observed").alias("observed"), near.alias("close")))


_add("score_correction", _correction,
     f"WITH {FUSED} " + C.rounded_sql(
         f"SELECT {KEY_SQL}, temperature_c AS observed, true AS close FROM fused "
         "WHERE prediction = 'SENSOR_FAULT' AND round_even(conf, 4) >= 0.75 AND temperature_c_baseline IS NOT NULL", ["observed"]))

# --- labels and health -------------------------------------------------------------------
_RULE = "(rule_freeze OR rule_spike OR rule_drift OR rule_communication)"
_WEATHER = "((wind_speed_kmh > 55 OR rainfall_mm > 40 OR combined_anomaly_score > 0.6) AND (neighbor_agreement_score IS NULL OR neighbor_agreement_score < 10))"
_STRONG = "(combined_anomaly_score > 0.65 AND statistical_anomaly_score > 0.4)"
_add("silver_labels_a", lambda s, d: L.silver_labels_a(_evidence(s, d)).select(*KEYS, "ground_truth_label", "fault_description"),
     f"""WITH {EV} SELECT {KEY_SQL}, CASE WHEN {_RULE} THEN 'SENSOR_FAULT' WHEN {_WEATHER} THEN 'GENUINE_EXTREME' WHEN {_STRONG} THEN 'SENSOR_FAULT' ELSE 'NORMAL' END AS ground_truth_label,
     CASE WHEN rule_freeze THEN 'FREEZE' WHEN rule_spike THEN 'SPIKE' WHEN rule_drift THEN 'DRIFT' WHEN rule_communication THEN 'COMMUNICATION_FAILURE'
     WHEN {_WEATHER} THEN 'None' WHEN {_STRONG} THEN 'DRIFT' ELSE 'None' END AS fault_description FROM ev""")
_add("silver_labels_b", lambda s, d: L.silver_labels_b(_evidence(s, d)).select(*KEYS, "ground_truth_label"),
     f"WITH {EV} SELECT {KEY_SQL}, CASE WHEN {_RULE} OR {_STRONG} THEN 'SENSOR_FAULT' WHEN combined_anomaly_score > 0.55 THEN 'GENUINE_EXTREME' ELSE 'NORMAL' END AS ground_truth_label FROM ev")
_HEALTH = ["fault_rate", "anomaly_rate", "missing_rate", "residual_score", "noise_score"]
_HEALTH_SQL = (
    "SELECT * REPLACE (" + ", ".join(f"floor(round_even({c}, 4) * 1000 + 0.5013::DOUBLE) / 1000 AS {c}" for c in _HEALTH) + "), CASE WHEN health_score >= 80 THEN 'HEALTHY' "
    "WHEN health_score >= 50 THEN 'NEEDS_ATTENTION' WHEN health_score >= 20 THEN 'DEGRADED' ELSE 'CRITICAL' END AS status FROM g"
)


def _health(s, d):
    """Components to thousandths: at four digits the engines meet exact ties."""
    rows = health_scores(_evidence(s, d))
    return C.rounded(rows.withColumns({c: F.floor(F.col(c) * 1000 + 0.5013) / 1000.0 for c in _HEALTH}), 4)


_add("health_scores", _health,
     f"""WITH {EV}, h AS (SELECT station_id, count(*) AS observations, avg((ground_truth_label = 'SENSOR_FAULT')::INT) AS fault_rate, avg((combined_anomaly_score > 0.5)::INT) AS anomaly_rate,
     avg(({' OR '.join(f'{c} IS NULL' for c in SENSORS)})::INT) AS missing_rate, least(avg(abs(temperature_c_residual)) / 10, 1) AS residual_score,
     least(coalesce(avg(temperature_c_roll3_std) / 5, 0), 1) AS noise_score FROM ev GROUP BY 1), g AS (SELECT *, round_even(100 * (1 - (fault_rate * 0.40::DOUBLE + anomaly_rate * 0.20::DOUBLE
     + missing_rate * 0.15::DOUBLE + residual_score * 0.15::DOUBLE + noise_score * 0.10::DOUBLE)), 1) AS health_score FROM h)
     {C.rounded_sql(_HEALTH_SQL, [*_HEALTH, 'health_score'], 4)}""")
