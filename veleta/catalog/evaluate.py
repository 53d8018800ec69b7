"""Classifier and regression metrics (survey 2.18, 2.13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from veleta.catalog import common as C
from veleta.fixed_values import CLASSES, TARGET_SCALES
from veleta.operators import evaluation as E
from veleta.operators.expected import combine

QUERIES: dict[str, C.Query] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query: C.Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


# Predictions from readings: windy rows are called faults, wet rows extremes.
SCORED = """SELECT *, least(wind_speed_kmh, 50) / 50 * 0.7 AS s_fault, least(rainfall_mm, 25) / 25 * 0.3 AS s_extreme FROM {src}"""
JUDGED = """SELECT *, CASE WHEN s_fault > 0.5 THEN 'SENSOR_FAULT' WHEN s_extreme > 0.15 THEN 'GENUINE_EXTREME' ELSE 'NORMAL' END AS predicted,
1 - s_fault - s_extreme AS s_normal FROM {src}"""


def _judged(s, d):
    scored = s.sql(SCORED.replace("0.7", "0.7D").replace("0.3", "0.3D"), src=C.obs(s, d))
    return s.sql(JUDGED, src=scored)


SQL = f"{C.OBS}, sc AS ({SCORED.format(src='obs').replace('0.7', '0.7::DOUBLE').replace('0.3', '0.3::DOUBLE')}), jd AS ({JUDGED.format(src='sc')})"
CLASS_LIST = ", ".join(f"('{c}')" for c in CLASSES)
CM = (f"{SQL}, cl(c) AS (VALUES {CLASS_LIST}), cm AS (SELECT a.c AS actual, p.c AS predicted, "
      "(SELECT count(*) FROM jd WHERE ground_truth_label = a.c AND jd.predicted = p.c) AS n FROM cl a CROSS JOIN cl p)")
PER = (f"{CM}, pc AS (SELECT c AS class, sum(n) FILTER (actual = c AND predicted = c)::DOUBLE AS tp, sum(n) FILTER (actual <> c AND predicted = c)::DOUBLE AS fp, "
       "sum(n) FILTER (actual = c AND predicted <> c)::DOUBLE AS fn, sum(n) FILTER (actual <> c AND predicted <> c)::DOUBLE AS tn FROM cl, cm GROUP BY c)")
SCORES = {"GENUINE_EXTREME": "s_extreme", "NORMAL": "s_normal", "SENSOR_FAULT": "s_fault"}
LONG = " UNION ALL ".join(f"SELECT '{c}' AS class, {p} AS score, (ground_truth_label = '{c}')::INT AS hit FROM jd" for c, p in SCORES.items())


def _confusion(s, d):
    return E.confusion_matrix(_judged(s, d), "ground_truth_label", "predicted")


_add("confusion_matrix", _confusion, f"WITH {CM} SELECT * FROM cm")
PRF = ["precision", "recall", "f1"]
_add("class_report", lambda s, d: C.rounded(E.class_report(_confusion(s, d))),
     f"""WITH {PER}, r AS (SELECT class, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
     coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, (tp + fn)::BIGINT AS support, tp FROM pc), u AS (SELECT class, precision, recall, f1, support FROM r
     UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM r
     UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM r
     UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support)::BIGINT FROM r) {C.rounded_sql('SELECT * FROM u', PRF)}""")
_add("false_alarm_rate", lambda s, d: C.rounded(E.false_alarm_rate(_confusion(s, d))),
     f"WITH {PER} " + C.rounded_sql("SELECT class, fp / (fp + tn) AS false_alarm_rate FROM pc", ["false_alarm_rate"]))
_add("brier", lambda s, d: C.rounded(E.brier(_judged(s, d), "ground_truth_label", SCORES)),
     f"WITH {SQL}, l AS ({LONG}) " + C.rounded_sql("SELECT class, avg(pow(score - hit, 2)) AS brier FROM l GROUP BY 1", ["brier"]))
_add("pr_auc", lambda s, d: C.rounded(E.pr_auc(_judged(s, d), "ground_truth_label", SCORES)),
     f"""WITH {SQL}, l AS ({LONG}), g AS (SELECT class, score, sum(hit)::DOUBLE AS h, count(*)::DOUBLE AS n FROM l GROUP BY 1, 2),
     t AS (SELECT *, sum(h) OVER w AS ch, sum(n) OVER w AS cn, sum(h) OVER (PARTITION BY class) AS pos FROM g WINDOW w AS (PARTITION BY class ORDER BY score DESC)),
     q AS (SELECT *, ch / cn AS pr, coalesce(lag(ch / cn) OVER (PARTITION BY class ORDER BY score DESC), 1) AS pp FROM t) """
     + C.rounded_sql("SELECT class, sum(h / pos * (pr + pp) / 2) AS pr_auc FROM q GROUP BY 1", ["pr_auc"]))

# Regression metrics and ensembles over three simple predictors of temperature.
PREDICTORS = {"flat": "24.0", "damp": "30.0 - relative_humidity_pct / 10.0", "windy": "20.0 + wind_speed_kmh / 8.0"}


def _predicted(s, d):
    return C.obs(s, d).filter("temperature_c IS NOT NULL AND relative_humidity_pct IS NOT NULL").selectExpr(
        "*", *[f"cast({e} AS DOUBLE) AS {n}" for n, e in PREDICTORS.items()])


PQ = f"{C.OBS}, pr AS (SELECT *, {', '.join(f'({e})::DOUBLE AS {n}' for n, e in PREDICTORS.items())} FROM obs WHERE temperature_c IS NOT NULL AND relative_humidity_pct IS NOT NULL)"
MET = " UNION ALL ".join(
    f"SELECT '{n}' AS model, round(avg(abs(temperature_c - {n})), 4) AS mae, round(sqrt(avg(pow(temperature_c - {n}, 2))), 4) AS rmse, "
    f"round(1 - sum(pow(temperature_c - {n}, 2)) / (var_pop(temperature_c) * count(*)), 4) AS r2 FROM pr" for n in PREDICTORS)
MQ = f"{PQ}, mt AS ({MET})"
_add("reg_metrics", lambda s, d: E.reg_metrics(_predicted(s, d), "temperature_c", list(PREDICTORS)), f"WITH {MQ} SELECT * FROM mt")
RAW = "CASE WHEN r2 > -1 AND mae > 0 THEN 1 / (mae + 1e-4::DOUBLE) ELSE 0 END"
_add("ev_weights", lambda s, d: E.ev_weights(E.reg_metrics(_predicted(s, d), "temperature_c", list(PREDICTORS))),
     f"WITH {MQ}, w AS (SELECT *, {RAW} AS raw FROM mt) SELECT model, mae, rmse, r2, round(CASE WHEN sum(raw) OVER () > 0 THEN raw / sum(raw) OVER () ELSE 1.0::DOUBLE / count(*) OVER () END, 4) AS weight FROM w")
WEIGHTS = {"flat": 0.5, "damp": 0.3, "windy": 0.2}


def _ensemble(s, d):
    rows = _predicted(s, d).withColumns(combine(WEIGHTS, TARGET_SCALES["temperature_c"]))
    return rows.withColumn("residual", F.col("temperature_c") - F.col("ensemble"))


EN = (f"{PQ}, en AS (SELECT *, flat * 0.5::DOUBLE + damp * 0.3::DOUBLE + windy * 0.2::DOUBLE AS ensemble FROM pr), "
      "ev AS (SELECT *, 0.5::DOUBLE * pow(flat - ensemble, 2) + 0.3::DOUBLE * pow(damp - ensemble, 2) + 0.2::DOUBLE * pow(windy - ensemble, 2) AS variance FROM en), "
      "ea AS (SELECT *, 1 / (1 + sqrt(variance) / 2.5::DOUBLE) AS agreement FROM ev)")
OUT = ["ensemble", "variance", "agreement", "disagreement"]
_add("ev_ensemble", lambda s, d: C.rounded(_ensemble(s, d).select("station_id", "timestamp", "seq", *OUT)),
     f"WITH {EN} " + C.rounded_sql("SELECT station_id, timestamp, seq, ensemble, variance, agreement, 1 - agreement AS disagreement FROM ea", OUT))
_add("ev_residual", lambda s, d: C.rounded(_ensemble(s, d).select("station_id", "timestamp", "seq", "ensemble", "residual", "agreement")),
     f"WITH {EN} " + C.rounded_sql("SELECT station_id, timestamp, seq, ensemble, temperature_c - ensemble AS residual, agreement FROM ea", ["ensemble", "residual", "agreement"]))
