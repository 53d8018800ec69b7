"""Audit, validation and serving queries (survey 2.5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from veleta.catalog import common as C
from veleta.fixed_values import PHYSICAL_BOUNDS, SENSORS
from veleta.operators import audit as A
from veleta.operators import filters as FL
from veleta.operators import serve as SV
from veleta.sources.telemetry import hourly

QUERIES: dict[str, C.Query] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query: C.Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


COLS = ["station_id", "station_no", "timestamp", "seq", "latitude", "longitude", *SENSORS, "ground_truth_label", "fault_description"]


def bad(c: str) -> str:
    lo, hi = PHYSICAL_BOUNDS[c]
    return f"count(*) FILTER ({c} < {lo} OR {c} > {hi})"


def hourly_values(s, d):
    """Full-hour rows without their ingest number, so that equal rows can occur."""
    return hourly(s, d).select("station_id", "timestamp", "latitude", "longitude", "wind_speed_kmh", *SENSORS[:3], "rainfall_mm")


HV = ["station_id", "timestamp", "latitude", "longitude", "wind_speed_kmh", *SENSORS[:3], "rainfall_mm"]
TEXTS = ", ".join(
    f"CASE WHEN {bad(c)} > 0 THEN format('{c} has {{}} values outside [{PHYSICAL_BOUNDS[c][0]}, {PHYSICAL_BOUNDS[c][1]}]', {bad(c)}) END" for c in SENSORS)
_add("validate_report", lambda s, d: A.validate_report(hourly_values(s, d)),
     f"""WITH {C.HOURLY}, v AS (SELECT {', '.join(HV)} FROM hourly)
     SELECT '' AS missing_columns, ({' + '.join(f'count(*) FILTER ({c} IS NULL)' for c in HV)})::BIGINT AS missing_values,
     (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM v)))::BIGINT AS duplicate_rows,
     (count(*) - (SELECT count(*) FROM (SELECT DISTINCT station_id, timestamp FROM v)))::BIGINT AS duplicate_station_timestamps,
     count(*) FILTER (timestamp IS NULL) AS timestamp_parse_failures, {', '.join(f'{bad(c)} AS violations_{c}' for c in SENSORS)},
     concat_ws('; ', {TEXTS}) AS warnings, true AS is_valid FROM v""")
_add("agg_missing", lambda s, d: A.agg_missing(C.obs(s, d)),
     f"WITH {C.OBS} " + " UNION ALL ".join(
         f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS nulls, round(count(*) FILTER ({c} IS NULL) * 100.0::DOUBLE / count(*), 2) AS pct FROM obs" for c in COLS))
# Whole rows; every seventh comes twice.
_add("agg_dup_rows", lambda s, d: A.agg_dup_rows(C.obs(s, d).unionByName(C.obs(s, d).filter("seq % 7 = 0"))),
     f"""WITH {C.OBS}, u AS (SELECT * FROM obs UNION ALL SELECT * FROM obs WHERE seq % 7 = 0)
     SELECT (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM u)))::BIGINT AS duplicate_rows FROM u""")
_add("agg_dup_keys", lambda s, d: A.agg_dup_keys(hourly(s, d)),
     f"""WITH {C.HOURLY}, g AS (SELECT count(*) AS n FROM hourly GROUP BY station_id, timestamp)
     SELECT sum(n - 1)::BIGINT AS beyond_first, (sum(n) FILTER (n > 1))::BIGINT AS all_members, round((sum(n) FILTER (n > 1)) * 100.0::DOUBLE / sum(n), 3) AS rate_pct FROM g""")
_add("agg_ts_failures",
     lambda s, d: A.agg_ts_failures(_reparsed(s, d)),
     f"WITH {C.OBS} SELECT count(*) FILTER (seq % 97 = 0) AS timestamp_failures FROM obs")


def _reparsed(s, d):
    """Timestamps as day-first text with some unreadable ones, parsed again."""
    from veleta.functions.parse import parse_timestamp

    text = F.when(F.col("seq") % 97 == 0, "31/31/2024").otherwise(F.date_format("timestamp", "dd/MM/yyyy HH:mm"))
    return C.obs(s, d).select(parse_timestamp(text).alias("timestamp"))


_add("agg_violations", lambda s, d: A.agg_violations(C.obs(s, d)),
     f"WITH {C.OBS} " + " UNION ALL ".join(f"SELECT '{c}' AS sensor, {bad(c)} AS violations FROM obs" for c in SENSORS)
     + f" UNION ALL SELECT 'total', {' + '.join(bad(c) for c in SENSORS)} FROM obs")
DAYS = "floor((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 86400000000.0::DOUBLE)"
_add("audit_dataset", lambda s, d: A.audit_dataset(hourly(s, d)),
     f"""WITH {C.HOURLY}, k AS (SELECT count(*) AS n FROM hourly GROUP BY station_id, timestamp HAVING count(*) > 1)
     SELECT count(*) AS records, count(DISTINCT station_id) AS stations, min(timestamp) AS oldest, max(timestamp) AS latest,
     round({DAYS} / 365.25::DOUBLE, 2) AS coverage_years, (SELECT sum(n)::BIGINT FROM k) AS duplicate_members,
     round((SELECT sum(n) FROM k) * 100.0::DOUBLE / count(*), 3) AS duplicate_rate_pct,
     {', '.join(f'round(count(*) FILTER ({c} IS NULL) * 100.0::DOUBLE / count(*), 2) AS missing_pct_{c}' for c in SENSORS)},
     {', '.join(f'{bad(c)} AS violations_{c}' for c in SENSORS)} FROM hourly""")
_add("audit_shape", lambda s, d: C.rounded(A.audit_shape(C.obs(s, d))),
     f"WITH {C.OBS} " + C.rounded_sql(
         f"SELECT count(*) AS row_count, {len(COLS)} AS column_count, min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp, "
         "(epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 3.6e9::DOUBLE AS span_hours FROM obs", ["span_hours"]))
STEP = f"{C.GRID}, st AS (SELECT station_id, epoch_us(timestamp) - epoch_us(lag(timestamp) OVER s) AS us FROM grid WINDOW s AS ({C.W}))"
_add("audit_interval_mode", lambda s, d: A.audit_interval_mode(C.grid(s, d), C.grid_layout(s, d)),
     f"""WITH {STEP}, n AS (SELECT station_id, us AS interval_us, count(*) AS times FROM st WHERE us IS NOT NULL GROUP BY 1, 2)
     SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY times DESC, interval_us) = 1""")
_add("audit_gaps", lambda s, d: A.audit_gaps(C.grid(s, d), C.grid_layout(s, d)),
     f"WITH {STEP} SELECT station_id, count(*) FILTER (us > 3600000000) AS gaps FROM st GROUP BY 1")
_add("audit_stations", lambda s, d: A.audit_stations(C.obs(s, d)),
     f"WITH {C.OBS} SELECT station_id, count(*) AS observations, arg_min(latitude, (timestamp, seq)) AS latitude, arg_min(longitude, (timestamp, seq)) AS longitude FROM obs GROUP BY 1")
_add("audit_labels", lambda s, d: A.audit_labels(C.obs(s, d)),
     f"WITH {C.OBS} SELECT ground_truth_label, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS pct FROM obs GROUP BY 1")
_add("audit_faults", lambda s, d: A.audit_faults(C.obs(s, d)), f"WITH {C.OBS} SELECT fault_description, count(*) AS n FROM obs GROUP BY 1")
_add("audit_faults_by_station", lambda s, d: A.audit_faults_by_station(C.obs(s, d)),
     f"WITH {C.OBS} SELECT station_id, ground_truth_label, count(*) AS n FROM obs WHERE ground_truth_label <> 'NORMAL' GROUP BY 1, 2")
ST = ["mean", "std", "min", "q25", "q50", "q75", "max"]
_add("audit_describe", lambda s, d: C.rounded(A.audit_describe(C.obs(s, d))),
     f"WITH {C.OBS} " + C.rounded_sql(" UNION ALL ".join(
         f"SELECT '{c}' AS sensor, count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, quantile_cont({c}, 0.25) AS q25, "
         f"quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75, max({c}) AS max FROM obs" for c in SENSORS), ST))
_add("audit_corr", lambda s, d: C.rounded(A.audit_corr(C.obs(s, d))),
     f"WITH {C.OBS} " + C.rounded_sql(" UNION ALL ".join(
         f"SELECT '{a}/{b}' AS pair, corr({a}, {b}) AS correlation FROM obs" for i, a in enumerate(SENSORS) for b in SENSORS[i + 1:]), ["correlation"]))
_add("audit_hist", lambda s, d: A.audit_hist(C.obs(s, d)),
     f"WITH {C.OBS}, l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS sensor, ground_truth_label, {c} AS v FROM obs WHERE {c} IS NOT NULL" for c in SENSORS)
     + "), e AS (SELECT *, min(v) OVER g AS lo, max(v) OVER g AS hi FROM l WINDOW g AS (PARTITION BY sensor, ground_truth_label)) "
     "SELECT sensor, ground_truth_label, CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) / ((hi - lo) / 30)), 29)::INT END AS bin, count(*) AS n FROM e GROUP BY ALL")

# --- serving -----------------------------------------------------------------------------
_add("store_status", lambda s, d: SV.store_status(C.grid(s, d)),
     f"WITH {C.GRID} SELECT count(*) > 0 AS available, count(DISTINCT station_id) AS stations, count(*) AS records, min(timestamp) AS oldest_observation, "
     f"max(timestamp) AS latest_observation, round({DAYS} / 365.25::DOUBLE, 2) AS years_available FROM grid")
_add("station_registry", lambda s, d: SV.station_registry(C.grid(s, d)),
     f"WITH {C.GRID} SELECT station_id, arg_min(latitude, (timestamp, seq)) AS latitude, arg_min(longitude, (timestamp, seq)) AS longitude, "
     "min(timestamp) AS oldest_timestamp, max(timestamp) AS latest_timestamp, count(*) AS records FROM grid GROUP BY 1")
LATEST = "latest AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY timestamp DESC, seq DESC) = 1)"
RAW = ["station_id", "timestamp", "seq", *SENSORS]
_add("latest_per_station", lambda s, d: C.rounded(SV.latest_per_station(C.obs(s, d).select(*RAW))),
     f"WITH {C.OBS}, {LATEST} " + C.rounded_sql(f"SELECT {', '.join(RAW)} FROM latest", SENSORS))

# Predictions of these queries are the ground-truth labels, severity follows from readings.
PRED = {
    "prediction": ("ground_truth_label", "ground_truth_label"),
    "severity": (
        "CASE WHEN ground_truth_label = 'NORMAL' THEN 'LOW' WHEN wind_speed_kmh > 40 THEN 'CRITICAL' WHEN wind_speed_kmh > 20 THEN 'HIGH' ELSE 'MEDIUM' END",
    ) * 2,
    "fault_type": (
        "CASE WHEN ground_truth_label <> 'SENSOR_FAULT' THEN 'NONE' WHEN fault_description LIKE '%Drift%' THEN 'DRIFT' "
        "WHEN fault_description LIKE '%Freeze%' THEN 'FREEZE' WHEN fault_description LIKE '%Spike%' THEN 'SPIKE' ELSE 'COMMUNICATION_FAILURE' END",
    ) * 2,
    "station_name": ("concat('Station ', station_no)",) * 2,
}


def _predicted(df):
    return df.selectExpr("*", *[f"{v[0]} AS {k}" for k, v in PRED.items()])


PREDICTED = ", ".join(f"{v[1]} AS {k}" for k, v in PRED.items())
PO = f"{C.OBS}, po AS (SELECT *, {PREDICTED} FROM obs)"
PL = f"{C.OBS}, {LATEST}, pl AS (SELECT *, {PREDICTED} FROM latest)"
SHOWN = ["station_id", "timestamp", "seq", "prediction", "severity", "fault_type"]


def _latest(s, d):
    return _predicted(SV.latest_per_station(C.obs(s, d)))


_add("anomaly_feed", lambda s, d: SV.anomaly_feed(_latest(s, d)).select(*SHOWN), f"WITH {PL} SELECT {', '.join(SHOWN)} FROM pl WHERE prediction <> 'NORMAL'")
_add("anomaly_totals", lambda s, d: SV.anomaly_totals(_predicted(C.obs(s, d))),
     f"WITH {PO} SELECT count(*) FILTER (prediction <> 'NORMAL') AS total, count(*) FILTER (prediction = 'SENSOR_FAULT') AS sensor_faults, "
     "count(*) FILTER (prediction = 'GENUINE_EXTREME') AS genuine_events FROM po")
_add("dash_kpis", lambda s, d: SV.dash_kpis(_predicted(C.obs(s, d))),
     f"WITH {PO} SELECT count(*) FILTER (prediction = 'NORMAL') AS healthy, floor(count(*) FILTER (prediction <> 'NORMAL') * 100.0::DOUBLE / count(*) + 0.5)::INT AS anomaly_rate_pct, "
     "count(*) FILTER (prediction <> 'NORMAL' AND severity = 'HIGH') AS high, count(*) FILTER (prediction <> 'NORMAL' AND severity = 'CRITICAL') AS critical FROM po")
_add("dash_distributions", lambda s, d: SV.dash_distributions(_predicted(C.obs(s, d))),
     f"WITH {PO}, u AS (" + " UNION ALL ".join(
         f"SELECT '{k}' AS kind, '{n}' AS name, count(*) FILTER ({k} = '{n}') AS n FROM po" for k, names in SV.CATEGORIES.items() for n in names)
     + ") SELECT * FROM u WHERE n > 0 OR kind = 'severity'")
_add("station_search", lambda s, d: FL.station_search(_predicted(C.obs(s, d)), "TION 1", "ANOMALY").select(*SHOWN),
     f"WITH {PO} SELECT {', '.join(SHOWN)} FROM po WHERE (lower(station_id) LIKE '%tion 1%' OR lower(station_name) LIKE '%tion 1%') AND prediction <> 'NORMAL'")
_add("alert_filter", lambda s, d: FL.alert_filter(_predicted(C.obs(s, d)), "CRITICAL").select(*SHOWN),
     f"WITH {PO} SELECT {', '.join(SHOWN)} FROM po WHERE severity = 'CRITICAL'")
_add("adaptive_history", lambda s, d: SV.adaptive_history(C.obs(s, d), 50).select("station_id", "timestamp", "seq", "position", "total"),
     f"""WITH {C.OBS}, p AS (SELECT station_id, timestamp, seq, row_number() OVER ({C.W}) - 1 AS position, count(*) OVER (PARTITION BY station_id) AS total FROM obs)
     SELECT * FROM p WHERE total <= 50 OR position % greatest(1, total // 50) = 0 OR position = total - 1""")
_add("adaptive_summary", lambda s, d: SV.adaptive_summary(C.obs(s, d), 50),
     f"""WITH {C.OBS}, p AS (SELECT *, row_number() OVER ({C.W}) - 1 AS position, count(*) OVER (PARTITION BY station_id) AS total FROM obs)
     SELECT station_id, any_value(total) AS total, count(*) FILTER (total <= 50 OR position % greatest(1, total // 50) = 0 OR position = total - 1) AS displayed,
     count(*) FILTER (ground_truth_label <> 'NORMAL') AS anomalies, max(timestamp) AS latest FROM p GROUP BY 1""")

