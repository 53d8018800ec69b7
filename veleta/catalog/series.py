"""Queries over filters, joins, preprocessing, splits and features (survey 2.3, 2.4, 2.6-2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from veleta.catalog import common as C
from veleta.fixed_values import SENSORS
from veleta.operators import baseline as B
from veleta.operators import dedup as D
from veleta.operators import feature_prep as FP
from veleta.operators import filters as FL
from veleta.operators import multivariate as MV
from veleta.operators import preprocess as P
from veleta.operators import spatial as SP
from veleta.operators import split as S
from veleta.operators import temporal as T
from veleta.operators.health import health_scores, join_health
from veleta.sources.telemetry import hourly
from veleta.sources.store import anti_existing
from veleta.sources.payload import known_station, region_lookup

QUERIES: dict[str, C.Query] = {}
ORACLES: dict[str, str] = {}
KEYS = ["station_id", "timestamp", "seq"]
KEY_SQL = "station_id, timestamp, seq"


def _add(name: str, query: C.Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _columns(df, cols, digits: int = C.DIGITS):
    return C.rounded(df.select(*KEYS, *cols), digits)


def _column_sql(ctes: str, source: str, cols: list[str], doubles: list[str] | None = None) -> str:
    inner = f"SELECT {KEY_SQL}, {', '.join(cols)} FROM {source}"
    return f"WITH {ctes} " + C.rounded_sql(inner, cols if doubles is None else doubles) if (doubles is None or doubles) else f"WITH {ctes} {inner}"


# --- 2.3 filters, de-duplication, limits -------------------------------------------------
RAW = [*KEYS, *SENSORS]
RAW_SQL = ", ".join(RAW)
_add("dedup_last", lambda s, d: C.rounded(D.dedup_last(hourly(s, d)).select(*RAW)),
     f"WITH {C.HOURLY} " + C.rounded_sql(
         f"SELECT {RAW_SQL} FROM hourly QUALIFY row_number() OVER (PARTITION BY station_id, timestamp ORDER BY seq DESC) = 1", SENSORS))
_add("dedup_first", lambda s, d: C.rounded(C.grid(s, d).select(*RAW)),
     f"WITH {C.GRID} " + C.rounded_sql(f"SELECT {RAW_SQL} FROM grid", SENSORS))
_add("filter_time_station",
     lambda s, d: C.rounded(FL.filter_time_station(C.obs(s, d), ["AWS_02", "AWS_07", "AWS_11"], "2024-01-05 00:00:00", "2024-01-20 12:00:00").select(*RAW)),
     f"WITH {C.OBS} " + C.rounded_sql(
         f"SELECT {RAW_SQL} FROM obs WHERE station_id IN ('AWS_02','AWS_07','AWS_11') AND timestamp BETWEEN '2024-01-05' AND '2024-01-20 12:00:00'", SENSORS))
_add("history_limit", lambda s, d: C.rounded(FL.history_limit(C.obs(s, d), "AWS_03", 50).select(*RAW)),
     f"WITH {C.OBS} " + C.rounded_sql(f"SELECT {RAW_SQL} FROM obs WHERE station_id = 'AWS_03' ORDER BY timestamp, seq LIMIT 50", SENSORS))
_add("history_recent", lambda s, d: C.rounded(FL.history_recent(C.obs(s, d), 100).select(*RAW)),
     f"WITH {C.OBS} " + C.rounded_sql(
         f"SELECT {RAW_SQL} FROM obs QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY timestamp DESC, seq DESC) <= 100", SENSORS))
_add("distinct_values", lambda s, d: FL.distinct_values(C.grid(s, d)),
     f"WITH {C.GRID} SELECT count(DISTINCT timestamp) AS timestamps, count(DISTINCT station_id) AS stations FROM grid")
_add("range_preset", lambda s, d: C.rounded(FL.range_preset(C.obs(s, d), "7D", "2024-01-31 00:00:00").select(*RAW)),
     f"WITH {C.OBS} " + C.rounded_sql(f"SELECT {RAW_SQL} FROM obs WHERE timestamp >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAYS", SENSORS))


def _union_splits(s, d):
    parts = S.split_chrono(C.grid(s, d), C.grid_split(s, d))
    whole = FL.union_splits(*[parts.filter(F.col("split") == n) for n in ("train", "val", "test")])
    return whole.groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("split").alias("splits"))


SPLIT_CASE = "CASE WHEN timestamp < v THEN 'train' WHEN timestamp < t THEN 'val' ELSE 'test' END"
_add("union_splits", _union_splits,
     f"WITH {C.TRAIN} SELECT station_id, count(*) AS n, count(DISTINCT {SPLIT_CASE}) AS splits FROM cleaned, cut GROUP BY 1")


# --- 2.4 joins ---------------------------------------------------------------------------
Z3 = [f"{c}_{k}" for c in SENSORS for k in ("baseline", "deviation", "robust_z")]


def _joined_baseline(s, d):
    m = C.feature_model(s, d)
    rows = B.join_baseline(C.grid(s, d), m.baselines, m.layout.small_baselines)
    return _columns(rows, [f"{c}_{k}" for c in SENSORS for k in ("median", "mad")])


MM = [f"{c}_{k}" for c in SENSORS for k in ("median", "mad")]
_add("join_baseline", _joined_baseline,
     f"WITH {C.BASELINE} " + C.rounded_sql(
         f"SELECT g.station_id, g.timestamp, g.seq, {', '.join(MM)} FROM grid g LEFT JOIN base b ON g.station_id = b.station_id AND hour(g.timestamp) = b.hour", MM))


def _neighbour_obs(s, d):
    m = C.feature_model(s, d)
    stats = SP.neighbour_stats(C.grid_clean(s, d), m.neighbours, SENSORS, m.layout.small_network)
    return C.rounded(stats.select("station_id", "timestamp", *[f"neighbor_{c}_mean" for c in SENSORS]))


NM = [f"neighbor_{c}_mean" for c in SENSORS]
_add("join_neighbor_obs", _neighbour_obs,
     f"WITH {C.CLEAN}, {C.PAIRS} " + C.rounded_sql(
         "SELECT k.station_id, n.timestamp, " + ", ".join(f"avg(n.{c}_clean) AS neighbor_{c}_mean" for c in SENSORS)
         + " FROM knn k JOIN cleaned n ON n.station_id = k.neighbour_id GROUP BY 1, 2", NM))


def _join_health(s, d):
    return C.rounded(join_health(C.grid(s, d), health_scores(C.grid(s, d)), True).select(*KEYS, "sensor_health", "sensor_health_status"))


_add("join_health", _join_health,
     f"""WITH {C.GRID}, r AS (SELECT station_id, avg((ground_truth_label = 'SENSOR_FAULT')::INT) AS f,
     avg((temperature_c IS NULL OR relative_humidity_pct IS NULL OR pressure_hpa IS NULL OR wind_speed_kmh IS NULL OR rainfall_mm IS NULL)::INT) AS m
     FROM grid GROUP BY 1), h AS (SELECT station_id, round_even(100 * (1 - (0.40::DOUBLE * f + 0.15::DOUBLE * m)), 1) AS hs FROM r)
     SELECT {KEY_SQL.replace('station_id', 'g.station_id')}, coalesce(hs, 100.0::DOUBLE) + 0.0::DOUBLE AS sensor_health,
     CASE WHEN coalesce(hs, 100) >= 80 THEN 'HEALTHY' WHEN hs >= 50 THEN 'NEEDS_ATTENTION' WHEN hs >= 20 THEN 'DEGRADED' ELSE 'CRITICAL' END AS sensor_health_status
     FROM grid g LEFT JOIN h USING (station_id)""".replace("g.station_id, timestamp", "station_id, timestamp"))

REGION_TEXT = "upper(CASE station_no % 5 WHEN 0 THEN 'Jorhat depot' WHEN 1 THEN 'Kamrup_Metropolitan, Assam' WHEN 2 THEN 'North Cachar' WHEN 3 THEN 'Assam' ELSE 'Pune' END)"


def _region(s, d):
    rows = C.obs(s, d).withColumn("place", F.expr(REGION_TEXT))
    at = F.coalesce(known_station(F.col("station_id")), region_lookup(F.col("place")))
    return rows.select("station_id", "timestamp", "seq", at["lat"].alias("region_lat"), at["lon"].alias("region_lon"))


_add("join_lookup_region", _region,
     f"WITH {C.OBS} SELECT {KEY_SQL}, CASE station_no % 5 WHEN 0 THEN 26.75::DOUBLE WHEN 1 THEN 26.1445::DOUBLE WHEN 2 THEN 24.8333::DOUBLE WHEN 3 THEN 26.2006::DOUBLE END AS region_lat, "
     "CASE station_no % 5 WHEN 0 THEN 94.22::DOUBLE WHEN 1 THEN 91.7362::DOUBLE WHEN 2 THEN 92.8::DOUBLE WHEN 3 THEN 92.9376::DOUBLE END AS region_lon FROM obs")
_add("anti_existing",
     lambda s, d: anti_existing(C.grid(s, d), FL.filter_time_station(C.grid(s, d), None, None, "2024-01-16 00:00:00")).select(*KEYS),
     f"WITH {C.GRID} SELECT {KEY_SQL} FROM grid WHERE timestamp > '2024-01-16'")
_add("semi_split", lambda s, d: S.split_chrono(C.grid(s, d), C.grid_split(s, d)).filter(F.col("split") == "val").select(*KEYS),
     f"WITH {C.TRAIN} SELECT {KEY_SQL} FROM cleaned, cut WHERE timestamp >= v AND timestamp < t")

# --- 2.6 preprocessing -------------------------------------------------------------------
QM = [f"qf_missing_{c}" for c in SENSORS]
QP = [f"qf_physical_{c}" for c in SENSORS]
CL = [f"{c}_clean" for c in SENSORS]
_add("qf_missing", lambda s, d: P.flag_missing(C.obs(s, d)).select(*KEYS, *QM), _column_sql(C.OBS_CLEAN, "cleaned", QM, []))
_add("qf_physical", lambda s, d: P.flag_physical(C.obs(s, d)).select(*KEYS, *QP), _column_sql(C.OBS_CLEAN, "cleaned", QP, []))
_add("qf_duplicate_ts", lambda s, d: P.flag_duplicate_ts(hourly(s, d)).select(*KEYS, "qf_duplicate_ts"),
     f"WITH {C.HOURLY} SELECT {KEY_SQL}, count(*) OVER (PARTITION BY station_id, timestamp) > 1 AS qf_duplicate_ts FROM hourly")
_add("qf_temporal_gap", lambda s, d: P.flag_temporal_gap(C.obs(s, d), C.obs_layout(s, d)).select(*KEYS, "qf_temporal_gap"),
     f"WITH {C.OBS} SELECT {KEY_SQL}, coalesce({C.hours('timestamp', 'lag(timestamp) OVER s')} > 1, false) AS qf_temporal_gap FROM obs WINDOW s AS ({C.W})")


def _impute_sql() -> str:
    cols = ", ".join(
        f"coalesce(last_value({c} IGNORE NULLS) OVER (s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
        f"first_value({c} IGNORE NULLS) OVER (s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}_clean" for c in SENSORS)
    return f"WITH {C.OBS} " + C.rounded_sql(f"SELECT {KEY_SQL}, {cols} FROM obs WINDOW s AS ({C.W})", CL)


_add("impute", lambda s, d: _columns(P.impute(C.obs(s, d), C.obs_layout(s, d)), CL), _impute_sql())
_add("clip", lambda s, d: _columns(P.clip_physical(P.impute(C.obs(s, d), C.obs_layout(s, d))), CL), _column_sql(C.OBS_CLEAN, "cleaned", CL))
_add("preprocess",
     lambda s, d: _columns(P.preprocess(C.obs(s, d), C.obs_layout(s, d)), [*CL, *QM, *QP, "qf_duplicate_ts", "qf_temporal_gap"]),
     f"WITH {C.OBS_CLEAN} " + C.rounded_sql(
         f"SELECT {KEY_SQL}, {', '.join([*CL, *QM, *QP])}, count(*) OVER (PARTITION BY station_id, timestamp) > 1 AS qf_duplicate_ts, "
         f"coalesce({C.hours('timestamp', 'lag(timestamp) OVER s')} > 1, false) AS qf_temporal_gap FROM cleaned WINDOW s AS ({C.W})", CL))

# --- 2.7 split ---------------------------------------------------------------------------
_add("split_chrono", lambda s, d: S.split_chrono(C.grid(s, d), C.grid_split(s, d)).select(*KEYS, "split"),
     f"WITH {C.TRAIN} SELECT {KEY_SQL}, {SPLIT_CASE} AS split FROM cleaned, cut")
_add("split_report", lambda s, d: S.split_report(S.split_chrono(C.grid(s, d), C.grid_split(s, d))),
     f"WITH {C.TRAIN} SELECT {SPLIT_CASE} AS split, count(*) AS rows, min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp, "
     "count(*) FILTER (ground_truth_label = 'NORMAL') AS n_normal, count(*) FILTER (ground_truth_label = 'SENSOR_FAULT') AS n_sensor_fault, "
     "count(*) FILTER (ground_truth_label = 'GENUINE_EXTREME') AS n_genuine_extreme FROM cleaned, cut GROUP BY 1")

# --- 2.8 temporal features ---------------------------------------------------------------
OBS_TEMPORAL = f"{C.OBS_CLEAN}, temporal AS ({C._temporal_sql('cleaned')})"


def _temporal(s, d):
    layout = C.obs_layout(s, d)
    return T.add_temporal_features(P.clip_physical(P.impute(C.obs(s, d), layout)), layout)


for _name, _cols in {
    "feat_lag": [f"{c}_lag{k}" for c in SENSORS for k in (1, 2, 3)],
    "feat_delta": [f"{c}_delta" for c in SENSORS],
    "feat_rolling": [f"{c}_roll{n}_{k}" for c in SENSORS for n in (3, 6) for k in ("mean", "std")],
    "feat_gap_hours": ["time_since_prev_obs"],
}.items():
    _add(_name, lambda s, d, cols=_cols: _columns(_temporal(s, d), cols), _column_sql(OBS_TEMPORAL, "temporal", _cols))

# A deviation that is zero up to rounding noise makes the ratio meaningless; both sides report
# the score where the deviation is at least a millionth.
ROLLZ = [f"{c}_roll_zscore" for c in SENSORS]
_add("feat_roll_z",
     lambda s, d: C.rounded(_temporal(s, d).select(*KEYS, *[F.when(F.col(f"{c}_roll6_std") > 1e-6, F.col(f"{c}_roll_zscore")).alias(f"{c}_roll_zscore") for c in SENSORS])),
     f"WITH {OBS_TEMPORAL} " + C.rounded_sql(
         f"SELECT {KEY_SQL}, " + ", ".join(f"CASE WHEN {c}_roll6_std > 1e-6 THEN ({c}_clean - {c}_roll6_mean) / {c}_roll6_std END AS {c}_roll_zscore" for c in SENSORS)
         + " FROM temporal", ROLLZ))
CAL = ["hour", "day_of_week", "day_of_year", "month"]
_add("feat_calendar", lambda s, d: T.add_calendar(C.obs(s, d)).select(*KEYS, *CAL), _column_sql(OBS_TEMPORAL, "temporal", CAL, []))

# --- 2.9 baselines -----------------------------------------------------------------------
_add("baseline_fit", lambda s, d: C.rounded(C.grid_baselines(s, d)),
     f"WITH {C.BASELINE} " + C.rounded_sql(f"SELECT station_id, hour, {', '.join(MM)} FROM base", MM))


def _based(s, d):
    m = C.feature_model(s, d)
    return B.baseline_apply(C.grid_clean(s, d), m.baselines, small=m.layout.small_baselines)


_add("baseline_apply", lambda s, d: _columns(_based(s, d), Z3), f"WITH {C.BASED} " + C.rounded_sql(f"SELECT {KEY_SQL}, {', '.join(Z3)} FROM based", Z3))


# --- 2.10 spatial features ---------------------------------------------------------------
def _haversine(s, d):
    from veleta.functions.geo import haversine_km

    rows = C.obs(s, d)
    return C.rounded(rows.select(*KEYS, haversine_km(F.col("latitude"), F.col("longitude"), F.lit(13.0827), F.lit(80.2707)).alias("km")))


_add("haversine", _haversine,
     f"WITH {C.OBS} " + C.rounded_sql(
         f"SELECT {KEY_SQL}, 2 * 6371.0::DOUBLE * asin(sqrt(pow(sin(radians(13.0827::DOUBLE - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(13.0827::DOUBLE)) "
         "* pow(sin(radians(80.2707::DOUBLE - longitude) / 2), 2))) AS km FROM obs", ["km"]))
_add("station_coords", lambda s, d: SP.station_coords(C.grid(s, d)), f"WITH {C.GRID}, {C.PAIRS} SELECT * FROM coords")
_add("knn_stations", lambda s, d: C.rounded(SP.knn_stations(SP.station_coords(C.grid(s, d)))),
     f"WITH {C.GRID}, {C.PAIRS} " + C.rounded_sql("SELECT station_id, neighbour_id, rank, distance_km FROM knn", ["distance_km"]))


def _spatial(s, d):
    m = C.feature_model(s, d)
    return SP.add_spatial_features(C.grid_clean(s, d), m.neighbours, small_network=m.layout.small_network)


NEAR = f"{C.CLEAN}, {C.PAIRS}, {C._spatial_sql('cleaned')}"
for _name, _cols in {
    "feat_neighbor": ["nearest_station_distance_km", *[f"neighbor_{c}_{k}" for c in SENSORS for k in ("mean", "std")]],
    "feat_spatial_resid": [f"spatial_{c}_residual" for c in SENSORS],
    "feat_agreement": ["neighbor_agreement_score"],
}.items():
    _add(_name, lambda s, d, cols=_cols: _columns(_spatial(s, d), cols), _column_sql(NEAR, "feat", _cols))


# --- 2.11 feature preparation ------------------------------------------------------------
def _train(s, d):
    return C.train_rows(C.grid(s, d), C.grid_split(s, d))


TRAIN_GRID = f"{C.TRAIN}, tr AS (SELECT grid.* FROM grid, cut WHERE timestamp < v)"


def _selected(s, d):
    """Filled values per candidate of the feature table's training part; no deviation counts where the spread is but rounding."""
    rows = C.train_rows(C.grid_features(s, d), C.grid_split(s, d))
    rows = rows.withColumns({f"{c}_roll_zscore": F.when(F.col(f"{c}_roll6_std") > 1e-6, F.col(f"{c}_roll_zscore")) for c in SENSORS})
    return FP.filled_counts(rows, FP.anomaly_features(rows))


PER_SENSOR = [
    "", "_clean", "_baseline", "_deviation", "_robust_z", "_lag1", "_lag2", "_lag3", "_delta", "_roll3_mean", "_roll3_std", "_roll6_mean", "_roll6_std"]
FILLED = {f"{c}{k}": f"{c}{k}" for c in SENSORS for k in PER_SENSOR}
FILLED |= {f"neighbor_{c}_{k}": f"neighbor_{c}_{k}" for c in SENSORS for k in ("mean", "std")}
FILLED |= {c: c for c in ("hour", "day_of_week", "day_of_year", "month", "time_since_prev_obs", "nearest_station_distance_km", "neighbor_agreement_score")}
_add("feature_select", _selected,
     f"WITH {C.FEATURES} SELECT " + ", ".join(f"count(feat.{c}) AS {name}" for name, c in FILLED.items()) + ", "
     + ", ".join(f"count(*) FILTER ({c}_roll6_std > 1e-6) AS {c}_roll_zscore" for c in SENSORS) + " FROM feat, cut WHERE feat.timestamp < v")


def _imputed(s, d):
    scaling = C.once(s, d, "raw_scaling", lambda: FP.fit_scaling(_train(s, d), SENSORS))
    rows = C.grid(s, d)
    return _columns(rows.withColumns({c: F.coalesce(F.col(c), F.lit(scaling.median[c])) for c in SENSORS}), SENSORS)


def _scaled(s, d):
    scaling = C.once(s, d, "raw_scaling", lambda: FP.fit_scaling(_train(s, d), SENSORS))
    rows = C.grid(s, d)
    return _columns(rows.withColumns({f"{c}_scaled": scaling.scaled(rows, c) for c in SENSORS}), [f"{c}_scaled" for c in SENSORS])


MED = ", ".join(f"median({c}) AS {c}_m" for c in SENSORS)
QRT = ", ".join(
    f"quantile_cont(coalesce({c}, {c}_m), 0.75) - quantile_cont(coalesce({c}, {c}_m), 0.25) AS {c}_w" for c in SENSORS)
SCALE = f"{TRAIN_GRID}, md AS (SELECT {MED} FROM tr), iq AS (SELECT {QRT} FROM tr, md)"
_add("impute_median_cols", _imputed,
     f"WITH {SCALE} " + C.rounded_sql(f"SELECT {KEY_SQL}, " + ", ".join(f"coalesce({c}, {c}_m) AS {c}" for c in SENSORS) + " FROM grid, md", SENSORS))
_add("robust_scale", _scaled,
     f"WITH {SCALE} " + C.rounded_sql(
         f"SELECT {KEY_SQL}, " + ", ".join(f"(coalesce({c}, {c}_m) - {c}_m) / CASE WHEN {c}_w = 0 THEN 1 ELSE {c}_w END AS {c}_scaled" for c in SENSORS)
         + " FROM grid, md, iq", [f"{c}_scaled" for c in SENSORS]))
BUILT = ["temperature_c_lag1", "pressure_hpa_roll6_mean", "temperature_c_robust_z", "relative_humidity_pct_deviation",
         "neighbor_temperature_c_mean", "neighbor_agreement_score", "time_since_prev_obs"]
_add("feature_builder", lambda s, d: _columns(C.grid_features(s, d), BUILT),
     f"WITH {C.FEATURES} " + C.rounded_sql(f"SELECT {KEY_SQL}, {', '.join(BUILT)} FROM feat", BUILT))


# --- 2.12 cross-sensor consistency -------------------------------------------------------
def _moments(s, d):
    rows = C.grid_clean(s, d)
    return C.rounded(MV.moments(C.train_rows(rows, C.grid_split(s, d)), [F.col(c) for c in CL]), 4)


MOM = [f"m{i}" for i in range(5)] + [f"c{i}_{j}" for i in range(5) for j in range(i, 5)]
_add("mv_moments", _moments,
     f"WITH {C.TRAIN} " + C.rounded_sql(
         "SELECT " + ", ".join([f"avg({c}) AS m{i}" for i, c in enumerate(CL)]
                               + [f"covar_samp({CL[i]}, {CL[j]}) AS c{i}_{j}" for i in range(5) for j in range(i, 5)]) + " FROM train", MOM, 4))


def _mahalanobis(s, d):
    rows = C.grid_clean(s, d)
    fitted = C.once(s, d, "mahalanobis", lambda: MV.fit_mahalanobis(C.train_rows(rows, C.grid_split(s, d))))
    return _columns(fitted.distance(rows), ["mahalanobis_distance"])


def _mv_regress(s, d):
    rows = C.grid_clean(s, d)
    fitted = C.once(s, d, "consistency", lambda: MV.fit_consistency(C.train_rows(rows, C.grid_split(s, d))))
    return _columns(fitted.transform(rows), [f"mv_{c}_residual" for c in SENSORS])


_add("mv_mahalanobis", _mahalanobis)
_add("mv_regress", _mv_regress)
