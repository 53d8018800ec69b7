"""Shared inputs of the registered queries, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veleta.fixed_values import PHYSICAL_BOUNDS, SENSORS
from veleta.operators.baseline import baseline_fit
from veleta.operators.dedup import dedup_first
from veleta.operators.series import SeriesLayout
from veleta.plans.features import FeatureModel, clean, fit_features
from veleta.operators.split import SplitBounds, split_bounds
from veleta.sources.telemetry import hourly, telemetry

Query = Callable[[SparkSession, str], DataFrame]
DIGITS = 6

_memo: dict[tuple, object] = {}


def once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], object]):
    """Fitted models and measured sizes are made once per session and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _memo:
        _memo[key] = make()
    return _memo[key]


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded for comparison; adding zero turns -0.0 into 0.0."""
    return df.select(
        *[
            (F.round(f.name, digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema
        ]
    )


def rounded_sql(sql: str, doubles: Sequence[str], digits: int = DIGITS) -> str:
    parts = ", ".join(f"round({c}, {digits}) + 0.0::DOUBLE AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({parts}) FROM ({sql})"


# --- tables ---------------------------------------------------------------------------
def obs(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry(spark, sf)


def obs_layout(spark: SparkSession, sf: str) -> SeriesLayout:
    return once(spark, sf, "obs_layout", lambda: SeriesLayout.measure(obs(spark, sf)))


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """Full-hour observations with unique keys."""
    return dedup_first(hourly(spark, sf))


def grid_layout(spark: SparkSession, sf: str) -> SeriesLayout:
    return once(spark, sf, "grid_layout", lambda: SeriesLayout.measure(grid(spark, sf)))


def grid_clean(spark: SparkSession, sf: str) -> DataFrame:
    return clean(grid(spark, sf), grid_layout(spark, sf))


def grid_split(spark: SparkSession, sf: str) -> SplitBounds:
    return once(spark, sf, "grid_split", lambda: split_bounds(grid(spark, sf)))


def train_rows(df: DataFrame, bounds: SplitBounds) -> DataFrame:
    from veleta.operators.filters import time_literal

    return df.filter(F.col("timestamp") < time_literal(bounds.val_from))


def grid_baselines(spark: SparkSession, sf: str) -> DataFrame:
    def make() -> DataFrame:
        return baseline_fit(train_rows(grid_clean(spark, sf), grid_split(spark, sf)), grid_layout(spark, sf)).persist()

    return once(spark, sf, "grid_baselines", make)


def feature_model(spark: SparkSession, sf: str) -> FeatureModel:
    def make() -> FeatureModel:
        rows = grid_clean(spark, sf)
        train = train_rows(rows, grid_split(spark, sf))
        return fit_features(train, rows, grid_layout(spark, sf), baselines=grid_baselines(spark, sf))

    return once(spark, sf, "feature_model", make)


def grid_features(spark: SparkSession, sf: str) -> DataFrame:
    return feature_model(spark, sf).transform(grid_clean(spark, sf))


# --- the same tables in DuckDB SQL ------------------------------------------------------
OBS_SQL = """
SELECT
  concat('AWS_', lpad(cast(user_id % 30 AS VARCHAR), 2, '0'))       AS station_id,
  cast(user_id % 30 AS INT)                                         AS station_no,
  ts                                                                AS timestamp,
  event_id                                                          AS seq,
  (8.0::DOUBLE) + (user_id % 30 % 6) * (4.5::DOUBLE)                AS latitude,
  (70.0::DOUBLE) + floor((user_id % 30) / (6::DOUBLE)) * (5.0::DOUBLE) AS longitude,
  CASE WHEN event_id % 23 = 0 THEN NULL
       ELSE (18.0::DOUBLE) + (value - (12.0::DOUBLE) * floor(value / (12.0::DOUBLE)))
          + CASE WHEN user_id % 30 % 5 = 2 AND day(ts) BETWEEN 20 AND 24 THEN (25.0::DOUBLE) ELSE (0.0::DOUBLE) END
          + CASE WHEN event_id % 211 = 0 THEN (45.0::DOUBLE) ELSE (0.0::DOUBLE) END
  END                                                               AS temperature_c,
  CASE WHEN event_id % 29 = 0 THEN NULL
       WHEN user_id % 30 % 4 = 1 AND day(ts) IN (3, 13) THEN (62.4::DOUBLE)
       ELSE (20.0::DOUBLE) + (user_id * 7 + event_id * 13) % 80 END AS relative_humidity_pct,
  CASE WHEN event_type = 'error' AND event_id % 50 = 0 THEN (650.0::DOUBLE)
       ELSE (995.0::DOUBLE) + (event_id % 200) / (10.0::DOUBLE) END AS pressure_hpa,
  cast(json_extract_string(props,'$.k') AS DOUBLE) * (0.5::DOUBLE)
       + CASE WHEN event_id % 307 = 0 THEN (160.0::DOUBLE) ELSE (0.0::DOUBLE) END AS wind_speed_kmh,
  CASE WHEN event_type = 'purchase' THEN value / (4.0::DOUBLE) ELSE (0.0::DOUBLE) END AS rainfall_mm,
  CASE WHEN event_type = 'error' THEN 'SENSOR_FAULT'
       WHEN event_type = 'purchase' AND value > 60 THEN 'GENUINE_EXTREME'
       ELSE 'NORMAL' END                                            AS ground_truth_label,
  CASE WHEN event_type <> 'error' THEN 'None'
       WHEN event_id % 4 = 0 THEN 'Temperature Sensor Drift / Calibration Loss'
       WHEN event_id % 4 = 1 THEN 'Humidity Sensor Freeze (Zero variance)'
       WHEN event_id % 4 = 2 THEN 'Barometric Sensor Single-Point Noise Spike'
       ELSE 'Communication dropout' END                             AS fault_description
FROM events
"""
OBS = f"obs AS ({OBS_SQL})"
HOURLY = f"{OBS}, hourly AS (SELECT * REPLACE (date_trunc('hour', timestamp)::TIMESTAMP AS timestamp) FROM obs)"
GRID = (
    f"{HOURLY}, grid AS (SELECT * FROM hourly "
    "QUALIFY row_number() OVER (PARTITION BY station_id, timestamp ORDER BY seq) = 1)"
)
W = "PARTITION BY station_id ORDER BY timestamp, seq"


def hours(a: str, b: str) -> str:
    return f"((epoch_us({a}) - epoch_us({b})) / 3.6e9::DOUBLE)"


def _clean_sql(source: str) -> str:
    cols = []
    for c, (lo, hi) in PHYSICAL_BOUNDS.items():
        cols.append(
            f"least(greatest(coalesce(last_value({c} IGNORE NULLS) OVER (s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
            f"first_value({c} IGNORE NULLS) OVER (s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), "
            f"{lo}::DOUBLE), {hi}::DOUBLE) AS {c}_clean"
        )
        cols.append(f"{c} IS NULL AS qf_missing_{c}")
        cols.append(f"coalesce({c} < {lo} OR {c} > {hi}, false) AS qf_physical_{c}")
    return f"SELECT *, {', '.join(cols)} FROM {source} WINDOW s AS ({W})"


CLEAN = f"{GRID}, cleaned AS ({_clean_sql('grid')})"
OBS_CLEAN = f"{OBS}, cleaned AS ({_clean_sql('obs')})"
SPLIT = (
    "times AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp) - 1 AS i, count(*) OVER () AS n "
    "FROM (SELECT DISTINCT timestamp FROM cleaned)), "
    "cut AS (SELECT max(timestamp) FILTER (i = floor(n * 0.6)::BIGINT) AS v, "
    "max(timestamp) FILTER (i = floor(n * 0.6)::BIGINT + floor(n * 0.2)::BIGINT) AS t FROM times)"
)


def _temporal_sql(source: str, lags=(1, 2, 3), windows=(3, 6)) -> str:
    cols = []
    for c in SENSORS:
        v = f"{c}_clean"
        cols += [f"lag({v}, {k}) OVER s AS {c}_lag{k}" for k in lags]
        cols.append(f"{v} - lag({v}) OVER s AS {c}_delta")
        for n in windows:
            f = f"(s ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
            cols.append(f"CASE WHEN count({v}) OVER {f} >= 2 THEN avg({v}) OVER {f} END AS {c}_roll{n}_mean")
            cols.append(f"CASE WHEN count({v}) OVER {f} >= 2 THEN stddev_samp({v}) OVER {f} END AS {c}_roll{n}_std")
    cols.append(f"{hours('timestamp', 'lag(timestamp) OVER s')} AS time_since_prev_obs")
    cols.append(f"coalesce({hours('timestamp', 'lag(timestamp) OVER s')} > 1, false) AS qf_temporal_gap")
    cols += [
        "hour(timestamp)::INT AS hour", "(isodow(timestamp) - 1)::INT AS day_of_week",
        "dayofyear(timestamp)::INT AS day_of_year", "month(timestamp)::INT AS month",
        "count(*) OVER (PARTITION BY station_id, timestamp) > 1 AS qf_duplicate_ts",
    ]
    return f"SELECT *, {', '.join(cols)} FROM {source} WINDOW s AS ({W})"


def _baseline_sql(train: str) -> str:
    med = ", ".join(f"quantile_cont({c}_clean, 0.5) AS {c}_median" for c in SENSORS)
    mad = ", ".join(f"greatest(quantile_cont(abs({c}_clean - {c}_median), 0.5), 1e-6::DOUBLE) AS {c}_mad" for c in SENSORS)
    keep = ", ".join(f"any_value({c}_median) AS {c}_median" for c in SENSORS)
    return (
        f"med AS (SELECT station_id, hour(timestamp)::INT AS hour, {med} FROM {train} GROUP BY ALL), "
        f"base AS (SELECT station_id, hour, {keep}, {mad} FROM {train} t JOIN med m "
        "USING (station_id) WHERE hour(t.timestamp) = m.hour GROUP BY station_id, hour)"
    )


def _rules_sql(source: str) -> str:
    h, p = "relative_humidity_pct_clean", "pressure_hpa_clean"
    return (
        f"spike_med AS (SELECT station_id, quantile_cont({p}, 0.5) AS md, stddev_pop({p}) AS sg FROM {source} GROUP BY 1), "
        f"spike_stat AS (SELECT f.station_id, any_value(md) AS md, any_value(sg) AS sg, quantile_cont(abs({p} - md), 0.5) * 1.4826::DOUBLE AS sc "
        f"FROM {source} f JOIN spike_med USING (station_id) GROUP BY 1), "
        f"ruled1 AS (SELECT f.*, abs({p} - md) / nullif(CASE WHEN sc < 1e-6 THEN CASE WHEN sg < 1e-6 THEN 0 ELSE sg END ELSE sc END, 0) AS z, "
        f"CASE WHEN count(*) OVER (s ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AND "
        f"var_pop({h}) OVER (s ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) < 0.01 THEN 1 ELSE 0 END AS still, "
        f"CASE WHEN abs(temperature_c_robust_z) > 2 THEN 1 ELSE 0 END AS high, "
        f"row_number() OVER s AS rn FROM {source} f JOIN spike_stat USING (station_id) WINDOW s AS ({W})), "
        f"ruled2 AS (SELECT *, max(still) OVER (s ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) = 1 AS rule_freeze, "
        "coalesce(z > 4 AND lag(z) OVER s < 4 AND lead(z) OVER s < 4, false) AS rule_spike, "
        f"rn - row_number() OVER (PARTITION BY station_id, high ORDER BY timestamp, seq) AS isl FROM ruled1 WINDOW s AS ({W})), "
        "ruled AS (SELECT *, high = 1 AND count(*) OVER (PARTITION BY station_id, high, isl) >= 5 AS rule_drift, "
        "coalesce(time_since_prev_obs > 3, false) AS rule_communication, "
        "rule_freeze OR rule_spike OR rule_drift OR rule_communication AS rule_any_fault, "
        "CASE WHEN rule_spike THEN 'SPIKE' WHEN rule_freeze THEN 'FREEZE' WHEN rule_drift THEN 'DRIFT' "
        "WHEN rule_communication THEN 'COMMUNICATION_FAILURE' ELSE 'UNKNOWN' END AS inferred_fault FROM ruled2)"
    )


def _based_sql(source: str) -> str:
    cols = ", ".join(
        f"{c}_median AS {c}_baseline, {c}_clean - {c}_median AS {c}_deviation, ({c}_clean - {c}_median) / {c}_mad AS {c}_robust_z"
        for c in SENSORS
    )
    return f"SELECT f.*, {cols} FROM {source} f LEFT JOIN base b ON f.station_id = b.station_id AND hour(f.timestamp) = b.hour"


PAIRS = (
    "coords AS (SELECT station_id, arg_min(latitude, (timestamp, seq)) AS latitude, arg_min(longitude, (timestamp, seq)) AS longitude "
    "FROM grid GROUP BY 1), "
    "pairs AS (SELECT a.station_id, b.station_id AS neighbour_id, 2 * 6371.0::DOUBLE * asin(sqrt("
    "pow(sin(radians(b.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * "
    "pow(sin(radians(b.longitude - a.longitude) / 2), 2))) AS distance_km FROM coords a JOIN coords b ON a.station_id <> b.station_id), "
    # Distances that differ only in the last bits count as ties, which go by id.
    "knn AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY round(distance_km, 7), neighbour_id) AS rank FROM pairs "
    "QUALIFY rank <= 2)"
)


def _spatial_sql(source: str) -> str:
    stats = ", ".join(
        f"avg(n.{c}_clean) AS neighbor_{c}_mean, coalesce(stddev_samp(n.{c}_clean), 0) AS neighbor_{c}_std" for c in SENSORS
    )
    cols = ", ".join(
        f"neighbor_{c}_mean, coalesce(neighbor_{c}_std, 0) AS neighbor_{c}_std, {c}_clean - neighbor_{c}_mean AS spatial_{c}_residual"
        for c in SENSORS
    )
    total = " + ".join(f"coalesce(abs(spatial_{c}_residual), 0)" for c in SENSORS)
    present = " + ".join(f"(spatial_{c}_residual IS NOT NULL)::INT" for c in SENSORS)
    return (
        f"nstat AS (SELECT f.station_id, f.timestamp, {stats} FROM {source} f JOIN knn k ON k.station_id = f.station_id "
        f"JOIN {source} n ON n.station_id = k.neighbour_id AND n.timestamp = f.timestamp GROUP BY 1, 2), "
        f"near AS (SELECT f.*, k.distance_km AS nearest_station_distance_km, {cols} FROM {source} f "
        "JOIN knn k ON k.station_id = f.station_id AND k.rank = 1 LEFT JOIN nstat n ON n.station_id = f.station_id AND n.timestamp = f.timestamp), "
        f"feat AS (SELECT *, CASE WHEN ({present}) > 0 THEN ({total}) / ({present}) END AS neighbor_agreement_score FROM near)"
    )


TEMPORAL = f"{CLEAN}, temporal AS ({_temporal_sql('cleaned')})"
TRAIN = f"{CLEAN}, {SPLIT}, train AS (SELECT * FROM cleaned, cut WHERE timestamp < v)"
BASELINE = f"{TRAIN}, {_baseline_sql('train')}"
BASED = f"{BASELINE}, based AS ({_based_sql('cleaned')})"
FEATURES = (
    f"{BASELINE}, temporal AS ({_temporal_sql('cleaned')}), based AS ({_based_sql('temporal')}), "
    f"{_rules_sql('based')}, {PAIRS}, {_spatial_sql('ruled')}"
)
