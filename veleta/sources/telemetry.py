"""Station telemetry view over the ``events`` table (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEW = """
SELECT
  concat('AWS_', lpad(cast(user_id % 30 AS STRING), 2, '0'))        AS station_id,
  cast(user_id % 30 AS INT)                                         AS station_no,
  ts                                                                AS timestamp,
  event_id                                                          AS seq,
  8.0D + (user_id % 30 % 6) * 4.5D                                  AS latitude,
  70.0D + floor((user_id % 30) / 6D) * 5.0D                         AS longitude,
  CASE WHEN event_id % 23 = 0 THEN NULL
       ELSE 18.0D + (value - 12.0D * floor(value / 12.0D))
          + CASE WHEN user_id % 30 % 5 = 2 AND day(ts) BETWEEN 20 AND 24 THEN 25.0D ELSE 0.0D END
          + CASE WHEN event_id % 211 = 0 THEN 45.0D ELSE 0.0D END
  END                                                               AS temperature_c,
  CASE WHEN event_id % 29 = 0 THEN NULL
       WHEN user_id % 30 % 4 = 1 AND day(ts) IN (3, 13) THEN 62.4D
       ELSE 20.0D + (user_id * 7 + event_id * 13) % 80 END          AS relative_humidity_pct,
  CASE WHEN event_type = 'error' AND event_id % 50 = 0 THEN 650.0D
       ELSE 995.0D + (event_id % 200) / 10.0D END                   AS pressure_hpa,
  cast(get_json_object(props,'$.k') AS DOUBLE) * 0.5D
       + CASE WHEN event_id % 307 = 0 THEN 160.0D ELSE 0.0D END     AS wind_speed_kmh,
  CASE WHEN event_type = 'purchase' THEN value / 4.0D ELSE 0.0D END AS rainfall_mm,
  CASE WHEN event_type = 'error' THEN 'SENSOR_FAULT'
       WHEN event_type = 'purchase' AND value > 60 THEN 'GENUINE_EXTREME'
       ELSE 'NORMAL' END                                            AS ground_truth_label,
  CASE WHEN event_type <> 'error' THEN 'None'
       WHEN event_id % 4 = 0 THEN 'Temperature Sensor Drift / Calibration Loss'
       WHEN event_id % 4 = 1 THEN 'Humidity Sensor Freeze (Zero variance)'
       WHEN event_id % 4 = 2 THEN 'Barometric Sensor Single-Point Noise Spike'
       ELSE 'Communication dropout' END                             AS fault_description
FROM {events}
"""


def from_events(events: DataFrame) -> DataFrame:
    """Telemetry rows derived from an ``events`` frame (batch or stream)."""
    return events.sparkSession.sql(VIEW, events=events)


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows on full hours: stations become co-temporal and keys repeat."""
    return telemetry(spark, sf_dir).withColumn("timestamp", F.date_trunc("hour", "timestamp").cast("timestamp_ntz"))
