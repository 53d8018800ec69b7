"""Sensor fault diagnosis from rules, checks, residuals and baseline deviations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veleta import fixed_values as V
from veleta.functions.texts import flag, gathered, holds, optional, said, staged


def severe_weather(df: DataFrame) -> Column:
    rain = F.coalesce(optional(df, "rainfall_mm"), F.lit(0.0))
    wind = F.coalesce(optional(df, "wind_speed_kmh"), F.lit(0.0))
    temp = F.coalesce(optional(df, "temperature_c"), F.lit(25.0))
    rh = F.coalesce(optional(df, "relative_humidity_pct"), F.lit(50.0))
    return (
        ((rain >= 10.0) & (rh >= 70.0))
        | (wind >= 35.0)
        | ((temp >= 40.0) & (rh <= 55.0))
        | ((temp <= 8.0) & (temp >= -20.0))
    )


def fault_evidence(df: DataFrame, is_anomaly: Column | None = None) -> DataFrame:
    """``fault_type``, ``fault_confidence`` and ``fault_evidence`` of every row.

    Rules come first in their order of priority, then a severe check violation that severe
    weather does not explain. Rows that are not anomalous get NONE and no evidence.
    """
    anomalous = F.lit(True) if is_anomaly is None else holds(is_anomaly)
    spike, freeze, drift, comm = (
        flag(df, c) for c in ("rule_spike", "rule_freeze", "rule_drift", "rule_communication")
    )
    score = F.coalesce(optional(df, "statistical_anomaly_score"), F.lit(0.0))
    temp_residual, pressure_residual = (
        optional(df, "temperature_c_residual"),
        optional(df, "pressure_hpa_residual"),
    )
    temp_z, rh_z = optional(df, "temperature_c_robust_z"), optional(df, "relative_humidity_pct_robust_z")
    gap = optional(df, "time_since_prev_obs")
    cause = (
        F.when(~anomalous, "quiet")
        .when(spike, "spike")
        .when(freeze, "freeze")
        .when(drift, "drift")
        .when(comm, "comm")
        .when((score >= 0.50) & ~severe_weather(df), "check")
        .otherwise("none")
    )
    df = staged(df.withColumn("_cause", cause), "cause")
    why = F.col("_cause")
    faulty = ~why.isin("quiet", "none")
    kind = (
        F.when(why == "spike", "SPIKE")
        .when(why == "freeze", "FREEZE")
        .when(why.isin("drift", "check"), "DRIFT")
        .when(why == "comm", "COMMUNICATION_FAILURE")
        .otherwise("NONE")
    )
    confidence = (
        F.when(why == "spike", 0.95)
        .when(why == "freeze", 0.92)
        .when(why == "drift", 0.88)
        .when(why == "comm", 0.85)
        .when(why == "check", 0.80)
        .otherwise(0.0)
    )
    # The freeze text on relative humidity already speaks of humidity.
    humidity_told = (why == "freeze") & rh_z.isNotNull()
    texts = gathered(
        said(why == "spike", V.TEXT_SPIKE),
        said((why == "spike") & pressure_residual.isNotNull(), V.TEXT_SPIKE_RESIDUAL, pressure_residual),
        said(why == "freeze", V.TEXT_FREEZE),
        said(humidity_told, V.TEXT_FREEZE_Z),
        said(why == "drift", V.TEXT_DRIFT),
        said((why == "drift") & (F.abs(temp_residual) > 1.5), V.TEXT_DRIFT_RESIDUAL, temp_residual),
        said(why == "comm", V.TEXT_COMM, gap),
        said(why == "check", V.TEXT_QC_FAULT, score),
        said(why == "none", V.TEXT_NO_FAULT),
        said(faulty & (F.abs(temp_z) > 2.5), V.TEXT_TEMP_Z, temp_z),
        said(faulty & ~humidity_told & (F.abs(rh_z) > 2.5), V.TEXT_RH_Z, rh_z),
    )
    return df.withColumns(
        {"fault_type": kind, "fault_confidence": confidence, "fault_evidence": texts}
    ).drop("_cause")
