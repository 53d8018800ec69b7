"""Labels from rules and scores for tables without (enough) ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veleta.functions.texts import flag, holds, optional

ENOUGH_LABELS = 10


def has_labels(df: DataFrame) -> bool:
    """More than ten labelled rows; reads no further than the eleventh."""
    if "ground_truth_label" not in df.columns:
        return False
    return df.filter(F.col("ground_truth_label").isNotNull()).limit(ENOUGH_LABELS + 1).count() > ENOUGH_LABELS


def silver_labels_a(df: DataFrame) -> DataFrame:
    """Rules, then extremes that neighbours do not contradict, then strong scores."""
    freeze, spike, drift, comm = (
        flag(df, c) for c in ("rule_freeze", "rule_spike", "rule_drift", "rule_communication")
    )
    score = F.coalesce(optional(df, "combined_anomaly_score"), F.lit(0.0))
    checks = F.coalesce(optional(df, "statistical_anomaly_score"), F.lit(0.0))
    apart = optional(df, "neighbor_agreement_score")
    extreme = holds(optional(df, "wind_speed_kmh") > 55.0) | holds(optional(df, "rainfall_mm") > 40.0) | (score > 0.6)
    rule = freeze | spike | drift | comm
    weather = extreme & (apart.isNull() | (apart < 10.0))
    strong = (score > 0.65) & (checks > 0.4)
    return df.withColumns(
        {
            "ground_truth_label": F.when(rule, "SENSOR_FAULT")
            .when(weather, "GENUINE_EXTREME")
            .when(strong, "SENSOR_FAULT")
            .otherwise("NORMAL"),
            "fault_description": F.when(freeze, "FREEZE")
            .when(spike, "SPIKE")
            .when(drift, "DRIFT")
            .when(comm, "COMMUNICATION_FAILURE")
            .when(~weather & strong, "DRIFT")
            .otherwise("None"),
        }
    )


def silver_labels_b(df: DataFrame) -> DataFrame:
    """Retraining variant: rules, strong scores as faults, high scores as extremes."""
    score = F.coalesce(optional(df, "combined_anomaly_score"), F.lit(0.0))
    checks = F.coalesce(optional(df, "statistical_anomaly_score"), F.lit(0.0))
    rule = flag(df, "rule_freeze") | flag(df, "rule_spike") | flag(df, "rule_drift") | flag(df, "rule_communication")
    label = (
        F.when(rule | ((score > 0.65) & (checks > 0.4)), "SENSOR_FAULT")
        .when(score > 0.55, "GENUINE_EXTREME")
        .otherwise("NORMAL")
    )
    return df.withColumn("ground_truth_label", label)
