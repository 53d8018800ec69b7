"""Station health: one aggregate per station."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veleta.fixed_values import HEALTH_STATUS, HEALTH_WEIGHTS, SENSORS
from veleta.functions.texts import clip, holds
from veleta.operators.series import STATION


def health_scores(df: DataFrame, weights: dict[str, float] = HEALTH_WEIGHTS) -> DataFrame:
    cols = df.columns

    def rate(condition):
        return F.avg(holds(condition).cast("double"))

    if "ground_truth_label" in cols:
        fault = rate(F.col("ground_truth_label") == "SENSOR_FAULT")
    else:
        fault = rate(F.col("rule_any_fault")) if "rule_any_fault" in cols else F.lit(0.0)
    sensors = [c for c in SENSORS if c in cols]
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in sensors]) if sensors else F.lit(False)

    def sized(column: str, scale: float, size):
        if column not in cols:
            return F.lit(0.0)
        return clip(F.coalesce(F.avg(size(F.col(column))) / scale, F.lit(0.0)), 0.0, 1.0)

    components = {
        "fault_rate": fault,
        "anomaly_rate": rate(F.col("combined_anomaly_score") > 0.5) if "combined_anomaly_score" in cols else F.lit(0.0),
        "missing_rate": rate(missing),
        "residual_score": sized("temperature_c_residual", 10.0, F.abs),
        "noise_score": sized("temperature_c_roll3_std", 5.0, lambda c: c),
    }
    per_station = df.groupBy(STATION).agg(
        *[c.alias(n) for n, c in components.items()], F.count(F.lit(1)).alias("observations")
    )
    penalty = reduce(lambda a, b: a + b, [F.col(n) * w for n, w in weights.items()])
    score = F.bround(clip((F.lit(1.0) - penalty) * 100.0, 0.0, 100.0), 1)
    scored = per_station.withColumn("health_score", score)
    status = F.coalesce(
        *[F.when(F.col("health_score") >= limit, F.lit(name)) for name, limit in HEALTH_STATUS], F.lit("CRITICAL")
    )
    return scored.withColumn("status", status).withColumns({n: F.bround(n, 4) for n in components})


def join_health(df: DataFrame, health: DataFrame, small_network: bool = False) -> DataFrame:
    """Health of the row's station; unknown stations count as 100 / HEALTHY."""
    side = health.select(
        STATION, F.col("health_score").alias("sensor_health"), F.col("status").alias("sensor_health_status")
    )
    return df.join(F.broadcast(side) if small_network else side, STATION, "left").fillna(
        {"sensor_health": 100.0, "sensor_health_status": "HEALTHY"}
    )
