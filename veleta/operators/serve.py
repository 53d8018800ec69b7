"""Serving queries over stored observations and predictions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veleta.operators.audit import DAY_US
from veleta.operators.filters import filter_time_station
from veleta.operators.series import ORDER, STATION, micros

# Dashboard categories.
CATEGORIES = {
    "prediction": ["NORMAL", "SENSOR_FAULT", "GENUINE_EXTREME"],
    "fault_type": ["DRIFT", "FREEZE", "SPIKE", "NONE"],
    "severity": ["LOW", "MEDIUM", "HIGH", "CRITICAL"],
}


def store_status(df: DataFrame) -> DataFrame:
    per_station = df.groupBy(STATION).agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"),
        *([F.max("ingested_at").alias("sync")] if "ingested_at" in df.columns else []),
    )
    days = F.floor((F.max(micros(F.col("hi"))) - F.min(micros(F.col("lo")))) / F.lit(DAY_US))
    return per_station.agg(
        (F.count(F.lit(1)) > 0).alias("available"),
        F.count(F.lit(1)).alias("stations"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"),
        F.min("lo").alias("oldest_observation"),
        F.max("hi").alias("latest_observation"),
        F.coalesce(F.round(days / 365.25, 2), F.lit(0.0)).alias("years_available"),
        *([F.max("sync").alias("last_sync")] if "ingested_at" in df.columns else []),
    )


def station_registry(df: DataFrame) -> DataFrame:
    """Lifecycle bounds and record counts per station, ordered by station."""
    return (
        df.groupBy(STATION)
        .agg(
            F.min_by(F.struct("latitude", "longitude"), F.struct(*ORDER)).alias("_at"),
            F.min("timestamp").alias("oldest_timestamp"),
            F.max("timestamp").alias("latest_timestamp"),
            F.count(F.lit(1)).alias("records"),
        )
        .select(STATION, "_at.latitude", "_at.longitude", "oldest_timestamp", "latest_timestamp", "records")
        .orderBy(STATION)
    )


def latest_per_station(df: DataFrame) -> DataFrame:
    """Newest row of every station; map-side combined, one row per station is shuffled."""
    payload = [c for c in df.columns if c != STATION]
    newest = F.max_by(F.struct(*payload), F.struct(*ORDER))
    return df.groupBy(STATION).agg(newest.alias("_r")).select(STATION, *[f"_r.{c}" for c in payload])


def anomaly_feed(latest: DataFrame) -> DataFrame:
    """Rows that are not normal."""
    return latest.filter(F.col("prediction") != "NORMAL")


def anomaly_totals(latest: DataFrame) -> DataFrame:
    return latest.agg(
        F.count_if(F.col("prediction") != "NORMAL").alias("total"),
        F.count_if(F.col("prediction") == "SENSOR_FAULT").alias("sensor_faults"),
        F.count_if(F.col("prediction") == "GENUINE_EXTREME").alias("genuine_events"),
    )


def dash_kpis(latest: DataFrame) -> DataFrame:
    odd = F.count_if(F.col("prediction") != "NORMAL")
    rate = F.when(F.count(F.lit(1)) > 0, F.floor(odd * 100.0 / F.count(F.lit(1)) + 0.5)).otherwise(0)

    def alerts(level: str) -> Column:
        return F.count_if((F.col("prediction") != "NORMAL") & (F.col("severity") == level))

    return latest.agg(
        F.count_if(F.col("prediction") == "NORMAL").alias("healthy"),
        rate.cast("int").alias("anomaly_rate_pct"),
        alerts("HIGH").alias("high"),
        alerts("CRITICAL").alias("critical"),
    )


def dash_distributions(predictions: DataFrame) -> DataFrame:
    """Counts over fixed categories; only severity keeps categories without rows."""
    row = predictions.agg(
        *[
            F.count_if(F.col(kind) == name).alias(f"{kind}__{name}")
            for kind, names in CATEGORIES.items()
            for name in names
        ]
    )
    entries = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.col(f"{kind}__{name}").alias("n"))
            for kind, names in CATEGORIES.items()
            for name in names
        ]
    )
    long = row.select(F.explode(entries).alias("_e")).select("_e.*")
    return long.filter((F.col("n") > 0) | (F.col("kind") == "severity"))


def with_position(df: DataFrame) -> DataFrame:
    """Add the 0-based ``position`` in the station's order and its ``total``.

    Rows are numbered inside calendar days and shifted by the count of earlier days, so a long
    series is numbered in many tasks.
    """
    daily = df.withColumn("_day", F.to_date("timestamp"))
    days = Window.partitionBy(STATION).orderBy("_day")
    whole = Window.partitionBy(STATION)
    sizes = (
        daily.groupBy(STATION, "_day")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            STATION,
            "_day",
            (F.sum("_n").over(days) - F.col("_n")).alias("_off"),
            F.sum("_n").over(whole).alias("total"),
        )
    )
    inside = Window.partitionBy(STATION, "_day").orderBy(*ORDER)
    return (
        daily.join(sizes, [STATION, "_day"])
        .withColumn("position", F.col("_off") + F.row_number().over(inside) - 1)
        .drop("_day", "_off")
    )


def adaptive_history(
    df: DataFrame, max_points: int = 200, station: str | None = None,
    start: str | dt.datetime | None = None, end: str | dt.datetime | None = None,
) -> DataFrame:
    """Evenly thinned points of every station plus its last row."""
    rows = with_position(filter_time_station(df, station, start, end))
    step = F.greatest(F.lit(1), F.floor(F.col("total") / max_points))
    keep = (
        (F.col("total") <= max_points)
        | (F.col("position") % step == 0)
        | (F.col("position") == F.col("total") - 1)
    )
    return rows.filter(keep)


def adaptive_summary(df: DataFrame, max_points: int = 200) -> DataFrame:
    """Total, displayed points, anomalies of all rows and latest time per station.

    The number of displayed points follows from the total, so no row is numbered.
    """
    total = F.col("total")
    step = F.greatest(F.lit(1), F.floor(total / max_points))
    sampled = F.floor((total - 1) / step) + 1 + F.when((total - 1) % step != 0, 1).otherwise(0)
    return (
        df.groupBy(STATION)
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.coalesce(F.col("ground_truth_label") != "NORMAL", F.lit(False))).alias("anomalies"),
            F.max("timestamp").alias("latest"),
        )
        .select(
            STATION, "total", F.when(total <= max_points, total).otherwise(sampled).alias("displayed"),
            "anomalies", "latest",
        )
    )
