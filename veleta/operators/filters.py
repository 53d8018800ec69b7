"""Filters, limits and presets over observations."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veleta.fixed_values import REQUEST_BOUNDS

PRESET_DAYS = {"24H": 1, "7D": 7, "30D": 30, "3M": 90, "1Y": 365, "5Y": 1825, "10Y": 3650, "ALL": None}


def time_literal(value: str | dt.datetime) -> Column:
    return F.lit(str(value)).cast("timestamp_ntz")


def filter_time_station(
    df: DataFrame,
    stations: Sequence[str] | str | None = None,
    start: str | dt.datetime | None = None,
    end: str | dt.datetime | None = None,
) -> DataFrame:
    """Conjunction of the given conditions; both time bounds are inclusive."""
    if stations:
        names = [stations] if isinstance(stations, str) else list(stations)
        df = df.filter(F.col("station_id").isin(names))
    if start is not None:
        df = df.filter(F.col("timestamp") >= time_literal(start))
    if end is not None:
        df = df.filter(F.col("timestamp") <= time_literal(end))
    return df


def history_limit(df: DataFrame, station: str, limit: int, start=None, end=None) -> DataFrame:
    """The oldest ``limit`` observations of one station."""
    return filter_time_station(df, station, start, end).orderBy("timestamp", "seq").limit(limit)


def history_recent(df: DataFrame, limit: int = 100) -> DataFrame:
    """The newest ``limit`` observations of every station (pruned before the shuffle)."""
    newest = Window.partitionBy("station_id").orderBy(F.col("timestamp").desc(), F.col("seq").desc())
    return df.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= limit).drop("_rn")


def range_preset(df: DataFrame, preset: str, anchor: str | dt.datetime) -> DataFrame:
    days = PRESET_DAYS[preset]
    if days is None:
        return df
    return df.filter(F.col("timestamp") >= time_literal(anchor) - F.expr(f"INTERVAL {days} DAYS"))


def union_splits(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def distinct_values(df: DataFrame) -> DataFrame:
    return df.agg(
        F.countDistinct("timestamp").alias("timestamps"), F.countDistinct("station_id").alias("stations")
    )


def station_search(df: DataFrame, text: str, status: str = "ALL") -> DataFrame:
    """Case-insensitive substring of id or name, and ALL / NORMAL / ANOMALY."""
    needle = text.lower()
    hit = F.lower("station_id").contains(needle) | F.coalesce(
        F.lower("station_name").contains(needle), F.lit(False)
    )
    df = df.filter(hit)
    if status == "NORMAL":
        return df.filter(F.col("prediction") == "NORMAL")
    if status == "ANOMALY":
        return df.filter(F.col("prediction") != "NORMAL")
    return df


def alert_filter(df: DataFrame, choice: str = "ALL") -> DataFrame:
    if choice == "ALL":
        return df
    if choice in ("HIGH", "CRITICAL"):
        return df.filter(F.col("severity") == choice)
    if choice == "ANOMALOUS":
        return df.filter(F.col("prediction") != "NORMAL")
    return df.filter(F.col("prediction") == choice)


def in_request_bounds() -> Column:
    ok = F.lit(True)
    for column, (low, high) in REQUEST_BOUNDS.items():
        ok = ok & F.coalesce(F.col(column).between(low, high), F.lit(False))
    return ok


def filter_request_bounds(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows inside the accepted ranges, and the quarantined rest."""
    return df.filter(in_request_bounds()), df.filter(~in_request_bounds())
