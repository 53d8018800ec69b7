"""De-duplication on (station, timestamp).

A ranked filter with limit 1: Spark prunes each partition to one row per key before the
shuffle, so a key that is repeated a billion times costs one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("station_id", "timestamp")


def dedup_first(df: DataFrame, key: Sequence[str] = KEY, order: Sequence[str] = ("seq",)) -> DataFrame:
    return _keep_one(df, key, [F.col(c).asc() for c in order])


def dedup_last(df: DataFrame, key: Sequence[str] = KEY, order: Sequence[str] = ("seq",)) -> DataFrame:
    return _keep_one(df, key, [F.col(c).desc() for c in order])


def _keep_one(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def duplicate_keys(df: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Keys that occur more than once, with the number of copies (map-side counted)."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)
