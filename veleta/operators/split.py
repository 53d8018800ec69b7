"""Chronological split on distinct timestamps."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veleta.operators.filters import time_literal
from veleta.operators.order_stats import values_at_ranks
from veleta.operators.series import micros


@dataclass(frozen=True)
class SplitBounds:
    """First timestamp of validation and of test; None when that part is empty."""

    val_from: dt.datetime | None
    test_from: dt.datetime | None


def split_bounds(df: DataFrame, train: float = 0.60, val: float = 0.20) -> SplitBounds:
    """Two ranks among the distinct timestamps, found without sorting them in one task."""
    n = df.agg(F.countDistinct("timestamp")).first()[0]
    first_val = int(n * train)
    first_test = first_val + int(n * val)
    return SplitBounds(*values_at_ranks(df, "timestamp", micros(F.col("timestamp")), [first_val, first_test]))


def split_chrono(df: DataFrame, bounds: SplitBounds | None = None, train: float = 0.60, val: float = 0.20) -> DataFrame:
    """Label rows train / val / test; all stations of a timestamp stay together."""
    bounds = bounds or split_bounds(df, train, val)
    ts = F.col("timestamp")
    label = F.lit("train")
    if bounds.val_from is not None:
        label = F.when(ts < time_literal(bounds.val_from), "train").otherwise("val")
    if bounds.test_from is not None:
        label = F.when(ts >= time_literal(bounds.test_from), "test").otherwise(label)
    return df.withColumn("split", label)


def split_report(df: DataFrame) -> DataFrame:
    """Rows, span and label counts of each split."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"),
        *[
            F.count_if(F.col("ground_truth_label") == c).alias(f"n_{c.lower()}")
            for c in ("NORMAL", "SENSOR_FAULT", "GENUINE_EXTREME")
        ],
    )
