"""Station × hour baselines: median and MAD, fitted on training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veleta.operators.order_stats import quantiles
from veleta.operators.series import STATION, SeriesLayout, present_sensors, source_column

MAD_FLOOR = 1e-6
GROUP = [STATION, "hour"]


def baseline_fit(
    train: DataFrame, layout: SeriesLayout | None = None, sensors: Sequence[str] | None = None
) -> DataFrame:
    """One row per station and hour with ``<c>_median`` and ``<c>_mad``."""
    layout = layout or SeriesLayout.measure(train)
    names = present_sensors(train, sensors)
    rows = train.select(
        STATION,
        F.hour("timestamp").alias("hour"),
        *[F.col(source_column(train, s)).alias(s) for s in names],
    )
    medians = quantiles(rows, GROUP, names, [0.5], layout.small_groups).select(
        *GROUP, *[F.col(f"{s}_q0").alias(f"{s}_median") for s in names]
    )
    # At most 24 rows per station.
    build = F.broadcast(medians) if layout.small_baselines else medians
    deviations = rows.join(build, GROUP).select(
        *GROUP, *[F.abs(F.col(s) - F.col(f"{s}_median")).alias(s) for s in names]
    )
    mads = quantiles(deviations, GROUP, names, [0.5], layout.small_groups).select(
        *GROUP, *[F.greatest(F.col(f"{s}_q0"), F.lit(MAD_FLOOR)).alias(f"{s}_mad") for s in names]
    )
    return medians.join(mads, GROUP)


def join_baseline(df: DataFrame, baselines: DataFrame, small: bool = False) -> DataFrame:
    """Left lookup on (station, hour); unknown stations keep nulls."""
    if "hour" not in df.columns:
        df = df.withColumn("hour", F.hour("timestamp"))
    return df.join(F.broadcast(baselines) if small else baselines, GROUP, "left")


def baseline_apply(
    df: DataFrame, baselines: DataFrame, sensors: Sequence[str] | None = None, small: bool = False
) -> DataFrame:
    names = present_sensors(df, sensors)
    joined = join_baseline(df, baselines, small)
    out = {}
    for s in names:
        deviation = F.col(source_column(df, s)) - F.col(f"{s}_median")
        out[f"{s}_baseline"] = F.col(f"{s}_median")
        out[f"{s}_deviation"] = deviation
        out[f"{s}_robust_z"] = deviation / F.col(f"{s}_mad")
    drop = [f"{s}_{k}" for s in names for k in ("median", "mad")]
    return joined.withColumns(out).drop(*drop)
