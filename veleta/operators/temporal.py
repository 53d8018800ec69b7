"""Backward-looking features of a station's own series.

All features share one window order, so one exchange and one sort serve every sensor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veleta.operators.series import SeriesLayout, micros, present_sensors, source_column

LAGS = (1, 2, 3)
WINDOWS = (3, 6)
RETRAIN_WINDOWS = (3, 6, 12, 24)


def add_temporal_features(
    df: DataFrame,
    layout: SeriesLayout | None = None,
    lags: Sequence[int] = LAGS,
    windows: Sequence[int] = WINDOWS,
    sensors: Sequence[str] | None = None,
) -> DataFrame:
    layout = layout or SeriesLayout.measure(df)
    names = present_sensors(df, sensors)
    source = {s: F.col(source_column(df, s)) for s in names}

    def windowed(rows: DataFrame) -> DataFrame:
        w = layout.window()
        features: dict[str, Column] = {}
        for s, value in source.items():
            for k in lags:
                features[f"{s}_lag{k}"] = F.lag(value, k).over(w)
            features[f"{s}_delta"] = value - F.lag(value, 1).over(w)
            for n in windows:
                frame = w.rowsBetween(-n, -1)
                enough = F.count(value).over(frame) >= 2
                features[f"{s}_roll{n}_mean"] = F.when(enough, F.avg(value).over(frame))
                features[f"{s}_roll{n}_std"] = F.when(enough, F.stddev_samp(value).over(frame))
        previous = F.lag("timestamp").over(w)
        features["time_since_prev_obs"] = (micros(F.col("timestamp")) - micros(previous)) / F.lit(3.6e9)
        return rows.withColumns(features)

    out = layout.run(df, windowed, before=max([*lags, *windows, 1]))
    widest = max(windows)
    zscores = {
        f"{s}_roll_zscore": (value - F.col(f"{s}_roll{widest}_mean"))
        / F.nullif(F.col(f"{s}_roll{widest}_std"), F.lit(0.0))
        for s, value in source.items()
    }
    return add_calendar(out.withColumns(zscores))


def add_calendar(df: DataFrame) -> DataFrame:
    ts = F.col("timestamp")
    return df.withColumns(
        {
            "hour": F.hour(ts),
            "day_of_week": F.weekday(ts),
            "day_of_year": F.dayofyear(ts),
            "month": F.month(ts),
        }
    )
