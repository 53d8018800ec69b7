"""Quality flags, imputation and clipping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veleta.fixed_values import PHYSICAL_BOUNDS, SENSORS
from veleta.operators.dedup import KEY, duplicate_keys
from veleta.operators.order_stats import SMALL_GROUP_ROWS, quantiles
from veleta.operators.series import CHUNK, ORDER, STATION, SeriesLayout, micros

GAP_HOURS = 1.0


def true_or_false(predicate: Column) -> Column:
    """A missing operand makes a flag false, never null."""
    return F.coalesce(predicate, F.lit(False))


def outside(column: str, bounds: tuple[float, float]) -> Column:
    return true_or_false((F.col(column) < bounds[0]) | (F.col(column) > bounds[1]))


def flag_missing(df: DataFrame) -> DataFrame:
    return df.withColumns({f"qf_missing_{c}": F.col(c).isNull() for c in SENSORS if c in df.columns})


def flag_physical(df: DataFrame, bounds: dict = PHYSICAL_BOUNDS) -> DataFrame:
    return df.withColumns({f"qf_physical_{c}": outside(c, b) for c, b in bounds.items() if c in df.columns})


def flag_duplicate_ts(df: DataFrame) -> DataFrame:
    """Every member of a repeated key.

    Keys are counted map-side and joined back, so a key with a third of all rows becomes one
    build row; the probe side of that join is what adaptive execution may split.
    """
    repeated = duplicate_keys(df).select(*KEY, F.lit(True).alias("_dup"))
    return (
        df.join(repeated, list(KEY), "left")
        .withColumn("qf_duplicate_ts", true_or_false(F.col("_dup")))
        .drop("_dup")
    )


def flag_adjacent_duplicates(df: DataFrame, layout: SeriesLayout) -> DataFrame:
    """The same flag inside a station window that is needed anyway: copies are adjacent."""

    def flag(rows: DataFrame) -> DataFrame:
        w, ts = layout.window(), F.col("timestamp")
        return rows.withColumn(
            "qf_duplicate_ts",
            true_or_false(F.lag(ts).over(w) == ts) | true_or_false(F.lead(ts).over(w) == ts),
        )

    return layout.run(df, flag, before=1, after=1)


def flag_temporal_gap(df: DataFrame, layout: SeriesLayout | None = None, hours: float = GAP_HOURS) -> DataFrame:
    layout = layout or SeriesLayout.measure(df)

    def flag(rows: DataFrame) -> DataFrame:
        previous = F.lag("timestamp").over(layout.window())
        gap = micros(F.col("timestamp")) - micros(previous) > F.lit(int(hours * 3_600_000_000))
        return rows.withColumn("qf_temporal_gap", true_or_false(gap))

    return layout.run(df, flag, before=1)


def add_quality_flags(df: DataFrame, layout: SeriesLayout | None = None) -> DataFrame:
    return flag_temporal_gap(flag_duplicate_ts(flag_physical(flag_missing(df))), layout)


def impute(df: DataFrame, layout: SeriesLayout | None = None) -> DataFrame:
    """``<c>_clean``: last known value, else the station's first, else 0 (rain) or the median.

    Backward filling only ever reaches rows before the first value of a station, so it is that
    first value: both window frames are linear in the length of the series.
    """
    layout = layout or SeriesLayout.measure(df)
    sensors = [c for c in SENSORS if c in df.columns]
    window = layout.window()
    so_far = window.rowsBetween(Window.unboundedPreceding, 0)
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if layout.hot:
        carried = _carried(df, layout, sensors)
        opened = layout.with_chunk(df).join(carried, [STATION, CHUNK], "left")
        filled = opened.withColumns(
            {
                f"{c}_clean": F.coalesce(
                    F.last(c, ignorenulls=True).over(so_far),
                    F.col(f"_before_{c}"),
                    F.col(f"_first_{c}"),
                    F.first(c, ignorenulls=True).over(whole),
                )
                for c in sensors
            }
        ).drop(CHUNK, *[f"_before_{c}" for c in sensors], *[f"_first_{c}" for c in sensors])
    else:
        filled = df.withColumns(
            {
                f"{c}_clean": F.coalesce(
                    F.last(c, ignorenulls=True).over(so_far), F.first(c, ignorenulls=True).over(whole)
                )
                for c in sensors
            }
        )
    if not layout.empty_sensors:
        return filled
    return _fill_empty_stations(filled, layout)


def _carried(df: DataFrame, layout: SeriesLayout, sensors: list[str]) -> DataFrame:
    """Per chunk of a hot station: last value before it and first value of the station.

    One row per chunk, at most a few per task of the job, hence the broadcast above.
    """
    at = F.struct(*ORDER)
    chunks = (
        layout.with_chunk(df)
        .filter(layout.is_hot())
        .groupBy(STATION, CHUNK)
        .agg(
            *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_last_{c}") for c in sensors],
            *[F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_head_{c}") for c in sensors],
        )
    )
    by_chunk = Window.partitionBy(STATION).orderBy(CHUNK)
    earlier = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    whole = by_chunk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return chunks.select(
        STATION,
        CHUNK,
        *[F.last(f"_last_{c}", ignorenulls=True).over(earlier).alias(f"_before_{c}") for c in sensors],
        *[F.first(f"_head_{c}", ignorenulls=True).over(whole).alias(f"_first_{c}") for c in sensors],
    )


def _fill_empty_stations(filled: DataFrame, layout: SeriesLayout) -> DataFrame:
    """Some station never reported a sensor: use the median over the filled column."""
    by_median = [c for c in layout.empty_sensors if c != "rainfall_mm"]
    fill: dict[str, float] = {f"{c}_clean": 0.0 for c in layout.empty_sensors if c == "rainfall_mm"}
    if by_median:
        medians = quantiles(
            filled, [], [f"{c}_clean" for c in by_median], [0.5], layout.rows <= SMALL_GROUP_ROWS
        ).first()
        for c in by_median:
            if medians[f"{c}_clean_q0"] is not None:
                fill[f"{c}_clean"] = medians[f"{c}_clean_q0"]
    return filled.fillna(fill) if fill else filled


def clip_physical(df: DataFrame, bounds: dict = PHYSICAL_BOUNDS) -> DataFrame:
    return df.withColumns(
        {
            f"{c}_clean": F.when(
                F.col(f"{c}_clean").isNotNull(),
                F.least(F.greatest(F.col(f"{c}_clean"), F.lit(low)), F.lit(high)),
            )
            for c, (low, high) in bounds.items()
            if f"{c}_clean" in df.columns
        }
    )


def preprocess(df: DataFrame, layout: SeriesLayout | None = None) -> DataFrame:
    """Flags, then imputation, then clipping; raw columns stay as they are."""
    layout = layout or SeriesLayout.measure(df)
    return clip_physical(impute(add_quality_flags(df, layout), layout))
