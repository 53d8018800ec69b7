"""Fault rules: freeze, spike, drift, communication loss.

Every rule is a bounded frame over the station window, so a rule needs only a few context rows
around each time chunk of a long series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from veleta.operators.order_stats import quantiles
from veleta.operators.preprocess import true_or_false
from veleta.operators.series import STATION, SeriesLayout, micros, source_column

FREEZE_VARIANCE, FREEZE_ROWS = 0.01, 3
SPIKE_Z = 4.0
DRIFT_Z, DRIFT_ROWS = 2.0, 5
COMM_GAP_HOURS = 3.0
MAD_TO_SIGMA = 1.4826


def _any_full_frame(hit: Column, rows: int, window) -> Column:
    """True where some frame of ``rows`` rows that covers this row is a hit."""
    return F.max(hit.cast("int")).over(window.rowsBetween(0, rows - 1)) == 1


def rule_freeze(
    df: DataFrame,
    layout: SeriesLayout | None = None,
    sensor: str = "relative_humidity_pct",
    variance: float = FREEZE_VARIANCE,
    rows: int = FREEZE_ROWS,
) -> DataFrame:
    layout = layout or SeriesLayout.measure(df)
    value = F.col(source_column(df, sensor))

    def flag(table: DataFrame) -> DataFrame:
        w = layout.window()
        frame = w.rowsBetween(-(rows - 1), 0)
        still = (F.count(F.lit(1)).over(frame) == rows) & (F.var_pop(value).over(frame) < variance)
        marked = table.withColumn("_still", true_or_false(still))
        return marked.withColumn("rule_freeze", _any_full_frame(F.col("_still"), rows, w)).drop("_still")

    return layout.run(df, flag, before=rows - 1, after=rows - 1)


def rule_spike(
    df: DataFrame,
    layout: SeriesLayout | None = None,
    sensor: str = "pressure_hpa",
    threshold: float = SPIKE_Z,
) -> DataFrame:
    """A row far from the station median whose two neighbours are near it."""
    layout = layout or SeriesLayout.measure(df)
    src = source_column(df, sensor)
    if not layout.small_groups and "_median" not in df.columns:
        df = df.join(spike_stats(df, src, layout), STATION, "left")

    def flag(table: DataFrame) -> DataFrame:
        w = layout.window()
        if layout.small_groups:
            whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            half = F.lit(0.5)
            table = (
                table.withColumn("_median", F.percentile(F.col(src), half).over(whole))
                .withColumn("_mad", F.percentile(F.abs(F.col(src) - F.col("_median")), half).over(whole))
                .withColumn("_sigma", F.stddev_pop(src).over(whole))
            )
        sigma = F.col("_mad") * MAD_TO_SIGMA
        scale = F.when(sigma < 1e-6, F.col("_sigma")).otherwise(sigma)
        z = F.when(scale >= 1e-6, F.abs(F.col(src) - F.col("_median")) / scale)
        scored = table.withColumn("_z", z)
        spike = (
            (F.col("_z") > threshold)
            & (F.lag("_z").over(w) < threshold)
            & (F.lead("_z").over(w) < threshold)
        )
        return scored.withColumn("rule_spike", true_or_false(spike)).drop("_median", "_mad", "_sigma", "_z")

    return layout.run(df, flag, before=1, after=1)


def spike_stats(df: DataFrame, src: str, layout: SeriesLayout) -> DataFrame:
    """Per station: median, MAD and population deviation; one row per station."""
    medians = quantiles(df, [STATION], [src], [0.5], layout.small_groups).withColumnRenamed(f"{src}_q0", "_median")
    medians = F.broadcast(medians) if layout.small_network else medians
    away = df.join(medians, STATION).select(STATION, F.abs(F.col(src) - F.col("_median")).alias("_away"))
    mads = quantiles(away, [STATION], ["_away"], [0.5], layout.small_groups).withColumnRenamed("_away_q0", "_mad")
    sigma = df.groupBy(STATION).agg(F.stddev_pop(src).alias("_sigma"))
    stats = medians.join(mads, STATION).join(sigma, STATION)
    return F.broadcast(stats) if layout.small_network else stats


def rule_drift(
    df: DataFrame,
    layout: SeriesLayout | None = None,
    sensor: str = "temperature_c",
    rows: int = DRIFT_ROWS,
    threshold: float = DRIFT_Z,
) -> DataFrame:
    """Runs of at least ``rows`` rows with a high robust z; a null breaks a run.

    A row is in such a run exactly when some frame of ``rows`` rows around it is high
    throughout, which keeps the frame bounded.
    """
    if f"{sensor}_robust_z" not in df.columns:
        return df.withColumn("rule_drift", F.lit(False))
    layout = layout or SeriesLayout.measure(df)

    def flag(table: DataFrame) -> DataFrame:
        w = layout.window()
        high = true_or_false(F.abs(F.col(f"{sensor}_robust_z")) > threshold)
        run = F.sum(high.cast("int")).over(w.rowsBetween(-(rows - 1), 0)) == rows
        marked = table.withColumn("_run", run)
        return marked.withColumn("rule_drift", _any_full_frame(F.col("_run"), rows, w)).drop("_run")

    return layout.run(df, flag, before=rows - 1, after=rows - 1)


def rule_comm(df: DataFrame, hours: float = COMM_GAP_HOURS) -> DataFrame:
    if "time_since_prev_obs" not in df.columns:
        return df.withColumn("rule_communication", F.lit(False))
    return df.withColumn("rule_communication", true_or_false(F.col("time_since_prev_obs") > hours))


def add_gap_hours(df: DataFrame, layout: SeriesLayout | None = None) -> DataFrame:
    layout = layout or SeriesLayout.measure(df)

    def measure(table: DataFrame) -> DataFrame:
        previous = F.lag("timestamp").over(layout.window())
        hours = (micros(F.col("timestamp")) - micros(previous)) / F.lit(3.6e9)
        return table.withColumn("time_since_prev_obs", hours)

    return layout.run(df, measure, before=1)


def apply_fault_rules(df: DataFrame, layout: SeriesLayout | None = None) -> DataFrame:
    """All four flags, their disjunction and the inferred fault type.

    The station statistics of the spike rule are taken before context rows are added; then one
    set of context rows serves all rules.
    """
    layout = layout or SeriesLayout.measure(df)
    if not layout.small_groups and "_median" not in df.columns:
        df = df.join(spike_stats(df, source_column(df, "pressure_hpa"), layout), STATION, "left")

    def flag(table: DataFrame) -> DataFrame:
        return rule_comm(rule_drift(rule_spike(rule_freeze(table, layout), layout), layout))

    flagged = layout.run(df, flag, before=DRIFT_ROWS - 1, after=DRIFT_ROWS - 1)
    flags = [F.col(c) for c in ("rule_freeze", "rule_spike", "rule_drift", "rule_communication")]
    return flagged.withColumns(
        {"rule_any_fault": flags[0] | flags[1] | flags[2] | flags[3], "inferred_fault": inferred_fault()}
    )


def inferred_fault() -> Column:
    """SPIKE before FREEZE before DRIFT before COMMUNICATION_FAILURE."""
    return (
        F.when(F.col("rule_spike"), "SPIKE")
        .when(F.col("rule_freeze"), "FREEZE")
        .when(F.col("rule_drift"), "DRIFT")
        .when(F.col("rule_communication"), "COMMUNICATION_FAILURE")
        .otherwise("UNKNOWN")
    )


def fault_summary(df: DataFrame) -> DataFrame:
    """Which stations show which sensor faults: counts by station and inferred type."""
    return (
        df.filter(F.col("rule_any_fault"))
        .groupBy(STATION, "inferred_fault")
        .agg(F.count(F.lit(1)).alias("observations"))
    )


def map_fault_text(description: Column) -> Column:
    """Fault type named by a free-text description, first match in this order."""
    text = F.lower(description)
    return (
        F.when(description.isNull() | (description == "None"), "UNKNOWN")
        .when(text.contains("drift") | text.contains("calibration"), "DRIFT")
        .when(text.contains("freeze") | text.contains("zero variance"), "FREEZE")
        .when(text.contains("spike"), "SPIKE")
        .when(text.contains("communication"), "COMMUNICATION_FAILURE")
        .otherwise("UNKNOWN")
    )
