"""Audit and validation aggregates over a table of observations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veleta.fixed_values import PHYSICAL_BOUNDS, REQUIRED_COLUMNS, SENSORS
from veleta.operators.dedup import KEY
from veleta.operators.order_stats import SMALL_GROUP_ROWS, quantiles
from veleta.operators.preprocess import outside
from veleta.operators.series import ORDER, STATION, SeriesLayout, micros

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def _rows_of(row: DataFrame, name: str, values: Sequence[tuple[str, list[Column]]], out: Sequence[str]) -> DataFrame:
    """Turn a one-row aggregate into one row per named entry."""
    entries = F.array(
        *[F.struct(F.lit(label).alias(name), *[c.alias(o) for c, o in zip(cols, out)]) for label, cols in values]
    )
    return row.select(F.explode(entries).alias("_e")).select("_e.*")


def agg_missing(df: DataFrame) -> DataFrame:
    """Nulls per column and their share in percent."""
    row = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    )
    share = lambda c: F.round(F.col(c) * 100.0 / F.col("_rows"), 2)
    return _rows_of(row, "column_name", [(c, [F.col(c), share(c)]) for c in df.columns], ["nulls", "pct"])


BITMAP_BITS = 32_768  # of one bitmap that Spark's functions build
BITMAPS = 4_096  # 16 MB in all


def repeated_rows(df: DataFrame) -> DataFrame:
    """Distinct rows that occur more than once, with their number ``_n``.

    Row hashes are counted first. Those that occur twice set bits of a filter of at most 16 MB, which every task gets, so a
    row without a repeat is hardly ever shuffled. Whole rows are compared for the others, and equal ones are counted within a
    task before they travel: a row that a third of the table repeats is one entry per task.
    """
    hashed = df.withColumn("_h", F.xxhash64(*df.columns))
    twice = hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1")
    place = F.pmod("_h", F.lit(BITMAP_BITS * BITMAPS))
    bucket, bit = F.floor(place / BITMAP_BITS).cast("int").alias("_bucket"), (place % BITMAP_BITS).alias("_bit")
    bits = twice.select(bucket, bit).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    tested = hashed.select(*df.columns, bucket, bit).join(F.broadcast(bits), "_bucket")
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_bit div 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    suspects = tested.filter(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1)
    return suspects.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")


def agg_dup_rows(df: DataFrame) -> DataFrame:
    """Fully repeated rows beyond the first of each."""
    return repeated_rows(df).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def agg_dup_keys(df: DataFrame) -> DataFrame:
    """Repeats beyond the first, all members of repeated keys, and their rate."""
    groups = df.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    members = F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(0))
    return groups.agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("beyond_first"),
        F.coalesce(members, F.lit(0)).alias("all_members"),
        F.round(F.coalesce(members * 100.0 / F.sum("_n"), F.lit(0.0)), 3).alias("rate_pct"),
    )


def agg_ts_failures(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.col("timestamp").isNull()).alias("timestamp_failures"))


def agg_violations(df: DataFrame, bounds: dict = PHYSICAL_BOUNDS) -> DataFrame:
    """Rows out of bounds per sensor, and in total."""
    present = [c for c in bounds if c in df.columns]
    row = df.agg(*[F.count_if(outside(c, bounds[c])).alias(c) for c in present])
    total = reduce(lambda a, b: a + b, [F.col(c) for c in present])
    return _rows_of(row, "sensor", [*[(c, [F.col(c)]) for c in present], ("total", [total])], ["violations"])


def validate_report(df: DataFrame, bounds: dict = PHYSICAL_BOUNDS) -> DataFrame:
    """One row; invalid only when a required column is missing.

    Nulls, bounds and failures are one map-side aggregate; repeated keys and rows are counted apart, and the three
    one-row results are put together.
    """
    absent = [c for c in REQUIRED_COLUMNS if c not in df.columns]
    present = [c for c in bounds if c in df.columns]
    key = [c for c in KEY if c in df.columns]
    facts = df.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in df.columns],
        *[F.count_if(outside(c, bounds[c])).alias(f"_bad_{c}") for c in present],
    )
    keys = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("_keys"))
    parts = facts.unionByName(keys, True).unionByName(agg_dup_rows(df), True)
    row = parts.agg(*[F.max(c).alias(c) for c in parts.columns])
    texts = [
        F.when(
            F.col(f"_bad_{c}") > 0,
            F.format_string(f"{c} has %d values outside [{bounds[c][0]}, {bounds[c][1]}]", F.col(f"_bad_{c}")),
        )
        for c in present
    ]
    return row.select(
        F.lit(", ".join(absent)).alias("missing_columns"),
        reduce(lambda a, b: a + b, [F.col(f"_null_{c}") for c in df.columns]).alias("missing_values"),
        "duplicate_rows",
        F.col("_keys").alias("duplicate_station_timestamps"),
        (F.col("_null_timestamp") if "timestamp" in df.columns else F.lit(0)).alias("timestamp_parse_failures"),
        *[F.col(f"_bad_{c}").alias(f"violations_{c}") for c in present],
        F.array_join(F.array_compact(F.array(*texts)), "; ").alias("warnings"),
        F.lit(not absent).alias("is_valid"),
    )


def audit_dataset(df: DataFrame, bounds: dict = PHYSICAL_BOUNDS) -> DataFrame:
    """Totals, coverage, missing share, repeated keys and violations in one row."""
    sensors = [c for c in SENSORS if c in df.columns]
    per_key = df.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in sensors],
        *[F.count_if(outside(c, bounds[c])).alias(f"_bad_{c}") for c in sensors],
    )
    total = F.sum("_n")
    members = F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(0))
    days = F.floor((F.max(micros(F.col("timestamp"))) - F.min(micros(F.col("timestamp")))) / F.lit(DAY_US))
    return per_key.agg(
        total.alias("records"),
        F.countDistinct(STATION).alias("stations"),
        F.min("timestamp").alias("oldest"),
        F.max("timestamp").alias("latest"),
        F.round(days / 365.25, 2).alias("coverage_years"),
        members.alias("duplicate_members"),
        F.round(members * 100.0 / total, 3).alias("duplicate_rate_pct"),
        *[F.round(F.sum(f"_null_{c}") * 100.0 / total, 2).alias(f"missing_pct_{c}") for c in sensors],
        *[F.sum(f"_bad_{c}").alias(f"violations_{c}") for c in sensors],
    )


def audit_shape(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"),
        ((F.max(micros(F.col("timestamp"))) - F.min(micros(F.col("timestamp")))) / F.lit(float(HOUR_US))).alias("span_hours"),
    )


def _intervals(df: DataFrame, layout: SeriesLayout | None) -> DataFrame:
    layout = layout or SeriesLayout.measure(df)
    order_only = df.select(STATION, *ORDER)

    def step(rows: DataFrame) -> DataFrame:
        previous = F.lag("timestamp").over(layout.window())
        return rows.withColumn("interval_us", micros(F.col("timestamp")) - micros(previous))

    return layout.run(order_only, step, before=1)


def audit_interval_mode(df: DataFrame, layout: SeriesLayout | None = None) -> DataFrame:
    """Most frequent sampling interval per station, the smallest on ties."""
    counts = (
        _intervals(df, layout)
        .filter(F.col("interval_us").isNotNull())
        .groupBy(STATION, "interval_us")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    best = F.min_by(F.struct("interval_us", "times"), F.struct(-F.col("times"), F.col("interval_us")))
    return counts.groupBy(STATION).agg(best.alias("_b")).select(STATION, "_b.interval_us", "_b.times")


def audit_gaps(df: DataFrame, layout: SeriesLayout | None = None) -> DataFrame:
    """Gaps longer than an hour per station."""
    late = F.count_if(F.coalesce(F.col("interval_us") > HOUR_US, F.lit(False)))
    return _intervals(df, layout).groupBy(STATION).agg(late.alias("gaps"))


def audit_stations(df: DataFrame) -> DataFrame:
    names = [c for c in ("station_name", "latitude", "longitude") if c in df.columns]
    first = F.min_by(F.struct(*names), F.struct(*ORDER))
    return (
        df.groupBy(STATION)
        .agg(F.count(F.lit(1)).alias("observations"), first.alias("_f"))
        .select(STATION, "observations", *[f"_f.{c}" for c in names])
    )


def audit_labels(df: DataFrame) -> DataFrame:
    """Label counts and shares; the total runs over one row per label."""
    counts = df.groupBy("ground_truth_label").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.select("ground_truth_label", "n", F.round(F.col("n") * 100.0 / total, 1).alias("pct"))


def audit_faults(df: DataFrame) -> DataFrame:
    return df.groupBy("fault_description").agg(F.count(F.lit(1)).alias("n"))


def audit_faults_by_station(df: DataFrame) -> DataFrame:
    return (
        df.filter(F.col("ground_truth_label") != "NORMAL")
        .groupBy(STATION, "ground_truth_label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def audit_describe(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles per sensor."""
    sensors = [c for c in SENSORS if c in df.columns]
    rows = df.count() if rows is None else rows
    moments = df.agg(
        *[f(c).alias(f"{c}_{n}") for c in sensors for n, f in
          (("n", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    )
    quart = quantiles(df, [], sensors, [0.25, 0.5, 0.75], rows <= SMALL_GROUP_ROWS)
    # Two one-row tables.
    both = moments.withColumn("_k", F.lit(1)).join(quart.withColumn("_k", F.lit(1)), "_k")
    stats = ["n", "mean", "std", "min", "q0", "q1", "q2", "max"]
    return _rows_of(
        both,
        "sensor",
        [(c, [F.col(f"{c}_{s}") for s in stats]) for c in sensors],
        ["n", "mean", "std", "min", "q25", "q50", "q75", "max"],
    )


def audit_corr(df: DataFrame) -> DataFrame:
    """Pairwise-complete correlations, all pairs in one aggregate."""
    sensors = [c for c in SENSORS if c in df.columns]
    pairs = [(a, b) for i, a in enumerate(sensors) for b in sensors[i + 1:]]
    # ``corr`` skips a row when either side is null.
    row = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    return _rows_of(row, "pair", [(f"{a}/{b}", [F.col(f"{a}__{b}")]) for a, b in pairs], ["correlation"])


def audit_hist(df: DataFrame, bins: int = 30) -> DataFrame:
    """Equal-width histogram per sensor and label between the group's own extremes."""
    sensors = [c for c in SENSORS if c in df.columns]
    entries = F.array(*[F.struct(F.lit(c).alias("sensor"), F.col(c).alias("v")) for c in sensors])
    long = df.select("ground_truth_label", F.explode(entries).alias("_e")).select("ground_truth_label", "_e.*")
    long = long.filter(F.col("v").isNotNull())
    # One row per sensor and label.
    edges = long.groupBy("sensor", "ground_truth_label").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    joined = long.join(F.broadcast(edges), ["sensor", "ground_truth_label"])
    width = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)))
    return (
        joined.select("sensor", "ground_truth_label", bin_.cast("int").alias("bin"))
        .groupBy("sensor", "ground_truth_label", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
