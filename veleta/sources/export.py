"""Exports: by year with capped files, filtered, and refresh of one year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veleta.operators.filters import filter_time_station

MAX_ROWS_PER_FILE = 500_000


def _with_year(df: DataFrame) -> DataFrame:
    return df.withColumn("year", F.year("timestamp"))


def sink_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def sink_export_year(df: DataFrame, path: str, fmt: str = "parquet", rows_per_file: int = MAX_ROWS_PER_FILE, mode: str = "overwrite") -> None:
    """One folder per year, time-ordered files of at most ``rows_per_file`` rows.

    Range partitioning on time and station balances the tasks whatever the rows per year, and
    leaves narrow time ranges per file for later skipping.
    """
    (
        _with_year(df)
        .repartitionByRange("year", "timestamp", "station_id")
        .sortWithinPartitions("year", "timestamp", "station_id")
        .write.mode(mode)
        .partitionBy("year")
        .option("maxRecordsPerFile", rows_per_file)
        .option("header", "true")
        .format(fmt)
        .save(path)
    )


def sink_export_filtered(df: DataFrame, path: str, station: str | None = None, start=None, end=None, fmt: str = "csv") -> None:
    rows = filter_time_station(df, station, start, end)
    rows.write.mode("overwrite").option("header", "true").format(fmt).save(path)


def sink_refresh_year(df: DataFrame, path: str, year: int, rows_per_file: int = MAX_ROWS_PER_FILE) -> None:
    """Rewrite one year's folder and leave the others untouched."""
    (
        _with_year(df)
        .filter(F.col("timestamp") >= F.lit(f"{year}-01-01 00:00:00").cast("timestamp_ntz"))
        .filter(F.col("year") == year)
        .repartitionByRange("timestamp", "station_id")
        .sortWithinPartitions("timestamp", "station_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy("year")
        .parquet(path)
    )


def export_plan(df: DataFrame, rows_per_file: int = MAX_ROWS_PER_FILE) -> DataFrame:
    """Rows per year and the fewest files that hold them."""
    return (
        _with_year(df)
        .groupBy("year")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("parts", F.ceil(F.col("n_rows") / rows_per_file))
    )
