"""CSV observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veleta.functions.parse import parse_timestamp
from veleta.operators.dedup import dedup_last

SCHEMA = """
timestamp STRING, station_id STRING, station_name STRING, latitude DOUBLE, longitude DOUBLE,
temperature_c DOUBLE, relative_humidity_pct DOUBLE, pressure_hpa DOUBLE, wind_speed_kmh DOUBLE,
rainfall_mm DOUBLE, ground_truth_label STRING, fault_description STRING
"""


def read_csv(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """Parse mixed day-first timestamps and keep the last row of each key.

    Rows stand in the order of file, split offset and place in the split; ``seq`` is that place
    and settles ties later on.
    """
    raw = spark.read.csv(path, schema=schema, header=True, enforceSchema=False)
    placed = raw.select(
        *[parse_timestamp(F.col(c)).alias(c) if c == "timestamp" else F.col(c) for c in raw.columns],
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("seq"),
    )
    return dedup_last(placed, order=("_file", "_block", "seq")).drop("_file", "_block")


def load_raw(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    return read_csv(spark, path, schema).orderBy("station_id", "timestamp")
