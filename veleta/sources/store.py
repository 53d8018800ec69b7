"""Parquet store of observations, partitioned by year."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from veleta.operators.dedup import KEY, dedup_first
from veleta.operators.filters import filter_time_station

COLUMNS = [
    ("station_id", T.StringType()),
    ("timestamp", T.TimestampNTZType()),
    ("seq", T.LongType()),
    ("station_name", T.StringType()),
    ("district", T.StringType()),
    ("state", T.StringType()),
    ("latitude", T.DoubleType()),
    ("longitude", T.DoubleType()),
    ("temperature_c", T.DoubleType()),
    ("relative_humidity_pct", T.DoubleType()),
    ("pressure_hpa", T.DoubleType()),
    ("wind_speed_kmh", T.DoubleType()),
    ("rainfall_mm", T.DoubleType()),
    ("ground_truth_label", T.StringType()),
    ("fault_description", T.StringType()),
    ("source", T.StringType()),
    ("ingested_at", T.TimestampType()),
]
SCHEMA = T.StructType([T.StructField(n, t) for n, t in COLUMNS])
STORE_SCHEMA = T.StructType([*SCHEMA.fields, T.StructField("year", T.IntegerType())])


def conform(df: DataFrame, source: str = "imd") -> DataFrame:
    """The store's columns; usable keys only; wind and rain default to zero."""
    have = set(df.columns)
    cols = []
    for name, kind in COLUMNS:
        c = F.col(name) if name in have else F.lit(None)
        if name == "source":
            c = F.coalesce(c, F.lit(source))
        if name == "ingested_at":
            c = F.coalesce(c, F.current_timestamp())
        if name in ("wind_speed_kmh", "rainfall_mm"):
            c = F.coalesce(c, F.lit(0.0))
        if name == "station_id":
            c = F.trim(c)
        cols.append(c.cast(kind).alias(name))
    usable = (F.col("station_id") != "") & F.col("timestamp").isNotNull()
    return df.select(*cols).filter(usable)


class ObservationStore:
    """Append-only table; an existing key is never replaced."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def read(self, stations: Sequence[str] | None = None, start=None, end=None) -> DataFrame:
        """Filtered observations; a time filter also prunes year folders."""
        try:
            rows = self.spark.read.schema(STORE_SCHEMA).parquet(self.path)
        except AnalysisException as error:  # only a store without a first batch is empty
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], STORE_SCHEMA).drop("year")
        if start is not None:
            rows = rows.filter(F.col("year") >= int(str(start)[:4]))
        if end is not None:
            rows = rows.filter(F.col("year") <= int(str(end)[:4]))
        return filter_time_station(rows, stations, start, end).drop("year")

    def new_rows(self, batch: DataFrame) -> DataFrame:
        """Rows of the batch whose key the store lacks, first of each key.

        The batch's own time span, that of its keys too, limits what is read of the store.
        """
        rows = conform(batch)
        span = rows.agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")).first()
        if span["lo"] is None:
            return dedup_first(rows)
        stored = self.read(start=span["lo"], end=span["hi"]).select(*KEY)
        return anti_existing(dedup_first(rows), stored)

    def insert_ignore(self, batch: DataFrame) -> int:
        """Append what is new and return its row count.

        The count is observed while writing, so the batch is not computed twice.
        """
        from pyspark.sql import Observation

        watch = Observation()
        rows = self.new_rows(batch).observe(watch, F.count(F.lit(1)).alias("n"))
        rows.withColumn("year", F.year("timestamp")).write.mode("append").partitionBy("year").parquet(self.path)
        return watch.get["n"]


def anti_existing(batch: DataFrame, stored: DataFrame) -> DataFrame:
    return batch.join(stored.select(*KEY), list(KEY), "left_anti")


def src_range(store: ObservationStore, start=None, end=None, stations=None, fallback: DataFrame | None = None) -> DataFrame:
    """Observations in time order; the fallback table when the range is empty."""
    rows = store.read(stations, start, end)
    if fallback is not None and rows.isEmpty():
        rows = filter_time_station(fallback, stations, start, end)
    return rows.orderBy("timestamp", "station_id")


REGISTRY_TEXT = ["station_name", "district", "state", "latitude", "longitude"]


def registry_of(df: DataFrame) -> DataFrame:
    """One row per station: first attributes, bounds, count, last ingest."""
    attrs = [c for c in REGISTRY_TEXT if c in df.columns]
    first = F.min_by(F.struct(*attrs), F.struct("timestamp", "seq"))
    synced = F.max("ingested_at") if "ingested_at" in df.columns else F.lit(None).cast("timestamp")
    return (
        df.groupBy("station_id")
        .agg(
            first.alias("_a"), F.min("timestamp").alias("oldest_timestamp"),
            F.max("timestamp").alias("latest_timestamp"), F.count(F.lit(1)).alias("records"), synced.alias("last_sync"),
        )
        .select("station_id", *[f"_a.{c}" for c in attrs], "oldest_timestamp", "latest_timestamp", "last_sync", "records")
    )


def registry_upsert(registry: DataFrame, touched: DataFrame) -> DataFrame:
    """Replace bounds of touched stations; attributes keep the old value where new is null."""
    attrs = [c for c in REGISTRY_TEXT if c in touched.columns]
    facts = ["oldest_timestamp", "latest_timestamp", "last_sync", "records"]
    old, new = registry.alias("o"), touched.alias("n")
    joined = old.join(new, F.col("o.station_id") == F.col("n.station_id"), "full_outer")
    fresh = F.col("n.station_id").isNotNull()
    return joined.select(
        F.coalesce("n.station_id", "o.station_id").alias("station_id"),
        *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in attrs],
        *[F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in facts],
    )


def fix_coords_update(df: DataFrame, station: str, latitude: float, longitude: float) -> DataFrame:
    """Set coordinates of one station and of every row at (0, 0)."""
    hit = F.coalesce(
        (F.col("station_id") == station) | ((F.col("latitude") == 0.0) & (F.col("longitude") == 0.0)), F.lit(False)
    )
    return df.withColumns(
        {
            "latitude": F.when(hit, F.lit(latitude)).otherwise(F.col("latitude")),
            "longitude": F.when(hit, F.lit(longitude)).otherwise(F.col("longitude")),
        }
    )


def outside_box(box: dict) -> Column:
    """Whether a row's place lies outside the box; not so where it is unknown."""
    (s, n), (w, e) = box["latitude"], box["longitude"]
    lat, lon = F.col("latitude"), F.col("longitude")
    return F.coalesce((lat < s) | (lat > n) | (lon < w) | (lon > e), F.lit(False))


def out_of_country(df: DataFrame, box: dict) -> DataFrame:
    return df.filter(outside_box(box)).select("station_id", "latitude", "longitude").distinct()


def backfill(store: ObservationStore, provider, start: dt.date, end: dt.date, chunk_days: int = 30) -> list[tuple[int, int, int, float]]:
    """Fetch and insert chunk by chunk: (chunk, new rows, rows held, percent) for each.

    ``provider(first, after)`` gives the observations of a chunk as a DataFrame. Keys that the store holds are left alone,
    so a backfill that is run again inserts what is missing. The driver sees one count per chunk.
    """
    out, first, number, held = [], start, 0, store.read().count()
    while first < end:
        after = min(first + dt.timedelta(days=chunk_days), end)
        new = store.insert_ignore(provider(first, after))
        held += new
        out.append((number, new, held, min(100.0, round((after - start).days * 100.0 / max((end - start).days, 1), 1))))
        first, number = after, number + 1
    return out


BACKFILL_GROUP = 24  # chunks that one commit inserts together


class Backfill:
    """A chunked backfill that can be stopped anywhere and run again.

    Next to the store lie two logs with a row per chunk and commit: ``begun`` with the rows that the store held before, written
    ahead of the insert, and ``done`` with those it held after. A chunk is done up to the time its log row names, so a
    span that ends within a chunk is taken up there later. Several missing chunks are read and inserted by one job;
    existing keys are left alone, so a commit that is run again inserts only what is missing and new rows count right.
    """

    def __init__(self, store: ObservationStore, start: dt.datetime, end: dt.datetime, chunk_days: int = 30) -> None:
        if end <= start or chunk_days < 1:
            raise ValueError("an empty span or chunk")
        self.store, self.spark, self.start, self.end, self.days = store, store.spark, start, end, chunk_days
        self.logs = f"{store.path}-backfill"

    def chunks(self) -> list[tuple[int, dt.datetime, dt.datetime]]:
        """Number, first moment and end of every chunk."""
        step = dt.timedelta(days=self.days)
        count = -((self.start - self.end) // step)
        return [(i, self.start + i * step, min(self.end, self.start + (i + 1) * step)) for i in range(count)]

    def _log(self, name: str) -> DataFrame:
        schema = "chunk LONG, upto TIMESTAMP_NTZ, held LONG"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.logs}/{name}")
        except AnalysisException as error:  # only a backfill without a first commit is empty
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def missing(self) -> list[tuple[int, dt.datetime, dt.datetime]]:
        """Chunks that are not done up to their end; the driver sees one row per chunk."""
        done = {r["chunk"]: r["upto"] for r in self._log("done").groupBy("chunk").agg(F.max("upto").alias("upto")).collect()}
        return [c for c in self.chunks() if c[0] not in done or done[c[0]] < c[2]]

    def _chunk(self) -> Column:
        from veleta.operators.filters import time_literal
        from veleta.operators.series import micros

        return F.floor((micros(F.col("timestamp")) - micros(time_literal(self.start))) / F.lit(self.days * 86_400_000_000))

    def _inside(self, df: DataFrame, first: dt.datetime, after: dt.datetime) -> DataFrame:
        from veleta.operators.filters import time_literal

        return filter_time_station(df, None, first, None).filter(F.col("timestamp") < time_literal(after))

    def _write(self, name: str, group: list[tuple[int, dt.datetime, dt.datetime]]) -> None:
        stored = self._inside(self.store.read(start=group[0][1], end=group[-1][2]), group[0][1], group[-1][2])
        held = stored.groupBy(self._chunk().alias("chunk")).agg(F.count(F.lit(1)).alias("held"))
        wanted = self.spark.createDataFrame([(n, after) for n, _, after in group], "chunk LONG, upto TIMESTAMP_NTZ")
        rows = wanted.join(held, "chunk", "left").select("chunk", "upto", F.coalesce("held", F.lit(0)).alias("held"))
        rows.coalesce(1).write.mode("append").parquet(f"{self.logs}/{name}")  # a row per chunk

    def run(self, provider: Callable[[dt.datetime, dt.datetime], DataFrame], group: int = BACKFILL_GROUP) -> int:
        """Insert what is missing and return the new rows; ``provider(first, after)`` gives the observations of a span."""
        missing, new = self.missing(), 0
        for i in range(0, len(missing), group):
            part = missing[i : i + group]
            first, after = part[0][1], part[-1][2]
            rows = self._inside(provider(first, after), first, after)
            if len(part) < part[-1][0] - part[0][0] + 1:  # chunks between them are done
                rows = rows.filter(self._chunk().isin([c[0] for c in part]))
            self._write("begun", part)
            new += self.store.insert_ignore(rows)
            self._write("done", part)
        return new

    def progress(self) -> DataFrame:
        """Per finished chunk its new rows, running totals of rows and of stations first seen, and percent."""
        from pyspark.sql import Window

        before = self._log("begun").groupBy("chunk").agg(F.min("held").alias("before"))
        done = self._log("done").groupBy("chunk").agg(F.max("held").alias("after"), F.max("upto").alias("upto"))
        held = self._inside(self.store.read(start=self.start, end=self.end), self.start, self.end)
        found = (
            held.groupBy("station_id").agg(F.min(self._chunk()).alias("chunk"))
            .groupBy("chunk").agg(F.count(F.lit(1)).alias("found"))
        )
        so_far = Window.partitionBy(F.lit(1)).orderBy("chunk")  # one row per chunk
        days = max((self.end - self.start).days, 1)
        elapsed = F.least((F.col("chunk") + 1) * self.days, F.lit((self.end - self.start).days))
        new = F.col("after") - F.col("before")
        return done.join(before, "chunk").join(found, "chunk", "left").select(
            "chunk", new.alias("new_records"), F.sum(new).over(so_far).alias("records_inserted"),
            F.sum(F.coalesce("found", F.lit(0))).over(so_far).alias("stations_discovered"),
            F.least(F.lit(100.0), F.round(elapsed * 100.0 / days, 1)).alias("progress"),
        )


def backfill_chunks(df: DataFrame, start, end, chunk_days: int = 30) -> DataFrame:
    """Progress of a chunked backfill: per chunk its new rows, running totals and percent.

    A station counts as discovered in its first chunk, so running station numbers need one
    aggregate per station and a sum over chunks instead of a growing set.
    """
    from veleta.operators.filters import time_literal
    from veleta.operators.series import micros
    from pyspark.sql import Window

    day = 86_400_000_000
    since = micros(F.col("timestamp")) - micros(time_literal(start))
    inside = filter_time_station(df, None, start, None).filter(F.col("timestamp") < time_literal(end))
    chunked = dedup_first(inside).withColumn("chunk", F.floor(since / F.lit(chunk_days * day)))
    found = (
        chunked.groupBy("station_id").agg(F.min("chunk").alias("chunk"))
        .groupBy("chunk").agg(F.count(F.lit(1)).alias("_new_stations"))
    )
    span = micros(time_literal(end)) - micros(time_literal(start))
    total_days = F.greatest(F.lit(1), F.floor(span / F.lit(day)))
    elapsed = F.least((F.col("chunk") + 1) * chunk_days, F.floor(span / F.lit(day)))
    # One row per chunk.
    so_far = Window.partitionBy(F.lit(1)).orderBy("chunk")
    return (
        chunked.groupBy("chunk").agg(F.count(F.lit(1)).alias("new_records"))
        .join(found, "chunk", "left")
        .select(
            F.col("chunk"),
            "new_records",
            F.sum("new_records").over(so_far).alias("records_inserted"),
            F.sum(F.coalesce("_new_stations", F.lit(0))).over(so_far).alias("stations_discovered"),
            F.least(F.lit(100.0), F.round(elapsed * 100.0 / total_days, 1)).alias("progress"),
        )
    )
