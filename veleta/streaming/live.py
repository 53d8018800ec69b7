"""Live ingestion with Structured Streaming.

Per-station state is kept as small tables with one row (or a hundred rows) per station that every
micro-batch merges by ordinary, skew-safe aggregates. Each table has two slots: batch ``n`` reads
slot ``n - 1`` and overwrites slot ``n``, so a batch that is run again gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veleta.operators.filters import history_recent
from veleta.operators.series import SeriesLayout
from veleta.operators.serve import anomaly_feed, latest_per_station
from veleta.operators.temporal import add_temporal_features
from veleta.sources.export import sink_refresh_year
from veleta.sources.payload import normalize_records, split_typed, src_payload
from veleta.sources.store import ObservationStore, conform, registry_of, registry_upsert

WATERMARK = "2 hours"
BUFFER_ROWS = 100
POLL = "300 seconds"


def start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, poll: str | None = POLL) -> StreamingQuery:
    """Run ``each`` per micro-batch: every ``poll``, or until the source is drained if None."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)
    return writer.start()


class SlotTable:
    """A table replaced by every micro-batch."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _slot(self, batch: int) -> str:
        return f"{self.path}/slot={batch % 2}"

    def read(self, batch: int) -> DataFrame | None:
        """State after ``batch``; None before the first one."""
        if batch < 0:
            return None
        try:
            return self.spark.read.parquet(self._slot(batch))
        except AnalysisException as error:  # a lost or damaged state must not pass for a new one
            if batch > 0 or error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def write(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(self._slot(batch))


def merged(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    return batch if state is None else state.unionByName(batch)


def st_push(*streams: DataFrame) -> DataFrame:
    """Polled and pushed records as one stream."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out


def quarantine_of(store: ObservationStore) -> str:
    """Folder of records without a readable timestamp, next to the store."""
    return f"{store.path}-quarantine"


def st_ingest(payloads: DataFrame, store: ObservationStore, checkpoint: str, poll: str | None = POLL, column: str = "payload") -> StreamingQuery:
    """Payloads to stored observations; existing keys are left alone.

    Records without a readable timestamp go to ``quarantine_of(store)``, a folder per micro-batch, so that a batch
    that is run again replaces its own.
    """

    def each(batch: DataFrame, number: int) -> None:
        # Records are read several times, for their time span, the append and the quarantine, and normalised once.
        typed = normalize_records(src_payload(batch, column)).persist()
        store.insert_ignore(typed.filter(F.col("timestamp").isNotNull()))  # keeps the first of each key
        typed.filter(F.col("timestamp").isNull()).write.mode("overwrite").parquet(f"{quarantine_of(store)}/batch={number}")
        typed.unpersist()

    return start(payloads, each, checkpoint, poll)


def st_dedup(stream: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """One row per (station, timestamp) among rows within the watermark."""
    timed = stream.withColumn("event_time", F.col("timestamp").cast("timestamp"))
    return timed.withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(["station_id", "event_time"])


def st_buffer(stream: DataFrame, table: SlotTable, checkpoint: str, rows: int = BUFFER_ROWS, poll: str | None = POLL) -> StreamingQuery:
    """The newest rows of every station; a batch is cut to that many rows before its shuffle."""

    def each(batch: DataFrame, number: int) -> None:
        recent = merged(table.read(number - 1), history_recent(batch, rows))
        table.write(history_recent(recent, rows), number)

    return start(stream, each, checkpoint, poll)


def st_features(stream: DataFrame, buffer: SlotTable, out: str, checkpoint: str, rows: int = BUFFER_ROWS, poll: str | None = POLL) -> StreamingQuery:
    """Backward-looking features of new rows, with the buffer as their history."""

    def each(batch: DataFrame, number: int) -> None:
        history = buffer.read(number - 1)
        fresh = batch.withColumn("_new", F.lit(True))
        table = fresh if history is None else fresh.unionByName(history.withColumn("_new", F.lit(False)))
        features = add_temporal_features(table, SeriesLayout.measure(table)).filter("_new").drop("_new")
        features.write.mode("overwrite").parquet(f"{out}/batch={number}")
        buffer.write(history_recent(merged(history, history_recent(batch, rows)), rows), number)

    return start(stream, each, checkpoint, poll)


def st_latest(stream: DataFrame, table: SlotTable, checkpoint: str, poll: str | None = POLL) -> StreamingQuery:
    """Newest record per station by event time."""

    def each(batch: DataFrame, number: int) -> None:
        table.write(latest_per_station(merged(table.read(number - 1), latest_per_station(batch))), number)

    return start(stream, each, checkpoint, poll)


@dataclass
class LivePaths:
    """Folders of one live pipeline; each table is replaced or appended per micro-batch."""

    registry: SlotTable
    latest: SlotTable
    years: str
    feed: str


def live_pipeline(
    payloads: DataFrame, store: ObservationStore, paths: LivePaths, decide: Callable[[DataFrame], DataFrame],
    checkpoint: str, poll: str | None = POLL, column: str = "payload",
) -> StreamingQuery:
    """Payloads to store and quarantine, then registry, year export, current records and the anomaly feed.

    A micro-batch refreshes the registry rows of its stations and the exported years it touches from the store, so a
    batch that is run again gives the same tables. ``decide`` adds ``prediction`` to the current record of every station.
    """

    def each(batch: DataFrame, number: int) -> None:
        typed = normalize_records(src_payload(batch, column)).persist()
        accepted, unreadable = split_typed(typed)
        accepted = conform(accepted).persist()
        store.insert_ignore(accepted)
        unreadable.write.mode("overwrite").parquet(f"{quarantine_of(store)}/batch={number}")
        touched = store.read().join(accepted.select("station_id").distinct(), "station_id", "left_semi")
        old, new = paths.registry.read(number - 1), registry_of(touched)
        paths.registry.write(new if old is None else registry_upsert(old, new), number)
        for row in accepted.select(F.year("timestamp").alias("year")).distinct().collect():  # a row per year
            span = store.read(start=f"{row['year']}-01-01 00:00:00", end=f"{row['year']}-12-31 23:59:59.999999")
            sink_refresh_year(span, paths.years, row["year"])
        current = latest_per_station(merged(paths.latest.read(number - 1), latest_per_station(accepted)))
        paths.latest.write(current, number)
        anomaly_feed(decide(paths.latest.read(number))).write.mode("overwrite").parquet(f"{paths.feed}/batch={number}")
        accepted.unpersist()
        typed.unpersist()

    return start(payloads, each, checkpoint, poll)


def st_status(stream: DataFrame, table: SlotTable, checkpoint: str, poll: str | None = POLL) -> StreamingQuery:
    """Rows received and newest timestamp per station."""

    def each(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy("station_id").agg(
            F.count(F.lit(1)).alias("received"), F.max("timestamp").alias("latest")
        )
        both = merged(table.read(number - 1), counts)
        table.write(both.groupBy("station_id").agg(F.sum("received").alias("received"), F.max("latest").alias("latest")), number)

    return start(stream, each, checkpoint, poll)


def status_of(per_station: DataFrame) -> DataFrame:
    return per_station.agg(
        F.sum("received").alias("observations_received"),
        F.count(F.lit(1)).alias("stations_monitored"),
        F.max("latest").alias("latest_observation"),
    )
