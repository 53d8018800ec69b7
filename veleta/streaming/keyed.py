"""Per-station stream state in Spark's own state store.

Counts and newest records are streaming aggregates: combined before the shuffle, and only the groups a micro-batch touches
are written to the store. The newest rows of a station are a list state of ``transformWithStateInPandas``. The store is RocksDB with
a change log, so what is written per micro-batch follows the batch and not the number of stations; a restarted query goes on from
its checkpoint. Results are change logs: a folder per micro-batch, which a batch that is run again replaces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from veleta.operators.series import STATION, SeriesLayout, micros
from veleta.operators.serve import latest_per_station
from veleta.operators.temporal import LAGS, WINDOWS, add_temporal_features
from veleta.streaming.live import BUFFER_ROWS, POLL

STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
EARLIEST = -(2**63)
PACKED = "station_id STRING, at LONG, seq LONG, row STRING"
HELD = "at LONG, seq LONG, row STRING"
TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


class ChangeLog:
    """Rows of the stations that each micro-batch touched; a station's present rows are those of its newest batch."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def write(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def _present(self) -> DataFrame:
        log = self.spark.read.parquet(self.path)
        newest = log.groupBy(F.col(STATION).alias("_station")).agg(F.max("batch").alias("_newest"))
        same = F.col(STATION).eqNullSafe(F.col("_station")) & (F.col("batch") == F.col("_newest"))
        return log.join(newest, same).drop("_station", "_newest")

    def read(self) -> DataFrame:
        return self._present().drop("batch")

    def compacted(self, path: str) -> ChangeLog:
        """The present rows alone, with their batch numbers, in another folder."""
        self._present().write.partitionBy("batch").parquet(path)
        return ChangeLog(self.spark, path)


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, poll: str | None) -> StreamingQuery:
    """Run ``each`` on the changes of every micro-batch: every ``poll``, or until the source is drained if None."""
    for key, value in STORE.items():
        stream.sparkSession.conf.set(key, value)
    writer = stream.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)).start()


def st_latest(stream: DataFrame, log: ChangeLog, checkpoint: str, poll: str | None = POLL) -> StreamingQuery:
    """Newest record per station by event time; one row per station and task is shuffled."""
    return run(latest_per_station(stream), log.write, checkpoint, poll)


def st_status(stream: DataFrame, log: ChangeLog, checkpoint: str, poll: str | None = POLL) -> StreamingQuery:
    """Rows received and newest timestamp per station."""
    counts = stream.groupBy(STATION).agg(F.count(F.lit(1)).alias("received"), F.max("timestamp").alias("latest"))
    return run(counts, log.write, checkpoint, poll)


# --- the newest rows of every station ----------------------------------------------------
def pack(rows: DataFrame) -> DataFrame:
    """Order values without nulls, and the row as text: nulls, NaN and every column survive the way through pandas."""
    low = F.lit(EARLIEST)
    whole = F.to_json(F.struct(*rows.columns), TIMES)
    return rows.select(
        F.col(STATION).cast("string").alias(STATION), F.coalesce(micros(F.col("timestamp")), low).alias("at"),
        F.coalesce(F.col("seq").cast("long"), low).alias("seq"), whole.alias("row"),
    )


def unpack(packed: DataFrame, schema: T.StructType) -> DataFrame:
    return packed.select(F.from_json("row", schema, TIMES).alias("_r")).select("_r.*")


def cut(packed: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` newest rows per station and Arrow batch: a busy station sends little of a large micro-batch."""

    def newest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ordered = frame.sort_values(["at", "seq", "row"], ascending=False)
            yield ordered.groupby(STATION, dropna=False, sort=False).head(rows)

    return packed.mapInPandas(newest, PACKED)


class Recent(StatefulProcessor):
    """The newest rows of a station; emits them as they stood before the micro-batch, or as they stand after it."""

    def __init__(self, rows: int, before: bool, ttl_ms: int | None) -> None:
        self.rows, self.before, self.ttl_ms = rows, before, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("recent", HELD, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        best = old
        for frame in rows:
            fresh = zip(frame["at"].tolist(), frame["seq"].tolist(), frame["row"].tolist())
            best = sorted([*best, *fresh], reverse=True)[: self.rows]
        self.held.put(best)
        out = pd.DataFrame(old if self.before else best, columns=["at", "seq", "row"])
        out.insert(0, STATION, key[0])
        yield out

    def close(self) -> None:
        pass


def recent(stream: DataFrame, rows: int = BUFFER_ROWS, before: bool = False, ttl_ms: int | None = None) -> DataFrame:
    """For every station in a micro-batch its newest rows, packed. With ``ttl_ms``, rows untouched for so long are forgotten."""
    mode = "None" if ttl_ms is None else "ProcessingTime"
    return cut(pack(stream), rows).groupBy(STATION).transformWithStateInPandas(Recent(rows, before, ttl_ms), PACKED, "Update", mode)


def st_buffer(stream: DataFrame, log: ChangeLog, checkpoint: str, rows: int = BUFFER_ROWS, poll: str | None = POLL, ttl_ms: int | None = None) -> StreamingQuery:
    """The newest rows of every station."""
    schema = stream.schema
    return run(recent(stream, rows, ttl_ms=ttl_ms), lambda batch, number: log.write(unpack(batch, schema), number), checkpoint, poll)


def st_features(
    stream: DataFrame, out: str, checkpoint: str, rows: int = BUFFER_ROWS, poll: str | None = POLL, ttl_ms: int | None = None,
    lags: tuple[int, ...] = LAGS, windows: tuple[int, ...] = WINDOWS,
) -> StreamingQuery:
    """Backward-looking features of new rows.

    The state only hands out the rows that came before; features are the windows of the batch operator over these and
    the new rows, so a busy station is cut into chunks as it is there. A row that arrives later than its
    station's ``rows`` newest ones sees what of its past is still held.
    """
    if rows < max([*lags, *windows]):
        raise ValueError(f"{rows} rows are fewer than the features look back")
    schema = stream.schema
    old = recent(stream, rows, before=True, ttl_ms=ttl_ms).select(F.lit(False).alias("_new"), "row")
    new = pack(stream).select(F.lit(True).alias("_new"), "row")

    def each(batch: DataFrame, number: int) -> None:
        table = batch.select("_new", F.from_json("row", schema, TIMES).alias("_r")).select("_new", "_r.*").persist()
        features = add_temporal_features(table, SeriesLayout.measure(table), lags, windows)
        features.filter("_new").drop("_new").write.mode("overwrite").parquet(f"{out}/batch={number}")
        table.unpersist()

    return run(new.unionByName(old), each, checkpoint, poll)
