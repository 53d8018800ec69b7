"""Streams drained to the end and compared with the batch result (survey 2.20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from veleta.catalog import common as C
from veleta.catalog import ingest as I
from veleta.fixed_values import SENSORS
from veleta.operators.filters import time_literal
from veleta.session import scratch_dir
from veleta.sources.store import ObservationStore
from veleta.sources.telemetry import from_events
from veleta.streaming import keyed as K
from veleta.streaming import live as L

QUERIES: dict[str, C.Query] = {}
ORACLES: dict[str, str] = {}
KEYS = ["station_id", "timestamp", "seq"]
RAW = [*KEYS, *SENSORS]
CUTS = [None, "2024-01-11 00:00:00", "2024-01-21 00:00:00", None]


def _in_slices(s, rows, begin, time: str = "ts") -> None:
    """The whole table in three time slices; the stream drains each, stops, and goes on from its checkpoint at the next.

    A slice is as many files as its tasks write. ``begin`` starts a query on a stream and a checkpoint folder.
    """
    path, checkpoint = scratch_dir(s, "arrivals"), scratch_dir(s, "cp")
    for low, high in zip(CUTS, CUTS[1:]):
        part = rows
        if low:
            part = part.filter(F.col(time) >= time_literal(low))
        if high:
            part = part.filter(F.col(time) < time_literal(high))
        part.write.mode("append").parquet(path)
        begin(s.readStream.schema(rows.schema).parquet(path), checkpoint).awaitTermination()


def _observed(s, d, begin) -> None:
    _in_slices(s, s.read.parquet(f"{d}/events.parquet"), lambda events, checkpoint: begin(from_events(events), checkpoint))


def _records(s, d, begin) -> None:
    """Payloads with numbers, as ``begin`` takes them; the time of arrival is not part of the stream."""
    rows = C.obs(s, d).selectExpr("timestamp", "seq", f"to_json({I.RECORD}) AS r").selectExpr("timestamp", "seq", f"{I.WRAPPED} AS payload")
    _in_slices(s, rows, lambda payloads, checkpoint: begin(payloads.select("seq", "payload"), checkpoint), "timestamp")


def _ingested(s, d):
    store = ObservationStore(s, scratch_dir(s, "live"))
    _records(s, d, lambda payloads, checkpoint: L.st_ingest(payloads, store, checkpoint, None))
    return store.read().select("station_id", "timestamp", "seq")


# Rows whose timestamps were missing would get the time of ingest; this input has none.
INGESTED = (f"WITH {C.OBS}, o AS (SELECT station_id, date_trunc('second', timestamp)::TIMESTAMP AS timestamp, seq FROM obs WHERE NOT ({I.DROPPED})) "
            "SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY station_id, timestamp ORDER BY seq) = 1")
QUERIES["st_ingest"] = _ingested
ORACLES["st_ingest"] = INGESTED


def _pushed(s, d):
    """Polled and pushed copies of the same records are stored once."""
    store = ObservationStore(s, scratch_dir(s, "push"))
    _records(s, d, lambda payloads, checkpoint: L.st_ingest(L.st_push(payloads, payloads), store, checkpoint, None))
    return store.read().select("station_id", "timestamp", "seq")


QUERIES["st_push"] = _pushed
ORACLES["st_push"] = INGESTED


def _dedup(s, d):
    out = scratch_dir(s, "dedup")

    def begin(rows, checkpoint):
        rows = rows.select("station_id", F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("timestamp"))
        writer = L.st_dedup(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start()

    _observed(s, d, begin)
    return s.read.parquet(out).select("station_id", "timestamp")


QUERIES["st_dedup"] = _dedup
ORACLES["st_dedup"] = f"WITH {C.HOURLY} SELECT DISTINCT station_id, timestamp FROM hourly"


def _log(s, d, columns, begin) -> K.ChangeLog:
    log = K.ChangeLog(s, scratch_dir(s, "changes"))
    _observed(s, d, lambda rows, checkpoint: begin(rows.select(*columns), log, checkpoint, poll=None))
    return log


def _buffer(s, d):
    return C.rounded(_log(s, d, RAW, K.st_buffer).read())


QUERIES["st_buffer"] = _buffer
ORACLES["st_buffer"] = f"WITH {C.OBS} " + C.rounded_sql(
    f"SELECT {', '.join(RAW)} FROM obs QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY timestamp DESC, seq DESC) <= 100", SENSORS)
FEATURES = [
    *[f"{c}_{f}" for c in SENSORS for f in ("lag1", "lag2", "lag3", "delta", "roll3_mean", "roll3_std", "roll6_mean", "roll6_std")],
    "time_since_prev_obs", "hour", "day_of_week", "day_of_year", "month",
]


def _features(s, d):
    out = scratch_dir(s, "features")
    _observed(s, d, lambda rows, checkpoint: K.st_features(rows.select(*RAW), out, checkpoint, 100, None))
    return C.rounded(s.read.parquet(out).select(*KEYS, *FEATURES))


def _feature_sql() -> str:
    cols = []
    for c in SENSORS:
        cols += [f"lag({c}, {k}) OVER s AS {c}_lag{k}" for k in (1, 2, 3)]
        cols.append(f"{c} - lag({c}) OVER s AS {c}_delta")
        for n in (3, 6):
            f = f"(s ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
            for name, call in (("mean", "avg"), ("std", "stddev_samp")):
                cols.append(f"CASE WHEN count({c}) OVER {f} >= 2 THEN {call}({c}) OVER {f} END AS {c}_roll{n}_{name}")
    return C.rounded_sql(
        f"SELECT station_id, timestamp, seq, {', '.join(cols)}, {C.hours('timestamp', 'lag(timestamp) OVER s')} AS time_since_prev_obs, "
        "hour(timestamp)::INT AS hour, (isodow(timestamp) - 1)::INT AS day_of_week, dayofyear(timestamp)::INT AS day_of_year, month(timestamp)::INT AS month "
        f"FROM obs WINDOW s AS ({C.W})", FEATURES[:-4])


QUERIES["st_features"] = _features
ORACLES["st_features"] = f"WITH {C.OBS} {_feature_sql()}"


def _latest(s, d):
    return C.rounded(_log(s, d, RAW, K.st_latest).read())


QUERIES["st_latest"] = _latest
ORACLES["st_latest"] = f"WITH {C.OBS} " + C.rounded_sql(
    f"SELECT {', '.join(RAW)} FROM obs QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY timestamp DESC, seq DESC) = 1", SENSORS)


def _status(s, d):
    return L.status_of(_log(s, d, KEYS, K.st_status).read())


QUERIES["st_status"] = _status
ORACLES["st_status"] = f"WITH {C.OBS} SELECT count(*) AS observations_received, count(DISTINCT station_id) AS stations_monitored, max(timestamp) AS latest_observation FROM obs"


def _pipeline(s, d):
    """The live pipeline to its end: registry, exported years, current records and the last batch's anomaly feed per station."""
    store = ObservationStore(s, scratch_dir(s, "live"))
    paths = L.LivePaths(L.SlotTable(s, scratch_dir(s, "registry")), L.SlotTable(s, scratch_dir(s, "current")), scratch_dir(s, "years"), scratch_dir(s, "feed"))
    decide = lambda rows: rows.withColumn("prediction", F.when(F.col("seq") % 2 == 0, "NORMAL").otherwise("SENSOR_FAULT"))
    _records(s, d, lambda payloads, checkpoint: L.live_pipeline(payloads, store, paths, decide, checkpoint, None))
    last = len(CUTS) - 2
    registry = paths.registry.read(last).select("station_id", "oldest_timestamp", "latest_timestamp", "records")
    current = paths.latest.read(last).select("station_id", F.col("seq").alias("current_seq"))
    years = s.read.parquet(paths.years).groupBy("station_id").agg(F.count(F.lit(1)).alias("exported"))
    feed = s.read.parquet(f"{paths.feed}/batch={last}").select("station_id", "prediction")
    return registry.join(current, "station_id", "left").join(years, "station_id", "left").join(feed, "station_id", "left")


QUERIES["st_pipeline"] = _pipeline
ORACLES["st_pipeline"] = f"""WITH ing AS ({INGESTED}), cur AS (SELECT station_id, seq AS current_seq FROM ing QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY timestamp DESC, seq DESC) = 1)
    SELECT station_id, min(timestamp) AS oldest_timestamp, max(timestamp) AS latest_timestamp, count(*) AS records, any_value(current_seq) AS current_seq, count(*) AS exported,
    CASE WHEN any_value(current_seq) % 2 = 1 THEN 'SENSOR_FAULT' END AS prediction FROM ing JOIN cur USING (station_id) GROUP BY 1"""
