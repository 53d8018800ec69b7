"""Stream state in the state store: restarts in mid-stream, late rows, odd values, a busy station, compaction."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from veleta.operators.filters import history_recent
from veleta.operators.temporal import add_temporal_features
from veleta.streaming import keyed as K
from veleta.streaming import live as L

AT = dt.datetime(2024, 3, 1, 0, 0, 0, 123457)
SCHEMA = "station_id STRING, timestamp TIMESTAMP_NTZ, seq LONG, temperature_c DOUBLE, note STRING"


def observations():
    """Station A has most rows; others are few, null, or carry NaN, nulls and large numbers."""
    rows = [("A", AT + dt.timedelta(hours=i), i, float(i % 17), None) for i in range(300)]
    rows += [("B", AT + dt.timedelta(hours=i), 2**60 + i, math.nan if i % 3 == 0 else None, "x\"\n,é") for i in range(12)]
    rows += [(None, AT + dt.timedelta(hours=i), i, 1.5, "") for i in range(5)]
    return rows


def drained(spark, folder, parts, begin):
    """Each part arrives, is drained by a query of its own, and the next goes on from the checkpoint."""
    for number, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).repartition(3).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
        begin(stream, f"{folder}/cp").awaitTermination()


def told(df, cols=None):
    return sorted(map(str, df.select(*(cols or df.columns)).collect()))


def test_buffer_after_a_restart_holds_the_newest_rows(spark, tmp_path):
    rows = observations()
    late = rows[::2], rows[1::2]  # the second part is older and newer than the first by turns
    log = K.ChangeLog(spark, str(tmp_path / "log"))
    drained(spark, str(tmp_path), late, lambda stream, cp: K.st_buffer(stream, log, cp, 7, None))
    whole = spark.createDataFrame(rows, SCHEMA)
    assert told(log.read(), whole.columns) == told(history_recent(whole, 7))
    packed = log.compacted(str(tmp_path / "small"))
    assert told(packed.read(), whole.columns) == told(log.read(), whole.columns)
    assert spark.read.parquet(packed.path).count() == packed.read().count() == 7 + 7 + 5


def test_features_after_a_restart_equal_the_batch(spark, tmp_path):
    rows = sorted(observations(), key=lambda r: r[1])
    parts = rows[:40], rows[40:41], rows[41:]
    drained(spark, str(tmp_path), parts, lambda stream, cp: K.st_features(stream, str(tmp_path / "out"), cp, 6, None))
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = add_temporal_features(spark.createDataFrame(rows, SCHEMA))
    assert sorted(got.columns) == sorted(want.columns)
    assert told(got, want.columns) == told(want)
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError):
        K.st_features(stream, str(tmp_path / "other"), str(tmp_path / "cp2"), 5, None)


def test_aggregates_write_only_touched_stations(spark, tmp_path):
    rows = observations()
    parts = rows, [("B", AT + dt.timedelta(days=30), 1, 2.0, None)], []
    latest, status = (K.ChangeLog(spark, str(tmp_path / n / "log")) for n in ("latest", "status"))
    drained(spark, str(tmp_path / "latest"), parts, lambda stream, cp: K.st_latest(stream, latest, cp, None))
    drained(spark, str(tmp_path / "status"), parts, lambda stream, cp: K.st_status(stream, status, cp, None))
    log = spark.read.parquet(latest.path)
    assert [r[0] for r in log.filter("batch = 1").select("station_id").collect()] == ["B"]
    newest = {r.station_id: (r.timestamp, r.seq) for r in latest.read().collect()}
    assert newest == {"A": rows[299][1:3], "B": (AT + dt.timedelta(days=30), 1), None: rows[-1][1:3]}
    total = L.status_of(status.read()).first()
    assert tuple(total) == (len(rows) + 1, 3, AT + dt.timedelta(days=30))


def test_a_busy_station_is_cut_before_the_shuffle(spark):
    rows = spark.createDataFrame([("A", AT, i, float(i), None) for i in range(1000)], SCHEMA).coalesce(1)
    left = K.unpack(K.cut(K.pack(rows), 5), rows.schema)
    assert sorted(r.seq for r in left.collect()) == [995, 996, 997, 998, 999]
    assert K.cut(K.pack(rows.filter("seq < 0")), 5).count() == 0


def test_rows_without_time_or_number_come_last(spark):
    rows = spark.createDataFrame([("A", None, 3, 1.0, None), ("A", AT, None, 2.0, None), ("A", AT, 1, 3.0, None)], SCHEMA).coalesce(1)
    assert [r.temperature_c for r in K.unpack(K.cut(K.pack(rows), 2), rows.schema).collect()] == [3.0, 2.0]
    assert K.pack(rows).filter(F.col("at").isNull() | F.col("seq").isNull()).count() == 0
