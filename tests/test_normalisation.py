"""Work per record: texts are searched once, and a micro-batch is normalised once."""

import datetime as dt

from pyspark.sql import functions as F

from veleta.functions.parse import parse_epoch, parse_number
from veleta.sources.payload import norm_keys, normalize_records
from veleta.sources.store import ObservationStore
from veleta.streaming import live as L


def test_regions_are_searched_once_per_record(spark):
    raw = spark.createDataFrame([({"sid": "A", "state": "Assam"},), ({"sid": "B", "lat": "20", "lon": "77.1"},), ({"sid": "C", "lat": "x"},)], "raw map<string,string>")
    placed = normalize_records(raw).select("station_id", "latitude", "longitude")
    assert placed._jdf.queryExecution().optimizedPlan().toString().count("upper(") == 1
    assert {tuple(r) for r in placed.collect()} == {("A", 26.2006, 92.9376), ("B", 20.0, 77.1), ("C", 20.5937, 78.9629)}


def test_numbers_epochs_and_colliding_keys(spark):
    texts = [" 1e3 ", "-5", "NaN", "-888", "-888.00", "9999.00", "12-3", None, "1e-2", "1700000000", "1.7E12", "2024-01-02", "99/1", "0x10"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [tuple(r) for r in df.orderBy("i").select(parse_number(F.col("t")), parse_epoch(F.col("t"))).collect()]
    assert [n for n, _ in got] == [1000.0, -5.0, None, None, -888.0, None, None, None, 0.01, 1.7e9, 1.7e12, None, None, None]
    assert [e for n, e in got if n and e] == [dt.datetime(2023, 11, 14, 22, 13, 20)] * 2
    keyed = spark.sql("SELECT map('A b', '1', 'a_B', '2', 'c', null) AS raw").select(norm_keys(F.col("raw")).alias("m"))
    assert keyed.first()["m"] == {"a_b": "2", "c": None}


def test_a_micro_batch_is_normalised_once(spark, tmp_path, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(name):
        seen.add(1)
        return name

    whole, counted = L.normalize_records, counted.asNondeterministic()
    monkeypatch.setattr(L, "normalize_records", lambda records: whole(records).withColumn("station_name", counted("station_name")))
    rows = [(i, f'{{"id":"S{i % 3}","timestamp":"{"unknown" if i == 7 else f"2024-01-01 0{i % 9}:00:00"}"}}') for i in range(20)]
    path = str(tmp_path / "in")
    payloads = spark.createDataFrame(rows, "seq long, payload string")
    payloads.write.parquet(path)
    store = ObservationStore(spark, str(tmp_path / "store"))
    L.st_ingest(spark.readStream.schema(payloads.schema).parquet(path), store, str(tmp_path / "cp"), None).awaitTermination()
    assert seen.value == 20
    keys = {}
    for i in range(20):
        if i != 7:
            keys.setdefault((f"S{i % 3}", i % 9), i)
    assert {(r["station_id"], r["timestamp"].hour): r["seq"] for r in store.read().collect()} == keys
    assert spark.read.parquet(L.quarantine_of(store)).count() == 1
