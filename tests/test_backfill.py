"""Backfill in chunks: stopped anywhere and run again; repeated rows found by a filter of hashes."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veleta.operators.audit import agg_dup_rows, repeated_rows
from veleta.sources.store import Backfill, ObservationStore

START, END = dt.datetime(2024, 1, 1), dt.datetime(2024, 4, 10, 12)
SCHEMA = "station_id STRING, timestamp TIMESTAMP_NTZ, seq LONG, temperature_c DOUBLE"


def history():
    rows = [("A", START + dt.timedelta(hours=7 * i), i, 1.0) for i in range(400)]  # beyond the end too
    rows += [("B", START + dt.timedelta(days=40, hours=i // 2), i, 2.0) for i in range(20)]  # every key twice
    return [*rows, ("A", START - dt.timedelta(hours=1), 900, 0.0), (None, START, 901, 0.0), ("C", None, 902, 0.0)]


def keys(rows):
    return {(r[0], r[1]) for r in rows if r[0] and r[1] and START <= r[1] < END}


def test_backfill_goes_on_where_it_was_stopped(spark, tmp_path):
    rows, asked = history(), []
    table = spark.createDataFrame(rows, SCHEMA).cache()
    held = ObservationStore(spark, str(tmp_path / "store"))
    assert held.insert_ignore(table.filter("station_id = 'A' AND seq < 10")) == 10  # were there before

    def provider(first, after):
        asked.append((first, after))
        return table

    assert Backfill(held, START, START + dt.timedelta(days=25)).run(provider) == 86 - 10  # within the first chunk
    whole = Backfill(held, START, END)
    assert [c[0] for c in whole.missing()] == [0, 1, 2, 3] and whole.chunks()[-1][2] == END

    def lost(first, after):
        if first > START:
            raise RuntimeError("the driver is lost")
        return provider(first, after)

    with pytest.raises(RuntimeError):
        whole.run(lost, group=1)
    # a commit that inserted but was not logged as done
    whole._write("begun", whole.chunks()[1:2])
    held.insert_ignore(whole._inside(table, *whole.chunks()[1][1:]))
    assert [c[0] for c in whole.missing()] == [1, 2, 3]
    whole.run(provider, group=2)
    assert asked[-2:] == [(whole.chunks()[1][1], whole.chunks()[2][2]), whole.chunks()[3][1:]]
    assert whole.run(provider) == 0 and len(asked) == 4
    stored = held.read().select("station_id", "timestamp").collect()
    assert {tuple(r) for r in stored} == keys(rows) and len(stored) == len(keys(rows))
    count = Counter((t - START).days // 30 for _, t in keys(rows))
    count[0] -= 10
    got = sorted(map(tuple, whole.progress().collect()))
    sums = [sum(count[j] for j in range(i + 1)) for i in range(4)]
    assert got == [(i, count[i], sums[i], [1, 2, 2, 2][i], [30.0, 60.0, 90.0, 100.0][i]) for i in range(4)]


def test_backfill_of_nothing(spark, tmp_path):
    empty = Backfill(ObservationStore(spark, str(tmp_path / "store")), START, END)
    assert empty.run(lambda first, after: spark.createDataFrame([], SCHEMA)) == 0 and empty.missing() == []
    assert [r.new_records for r in empty.progress().orderBy("chunk").collect()] == [0] * 4
    with pytest.raises(ValueError):
        Backfill(empty.store, END, START)


def test_repeated_rows_equal_a_count(spark):
    rows = [("A", START, i, float(i % 7)) for i in range(500)] + [(None, None, None, None)] * 300 + [("B", START, i % 50, None) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = {r: n for r, n in Counter(rows).items() if n > 1}
    assert {tuple(r)[:-1]: r["_n"] for r in repeated_rows(df).collect()} == want
    assert agg_dup_rows(df).first()[0] == sum(want.values()) - len(want)
    assert agg_dup_rows(df.filter("seq < 0")).first()[0] == 0
    plan = repeated_rows(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    few = df.filter(F.col("station_id") == "A")
    assert repeated_rows(few).count() == 0
