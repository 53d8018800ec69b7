"""Small fixtures with known answers, and scale paths against the plain ones."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from veleta.operators import fusion, labels, qc, rules, spatial, weather
from veleta.operators.diagnosis import fault_evidence
from veleta.operators.health import health_scores
from veleta.operators.order_stats import quantiles
from veleta.operators.preprocess import flag_temporal_gap, impute
from veleta.operators.series import SeriesLayout
from veleta.sources.payload import norm_batch, src_payload
from veleta.sources.store import ObservationStore, registry_of

T0 = dt.datetime(2023, 1, 1)


def series(spark, column, values, station="S1"):
    rows = [(station, T0 + dt.timedelta(hours=i), i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"station_id string, timestamp timestamp_ntz, seq long, {column} double")


def test_freeze_flags_constant_series(spark):
    out = rules.rule_freeze(series(spark, "relative_humidity_pct", [50.0] * 10))
    assert out.filter("rule_freeze").count() >= 5


def test_spike_is_the_single_excursion(spark):
    out = rules.rule_spike(series(spark, "pressure_hpa", [1010.0] * 4 + [850.0] + [1010.0] * 5), threshold=2.0)
    assert [r.seq for r in out.filter("rule_spike").collect()] == [4]


def test_drift_needs_five_in_a_row(spark):
    out = rules.rule_drift(series(spark, "temperature_c_robust_z", [3.0] * 4 + [None] + [3.0] * 5 + [0.0]))
    assert sorted(r.seq for r in out.filter("rule_drift").collect()) == [5, 6, 7, 8, 9]


def test_health_ranks_the_faulty_station_lower(spark):
    rows = [("a", "NORMAL")] * 10 + [("b", "SENSOR_FAULT")] * 8 + [("b", "NORMAL")] * 2
    got = {r.station_id: r.health_score for r in health_scores(spark.createDataFrame(rows, "station_id string, ground_truth_label string")).collect()}
    assert got["b"] < got["a"] == 100.0


@pytest.mark.parametrize("row, level", [
    (("NORMAL", 0.9, "NONE"), "LOW"), (("SENSOR_FAULT", 0.9, "DRIFT"), "CRITICAL"), (("GENUINE_EXTREME", 0.7, "NONE"), "HIGH")])
def test_severity(spark, row, level):
    df = spark.createDataFrame([row], "p string, s double, f string")
    assert df.select(fusion.severity(F.col("p"), F.col("s"), F.col("f"))).first()[0] == level


def test_distance_chennai_bengaluru(spark):
    from veleta.functions.geo import haversine_km

    km = spark.range(1).select(haversine_km(F.lit(13.0827), F.lit(80.2707), F.lit(12.9716), F.lit(77.5946))).first()[0]
    assert 250 < km < 330


def test_payload_of_a_live_station(spark):
    text = ('{"data":[{"ID":"4952C57C","DISTRICT":"UTTARKASHI","STATE":"UTTARAKHAND","STATION":"PUROLA","DATE":"21-09-2026","TIME":"09:15:00",'
            '"CURR_TEMP":"33.3","RH":"55","MSLP":"889.7","WIND_SPEED":"0","RAINFALL":"0","Latitude":"30.86","Longitude":"78.0"},{"ID":"-"}]}')
    df = spark.createDataFrame([(text, 1)], "payload string, seq long")
    rows = norm_batch(src_payload(df))[0].collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.station_id, r.station_name, r.latitude, r.longitude) == ("4952C57C", "PUROLA (UTTARKASHI, UTTARAKHAND)", 30.86, 78.0)
    assert (r.temperature_c, r.relative_humidity_pct, r.pressure_hpa) == (33.3, 55.0, 889.7)
    assert r.timestamp == dt.datetime(2026, 9, 21, 9, 15)


def test_units_and_markers(spark):
    texts = ['[{"id":"A","timestamp":"2026-01-01 00:00:00","temperature":"86.0","pressure":"101325","wind_speed_ms":"10","rainfall_cm":"2.5"}]',
             '{"id":"B","timestamp":"2026-01-01 00:00:00","temp":"NA","pressure":"-999.0","ws":"null","rain":""}']
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "payload string, seq long")
    got = {r.station_id: r for r in norm_batch(src_payload(df))[0].collect()}
    assert (got["A"].temperature_c, got["A"].pressure_hpa, got["A"].wind_speed_kmh, got["A"].rainfall_mm) == (86.0, 1013.25, 36.0, 25.0)
    assert (got["B"].temperature_c, got["B"].pressure_hpa, got["B"].wind_speed_kmh, got["B"].rainfall_mm) == (25.0, 1013.25, 0.0, 0.0)


def test_store_keeps_first_and_counts_new(spark, tmp_path):
    rows = [(f"S{s}", T0 + dt.timedelta(hours=h), h, 25 + 0.5 * h) for s in range(3) for h in range(10)]
    df = spark.createDataFrame(rows, "station_id string, timestamp timestamp_ntz, seq long, temperature_c double")
    store = ObservationStore(spark, str(tmp_path / "store"))
    assert store.insert_ignore(df) == 30
    assert store.insert_ignore(df) == 0
    registry = registry_of(store.read()).collect()
    assert {r.records for r in registry} == {10}
    assert {r.latest_timestamp for r in registry} == {T0 + dt.timedelta(hours=9)}


def test_checks_and_weather(spark):
    schema = ("temperature_c double, relative_humidity_pct double, pressure_hpa double, wind_speed_kmh double, rainfall_mm double, temperature_c_delta double, "
              "relative_humidity_pct_delta double, pressure_hpa_delta double, neighbor_agreement_score double, rule_freeze boolean, rule_spike boolean")
    df = spark.createDataFrame([(75.0, 50.0, 1000.0, 5.0, 0.0, None, None, None, None, False, True),
                                (24.0, 85.0, 1002.0, 38.0, 15.0, -3.5, 18.0, -2.1, 1.1, False, False),
                                (24.0, 85.0, 1002.0, 38.0, 15.0, -3.5, 18.0, -2.1, 1.1, True, False)], schema)
    a, b, c = weather.wx_score(qc.qc_score(df)).collect()
    assert not a.qc_passed and a.statistical_anomaly_score == 0.75 and "temperature_c (75.0) outside physical bounds [-10.0, 60.0]" in a.qc_evidence
    assert b.genuine_event_score >= 0.5 and c.genuine_event_score <= 0.15


def test_fault_types(spark):
    schema = "rule_freeze boolean, rule_spike boolean, rule_drift boolean, rule_communication boolean, pressure_hpa_residual double, temperature_c_residual double, temperature_c_robust_z double"
    rows = [(True, False, False, False, None, None, None), (False, True, False, False, -159.4, None, None), (False, False, True, False, None, 3.8, 2.8)]
    got = [(r.fault_type, r.fault_confidence) for r in fault_evidence(spark.createDataFrame(rows, schema)).collect()]
    assert got == [("FREEZE", 0.92), ("SPIKE", 0.95), ("DRIFT", 0.88)]


def test_silver_labels(spark):
    df = spark.createDataFrame([(True, 0.0, 0.0, 0.0), (False, 60.0, 0.0, 0.0), (False, 0.0, 0.7, 0.5), (False, 0.0, 0.1, 0.0)],
                               "rule_freeze boolean, wind_speed_kmh double, combined_anomaly_score double, statistical_anomaly_score double")
    assert [r.ground_truth_label for r in labels.silver_labels_a(df).collect()] == ["SENSOR_FAULT", "GENUINE_EXTREME", "GENUINE_EXTREME", "NORMAL"]
    assert [r.ground_truth_label for r in labels.silver_labels_b(df).collect()] == ["SENSOR_FAULT", "NORMAL", "SENSOR_FAULT", "NORMAL"]


# --- scale paths -------------------------------------------------------------------------
def skewed(spark):
    """One station holds most rows, with gaps, missing values and a frozen stretch."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        ts = T0 + dt.timedelta(minutes=int(i * 20 + (300 if i > 200 else 0)))
        rows.append(("hot", ts, i, None if i < 30 or i % 7 == 0 else float(rng.normal(20, 3)), 60.0 if 100 < i < 110 else float(rng.uniform(20, 90)),
                     600.0 if i % 97 == 50 else float(rng.normal(1000, 2))))
    for s in range(4):
        rows += [(f"S{s}", T0 + dt.timedelta(hours=i), i, float(i % 9), 50.0 + i, 1000.0 + i % 5) for i in range(20)]
    return spark.createDataFrame(rows, "station_id string, timestamp timestamp_ntz, seq long, temperature_c double, relative_humidity_pct double, pressure_hpa double")


@pytest.mark.parametrize("name", ["impute", "gap", "freeze", "spike", "gap_hours"])
def test_chunked_series_equal_whole_series(spark, name):
    step = {"impute": impute, "gap": flag_temporal_gap, "freeze": rules.rule_freeze, "spike": rules.rule_spike, "gap_hours": rules.add_gap_hours}[name]
    df = skewed(spark)
    plain, hot = SeriesLayout.measure(df), SeriesLayout.measure(df, task_rows=100)
    assert not plain.hot and hot.hot == ("hot",)
    a = step(df, plain)
    b = step(df, hot).select(a.columns)
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_ranked_quantiles_equal_percentile(spark):
    rng = np.random.default_rng(3)
    rows = [("big" if i % 3 else "small", float(v), float(v) ** 3, None if i % 5 else float(v)) for i, v in enumerate(rng.normal(0, 40, 2000))]
    df = spark.createDataFrame(rows, "k string, a double, b double, c double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    fast = {r.k: r for r in quantiles(df, ["k"], ["a", "b", "c"], probs, True).collect()}
    wide = {r.k: r for r in quantiles(df, ["k"], ["a", "b", "c"], probs, False).collect()}
    for k, r in fast.items():
        for c in r.asDict():
            if c != "k":
                assert wide[k][c] == pytest.approx(r[c], rel=1e-9)


def test_grid_neighbours_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spatial, "BLOCK_SITES", 20)
    rng = np.random.default_rng(2)
    lat, lon = rng.uniform(8, 35, 120), rng.uniform(68, 97, 120)
    lat[:40], lon[:40] = 20.5937, 78.9629
    rows = [(f"S{i:03d}", float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))]
    got = {}
    for r in spatial.knn_stations(spark.createDataFrame(rows, "station_id string, latitude double, longitude double"), 2).collect():
        got.setdefault(r.station_id, []).append(round(r.distance_km, 6))
    p, l = np.radians(lat), np.radians(lon)
    for i, row in enumerate(rows):
        x = np.sin((p - p[i]) / 2) ** 2 + np.cos(p) * np.cos(p[i]) * np.sin((l - l[i]) / 2) ** 2
        d = 2 * 6371 * np.arcsin(np.sqrt(x))
        d[i] = np.inf
        assert sorted(got[row[0]]) == pytest.approx(sorted(d)[:2], abs=1e-5)
