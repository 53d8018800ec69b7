"""Cases that reviews of the first round found wrong or unchecked."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from veleta.catalog import common as C
from veleta.fixed_values import COUNTRY_BOX
from veleta.functions.parse import parse_timestamp
from veleta.operators import anomaly as A
from veleta.operators.feature_prep import decision_features, fit_scaling
from veleta.operators.order_stats import BINS, _bin, _with_range, quantiles, values_at_ranks
from veleta.sources.store import ObservationStore, outside_box
from veleta.streaming import live

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("text, want", [
    ("2026-09-21T09:15:00Z", "2026-09-21 09:15:00"), ("2026-09-21T09:15:00+05:30", "2026-09-21 03:45:00"), ("2026-09-21T09:15:00.123", "2026-09-21 09:15:00.123"),
    ("21-09-2026 9:15", "2026-09-21 09:15:00"), ("1-9-2026 09:15:00", "2026-09-01 09:15:00"), ("21 Sep 2026 09:15", "2026-09-21 09:15:00"),
    ("1 september 2026", "2026-09-01 00:00:00"), ("2026-09-21", "2026-09-21 00:00:00"), ("21/09/2026", "2026-09-21 00:00:00"), ("2026", None), ("T09:15", None),
    ("31/31/2024", None), ("21 Foo 2026", None), ("2026-09-21 25:00", None), ("", None), ("soon", None),
])
def test_layouts(spark, text, want):
    got = spark.createDataFrame([(text,)], "t STRING").select(parse_timestamp(F.col("t")).alias("t")).first()["t"]
    assert got == (dt.datetime.fromisoformat(want) if want else None)


def test_unreadable_records_are_kept(spark, tmp_path):
    arrivals = str(tmp_path / "in")
    records = [(1, '[{"sid": "A", "timestamp": "2026-09-21T09:15:00Z", "t": "20"}]'), (2, '[{"sid": "B", "timestamp": "some day", "t": "21"}]')]
    spark.createDataFrame(records, "seq LONG, payload STRING").write.parquet(arrivals)
    store = ObservationStore(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema("seq LONG, payload STRING").parquet(arrivals)
    live.st_ingest(stream, store, str(tmp_path / "cp"), None).awaitTermination()
    assert [r.station_id for r in store.read().collect()] == ["A"]
    assert [r.station_id for r in spark.read.parquet(live.quarantine_of(store)).collect()] == ["B"]


def test_damaged_store_is_not_empty(spark, tmp_path):
    assert ObservationStore(spark, str(tmp_path / "none")).read().count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        ObservationStore(spark, str(tmp_path / "bad")).read().count()
    with pytest.raises(Exception):
        live.SlotTable(spark, str(tmp_path / "state")).read(3)
    assert live.SlotTable(spark, str(tmp_path / "state")).read(0) is None


def test_two_bad_places_keep_their_rows(spark):
    rows = spark.createDataFrame([("A", 0.0, 0.0), ("A", 80.0, 10.0), ("B", 20.0, 78.0), ("C", None, None)], "station_id STRING, latitude DOUBLE, longitude DOUBLE")
    assert [r.o for r in rows.select(outside_box(COUNTRY_BOX).alias("o")).collect()] == [True, True, False, False]


def test_flags_are_features(spark):
    df = spark.createDataFrame([(True, False, 1.0), (False, False, 3.0), (None, True, 2.0)], "rule_spike BOOLEAN, qc_passed BOOLEAN, x DOUBLE")
    assert decision_features(df) == ["rule_spike", "qc_passed", "x"]
    scaling = fit_scaling(df, ["rule_spike", "x"])
    assert scaling.median == {"rule_spike": 0.5, "x": 2.0}
    assert scaling.with_array(df).count() == 3


def test_quantiles_of_close_values_without_hot_bins(spark):
    rng = np.random.default_rng(1)
    values = np.round(rng.uniform(995, 1015, 100_000), 9)
    df = spark.createDataFrame([(i % 2, float(v)) for i, v in enumerate(values)], "k INT, v DOUBLE").cache()
    probs = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    got = quantiles(df, [], ["v"], probs, False).first()
    assert np.allclose([got[f"v_q{i}"] for i in range(6)], np.quantile(values, probs), atol=1e-9)
    by_key = {r.k: r for r in quantiles(df, ["k"], ["v"], [0.5], False).collect()}
    assert all(abs(by_key[k].v_q0 - np.median(values[k::2])) < 1e-9 for k in (0, 1))
    bins = _with_range(df, ["k"], "v").withColumn("b", _bin("v")).groupBy("k", "b").count()
    assert bins.agg(F.max("count")).first()[0] < 100_000 / BINS * 5


def test_quantiles_with_an_outlier_and_one_value(spark):
    values = [5.0] * 1000 + [5.0 + i * 1e-7 for i in range(1000)] + [1e12]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    got = quantiles(df, [], ["v"], [0.25, 0.5, 0.9, 1.0], False).first()
    assert np.allclose([got[f"v_q{i}"] for i in range(4)], np.quantile(values, [0.25, 0.5, 0.9, 1.0]), rtol=1e-12)
    same = spark.createDataFrame([(7.0,)] * 9, "v DOUBLE")
    assert quantiles(same, [], ["v"], [0.3], False).first()["v_q0"] == 7.0
    assert values_at_ranks(df, "v", F.col("v"), [0, 1, 5000]) == [5.0, 5.0000001, None]


def test_scoring_a_table_that_the_fit_did_not_see(spark):
    """Features of unseen and sensor-less stations equal those of a model whose sizes come from that table."""
    from veleta.operators.series import SeriesLayout
    from veleta.plans.features import clean

    grid = C.grid(spark, SF)
    known = grid.filter(F.col("station_no") < 8)
    layout = SeriesLayout.measure(known)
    from veleta.plans.features import fit_features

    model = fit_features(clean(known, layout), clean(known, layout), layout)
    table = grid.withColumn("temperature_c", F.when(F.col("station_no") != 12, F.col("temperature_c")))
    own = SeriesLayout.measure(table)
    cleaned = clean(table, own)
    out = model.for_table(cleaned, own).transform(cleaned)
    whole = fit_features(clean(known, layout), cleaned, own)
    whole.baselines = model.baselines
    names = ["station_id", "timestamp", "seq", "temperature_c_clean", "neighbor_temperature_c_mean", "pressure_hpa_robust_z", "rule_any_fault"]
    rows = sorted(map(tuple, out.select(*names).collect()), key=repr)
    assert rows == sorted(map(tuple, whole.transform(cleaned).select(*names).collect()), key=repr)
    unseen = out.filter(F.col("station_no") >= 8)
    assert unseen.filter(F.col("temperature_c_clean").isNull()).count() == 0
    assert unseen.filter(F.col("neighbor_pressure_hpa_mean").isNotNull()).count() > 0


@pytest.fixture(scope="module")
def planted(spark):
    """Rows around a centre, one in a hundred far away."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(3000):
        far = i % 100 == 7
        x = rng.normal(0, 1, 6) + (rng.choice([-1, 1]) * 12 if far else 0)
        rows.append((f"S{i % 5}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i, float(i % 3), bool(far), *map(float, x)))
    names = ", ".join(f"f{j} DOUBLE" for j in range(6))
    return spark.createDataFrame(rows, f"station_id STRING, timestamp TIMESTAMP_NTZ, seq LONG, p_robust_z DOUBLE, far BOOLEAN, {names}").cache()


def test_detectors_rank_planted_outliers_first(planted):
    fitted = A.fit_anomaly(planted)
    assert set(fitted.models) == {"lof", *A.SCORERS}
    out = fitted.transform(planted).toPandas()
    for short in ("if", "lof", "ocsvm", "elliptic", "mahalanobis"):
        score = out[f"{short}_anomaly_score"]
        assert score.between(0, 1).all()
        if short != "lof":  # the planted rows are near one another, as its neighbours may be
            assert score[out["far"]].mean() > score[~out["far"]].mean() + 0.2
    assert out["combined_anomaly_score"].between(0, 1).all()
    combined = out["combined_anomaly_score"]
    assert combined[out["far"]].mean() > combined[~out["far"]].mean() + 0.1


def test_detectors_do_not_depend_on_partitions(planted):
    one, other = (A.fit_isolation_forest(A.fit_scaling(df, ["f0", "f1"]).with_array(df)) for df in (planted, planted.repartition(3)))
    assert all((a["cut"] == b["cut"]).all() for a, b in zip(one["trees"], other["trees"]))
    assert one["size"] == 256 and len(one["trees"]) == 100


def plain_lof(x, k=5):
    """Factor of every row against all rows, itself included, and that of the fit."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    reach = np.take_along_axis(d, near, axis=1)[:, -1]
    density = 1 / (np.maximum(np.take_along_axis(d, near, axis=1), reach[near]).mean(axis=1) + 1e-10)
    np.fill_diagonal(d, 0)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    own = 1 / (np.maximum(np.take_along_axis(d, near, axis=1), reach[near]).mean(axis=1) + 1e-10)
    return density[near].mean(axis=1) / own


def test_outlier_factor_against_brute_force(spark, planted):
    from veleta.operators import local_outliers as L

    cols = [f"f{j}" for j in range(6)]
    rows = A.fit_scaling(planted, cols).with_array(planted).filter(F.col("seq") < 2000).select(*L.KEYS, "features").cache()
    x = np.array([r.features for r in rows.orderBy("seq").collect()])
    want = plain_lof(x)

    def scores(model, df):
        return np.array([r._raw_lof for r in model.score(df).orderBy("seq").collect()])

    assert np.allclose(scores(L.fit_lof(rows, 2000), rows), want, rtol=1e-6)
    blocks = L.fit_lof(rows, 2000, block_rows=150)
    assert len(blocks.cells.cell) > 20
    assert np.allclose(scores(blocks, rows), want, rtol=1e-6)
    assert np.allclose(scores(L.fit_lof(rows.repartition(7), 2000, block_rows=300), rows.repartition(3)), want, rtol=1e-6)


def test_live_pipeline_equals_the_batch(spark, tmp_path):
    from veleta.catalog import ingest as I
    from veleta.operators.serve import latest_per_station
    from veleta.sources.store import registry_of

    rows = C.obs(spark, SF).selectExpr("timestamp", "seq", f"to_json({I.RECORD}) AS r").selectExpr("timestamp", "seq", f"{I.WRAPPED} AS payload")
    arrivals = str(tmp_path / "in")
    for part in ("seq % 3 = 0", "seq % 3 = 1", "seq % 3 = 2"):
        rows.filter(part).coalesce(1).write.mode("append").parquet(arrivals)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(arrivals).select("seq", "payload")
    store = ObservationStore(spark, str(tmp_path / "store"))
    paths = live.LivePaths(live.SlotTable(spark, str(tmp_path / "registry")), live.SlotTable(spark, str(tmp_path / "latest")), str(tmp_path / "years"), str(tmp_path / "feed"))
    decide = lambda df: df.withColumn("prediction", F.when(F.col("pressure_hpa") < 1000, "SENSOR_FAULT").otherwise("NORMAL"))
    query = live.live_pipeline(stream, store, paths, decide, str(tmp_path / "cp"), None)
    query.awaitTermination()
    last = query.lastProgress["batchId"]
    names = ["station_id", "oldest_timestamp", "latest_timestamp", "records"]

    def same(a, b, cols):
        assert sorted(map(tuple, a.select(*cols).collect())) == sorted(map(tuple, b.select(*cols).collect()))

    same(paths.registry.read(last), registry_of(store.read()), names)
    same(paths.latest.read(last), latest_per_station(store.read()), ["station_id", "timestamp", "seq"])
    same(spark.read.parquet(paths.years), store.read(), ["station_id", "timestamp", "seq"])
    want = decide(latest_per_station(store.read())).filter("prediction <> 'NORMAL'")
    same(spark.read.parquet(f"{paths.feed}/batch={last}"), want, ["station_id", "timestamp"])


def test_backfill_inserts_once(spark, tmp_path):
    from veleta.sources.store import backfill

    rows = C.grid(spark, SF)
    store = ObservationStore(spark, str(tmp_path / "store"))

    def provider(first, after):
        return rows.filter((F.col("timestamp") >= F.lit(str(first)).cast("timestamp_ntz")) & (F.col("timestamp") < F.lit(str(after)).cast("timestamp_ntz")))

    span = dt.date(2024, 1, 1), dt.date(2024, 2, 1)
    done = backfill(store, provider, *span, 10)
    assert [d[0] for d in done] == [0, 1, 2, 3] and done[-1][2] == store.read().count() == rows.count() and done[-1][3] == 100.0
    assert sum(d[1] for d in done) == rows.count()
    assert sum(d[1] for d in backfill(store, provider, *span, 10)) == 0


def test_registered_chain_is_the_whole_job(spark, monkeypatch):
    import inspect
    from types import SimpleNamespace

    from veleta.catalog import models
    from veleta.operators import decision, expected
    from veleta.plans import train

    full = spark.createDataFrame([("A", {"NORMAL": 1.0}, "none")], "station_id STRING, class_probabilities MAP<STRING, DOUBLE>, correction STRING")
    calls = []

    def job(*args, **named):
        used = inspect.signature(train.train_job).bind(*args, **named)
        used.apply_defaults()
        calls.append(used.arguments)
        return SimpleNamespace(engine=SimpleNamespace(score_batch=lambda rows: full))

    monkeypatch.setattr(models, "train_job", job)
    monkeypatch.setattr(models.C, "once", lambda s, d, name, make: make())
    assert models.QUERIES["score_batch"](spark, SF).columns == full.columns
    (used,) = calls
    assert used["consistency"] and (used["regressors"] or expected.CANDIDATES) == expected.CANDIDATES
    assert (used["classifiers"] or decision.CANDIDATES) == decision.CANDIDATES


def test_outlier_factor_with_many_equal_rows(spark):
    """A third of the rows are alike, and leaves are small: neighbours and factors are those of brute force."""
    from veleta.operators import local_outliers as L

    rng = np.random.default_rng(5)
    own = rng.normal(size=(1400, 6))
    own[:300] = own[0] + rng.normal(scale=0.05, size=(300, 6))  # close to the equal rows, but different
    x = np.vstack([own, np.repeat(own[:1], 700, axis=0)])
    at = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("A", at, i, v.tolist()) for i, v in enumerate(x)], "station_id STRING, timestamp TIMESTAMP_NTZ, seq LONG, features ARRAY<DOUBLE>").repartition(5).cache()
    model = L.fit_lof(rows, len(x), block_rows=64)
    got = np.array([r._raw_lof for r in model.score(rows).orderBy("seq").collect()])
    want = plain_lof(x)
    assert model.reference.count() == 1400 and np.isfinite(got).all()
    # the factor of a row whose neighbours tie with equal rows depends on which of the ties are taken
    assert (np.abs(got / want - 1) < 1e-6).mean() > 0.99
    # blocks asked are fewer than all, and neighbours are those of brute force on the different rows
    assert model.reference.groupBy("block").count().agg(F.max("count")).first()[0] <= 2 * 64
    held = model.reference.select("row", "features", "copies", "block")
    found = L._closest(L.neighbours(held, model.cells, held, ["row"], 5, [], itself=False).withColumn("copies", F.lit(1).cast("long")), ["row"], 5)
    ids = {r.row: np.array(r.features) for r in held.select("row", "features").collect()}
    points = np.array(list(ids.values()))
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    true = dict(zip(ids, np.sort(d, axis=1)[:, :5]))
    mine = {}
    for r in found.orderBy("row", "dist").collect():
        mine.setdefault(r.row, []).append(r.dist)
    assert all(np.allclose(mine[row], true[row]) for row in ids)


def test_blocks_beyond_reach_are_not_asked(spark):
    """Far groups: a row asks its own block and few others; one very full cell is cut into rings."""
    from veleta.operators import local_outliers as L

    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(1500, 3)), *[rng.normal(size=(60, 3)) * 0.1 + 50 * c for c in rng.normal(size=(8, 3))]])
    at = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("A", at, i, v.tolist()) for i, v in enumerate(x)], "station_id STRING, timestamp TIMESTAMP_NTZ, seq LONG, features ARRAY<DOUBLE>").repartition(4).cache()
    model = L.fit_lof(rows, len(x), block_rows=100)
    assert np.unique(model.cells.cell, return_counts=True)[1].max() > 1
    reach = np.full(len(x), 1.0)
    asked = (model.cells.within(x, reach) & np.isfinite(model.cells.low)).sum(axis=1)
    assert asked[1500:].mean() < 0.3 * len(model.cells.cell)
    got = np.array([r._raw_lof for r in model.score(rows).orderBy("seq").collect()])
    assert np.allclose(got, plain_lof(x), rtol=1e-6)
    new = spark.createDataFrame([("B", at, 1, [1e6, 0.0, 0.0])], "station_id STRING, timestamp TIMESTAMP_NTZ, seq LONG, features ARRAY<DOUBLE>")
    assert model.score(new).first()._raw_lof > 1e3
