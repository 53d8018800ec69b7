"""Registered queries against their DuckDB counterparts on the smallest data."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
NAMES = [
    "dedup_last", "dedup_first", "filter_time_station", "history_recent", "range_preset", "anti_existing", "join_neighbor_obs",
    "qf_duplicate_ts", "preprocess", "split_chrono", "feat_lag", "feat_rolling", "baseline_apply", "knn_stations", "feat_agreement",
    "robust_scale", "validate_report", "agg_missing", "audit_interval_mode", "audit_describe", "audit_hist", "adaptive_history",
    "adaptive_summary", "fault_summary", "qc_score", "wx_score", "fault_evidence", "severity", "health_scores", "pr_auc",
    "class_report", "ev_weights", "ev_ensemble", "src_csv", "sink_insert_ignore", "sink_registry_upsert", "sink_refresh_year",
    "backfill_chunks", "norm_coord_repair", "norm_units", "st_dedup", "st_features", "st_latest", "norm_timestamp", "norm_timestamp_layouts",
    "agg_dup_rows", "join_health", "fix_coords_update", "baseline_fit", "rule_drift", "st_ingest",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    df = contract.queries()[name](spark, SF)
    cols = sorted(df.columns)
    ours = Counter(tuple(r[c] for c in cols) for r in df.collect())
    rel = duck.sql(contract.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    order = [rel.columns.index(c) for c in cols]
    theirs = Counter(tuple(r[i] for i in order) for r in rel.fetchall())
    assert ours == theirs


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
