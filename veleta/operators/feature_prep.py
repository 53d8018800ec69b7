"""Feature selection, median imputation and robust scaling shared by the models."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veleta.operators.order_stats import SMALL_GROUP_ROWS, column_ranks

# Name rules that decide which numeric columns are model features.
DERIVED_PREFIXES = (
    "qf_", "qc_", "rule_", "predicted_", "expected_", "anomaly_",
    "if_", "lof_", "ocsvm_", "elliptic_", "mahalanobis_", "robust_z_",
)
DERIVED_SUFFIXES = ("_residual", "_disagreement", "_variance", "_model_agreement")
NEVER = {"station_id", "timestamp", "station_name", "latitude", "longitude", "seq", "station_no"}
LABELS = {"ground_truth_label", "fault_description"}
SCORES = {"statistical_anomaly_score", "combined_anomaly_score"}


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def anomaly_features(df: DataFrame) -> list[str]:
    prefixes = (*DERIVED_PREFIXES, "ground_truth", "fault_desc", "station_name", "timestamp")
    return [
        c
        for c in numeric_columns(df)
        if c not in NEVER | SCORES and not c.startswith(prefixes) and not c.endswith(DERIVED_SUFFIXES)
    ]


def expected_features(df: DataFrame, target: str) -> list[str]:
    own = tuple(f"{target}_{k}" for k in ("lag", "roll", "delta", "pred_"))
    exact = {target, *[f"{target}_{k}" for k in ("clean", "baseline", "deviation", "robust_z", "residual")]}
    return [
        c
        for c in numeric_columns(df)
        if c not in NEVER | LABELS | SCORES | exact
        and not c.startswith((*DERIVED_PREFIXES, *own))
        and not c.endswith(DERIVED_SUFFIXES)
    ]


def decision_features(df: DataFrame) -> list[str]:
    """Numbers and flags: rule results and the check's verdict count as 0 and 1."""
    names = [f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    return [c for c in names if c not in NEVER | LABELS and not c.startswith("qf_")]


def filled_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row of non-null counts."""
    return df.agg(*[F.count(c).alias(c) for c in cols])


def feature_select(train: DataFrame, cols: Sequence[str], more_than: int) -> list[str]:
    """Columns with more than ``more_than`` values, counted in one pass."""
    counts = filled_counts(train, cols).first()
    return [c for c in cols if counts[c] > more_than]


@dataclass
class Scaling:
    """Per feature: fill value (median), centre and width (interquartile range)."""

    cols: list[str]
    median: dict[str, float]
    width: dict[str, float]
    rows: int

    def scaled(self, df: DataFrame, col: str) -> Column:
        value = F.col(col).cast("double") if col in df.columns else F.lit(None).cast("double")
        value = F.when(~F.isnan(value), value)
        return (F.coalesce(value, F.lit(self.median[col])) - F.lit(self.median[col])) / F.lit(self.width[col])

    def with_vector(self, df: DataFrame, out: str = "features") -> DataFrame:
        """Add the imputed and scaled features as one vector column."""
        names = [f"_s{i}" for i in range(len(self.cols))]
        scaled = df.withColumns({n: self.scaled(df, c) for n, c in zip(names, self.cols)})
        return VectorAssembler(inputCols=names, outputCol=out).transform(scaled).drop(*names)

    def with_array(self, df: DataFrame, out: str = "features") -> DataFrame:
        return df.withColumn(out, F.array(*[self.scaled(df, c) for c in self.cols]))


def _ends(h: float) -> tuple[int, int]:
    """The two nearest ranks."""
    return int(np.floor(h)), int(np.ceil(h))


def _quantile(ordered: np.ndarray | dict[int, float], p: float, count: int | None = None) -> float:
    """Interpolated between the two nearest ranks."""
    h = ((len(ordered) if count is None else count) - 1) * p
    low, high = _ends(h)
    return float(ordered[low]) if low == high else float((high - h) * ordered[low] + (h - low) * ordered[high])


def _filled(ordered: dict[int, float], rank: int, missing: int, median: float) -> float:
    """Value at a rank once the missing values are the median."""
    if rank in ordered and ordered[rank] < median:
        return ordered[rank]
    return max(median, ordered.get(rank - missing, median))


def _quartiles(rows: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        values = np.sort(np.frombuffer(b"".join(frame["part"]), np.float64))
        median = _quantile(values, 0.5)
        filled = np.sort(np.append(values, np.full(rows - len(values), median)))
        return pd.DataFrame({"feature": [frame["feature"].iloc[0]], "median": [median], "low": [_quantile(filled, 0.25)], "high": [_quantile(filled, 0.75)]})

    return run


def _columns_apart(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The known values of each feature of a batch as one row."""
    for frame in frames:
        if len(frame):
            x = np.stack([np.asarray(v, dtype=np.float64) for v in frame["x"]])
            parts = [x[~np.isnan(x[:, j]), j] for j in range(x.shape[1])]
            yield pd.DataFrame({"feature": range(x.shape[1]), "part": [p.tobytes() for p in parts]})


def fit_scaling(train: DataFrame, cols: Sequence[str], rows: int | None = None) -> Scaling:
    """Quartiles are taken of the median-filled column, as imputation precedes scaling. NaN counts as missing.

    Where a column's values fit a task, each column is ordered in one; otherwise ranks of the known values are searched, all in one go.
    """
    cols = list(cols)
    rows = train.count() if rows is None else rows
    known = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols}
    if cols and rows * len(cols) <= SMALL_GROUP_ROWS:
        apart = train.select(F.array(*known.values()).alias("x")).mapInPandas(_columns_apart, "feature INT, part BINARY")
        found = apart.groupBy("feature").applyInPandas(_quartiles(rows), "feature INT, median DOUBLE, low DOUBLE, high DOUBLE").collect()  # a row per feature
        by_col = {cols[r["feature"]]: r for r in found}
        return Scaling(cols, {c: by_col[c]["median"] for c in cols}, {c: by_col[c]["high"] - by_col[c]["low"] or 1.0 for c in cols}, rows)
    names = {c: f"c{i}" for i, c in enumerate(cols)}
    held = train.select(*[known[c].alias(n) for c, n in names.items()])
    counts = filled_counts(held, list(names.values())).first()
    median, width, ranks = {}, {}, {}
    for c, n in names.items():
        some, missing = counts[n], rows - counts[n]
        # Filling moves the rank of a value above the median by the number of missing ones.
        places = [_ends((rows - 1) * p) for p in (0.25, 0.75)]
        ranks[n] = [*_ends((some - 1) * 0.5), *[r for low_high in places for h in low_high for r in (h, h - missing) if 0 <= r < some]]
    found = column_ranks(held, ranks)
    for c, n in names.items():
        some, missing = counts[n], rows - counts[n]
        median[c] = _quantile(found[n], 0.5, some)
        filled = {h: _filled(found[n], h, missing, median[c]) for p in (0.25, 0.75) for h in _ends((rows - 1) * p)}
        width[c] = (_quantile(filled, 0.75, rows) - _quantile(filled, 0.25, rows)) or 1.0
    return Scaling(cols, median, width, rows)
