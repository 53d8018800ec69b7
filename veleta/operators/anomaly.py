"""Anomaly ensemble: six detectors, training-based normalisation, weighted score, consensus.

Fits are distributed steps over the whole training table: moments for the covariance detectors, extreme points of the dual for
the one-class SVM, for each isolation tree its own 256 rows out of all, and joins for the local outlier factor. The limits of
normal scores come from every training row. Scoring is one Arrow pass over the rows with the fitted arrays broadcast, whose
size depends on the number of features, and one join for the local outlier factor.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veleta.fixed_values import DETECTOR_SHORT, DETECTOR_WEIGHTS
from veleta.functions.texts import clip, staged
from veleta.operators import local_outliers
from veleta.operators.feature_prep import Scaling, anomaly_features, feature_select, fit_scaling
from veleta.operators.order_stats import SMALL_GROUP_ROWS, column_ranks, quantiles

log = logging.getLogger(__name__)
TREES, TREE_ROWS = 100, 256
FOURIER, NU = 128, 0.05
SVM_GAP, SVM_STEPS = 1e-3, 300  # duality gap as a share of the objective; steps after which an open gap is reported
SUPPORT, STARTS, TRIAL_STEPS, BEST, C_STEPS = 0.8, 5, 2, 2, 50
SETTLED = 1e-6  # change of the log determinant


# --- isolation forest --------------------------------------------------------------------
def average_path(n):
    """Mean path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    big = 2.0 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2.0 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


TREE_SCHEMA = "tree INT, feature ARRAY<INT>, cut ARRAY<DOUBLE>, left ARRAY<INT>, right ARRAY<INT>, path ARRAY<DOUBLE>"


def _grow(pdf: pd.DataFrame) -> pd.DataFrame:
    """One isolation tree over at most 256 rows, as parallel node arrays."""
    tree = int(pdf["tree"].iloc[0])
    x = np.stack(pdf.sort_values("rank")["features"].to_numpy()[:TREE_ROWS])
    rng = np.random.default_rng(42 + tree)
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes: list[list] = [[-1, 0.0, -1, -1, 0.0]]
    open_nodes = [(0, np.arange(len(x)), 0)]
    while open_nodes:
        node, rows, depth = open_nodes.pop()
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        splittable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(splittable) == 0:
            nodes[node][4] = depth + float(average_path(len(rows)))
            continue
        feature = int(rng.choice(splittable))
        cut = float(rng.uniform(low[feature], high[feature]))
        below = x[rows, feature] <= cut
        left, right = len(nodes), len(nodes) + 1
        nodes += [[-1, 0.0, -1, -1, 0.0], [-1, 0.0, -1, -1, 0.0]]
        nodes[node][:4] = [feature, cut, left, right]
        open_nodes += [(left, rows[below], depth + 1), (right, rows[~below], depth + 1)]
    cols = list(map(list, zip(*nodes)))
    return pd.DataFrame([[tree, *cols]], columns=["tree", "feature", "cut", "left", "right", "path"])


def fit_isolation_forest(train: DataFrame) -> dict:
    """Every tree draws its rows from the whole table: those with the smallest hashes for that tree.

    A row is offered to a tree when its hash lies below a threshold that leaves about twice the rows a tree takes, so
    the table is read once and few rows travel. A table too small for that offers every row to every tree.
    """
    n = train.count()
    share = min(1.0, (2.0 * TREE_ROWS + 200.0) / max(n, 1))
    below = int(-(2**63) + share * (2**64 - 1)) if share < 1.0 else 2**63 - 1
    draws = F.filter(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64("seq", "station_id", "timestamp", t) <= F.lit(below))
    offered = train.select("features", "seq", "station_id", "timestamp", F.explode(draws).alias("tree"))
    offered = offered.withColumn("rank", F.xxhash64("seq", "station_id", "timestamp", "tree"))
    keep = Window.partitionBy("tree").orderBy("rank")
    chosen = offered.withColumn("_n", F.row_number().over(keep)).filter(F.col("_n") <= TREE_ROWS).select("tree", "rank", "features")
    grown = chosen.groupBy("tree").applyInPandas(_grow, TREE_SCHEMA).collect()  # TREES rows of bounded size
    trees = [
        {k: np.array(r[k]) for k in ("feature", "cut", "left", "right", "path")} for r in sorted(grown, key=lambda r: r["tree"])
    ]
    return {"trees": trees, "size": min(n, TREE_ROWS)}


def score_isolation_forest(model: dict, x: np.ndarray) -> np.ndarray:
    rows, total = np.arange(len(x)), np.zeros(len(x))
    for t in model["trees"]:
        node = np.zeros(len(x), dtype=int)
        while True:
            feature = t["feature"][node]
            inner = feature >= 0
            if not inner.any():
                break
            below = x[rows, np.maximum(feature, 0)] <= t["cut"][node]
            node = np.where(inner, np.where(below, t["left"][node], t["right"][node]), node)
        total += t["path"][node]
    return 2.0 ** (-(total / len(model["trees"])) / max(float(average_path(model["size"])), 1e-9))


# --- one-class SVM on random Fourier features --------------------------------------------
def fourier(model: dict, x: np.ndarray) -> np.ndarray:
    return np.sqrt(2.0 / FOURIER) * np.cos(x @ model["waves"] + model["shift"])


def _nearest_to_origin(points: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points and shares of the nearest point of their hull to the origin, from shares that are good for all but the last."""
    while True:
        n = len(points)
        system = np.zeros((n + 1, n + 1))
        system[0, 1:] = system[1:, 0] = 1.0
        system[1:, 1:] = points @ points.T
        flat = np.linalg.lstsq(system, np.eye(n + 1)[0], rcond=None)[0][1:]  # nearest point of the plane through all
        if (flat > 1e-12).all():
            return points, flat
        out = flat <= 1e-12
        step = np.min(shares[out] / np.maximum(shares[out] - flat[out], 1e-300))
        shares = shares + min(step, 1.0) * (flat - shares)
        keep = shares > 1e-12
        keep[np.argmin(shares)] = False  # at least one goes
        points, shares = points[keep], shares[keep] / shares[keep].sum()


def fit_ocsvm(train: DataFrame, width: int, variance: float, rows: int | None = None, nu: float = NU, tolerance: float = SVM_GAP) -> dict:
    """One-class SVM of parameter nu, by extreme points of its dual.

    The dual's points are means of the mapped rows with at most 1 / (nu n) of each; the solution is the one nearest to the
    origin. A step finds the extreme point that lies lowest in the present direction, the mean of the nu n lowest rows,
    by one order statistic and one sum; the driver holds these points only and moves to the nearest point of their hull. The
    duality gap bounds what is left to gain, and the steps stop by it. Reports ``steps``, ``gap`` and ``rho``.
    """
    rng = np.random.default_rng(42)
    gamma = 1.0 / max(width * variance, 1e-12)
    model = {
        "waves": rng.normal(0.0, np.sqrt(2.0 * gamma), (width, FOURIER)),
        "shift": rng.uniform(0.0, 2.0 * np.pi, FOURIER),
    }
    spark = train.sparkSession
    n = train.count() if rows is None else rows
    lowest = max(nu * n, 1.0)  # rows that an extreme point is the mean of
    last = int(np.ceil(lowest)) - 1  # rank of the row that may count in part

    def blocks(frames):
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"z": [fourier(model, np.stack(frame["features"].to_numpy())).tobytes()]})

    mapped = train.select("features").mapInPandas(blocks, "z BINARY").persist()  # a row per batch of rows

    def total(parts: DataFrame) -> np.ndarray:
        """Sum of rows of doubles, in two levels."""

        def added(frame: pd.DataFrame) -> pd.DataFrame:
            held = frame.sort_values("task")
            return pd.DataFrame({"task": [-1], "sums": [np.sum([np.frombuffer(b) for b in held["sums"]], axis=0).tobytes()]})

        schema = "task INT, sums BINARY"
        met = parts.groupBy((F.col("task") % 64).alias("part")).applyInPandas(added, schema)
        return np.sum([np.frombuffer(r["sums"]) for r in met.collect()], axis=0)  # 64 rows at most

    def summed(inside) -> np.ndarray:
        """Over all rows, the sum of what ``inside`` makes of a block."""

        def partial(frames):
            held = [inside(np.frombuffer(z).reshape(-1, FOURIER)) for frame in frames for z in frame["z"]]
            if held:
                yield pd.DataFrame({"task": [TaskContext.get().partitionId()], "sums": [np.sum(held, axis=0).tobytes()]})

        return total(mapped.mapInPandas(partial, "task INT, sums BINARY"))

    def extreme(w: np.ndarray) -> tuple[np.ndarray, float]:
        """Mean of the lowest rows along ``w``, and how high they reach."""
        shared = spark.sparkContext.broadcast(w)

        def heights(batches):
            for batch in batches:
                for z in batch.column("z").to_pylist():
                    yield pa.RecordBatch.from_pydict({"h": np.frombuffer(z).reshape(-1, FOURIER) @ shared.value})

        high = mapped.mapInArrow(heights, "h DOUBLE").persist()
        cut = column_ranks(high, {"h": [last]})["h"][last]
        high.unpersist()
        edge = 1e-9 * (1.0 + abs(cut))

        def below_and_tied(z: np.ndarray) -> np.ndarray:
            h = z @ shared.value
            masks = h < cut - edge, np.abs(h - cut) <= edge
            return np.concatenate([*[z[m].sum(axis=0) for m in masks], [m.sum() for m in masks]])

        sums = summed(below_and_tied)
        shared.unpersist()
        below, tied, (n_below, n_tied) = sums[:FOURIER], sums[FOURIER : 2 * FOURIER], sums[2 * FOURIER :]
        return (below + (lowest - n_below) / max(n_tied, 1) * tied) / lowest, cut

    w = summed(lambda z: z.sum(axis=0)) / n
    points, shares, gap, rho, steps = np.empty((0, FOURIER)), np.empty(0), np.inf, 0.0, 0
    for steps in range(1, SVM_STEPS + 1):
        found, rho = extreme(w)
        gap = float(w @ (w - found)) / max(float(w @ w), 1e-300)
        if len(points) and gap <= tolerance:
            break
        points, shares = np.vstack([points, found]), np.append(shares, 0.0 if len(points) else 1.0)
        points, shares = _nearest_to_origin(points, shares)
        w = shares @ points
    mapped.unpersist()
    if gap > tolerance:
        log.warning("one-class SVM: a gap of %.2g of the objective was left after %d steps", gap, steps)
    return {**model, "w": w, "rho": rho, "steps": steps, "gap": gap}


def score_ocsvm(model: dict, x: np.ndarray) -> np.ndarray:
    return -(fourier(model, x) @ model["w"])


# --- covariance detectors ----------------------------------------------------------------
def vector_moments(df: DataFrame, column: str = "vector") -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample covariance of a vector column, aggregated in the JVM."""
    facts = df.agg(Summarizer.metrics("mean", "std").summary(F.col(column)).alias("s")).select("s.mean", "s.std").first()
    corr = np.nan_to_num(Correlation.corr(df, column).first()[0].toArray(), nan=0.0)
    np.fill_diagonal(corr, 1.0)
    std = facts["std"].toArray()
    return facts["mean"].toArray(), corr * np.outer(std, std)


def fit_mahalanobis(train: DataFrame) -> dict:
    mean, cov = vector_moments(train)
    return {"mean": mean, "inverse": np.linalg.pinv(cov + np.eye(len(mean)) * 1e-5)}


def squared_distances(model: dict, x: np.ndarray) -> np.ndarray:
    diff = x - model["mean"]
    return np.maximum(np.einsum("ij,ij->i", diff @ model["inverse"], diff), 0.0)


def score_mahalanobis(model: dict, x: np.ndarray) -> np.ndarray:
    return np.sqrt(squared_distances(model, x))


def _chi_square(degrees: int, z: float) -> float:
    """Quantile of the chi-square distribution at the normal deviate ``z`` (Wilson and Hilferty)."""
    return degrees * (1.0 - 2.0 / (9.0 * degrees) + z * np.sqrt(2.0 / (9.0 * degrees))) ** 3


def _distances(df: DataFrame, models: list[dict]) -> DataFrame:
    """``_d``: squared distances by each model."""
    shared = df.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("array<double>")
    def distance(features: pd.Series) -> pd.Series:
        x = np.stack(features.to_numpy()) if len(features) else np.empty((0, 1))
        return pd.Series(list(np.column_stack([squared_distances(m, x) for m in shared.value])) if len(x) else [], dtype=object)

    return df.select("features", distance(F.col("features")).alias("_d"))


def _moments_within(measured: DataFrame, cuts: list[float]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Mean and covariance of the rows within each cut, all in one pass; sums meet in two levels."""

    def partial(frames):
        held = [0.0] * len(cuts)
        width = 0
        for frame in frames:
            if len(frame):
                x, d = np.stack(frame["features"].to_numpy()), np.stack(frame["_d"].to_numpy())
                width = x.shape[1]
                for i, cut in enumerate(cuts):
                    own = np.column_stack([np.ones((d[:, i] <= cut).sum()), x[d[:, i] <= cut]])
                    held[i] = held[i] + own.T @ own
        if width:
            yield pd.DataFrame({"start": range(len(cuts)), "part": TaskContext.get().partitionId() % 64, "sums": [np.asarray(h).tobytes() for h in held]})

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(b) for b in frame.sort_values("part")["sums"]], axis=0)
        return pd.DataFrame({"start": [frame["start"].iloc[0]], "part": [frame["part"].iloc[0]], "sums": [total.tobytes()]})

    schema = "start INT, part INT, sums BINARY"
    parts = measured.mapInPandas(partial, schema).groupBy("start", "part").applyInPandas(added, schema)
    out = []
    for r in parts.groupBy("start").applyInPandas(added, schema).orderBy("start").collect():  # a row per start
        sums = np.frombuffer(r["sums"])
        sums = sums.reshape(int(np.sqrt(len(sums))), -1)
        n, mean = sums[0, 0], sums[0, 1:] / sums[0, 0]
        out.append((mean, (sums[1:, 1:] - n * np.outer(mean, mean)) / max(n - 1, 1)))
    return out


def _covariance_model(mean: np.ndarray, cov: np.ndarray, scale: float = 1.0) -> dict:
    cov = cov + np.eye(len(mean)) * 1e-5
    return {"mean": mean, "inverse": np.linalg.pinv(cov * scale, hermitian=True), "size": float(np.linalg.slogdet(cov)[1])}


def _small_starts(train: DataFrame, rows: int, count: int, width: int) -> list[dict]:
    """Models of a few rows each: for every start those of the smallest hashes."""
    size = width + 1
    share = min(1.0, (2.0 * size + 200.0) / max(rows, 1))
    below = int(-(2**63) + share * (2**64 - 1)) if share < 1.0 else 2**63 - 1
    keys = ["station_id", "timestamp", "seq"]
    draws = F.filter(F.sequence(F.lit(1), F.lit(count)), lambda t: F.xxhash64(*keys, t) <= F.lit(below))
    offered = train.select("features", *keys, F.explode(draws).alias("start")).withColumn("rank", F.xxhash64(*keys, "start"))
    chosen = offered.withColumn("_n", F.row_number().over(Window.partitionBy("start").orderBy("rank"))).filter(F.col("_n") <= size)
    found: dict[int, list] = {}
    for r in chosen.select("start", "rank", "features").orderBy("start", "rank").collect():  # STARTS times width + 1 rows
        found.setdefault(r["start"], []).append(r["features"])
    return [_covariance_model(np.mean(x, axis=0), np.cov(np.array(x).T)) for x in map(np.array, found.values()) if len(x) > 1]


def _standardised(train: DataFrame, centre: np.ndarray, spread: np.ndarray) -> DataFrame:
    values = [F.array(*[F.lit(float(v)) for v in vector]) for vector in (centre, spread)]
    moved = F.zip_with(F.zip_with("features", values[0], lambda x, c: x - c), values[1], lambda x, s: x / s)
    return train.select("station_id", "timestamp", "seq", moved.alias("features"))


def fit_elliptic(train: DataFrame, rows: int, support: float = SUPPORT, starts: int = STARTS) -> dict:
    """Covariance of the share of rows whose determinant is smallest, by concentration steps from several starts.

    One start is the whole table, the others a few rows each. All take two steps together, a pass over the rows for the
    cuts and one for the moments; the best two go on until their determinants settle. The result is scaled to the
    median distance of a normal distribution, and its moments taken once more of all rows within its 97.5 % quantile. Steps
    run on columns of mean 0 and deviation 1: variances may lie 18 digits apart, and determinants fall from step to step
    only as long as small ones are not lost to rounding. Reports ``steps``, ``settled`` and the determinants' logarithms, a list per step.
    """
    centre, cov = vector_moments(train)
    width, spread = len(centre), np.sqrt(np.diag(cov))
    spread = np.where(spread > 0, spread, 1.0)
    train = _standardised(train, centre, spread)
    whole = _covariance_model(np.zeros(width), cov / np.outer(spread, spread))
    models = [whole, *(_small_starts(train, rows, starts - 1, width) if starts > 1 else [])]
    small = rows * starts <= SMALL_GROUP_ROWS
    sizes, steps, settled, logs = [np.inf] * len(models), 0, False, []
    while steps < C_STEPS and not settled:
        measured = _distances(train, models).persist()
        each = measured.select("features", *[F.col("_d")[i].alias(f"d{i}") for i in range(len(models))])
        cut = quantiles(each, [], [f"d{i}" for i in range(len(models))], [support], small).first()
        models = [_covariance_model(*m) for m in _moments_within(measured, [cut[f"d{i}_q0"] for i in range(len(models))])]
        measured.unpersist()
        steps += 1
        order = np.argsort([m["size"] for m in models], kind="stable")
        changes = [abs(sizes[i] - models[i]["size"]) for i in range(len(models))]
        sizes = [m["size"] for m in models]
        logs.append(sizes)
        if steps == TRIAL_STEPS:
            models, sizes = [models[i] for i in order[:BEST]], [sizes[i] for i in order[:BEST]]
        elif steps > TRIAL_STEPS:
            settled = max(changes) <= SETTLED
    if not settled:
        log.warning("robust covariance did not settle in %d steps", steps)
    best = min(models, key=lambda m: m["size"])
    measured = _distances(train, [best]).persist()
    half = quantiles(measured.select(F.col("_d")[0].alias("d")), [], ["d"], [0.5], small).first()["d_q0"]
    scale = max(half / _chi_square(width, 0.0), 1e-12)
    final = _covariance_model(*_moments_within(measured, [scale * _chi_square(width, 1.959964)])[0])
    measured.unpersist()
    return {
        "mean": centre + spread * final["mean"], "inverse": final["inverse"] / np.outer(spread, spread),
        "steps": steps, "settled": settled, "logs": logs,
    }


# --- the ensemble ------------------------------------------------------------------------
SCORERS = {
    "isolation_forest": score_isolation_forest,
    "one_class_svm": score_ocsvm,
    "elliptic_envelope": squared_distances,
    "mahalanobis": score_mahalanobis,
}


def ad_robust_z(df: DataFrame) -> Column:
    """Largest absolute robust z of the row; 0 when none is known."""
    cols = [c for c in df.columns if c.endswith("_robust_z")]
    sizes = [F.coalesce(F.abs(F.col(c)), F.lit(0.0)) for c in cols]
    return F.greatest(*sizes) if len(sizes) > 1 else sizes[0]


def ad_normalize(raw: Column, p5: float, p95: float) -> Column:
    """p5 becomes 0.05 and p95 0.85, clipped to [0, 1]."""
    return clip((raw - p5) / max(p95 - p5, 1e-6) * 0.80 + 0.05, 0.0, 1.0)


def ad_combine(scores: dict[str, Column], weights: dict[str, float] = DETECTOR_WEIGHTS) -> Column:
    """Weighted mean over the active detectors."""
    total = sum(weights[n] for n in scores)
    return clip(reduce(lambda a, b: a + b, [c * (weights[n] / total) for n, c in scores.items()]), 0.0, 1.0)


def ad_consensus(scores: dict[str, Column]) -> dict[str, Column]:
    """How many detectors see an anomaly (score of at least one half)."""
    agreeing = reduce(lambda a, b: a + b, [(c >= 0.50).cast("int") for c in scores.values()])
    return {
        "anomaly_model_count": F.lit(len(scores)),
        "anomaly_models_agreeing": agreeing,
        "anomaly_consensus_score": agreeing / F.lit(float(len(scores))),
        "anomaly_model_agreement": F.format_string("%d/%d models", agreeing, F.lit(len(scores))),
    }


@dataclass
class AnomalyEnsemble:
    scaling: Scaling
    models: dict[str, object]
    limits: dict[str, tuple[float, float]] = field(default_factory=dict)
    failed: dict[str, str] = field(default_factory=dict)

    @property
    def active(self) -> list[str]:
        return [n for n in DETECTOR_WEIGHTS if n in self.models or n == "robust_zscore"]

    def raw_scores(self, df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
        """Unnormalised scores as ``_raw_<detector>``; station, timestamp and seq are unique."""
        names = [n for n in (names or self.active) if n in self.models]
        out = df if "features" in df.columns else self.scaling.with_array(df)
        if "lof" in names:
            out = out.join(self.models["lof"].score(out), local_outliers.KEYS, "left")
            out = out.withColumn("_raw_lof", F.coalesce("_raw_lof", F.lit(1.0)))  # as dense as its neighbours
            names.remove("lof")
        if names:
            shared = df.sparkSession.sparkContext.broadcast({n: self.models[n] for n in names})

            @F.pandas_udf(", ".join(f"{n} double" for n in names))
            def score(features: pd.Series) -> pd.DataFrame:
                x = np.stack(features.to_numpy()) if len(features) else np.empty((0, 1))
                return pd.DataFrame({n: SCORERS[n](m, x) if len(x) else [] for n, m in shared.value.items()})

            out = out.withColumn("_raw", score(F.col("features")))
            out = out.withColumns({f"_raw_{n}": F.col(f"_raw.{n}") for n in names}).drop("_raw")
        return out.withColumn("_raw_robust_zscore", ad_robust_z(df))

    def transform(self, df: DataFrame) -> DataFrame:
        """Normalised scores per detector, the combined score and the consensus."""
        raw = self.raw_scores(df).drop("features")
        short = {n: f"{DETECTOR_SHORT[n]}_anomaly_score" for n in self.active}
        out = raw.withColumns({short[n]: ad_normalize(F.col(f"_raw_{n}"), *self.limits[n]) for n in self.active})
        out = staged(out.drop(*[f"_raw_{n}" for n in self.active]), "detectors")
        scores = {n: F.col(c) for n, c in short.items()}
        return out.withColumns({"combined_anomaly_score": ad_combine(scores), **ad_consensus(scores)})

    def summary(self, df: DataFrame) -> DataFrame:
        """Active flag, weight and threshold (95th percentile; 3 for robust z) per detector."""
        entries = [
            (n, n in self.active, w, 3.0 if n == "robust_zscore" else self.limits.get(n, (0.0, 0.5))[1])
            for n, w in DETECTOR_WEIGHTS.items()
        ]
        return df.sparkSession.createDataFrame(entries, "detector STRING, active BOOLEAN, weight DOUBLE, threshold DOUBLE")


def fit_anomaly(train: DataFrame, detectors: Sequence[str] = ("lof", *SCORERS)) -> AnomalyEnsemble:
    """Fit on a persisted training feature table. A detector that fails is left out."""
    from pyspark.ml.functions import array_to_vector

    cols = feature_select(train, anomaly_features(train), 10)
    scaling = fit_scaling(train, cols)
    z_cols = [c for c in train.columns if c.endswith("_robust_z")]
    slim = scaling.with_array(train.select("station_id", "timestamp", "seq", *dict.fromkeys([*cols, *z_cols])))
    ready = slim.select("station_id", "timestamp", "seq", *z_cols, "features").persist()
    ready = ready.withColumn("vector", array_to_vector("features"))
    fits = {
        "isolation_forest": lambda: fit_isolation_forest(ready),
        "lof": lambda: local_outliers.fit_lof(ready, scaling.rows),
        "one_class_svm": lambda: fit_ocsvm(ready, len(cols), entry_variance(ready), scaling.rows),
        "elliptic_envelope": lambda: fit_elliptic(ready, scaling.rows),
        "mahalanobis": lambda: fit_mahalanobis(ready),
    }
    failed = {}

    def fit(name: str):
        started = time.perf_counter()
        try:
            return fits[name]()
        except (np.linalg.LinAlgError, ValueError) as error:  # the data do not allow this fit; lost tasks raise
            log.warning("detector %s left out: %s", name, error)
            failed[name] = str(error)
        finally:
            log.info("detector %s took %.1f s", name, time.perf_counter() - started)

    with ThreadPoolExecutor(max(len(detectors), 1)) as pool:  # side by side: most of their jobs are small
        models = {name: model for name, model in zip(detectors, pool.map(fit, detectors)) if model is not None}
    fitted = AnomalyEnsemble(scaling, models, failed=failed)
    fitted.limits.update(_limits(fitted.raw_scores(ready), fitted.active, scaling.rows))
    ready.unpersist()
    return fitted


def entry_variance(train: DataFrame) -> float:
    """Variance of all entries of the feature arrays, taken together."""
    width = F.size("features")
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    squares = F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x)
    row = train.agg(F.sum(total).alias("s"), F.sum(squares).alias("q"), F.sum(width).alias("n")).first()
    return max(row["q"] / row["n"] - (row["s"] / row["n"]) ** 2, 0.0) if row["n"] else 0.0


def _limits(scored: DataFrame, names: list[str], rows: int) -> dict[str, tuple[float, float]]:
    if not names:
        return {}
    cols = [f"_raw_{n}" for n in names]
    row = quantiles(scored, [], cols, [0.05, 0.95], rows * len(cols) <= SMALL_GROUP_ROWS).first()
    return {n: (float(row[f"_raw_{n}_q0"]), float(row[f"_raw_{n}_q1"])) for n in names}
