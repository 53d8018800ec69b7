"""Local outlier factor over a whole table with exact neighbours.

Rows of equal features are folded into one point that counts as often as it occurs. Points are dealt to the nearest of a few
thousand pivots, and the cells of pivots that are full are cut into rings of the distance to the pivot: a block is one
ring of one cell. A row first asks the block that it lies in, which bounds the distance of its k-th neighbour; then it asks
every block that the triangle inequality does not place beyond that bound, so neighbours are exact whatever the
blocks. Distances of neighbours, k-distances and densities are tables of k numbers per point. The pivots and two
numbers per block travel to the driver and back.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veleta.operators.order_stats import with_running_totals
from veleta.session import scratch_dir

KEYS = ["station_id", "timestamp", "seq"]
NEIGHBOURS = 5
BLOCK_ROWS = 8192
BLOCKS = 65536  # more rows than BLOCKS * BLOCK_ROWS make larger blocks
PIVOTS = 4096
ASKED = 16384  # rows that one task asks one block for
NEAR = 1e-9  # distances are kept apart by more than rounding
TINY = 1e-10


def nearest(x: np.ndarray, reference: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and indices of the k nearest reference rows, a thousand rows at a time; fewer where there are fewer."""
    k = min(k, len(reference))
    dist, index = np.empty((len(x), k)), np.empty((len(x), k), dtype=int)
    norms = (reference**2).sum(axis=1)
    for i in range(0, len(x), 1000):
        block = x[i : i + 1000]
        d2 = np.maximum((block**2).sum(axis=1)[:, None] + norms - 2.0 * block @ reference.T, 0.0)
        near = np.argpartition(d2, k - 1, axis=1)[:, :k]
        found = np.stack([((reference[near[:, j]] - block) ** 2).sum(axis=1) for j in range(k)], axis=1)  # equal rows are exactly 0 apart
        order = np.argsort(found, axis=1)
        dist[i : i + 1000] = np.sqrt(np.take_along_axis(found, order, axis=1))
        index[i : i + 1000] = np.take_along_axis(near, order, axis=1)
    return dist, index


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@dataclass
class Cells:
    """Pivots, and for each block its cell and the range of its points' distances to the pivot; blocks go by cell and range."""

    pivots: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def distances(self, x: np.ndarray) -> np.ndarray:
        d2 = (x**2).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1) - 2.0 * x @ self.pivots.T
        return np.sqrt(np.maximum(d2, 0.0))

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block and distance to the pivot of each row; rows between two rings go to the inner one."""
        d = self.distances(x)
        cell = d.argmin(axis=1)
        own = d[np.arange(len(x)), cell]
        first, last = np.searchsorted(self.cell, cell, side="left"), np.searchsorted(self.cell, cell, side="right")
        block = np.array([max(a, a + int(np.searchsorted(self.low[a:b], v, side="right")) - 1) for a, b, v in zip(first, last, own)], dtype=np.int64)
        return block, own

    def within(self, x: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Rows x blocks: whether a block may hold points as near as ``reach``.

        A point is as far as its ring is from the row's distance to the pivot, and no nearer than the plane between
        the row's own pivot and the point's.
        """
        d = self.distances(x)
        own = d.argmin(axis=1)
        nearest_pivot = d[np.arange(len(x)), own]
        apart = self.distances(self.pivots)
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.nan_to_num((d**2 - (nearest_pivot**2)[:, None]) / (2.0 * apart[own]), nan=0.0, posinf=0.0, neginf=0.0)
        d, plane = d[:, self.cell], plane[:, self.cell]
        least = np.maximum(np.maximum(d - self.high, self.low - d), plane)
        return least * (1.0 - NEAR) - NEAR * (1.0 + d) <= reach[:, None]


def _stacked(features: pd.Series) -> np.ndarray:
    return np.stack(features.to_numpy()) if len(features) else np.empty((0, 1))


def _with_home(df: DataFrame, cells: Cells) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(cells)

    @F.pandas_udf("block long, away double")
    def place(features: pd.Series) -> pd.DataFrame:
        block, away = shared.value.home(_stacked(features)) if len(features) else ([], [])
        return pd.DataFrame({"block": block, "away": away})

    return df.withColumn("_home", place(F.col("features"))).select(*df.columns, "_home.block", "_home.away")


def fit_cells(points: DataFrame, count: int, block_rows: int = BLOCK_ROWS) -> Cells:
    """Pivots are the points of the smallest hashes; full cells are cut at ranks of the distance to the pivot."""
    block_rows = max(block_rows, -(-count // BLOCKS))
    if count <= block_rows:
        width = len(points.first()["features"]) if count else 1
        return Cells(np.zeros((1, width)), np.array([0]), np.array([0.0]), np.array([np.inf]))
    wanted = min(PIVOTS, -(-2 * count // block_rows))
    chosen = points.orderBy(F.xxhash64("features"), "row").limit(wanted).select("features").collect()  # PIVOTS rows at most
    pivots = np.array([r["features"] for r in chosen])
    whole = Cells(pivots, np.arange(len(pivots)), np.zeros(len(pivots)), np.full(len(pivots), np.inf))
    dealt = _stored(_with_home(points, whole).select("block", "away"), "lof-cells")
    full = dealt.groupBy("block").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block_rows).select("block")
    counts = dealt.join(F.broadcast(full), "block", "left_semi").groupBy("block", "away").agg(F.count(F.lit(1)).alias("n"))
    ranked = with_running_totals(counts, ["block"], "away", ["n"]).withColumn("ring", F.floor(F.col("n_before") / block_rows))
    rings = ranked.groupBy("block", "ring").agg(F.min("away").alias("low")).filter("ring > 0").collect()  # a row per further block
    edges = sorted([(i, 0.0) for i in range(len(pivots))] + [(r["block"], r["low"]) for r in rings])
    cell, low = np.array([c for c, _ in edges]), np.array([v for _, v in edges])
    return Cells(pivots, cell, low, np.full(len(edges), np.inf))


def _with_ranges(cells: Cells, placed: DataFrame) -> Cells:
    """The true ranges of blocks; blocks without points are beyond any reach."""
    low, high = np.full(len(cells.cell), np.inf), np.full(len(cells.cell), -np.inf)
    for r in placed.groupBy("block").agg(F.min("away").alias("low"), F.max("away").alias("high")).collect():  # a row per block
        low[r["block"]], high[r["block"]] = r["low"], r["high"]
    return Cells(cells.pivots, cells.cell, low, high)


KINDS = {"row": "LONG", "station_id": "STRING", "timestamp": "TIMESTAMP_NTZ", "seq": "LONG", "near": "LONG", "copies": "LONG"}


def _asked(held: DataFrame, asked: DataFrame, keys: list[str], k: int, facts: list[str], itself: bool) -> DataFrame:
    """The k nearest points of the asked block: keys, near, copies, dist and facts of the points.

    A block that very many rows ask is held whole by several tasks, and each answers some of the rows.
    """
    parts = asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("parts"))
    rows = asked.join(parts, "block").withColumn("part", F.pmod(F.xxhash64(*keys), F.col("parts")).cast("int")).drop("parts")
    held = held.select(*[F.col(c).alias(c) for c in held.columns])  # rows may come from the same table
    points = held.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    names = [*keys, "near", "copies", "dist", *facts]

    def search(reference: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(reference) or not len(rows):
            return pd.DataFrame({n: pd.Series([], dtype=object) for n in names})
        reference = reference.sort_values("row")
        dist, index = nearest(_stacked(rows["features"]), _stacked(reference["features"]), k if itself else k + 1)
        near = reference["row"].to_numpy()[index]
        keep = np.ones(near.shape, dtype=bool) if itself else near != rows["row"].to_numpy()[:, None]
        keep &= np.cumsum(keep, axis=1) <= k
        row, at = np.nonzero(keep)
        out = rows[keys].iloc[row].reset_index(drop=True)
        index = index[row, at]
        return out.assign(near=near[row, at], copies=reference["copies"].to_numpy()[index], dist=dist[row, at], **{f: reference[f].to_numpy()[index] for f in facts})

    schema = ", ".join(f"{n} {KINDS.get(n, 'DOUBLE')}" for n in names)
    return points.groupBy("block", "part").cogroup(rows.groupBy("block", "part")).applyInPandas(search, schema)


def neighbours(held: DataFrame, cells: Cells, rows: DataFrame, keys: list[str], k: int, facts: list[str], itself: bool) -> DataFrame:
    """Candidates that hold the k nearest points of each row: those of its own block and of all within their reach."""
    home = _with_home(rows.select(*keys, "features"), cells).drop("away")
    if len(cells.cell) == 1:
        return _asked(held, home, keys, k, facts, itself)
    home = _stored(home, "lof-asked")
    first = _stored(_asked(held, home, keys, k, facts, itself), "lof-first")
    reach = first.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= k, F.max("dist")).alias("reach"))
    shared = rows.sparkSession.sparkContext.broadcast(cells)

    @F.pandas_udf("array<long>")
    def others(features: pd.Series, reach: pd.Series, block: pd.Series) -> pd.Series:
        if not len(features):
            return pd.Series([], dtype=object)
        may = shared.value.within(_stacked(features), reach.fillna(np.inf).to_numpy())
        may &= np.isfinite(shared.value.low)  # blocks with points
        may[np.arange(len(may)), block.to_numpy()] = False
        return pd.Series([np.flatnonzero(m) for m in may], dtype=object)

    more = home.join(reach, keys, "left").withColumn("block", F.explode(others("features", "reach", "block"))).drop("reach")
    return first.unionByName(_asked(held, more, keys, k, facts, itself))


def _closest(pairs: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k nearest of each row over all trees; of the last point only as many copies as are missing."""
    before = F.coalesce(F.sum("copies").over(Window.partitionBy(*keys).orderBy("dist", "near").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    others = [c for c in pairs.columns if c not in (*keys, "near")]
    once = pairs.groupBy(*keys, "near").agg(*[F.min(c).alias(c) for c in others])
    return once.withColumn("_before", before).filter(F.col("_before") < k).withColumn("copies", F.least("copies", k - F.col("_before"))).drop("_before")


def _mean(value: Column | str) -> Column:
    """Mean over neighbours, each counted as often as it is taken."""
    value = F.col(value) if isinstance(value, str) else value
    return F.sum(value * F.col("copies")) / F.sum("copies")


@dataclass
class LocalOutliers:
    cells: Cells
    reference: DataFrame  # row, features, copies, block, reach, density
    k: int

    def score(self, df: DataFrame) -> DataFrame:
        """Keys and ``_raw_lof`` of rows with ``features``: mean density of the neighbours over the row's own."""
        found = neighbours(self.reference, self.cells, df, KEYS, self.k, ["reach", "density"], itself=True)
        closest = _closest(found, KEYS, self.k)
        own = 1.0 / (_mean(F.greatest("dist", "reach")) + TINY)
        return closest.groupBy(*KEYS).agg((_mean("density") / own).alias("_raw_lof"))


def fit_lof(train: DataFrame, count: int, k: int = NEIGHBOURS, block_rows: int = BLOCK_ROWS) -> LocalOutliers:
    """Reference rows are all training rows; keys must be unique."""
    points = train.groupBy("features").agg(F.count(F.lit(1)).alias("copies"))
    rows = _stored(points.withColumn("row", F.monotonically_increasing_id()), "lof-rows")
    k = max(1, min(k, count - 1))
    cells = fit_cells(rows, rows.count(), block_rows)
    held = _stored(_with_home(rows, cells), "lof-points")
    if len(cells.cell) > 1:
        cells = _with_ranges(cells, held)
    held = held.drop("away")
    pairs = neighbours(held, cells, held, ["row"], k, [], itself=False)
    alike = rows.filter("copies > 1").select("row", F.col("row").alias("near"), (F.col("copies") - 1).alias("copies"), F.lit(0.0).alias("dist"))
    near = _stored(_closest(pairs.unionByName(alike), ["row"], k), "lof-neighbours")
    reach = near.groupBy("row").agg(F.max("dist").alias("reach"))
    reached = near.join(reach.select(F.col("row").alias("near"), "reach"), "near")
    density = reached.groupBy("row").agg((1.0 / (_mean(F.greatest("dist", "reach")) + TINY)).alias("density"))
    reference = _stored(held.join(reach, "row").join(density, "row"), "lof-reference")
    return LocalOutliers(cells, reference, k)
