"""Extremely randomised trees for many models at once.

A node draws one cut per feature, uniform between the node's own smallest and largest value, and keeps the cut that lowers
the squared error most. Draws come from the numbers of tree, node and feature and label sums are whole numbers, so trees
do not depend on how rows are partitioned. A level takes two passes over the rows for all trees of all models: one finds the
ranges, one the sums left of the cuts. A table of at most ``IN_TASK_ROWS`` rows is grown to the end by tasks that
each hold it whole and grow some of the trees by the same steps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veleta.operators.boosted_trees import IN_TASK_ROWS, UNIT, Tree, mixed
from veleta.session import scratch_dir

TREES_IN_TASK = 13


@dataclass(frozen=True)
class Settings:
    name: str
    set: int
    trees: int
    depth: int
    least_rows: int = 1
    seed: int = 42


class Growing:
    """One tree, level by level. Nodes carry their heap number, from which their draws come."""

    def __init__(self, s: Settings, number: int):
        self.s, self.number = s, number
        self.feature, self.cut, self.left, self.right, self.value, self.heap = [-1], [0.0], [-1], [-1], [0.0], [1]
        self.open, self.depth = [0], 0

    def cuts(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """A cut per open node and feature; NaN where the node's values are all alike."""
        width = low.shape[1]
        heap = np.array([self.heap[n] for n in self.open], dtype=np.uint64)
        draw = mixed((heap[:, None] * np.uint64(width) + np.arange(width, dtype=np.uint64)).ravel(), self.s.seed * 1_000_003 + self.number).reshape(low.shape)
        return np.where(high > low, np.minimum(low + draw * (high - low), np.nextafter(high, low)), np.nan)

    def take(self, cuts: np.ndarray, rows: np.ndarray, total: np.ndarray, left_rows: np.ndarray, left: np.ndarray, unit: float) -> None:
        """Rows and label sums of the open nodes, and those left of each feature's cut."""
        right_rows, right = rows[:, None] - left_rows, total[:, None] - left
        least = max(self.s.least_rows, 1)
        ok = (left_rows >= least) & (right_rows >= least) & ~np.isnan(cuts)
        worth = (left / unit) ** 2 / np.maximum(left_rows, 1) + (right / unit) ** 2 / np.maximum(right_rows, 1) - ((total / unit) ** 2 / np.maximum(rows, 1))[:, None]
        gain = np.where(ok, worth, 0.0)
        best = np.argmax(gain, axis=1)
        self.depth += 1
        fresh = []
        for i, node in enumerate(self.open):
            j = int(best[i])
            self.value[node] = float(total[i] / unit / max(rows[i], 1))
            if gain[i, j] > 1e-9:
                children = len(self.feature), len(self.feature) + 1
                self.feature[node], self.cut[node], (self.left[node], self.right[node]) = j, float(cuts[i, j]), children
                for k, (n, y) in enumerate(((left_rows[i, j], left[i, j]), (right_rows[i, j], right[i, j]))):
                    self.feature.append(-1)
                    self.cut.append(0.0)
                    self.left.append(-1)
                    self.right.append(-1)
                    self.value.append(float(y / unit / n))
                    self.heap.append(2 * self.heap[node] + k)
                    if n >= 2 * least:
                        fresh.append(children[k])
        self.open = fresh if self.depth < self.s.depth else []

    def tree(self) -> Tree:
        return Tree(np.array(self.feature), np.array(self.cut), np.array(self.left), np.array(self.right), np.array(self.value))


def _by_node(tree: Tree, nodes: Sequence[int], x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of their open node, where each node's rows begin, and which of the nodes have rows."""
    place = np.full(len(tree.feature), -1)
    place[list(nodes)] = np.arange(len(nodes))
    node = place[tree.leaves_of(x)]
    order = np.argsort(node, kind="stable")
    order = order[np.searchsorted(node[order], 0) :]
    have, starts = np.unique(node[order], return_index=True)
    return order, starts, have


def ranges(tree: Tree, nodes: Sequence[int], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value per open node and feature."""
    low, high = np.full((len(nodes), x.shape[1]), np.inf), np.full((len(nodes), x.shape[1]), -np.inf)
    order, starts, have = _by_node(tree, nodes, x)
    if len(order):
        ordered = x[order]
        low[have], high[have] = np.minimum.reduceat(ordered, starts), np.maximum.reduceat(ordered, starts)
    return low, high


def left_sums(tree: Tree, nodes: Sequence[int], x: np.ndarray, y: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Per open node rows and label sum, then both left of each feature's cut: nodes x 2 x (1 + features)."""
    out = np.zeros((len(nodes), 2, 1 + x.shape[1]), dtype=np.int64)
    order, starts, have = _by_node(tree, nodes, x)
    if len(order):
        sizes = np.diff(starts, append=len(order))
        with np.errstate(invalid="ignore"):
            below = x[order] <= np.repeat(cuts[have], sizes, axis=0)
        label = y[order].astype(np.int64)
        out[have, 0, 0], out[have, 1, 0] = sizes, np.add.reduceat(label, starts)
        out[have, 0, 1:] = np.add.reduceat(below.astype(np.int64), starts)
        out[have, 1, 1:] = np.add.reduceat(np.where(below, label[:, None], 0), starts)
    return out


def _take(growing: Growing, cuts: np.ndarray, sums: np.ndarray, unit: float) -> None:
    growing.take(cuts, sums[:, 0, 0], sums[:, 1, 0], sums[:, 0, 1:], sums[:, 1, 1:], unit)


@dataclass
class RandomCutTrees:
    """Fitted trees; ``transform`` adds their mean."""

    settings: Settings
    trees: list[Tree]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sum(t.value[t.leaves_of(x)] for t in self.trees) / len(self.trees)

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def scored(values: pd.Series) -> pd.Series:
            return pd.Series(shared.value.scores(np.stack(values.to_numpy())) if len(values) else [], dtype=float)

        array = F.col(features) if dict(df.dtypes)[features].startswith("array") else vector_to_array(features)
        return df.withColumn(self.settings.name, scored(array))


TREE = "model INT, tree INT, feature ARRAY<INT>, cut ARRAY<DOUBLE>, left ARRAY<INT>, right ARRAY<INT>, value ARRAY<DOUBLE>"


def _matrix(features: pd.Series) -> np.ndarray:
    return np.stack(features.to_numpy()).astype(np.float64)


def _fit_in_tasks(rows: DataFrame, models: list[Settings], units: list[float]) -> list[list[Tree]]:
    def grow(key, frame: pd.DataFrame) -> pd.DataFrame:
        m, block = int(key[0]), int(key[1])
        frame = frame.sort_values("row")
        x, y, out = _matrix(frame["features"]), np.rint(frame["label"].to_numpy() * units[m]), []
        for number in range(block * TREES_IN_TASK, min((block + 1) * TREES_IN_TASK, models[m].trees)):
            growing = Growing(models[m], number)
            while growing.open:
                tree, nodes = growing.tree(), list(growing.open)
                cuts = growing.cuts(*ranges(tree, nodes, x))
                _take(growing, cuts, left_sums(tree, nodes, x, y, cuts), units[m])
            t = growing.tree()
            out.append((m, number, t.feature.tolist(), t.cut.tolist(), t.left.tolist(), t.right.tolist(), t.value.tolist()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in TREE.split(", ")])

    parts = [(m, s, b) for m, s in enumerate(models) for b in range(-(-s.trees // TREES_IN_TASK))]
    of_set = F.coalesce(*[
        F.when(F.col("set") == k, F.array(*[F.struct(F.lit(m).alias("model"), F.lit(b).alias("block")) for m, s, b in parts if s.set == k])) for k in {s.set for s in models}])
    dealt = rows.withColumn("part", F.explode(of_set)).select("part.model", "part.block", "row", "features", "label")
    found = dealt.repartitionByRange(len(parts), "model", "block").groupBy("model", "block").applyInPandas(grow, TREE).collect()  # the fitted trees
    out: list[list] = [[None] * s.trees for s in models]
    for r in found:
        out[r["model"]][r["tree"]] = Tree(*[np.array(r[c]) for c in ("feature", "cut", "left", "right", "value")])
    return out


def _fit_by_levels(rows: DataFrame, models: list[Settings], units: list[float]) -> list[list[Tree]]:
    """Two jobs per level for all trees of all models."""
    spark = rows.sparkSession
    trees = [(m, Growing(s, number)) for m, s in enumerate(models) for number in range(s.trees)]

    def gathered(task, merge, extra) -> dict[tuple[int, int], np.ndarray]:
        shared = spark.sparkContext.broadcast(({t: (m, g.tree(), list(g.open)) for t, (m, g) in enumerate(trees) if g.open}, extra))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            growing, more = shared.value
            held: dict[int, np.ndarray] = {}
            for frame in frames:
                for number, own in frame.groupby("set"):
                    x, label = _matrix(own["features"]), own["label"].to_numpy()
                    for t, (m, tree, nodes) in growing.items():
                        if models[m].set == number:
                            part = task(tree, nodes, x, np.rint(label * units[m]), more and more[t])
                            held[t] = merge(held[t], part) if t in held else part
            out = [(t, n, parts[n].tobytes()) for t, parts in held.items() for n in range(len(parts))]
            yield pd.DataFrame(out, columns=["tree", "node", "part"])

        def merged(key, frame: pd.DataFrame) -> pd.DataFrame:
            kind = np.int64 if shared.value[1] else np.float64
            whole = None
            for part in frame["part"]:
                part = np.frombuffer(part, kind)
                part = part.reshape(2, -1)
                whole = part if whole is None else merge(whole[None], part[None])[0]
            return pd.DataFrame({"tree": [key[0]], "node": [key[1]], "part": [whole.tobytes()]})

        schema = "tree INT, node INT, part BINARY"
        found = rows.mapInPandas(run, schema).groupBy("tree", "node").applyInPandas(merged, schema).collect()  # a row per open node
        shared.unpersist()
        return {(r["tree"], r["node"]): np.frombuffer(r["part"], np.int64 if extra else np.float64).reshape(2, -1) for r in found}

    def wider(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.stack([np.minimum(a[:, 0], b[:, 0]), np.maximum(a[:, 1], b[:, 1])], axis=1)

    def stacked(found: dict, t: int, g: Growing) -> np.ndarray:
        return np.stack([found[t, n] for n in range(len(g.open))])

    while any(g.open for _, g in trees):
        found = gathered(lambda tree, nodes, x, y, _: np.stack(ranges(tree, nodes, x), axis=1), wider, None)
        cuts = {}
        for t, (_, g) in enumerate(trees):
            if g.open:
                both = stacked(found, t, g)
                cuts[t] = g.cuts(both[:, 0], both[:, 1])
        found = gathered(left_sums, lambda a, b: a + b, cuts)
        for t, (m, g) in enumerate(trees):
            if g.open:
                _take(g, cuts[t], stacked(found, t, g), units[m])
    out: list[list[Tree]] = [[] for _ in models]
    for m, g in trees:
        out[m].append(g.tree())
    return out


def fit_random_cuts(rows: DataFrame, models: Sequence[Settings], in_task_rows: int = IN_TASK_ROWS) -> dict[tuple[int, str], RandomCutTrees]:
    """Fit all models on rows with set (INT), row (LONG, unique within a set), features (array<double>) and label (DOUBLE).

    Results by set and name; sets without rows give none. Rows are written once.
    """
    path = scratch_dir(rows.sparkSession, "random-cut-rows")
    rows.select("set", "row", "features", "label").write.parquet(path)
    rows = rows.sparkSession.read.parquet(path)
    facts = {r["set"]: r for r in rows.groupBy("set").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("label")).alias("most")).collect()}
    models = [s for s in models if s.set in facts]
    if not models:
        return {}
    units = [UNIT / max(facts[s.set]["most"], 1e-12) for s in models]
    grow = _fit_in_tasks if max(r["n"] for r in facts.values()) <= in_task_rows else _fit_by_levels
    return {(s.set, s.name): RandomCutTrees(s, own) for s, own in zip(models, grow(rows, models, units))}
