"""Histogram gradient boosting for many models at once: all targets, settings and classes share every pass over the rows.

Rows are kept as codes of quantile bins in a table that is written once. A level of trees is grown for all models together:
tasks sum gradients per node, feature and bin, the sums meet by node, and one row per node, its best split, reaches the driver.
Scores of rows are written again every few rounds, so that no pass walks more than those rounds' trees. A table of at
most ``IN_TASK_ROWS`` rows is instead grown to the end by one task per model, with the same steps.

Gradients are summed as whole numbers, so neither the partitioning of the rows nor the way of growing changes a tree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veleta.session import scratch_dir

BINS = 255
BIN_ROWS = 200_000  # rows that bin limits are taken from: all, or those of the smallest hashes
IN_TASK_ROWS = 100_000
KEEP_ROUNDS = 10  # rounds after which scores of rows are written
SORT_ROWS = 8  # fewer rows per feature than this are sorted, not summed per bin
FEATURE_BLOCK = 32  # features whose sums of a node meet in one group
UNIT = 2.0**20  # a gradient is rounded to this part of the largest one at the start


@dataclass(frozen=True)
class Settings:
    """One model: boosting rounds of trees on the rows of one set."""

    name: str
    set: int
    rounds: int
    depth: int
    rate: float = 0.08
    sample: float = 1.0  # share of rows that a round's trees see
    penalty: float = 0.0  # added to the weight of a leaf
    least_rows: int = 1
    least_weight: float = 0.0
    leaves: int | None = None  # most leaves of a tree; the splits of greatest gain come first
    classes: int = 1  # more than one: a tree per class and round on softmax gradients; labels are class numbers


@dataclass
class Tree:
    feature: np.ndarray  # -1 in leaves
    cut: np.ndarray  # codes up to the cut go left
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaves_of(self, codes: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(codes), dtype=np.int64), np.arange(len(codes))
        while True:
            feature = self.feature[node]
            inner = feature >= 0
            if not inner.any():
                return node
            below = codes[rows, np.maximum(feature, 0)] <= self.cut[node]
            node = np.where(inner, np.where(below, self.left[node], self.right[node]), node)


# ---- one level of trees ------------------------------------------------------------------------------------------


def node_sums(codes: np.ndarray, node: np.ndarray, nodes: int, gradient: np.ndarray, weight: np.ndarray | None) -> np.ndarray:
    """Sums of gradients, weights and rows: nodes x features x bins x 3. Rows of node -1 are left out.

    Whole numbers below 2**53 add up without error in any order.
    """
    inside = node >= 0
    codes, node = codes[inside], node[inside]
    width = codes.shape[1]
    index = ((node[:, None] * width + np.arange(width)) * (BINS + 1) + codes).ravel()
    size = nodes * width * (BINS + 1)

    def added(values: np.ndarray | None) -> np.ndarray:
        weights = None if values is None else np.repeat(values[inside].astype(np.float64), width)
        return np.bincount(index, weights=weights, minlength=size).astype(np.int64)

    rows = added(None)
    parts = [added(gradient), rows if weight is None else added(weight), rows]
    return np.stack(parts, axis=-1).reshape(nodes, width, BINS + 1, 3)


SPLIT = ["gain", "feature", "cut", "gradient", "weight", "rows", "left_gradient", "left_weight", "left_rows"]


def best_splits(sums: np.ndarray, unit: float, weight_unit: float, s: Settings) -> np.ndarray:
    """Per node: gain, feature and cut of its best split (gain 0: none), its own sums and those of the left part.

    Equal gains go to the first feature and the lowest cut.
    """
    total = sums[:, 0].sum(axis=1)  # nodes x 3: every feature's bins hold all rows
    gradient, weight, rows = (np.cumsum(sums[..., i], axis=2)[:, :, :-1] for i in range(3))
    whole = [total[:, i, None, None] for i in range(3)]
    least = max(s.least_rows, 1)
    ok = (rows >= least) & (whole[2] - rows >= least)
    if s.least_weight:
        ok &= (weight >= s.least_weight * weight_unit) & (whole[1] - weight >= s.least_weight * weight_unit)

    def worth(gradient, weight):
        out = weight / weight_unit
        out += s.penalty
        np.maximum(out, 1e-12, out=out)
        return np.divide(np.square(gradient / unit), out, out=out)

    gain = worth(gradient, weight)
    gain += worth(whole[0] - gradient, whole[1] - weight)
    gain -= worth(whole[0], whole[1])
    gain[~ok] = 0.0
    gain = gain.reshape(len(sums), -1)
    best = np.argmax(gain, axis=1)
    at = np.arange(len(sums))
    found = gain[at, best]
    feature, cut = best // rows.shape[2], best % rows.shape[2]
    own_left = np.column_stack([part[at, feature, cut] for part in (gradient, weight, rows)])
    return np.column_stack([np.where(found > 1e-9, found, 0.0), feature, cut, total, own_left])


def sorted_splits(codes: np.ndarray, node: np.ndarray, nodes: int, gradient: np.ndarray, weight: np.ndarray | None, unit: float, weight_unit: float, s: Settings) -> np.ndarray:
    """The splits of ``best_splits`` from running sums over rows in order of node and code: cheaper where rows are few.

    ``codes`` are features x rows here.
    """
    inside = node >= 0
    codes, node, gradient = codes[:, inside], node[inside], gradient[inside].astype(np.float64)
    out = np.zeros((nodes, len(SPLIT)))
    if not len(node):
        return out
    kind = np.uint16 if nodes * (BINS + 1) <= 2**16 else np.uint32
    key = (node * (BINS + 1)).astype(kind) + codes
    order = np.argsort(key, axis=1, kind="stable")
    key = np.take_along_axis(key, order, axis=1)
    rows = np.bincount(node, minlength=nodes)
    have = np.flatnonzero(rows)
    rows = rows[have]
    starts = np.cumsum(rows) - rows
    at = np.repeat(np.arange(len(have)), rows)  # node of every position, whatever the feature
    begun = starts[at]

    def left_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        run = np.cumsum(values[order], axis=1)  # whole numbers: exact in any order
        before = np.concatenate([np.zeros((len(run), 1)), run[:, starts[1:] - 1]], axis=1)
        return run - before[:, at], np.add.reduceat(values[order[0]], starts)

    left_rows, n = np.arange(1, len(node) + 1) - begun, rows[at]
    left_gradient, g = left_of(gradient)
    if weight is None:
        left_weight, w = left_rows.astype(np.float64)[None], rows.astype(np.float64)
    else:
        left_weight, w = left_of(weight[inside].astype(np.float64))
    ok = np.zeros(key.shape, dtype=bool)
    ok[:, :-1] = key[:, 1:] != key[:, :-1]
    least = max(s.least_rows, 1)
    ok &= (left_rows >= least) & (n - left_rows >= least)
    if s.least_weight:
        ok &= (left_weight >= s.least_weight * weight_unit) & (w[at] - left_weight >= s.least_weight * weight_unit)

    def worth(gradient, weight):
        return (gradient / unit) ** 2 / np.maximum(weight / weight_unit + s.penalty, 1e-12)

    gain = np.where(ok, worth(left_gradient, left_weight) + worth(g[at] - left_gradient, w[at] - left_weight) - worth(g, w)[at], 0.0)
    feature = np.maximum.reduceat(gain, starts, axis=1).argmax(axis=0)
    for i, (node_, start, j) in enumerate(zip(have, starts, feature)):
        k = start + int(gain[j, start : start + rows[i]].argmax())
        best = gain[j, k]
        out[node_] = [
            best if best > 1e-9 else 0.0, j, int(key[j, k]) % (BINS + 1), g[i], w[i], rows[i],
            left_gradient[j, k], left_weight[j if weight is not None else 0, k], left_rows[k]]
    return out


class Growing:
    """A tree that grows level by level from the splits found for its open nodes."""

    def __init__(self, s: Settings, unit: float, weight_unit: float):
        self.s, self.unit, self.weight_unit = s, unit, weight_unit
        self.feature, self.cut, self.left, self.right, self.sums, self.gain = [-1], [0], [-1], [-1], [None], [0.0]
        self.open, self.depth = [0], 0  # nodes without a decision yet

    def take(self, splits: np.ndarray) -> None:
        """Best splits of the open nodes, in their order. Sums are set for nodes and their new children."""
        fresh = []
        for node, row in zip(self.open, splits):
            gain, feature, cut = row[0], int(row[1]), int(row[2])
            self.sums[node] = row[3:6]
            if gain > 0:
                children = len(self.feature), len(self.feature) + 1
                self.feature[node], self.cut[node], self.gain[node] = feature, cut, float(gain)
                self.left[node], self.right[node] = children
                self.feature += [-1, -1]
                self.cut += [0, 0]
                self.left += [-1, -1]
                self.right += [-1, -1]
                self.gain += [0.0, 0.0]
                self.sums += [row[6:9], row[3:6] - row[6:9]]
                fresh += children
        self.depth += 1
        self.open = [n for n in fresh if self.sums[n][2] >= 2 * max(self.s.least_rows, 1)] if self.depth < self.s.depth else []

    def partial(self) -> Tree:
        """The tree as it stands, to find the open node of each row."""
        return Tree(np.array(self.feature), np.array(self.cut), np.array(self.left), np.array(self.right), np.zeros(len(self.feature)))

    def done(self) -> Tree:
        """The finished tree with its leaves' values; splits beyond the allowed leaves are taken back, least gain first."""
        kept = set()
        if self.s.leaves is not None:
            ready = [0] if self.feature[0] >= 0 else []
            while ready and len(kept) < self.s.leaves - 1:
                node = max(ready, key=lambda n: (self.gain[n], -n))
                ready.remove(node)
                kept.add(node)
                ready += [c for c in (self.left[node], self.right[node]) if self.feature[c] >= 0]
        else:
            kept = {n for n, f in enumerate(self.feature) if f >= 0}
        value = np.array([
            self.s.rate * (x[0] / self.unit) / max(x[1] / self.weight_unit + self.s.penalty, 1e-12) if x is not None and x[2] else 0.0 for x in self.sums])
        reached = [0]  # nodes that the kept splits lead to, in the order of their numbers
        for node in reached:
            reached += [self.left[node], self.right[node]] if node in kept else []
        place = {node: i for i, node in enumerate(reached)}
        return Tree(
            np.array([self.feature[n] if n in kept else -1 for n in reached]), np.array([self.cut[n] if n in kept else 0 for n in reached]),
            np.array([place[self.left[n]] if n in kept else -1 for n in reached]), np.array([place[self.right[n]] if n in kept else -1 for n in reached]), value[reached])


# ---- gradients ---------------------------------------------------------------------------------------------------


def mixed(row: np.ndarray, step: int) -> np.ndarray:
    """Numbers in [0, 1) from row keys and a step; the same for a row wherever it lies."""
    x = row.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (step + 1)) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53


def residuals(s: Settings, label: np.ndarray, scores: np.ndarray, unit: float, output: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Whole-number gradients to follow, and weights (None: one each), for one output."""
    if s.classes == 1:
        return np.rint((label - scores[:, 0]) * unit), None
    odds = np.exp(scores - scores.max(axis=1, keepdims=True))
    p = odds[:, output] / odds.sum(axis=1)
    return np.rint(((label == output) - p) * unit), np.rint(2.0 * p * (1.0 - p) * unit)


def sampled(s: Settings, row: np.ndarray, step: int) -> np.ndarray:
    return np.ones(len(row), dtype=bool) if s.sample >= 1.0 else mixed(row, step) < s.sample


# ---- bins --------------------------------------------------------------------------------------------------------


def bin_limits(values: np.ndarray) -> np.ndarray:
    """Limits of at most BINS + 1 bins: between all distinct values, or at quantiles. A value at a limit lies below it."""
    distinct = np.unique(values)
    if len(distinct) <= BINS + 1:
        return (distinct[:-1] + distinct[1:]) / 2
    return np.unique(np.quantile(values, np.arange(1, BINS + 1) / (BINS + 1), method="lower"))


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Values of each feature of a batch as one row."""
    for frame in frames:
        for number, own in frame.groupby("set"):
            x = np.stack(own["features"].to_numpy())
            yield pd.DataFrame({"set": number, "feature": range(x.shape[1]), "part": [x[:, j].astype(np.float64).tobytes() for j in range(x.shape[1])]})


def _limits_of(frame: pd.DataFrame) -> pd.DataFrame:
    values = np.frombuffer(b"".join(frame["part"]), np.float64)
    return pd.DataFrame({"set": [frame["set"].iloc[0]], "feature": [frame["feature"].iloc[0]], "limits": [bin_limits(values).tolist()]})


def fit_limits(rows: DataFrame, counts: dict[int, int]) -> dict[int, list[np.ndarray]]:
    """Bin limits per set and feature; a row per feature reaches the driver."""
    least = -(2**63)
    bound = {k: least + min(int(2**64 * min(1.0, BIN_ROWS / max(n, 1))), 2**64 - 1) for k, n in counts.items()}
    offered = F.coalesce(*[F.when(F.col("set") == k, F.xxhash64("row") <= F.lit(b)) for k, b in bound.items()])
    parts = rows.filter(offered).select("set", "features").mapInPandas(_blocks, "set INT, feature INT, part BINARY")
    found = parts.groupBy("set", "feature").applyInPandas(_limits_of, "set INT, feature INT, limits ARRAY<DOUBLE>").collect()
    out: dict[int, dict[int, np.ndarray]] = {}
    for r in found:
        out.setdefault(r["set"], {})[r["feature"]] = np.array(r["limits"])
    return {k: [v[i] for i in range(len(v))] for k, v in out.items()}


def _coded(x: np.ndarray, limits: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(cut, x[:, j], side="left") for j, cut in enumerate(limits)]).astype(np.uint8)


# ---- fitted models -----------------------------------------------------------------------------------------------


@dataclass
class Boosted:
    """A fitted model; ``transform`` adds its prediction, or class probabilities and the likeliest class."""

    settings: Settings
    start: np.ndarray
    limits: list[np.ndarray]
    trees: list[list[Tree]]  # rounds x outputs

    def scores(self, x: np.ndarray) -> np.ndarray:
        codes = _coded(x, self.limits)
        out = np.tile(self.start, (len(x), 1))
        for trees in self.trees:
            for k, tree in enumerate(trees):
                out[:, k] += tree.value[tree.leaves_of(codes)]
        return out

    def _column(self, df: DataFrame, features: str) -> Column:
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<double>")
        def scored(values: pd.Series) -> pd.Series:
            if not len(values):
                return pd.Series([], dtype=object)
            return pd.Series(list(shared.value.scores(np.stack(values.to_numpy()))), dtype=object)

        array = F.col(features) if dict(df.dtypes)[features].startswith("array") else vector_to_array(features)
        return scored(array)

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        out = df.withColumn("_scores", self._column(df, features))
        if self.settings.classes == 1:
            return out.withColumn(self.settings.name, F.col("_scores")[0]).drop("_scores")
        most = F.array_max("_scores")
        odds = F.transform("_scores", lambda v: F.exp(v - most))
        total = F.aggregate(odds, F.lit(0.0), lambda a, b: a + b)
        out = out.withColumn("proba", F.transform(odds, lambda o: o / total))
        return out.withColumn("prediction", (F.array_position("proba", F.array_max("proba")) - 1).cast("double")).drop("_scores")


# ---- fitting -----------------------------------------------------------------------------------------------------


def _start(s: Settings, mean: float) -> np.ndarray:
    return np.array([mean]) if s.classes == 1 else np.zeros(s.classes)


class _Sums:
    """Sums of one tree's open nodes on rows that one task holds.

    Features have as many bins as they use, one after the other. Of two children only the one with fewer rows is counted;
    the other has what is left of their parent.
    """

    def __init__(self, codes: np.ndarray, widths: list[int]):
        self.widths = np.array(widths)
        self.ends = np.cumsum(self.widths)
        self.places = codes.astype(np.int64) + (self.ends - self.widths)
        self.feature = np.repeat(np.arange(len(widths)), self.widths)
        self.base = np.repeat(self.ends - self.widths - 1, self.widths)  # the bin before each feature's first
        self.held: dict[int, np.ndarray] = {}

    def _counted(self, node: np.ndarray, nodes: int, values: list[np.ndarray | None]) -> np.ndarray:
        inside = np.flatnonzero(node >= 0)
        size = nodes * self.ends[-1]
        index = (self.places[inside] + (node[inside] * self.ends[-1])[:, None]).ravel()
        width = len(self.widths)
        return np.stack([np.bincount(index, None if v is None else np.repeat(v[inside], width), minlength=size).reshape(nodes, -1) for v in values], axis=1)

    def of(self, tree: Growing, leaf: np.ndarray, seen: np.ndarray, gradient: np.ndarray, weight: np.ndarray | None) -> np.ndarray:
        """Open nodes x (gradients, rows, weights if these differ) x bins."""
        parent = {c: n for n in range(len(tree.feature)) if tree.feature[n] >= 0 for c in (tree.left[n], tree.right[n])}
        fewer = {n: min((tree.left[n], tree.right[n]), key=lambda c: tree.sums[c][2]) for n in set(map(parent.get, tree.open)) if n is not None}
        wanted = sorted(fewer.values()) or list(tree.open)
        place = np.full(len(tree.feature), -1)
        place[wanted] = np.arange(len(wanted))
        values = [gradient, None] if weight is None else [gradient, None, weight]
        counted = dict(zip(wanted, self._counted(np.where(seen, place[leaf], -1), len(wanted), values)))
        self.held = {n: counted[n] if n in counted else self.held[parent[n]] - counted[fewer[parent[n]]] for n in tree.open}
        return np.stack([self.held[n] for n in tree.open])

    def splits(self, sums: np.ndarray, unit: float, weight_unit: float, s: Settings) -> np.ndarray:
        """The same splits as ``best_splits``."""
        run = np.cumsum(sums, axis=2)
        left = run - np.where(self.base >= 0, run[:, :, self.base], 0.0)
        total = run[:, :, self.ends[0] - 1]
        gradient, rows, weight = left[:, 0], left[:, 1], left[:, -1] if sums.shape[1] == 3 else left[:, 1]
        g, n, w = total[:, 0, None], total[:, 1, None], (total[:, 2] if sums.shape[1] == 3 else total[:, 1])[:, None]
        least = max(s.least_rows, 1)
        ok = (rows >= least) & (n - rows >= least)
        if s.least_weight:
            ok &= (weight >= s.least_weight * weight_unit) & (w - weight >= s.least_weight * weight_unit)

        def worth(gradient, weight):
            out = weight / weight_unit
            out += s.penalty
            np.maximum(out, 1e-12, out=out)
            return np.divide(np.square(gradient / unit), out, out=out)

        gain = worth(gradient, weight)
        gain += worth(g - gradient, w - weight)
        gain -= worth(g, w)
        gain[~ok] = 0.0
        best, at = np.argmax(gain, axis=1), np.arange(len(gain))
        found = gain[at, best]
        feature = self.feature[best]
        own = np.column_stack([np.where(found > 1e-9, found, 0.0), feature, best - self.base[best] - 1])
        return np.column_stack([own, g, w, n, gradient[at, best], weight[at, best], rows[at, best]])


def grow_in_task(s: Settings, codes: np.ndarray, widths: list[int], label: np.ndarray, row: np.ndarray, start: np.ndarray, unit: float) -> list[list[Tree]]:
    """All rounds of one model on rows that one task holds; ``widths`` are the numbers of bins."""
    scores, rounds = np.tile(start, (len(codes), 1)), []
    by_feature, sums = np.ascontiguousarray(codes.T), _Sums(codes, widths)
    for step in range(s.rounds):
        seen, trees = sampled(s, row, step), []
        for output in range(s.classes):
            gradient, weight = residuals(s, label, scores, unit, output)
            tree = Growing(s, unit, 1.0 if weight is None else unit)
            while tree.open:
                leaf = tree.partial().leaves_of(codes)
                if len(codes) < SORT_ROWS * len(widths):
                    place = np.full(len(tree.feature), -1)
                    place[tree.open] = np.arange(len(tree.open))
                    tree.take(sorted_splits(by_feature, np.where(seen, place[leaf], -1), len(tree.open), gradient, weight, unit, tree.weight_unit, s))
                else:
                    tree.take(sums.splits(sums.of(tree, leaf, seen, gradient, weight), unit, tree.weight_unit, s))
            trees.append(tree.done())
        for output, tree in enumerate(trees):
            scores[:, output] += tree.value[tree.leaves_of(codes)]
        rounds.append(trees)
    return rounds


TREE = "model INT, round INT, output INT, feature ARRAY<INT>, cut ARRAY<INT>, left ARRAY<INT>, right ARRAY<INT>, value ARRAY<DOUBLE>"


def _tree_row(model: int, step: int, output: int, t: Tree) -> tuple:
    return model, step, output, t.feature.tolist(), t.cut.tolist(), t.left.tolist(), t.right.tolist(), t.value.tolist()


def _matrix(codes: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)


def _fit_in_tasks(coded: DataFrame, models: list[Settings], starts, units, limits) -> list[list[list[Tree]]]:
    widths = {k: [len(cut) + 1 for cut in own] for k, own in limits.items()}

    def grow(key, frame: pd.DataFrame) -> pd.DataFrame:
        m = int(key[0])
        frame = frame.sort_values("row")
        grown = grow_in_task(models[m], _matrix(frame["codes"]), widths[models[m].set], frame["label"].to_numpy(), frame["row"].to_numpy(), starts[m], units[m])
        rows = [_tree_row(m, step, k, t) for step, trees in enumerate(grown) for k, t in enumerate(trees)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in TREE.split(", ")])

    of_set = F.coalesce(*[F.when(F.col("set") == k, F.array(*[F.lit(i) for i, m in enumerate(models) if m.set == k])) for k in {m.set for m in models}])
    dealt = coded.withColumn("model", F.explode(of_set)).repartitionByRange(len(models), "model")
    found = dealt.groupBy("model").applyInPandas(grow, TREE).collect()  # the fitted trees
    out = [[[None] * m.classes for _ in range(m.rounds)] for m in models]
    for r in found:
        out[r["model"]][r["round"]][r["output"]] = Tree(*[np.array(r[c]) for c in ("feature", "cut", "left", "right", "value")])
    return out


SUMS = "tree INT, node INT, block INT, sums BINARY"
FOUND = "tree INT, node INT, " + ", ".join(f"{c} DOUBLE" for c in SPLIT)


def _fit_by_levels(coded: DataFrame, models: list[Settings], starts, units, limits) -> list[list[list[Tree]]]:
    """One job per level for all models together."""
    spark = coded.sparkSession
    places = np.cumsum([0, *[m.classes for m in models]])  # of each model's scores in a row's array
    first = F.array(*[F.lit(float(v)) for start in starts for v in start])
    state = coded.withColumn("scores", first)
    out: list[list[list[Tree]]] = [[] for _ in models]
    recent: list[dict[int, list[Tree]]] = []  # trees that the written scores lack

    def walked(frame: pd.DataFrame, codes: np.ndarray, number: int, trees: list[dict[int, list[Tree]]]) -> np.ndarray:
        scores = np.stack(frame["scores"].to_numpy()).copy()
        for step in trees:
            for m, own in step.items():
                if models[m].set == number:
                    for k, tree in enumerate(own):
                        scores[:, places[m] + k] += tree.value[tree.leaves_of(codes)]
        return scores

    def carried(shared):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for number, own in frame.groupby("set"):
                    yield own.assign(scores=list(walked(own, _matrix(own["codes"]), number, shared.value)))

        return run

    def summed(shared):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            step, trees, growing = shared.value
            held: dict[int, np.ndarray] = {}
            for frame in frames:
                for number, own in frame.groupby("set"):
                    codes, label, row = _matrix(own["codes"]), own["label"].to_numpy(), own["row"].to_numpy()
                    scores = walked(own, codes, number, trees)
                    for t, (m, output, tree, nodes) in growing.items():
                        s = models[m]
                        if s.set == number:
                            gradient, weight = residuals(s, label, scores[:, places[m] : places[m + 1]], units[m], output)
                            place = np.full(len(tree.feature), -1)
                            place[nodes] = np.arange(len(nodes))
                            node = np.where(sampled(s, row, step), place[tree.leaves_of(codes)], -1)
                            part = node_sums(codes, node, len(nodes), gradient, weight)
                            held[t] = held[t] + part if t in held else part
            rows = []
            for t, sums in held.items():
                for n in range(len(sums)):
                    for block in range(0, sums.shape[1], FEATURE_BLOCK):
                        rows.append((t, n, block, sums[n, block : block + FEATURE_BLOCK].tobytes()))
            yield pd.DataFrame(rows, columns=["tree", "node", "block", "sums"])

        return run

    def decided(shared):
        def run(key, frame: pd.DataFrame) -> pd.DataFrame:
            m = shared.value[2][int(key[0])][0]
            sums = sum(np.frombuffer(b, np.int64) for b in frame["sums"]).reshape(1, -1, BINS + 1, 3)
            split = best_splits(sums, units[m], 1.0 if models[m].classes == 1 else units[m], models[m])
            split[:, 1] += key[2]
            return pd.DataFrame([(int(key[0]), int(key[1]), *split[0])], columns=["tree", "node", *SPLIT])

        return run

    for step in range(max(m.rounds for m in models)):
        trees = {}
        for m, s in enumerate(models):
            if step < s.rounds:
                for k in range(s.classes):
                    trees[len(trees)] = (m, k, Growing(s, units[m], 1.0 if s.classes == 1 else units[m]))
        while growing := {t: (m, k, g.partial(), list(g.open)) for t, (m, k, g) in trees.items() if g.open}:
            shared = spark.sparkContext.broadcast((step, recent, growing))
            parts = state.mapInPandas(summed(shared), SUMS).groupBy("tree", "node", "block").applyInPandas(decided(shared), FOUND)
            best: dict[tuple[int, int], tuple] = {}
            for r in parts.collect():  # a row per open node and block of features
                at = r["tree"], r["node"]
                if at not in best or (r["gain"], -r["feature"]) > (best[at][0], -best[at][1]):
                    best[at] = tuple(r[c] for c in SPLIT)
            for t, (_, _, _, nodes) in growing.items():
                empty = (0.0, 0, 0, 0, 0, 0, 0, 0, 0)
                trees[t][2].take(np.array([best.get((t, n), empty) for n in range(len(nodes))]))
            shared.unpersist()
        grown: dict[int, list[Tree]] = {}
        for m, _, g in trees.values():
            grown.setdefault(m, []).append(g.done())
        for m, own in grown.items():
            out[m].append(own)
        recent.append(grown)
        if len(recent) == KEEP_ROUNDS:
            path = scratch_dir(spark, "boosting-scores")
            shared = spark.sparkContext.broadcast(recent)
            state.mapInPandas(carried(shared), state.schema).write.parquet(path)
            state, recent = spark.read.parquet(path), []
    return out


def fit_boosted(rows: DataFrame, models: Sequence[Settings], in_task_rows: int = IN_TASK_ROWS) -> dict[tuple[int, str], Boosted]:
    """Fit all models on rows with set (INT), row (LONG, unique within a set), features (array<double>) and label (DOUBLE).

    Rows of a set have features of one length and a label. Results by set and name; sets without rows give none.
    """
    spark, models = rows.sparkSession, list(models)
    facts = {r["set"]: r for r in rows.groupBy("set").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("label").cast("decimal(30, 12)")).cast("double").alias("mean"), F.min("label").alias("low"), F.max("label").alias("high")).collect()}
    models = [m for m in models if m.set in facts]
    if not models:
        return {}
    counts = {k: r["n"] for k, r in facts.items()}
    limits = fit_limits(rows, counts)
    shared = spark.sparkContext.broadcast(limits)

    def code(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number, own in frame.groupby("set"):
                codes = _coded(np.stack(own["features"].to_numpy()), shared.value[number])
                yield pd.DataFrame({"set": number, "row": own["row"], "label": own["label"], "codes": [c.tobytes() for c in codes]})

    path = scratch_dir(spark, "boosting-bins")
    rows.select("set", "row", "features", "label").mapInPandas(code, "set INT, row LONG, label DOUBLE, codes BINARY").write.parquet(path)
    coded = spark.read.parquet(path)
    starts = [_start(m, facts[m.set]["mean"]) for m in models]
    spread = {k: max(abs(r["high"] - r["mean"]), abs(r["low"] - r["mean"]), 1e-12) for k, r in facts.items()}
    units = [UNIT / spread[m.set] if m.classes == 1 else UNIT for m in models]
    grow = _fit_in_tasks if max(counts.values()) <= in_task_rows else _fit_by_levels
    trees = grow(coded, models, starts, units, limits)
    return {(m.set, m.name): Boosted(m, start, limits[m.set], own) for m, start, own in zip(models, starts, trees)}
