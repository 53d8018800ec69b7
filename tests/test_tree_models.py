"""Boosted and extremely randomised trees: plain versions, partitioning, both ways of growing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veleta.operators import boosted_trees as B
from veleta.operators import random_cut_trees as R

SCHEMA = "set INT, row LONG, features ARRAY<DOUBLE>, label DOUBLE"


def table(seed, n, width, sets=(0,)):
    rng = np.random.default_rng(seed)
    rows = []
    for number in sets:
        x = np.round(rng.normal(size=(n, width + number)), 2)
        y = 3 * x[:, 0] + (x[:, 1] > 0.3) * 5 + x[:, 2] ** 2 + rng.normal(scale=0.3, size=n)
        rows += [(number, i, x[i].tolist(), float(y[i])) for i in range(n)]
    return rows


def arrays(rows, number=0):
    own = [r for r in rows if r[0] == number]
    return np.array([r[2] for r in own]), np.array([r[3] for r in own])


def plain_boosting(x, y, rounds, depth, rate, least):
    """One tree after the other, every split tried on every feature by plain sums."""
    scores = np.full(len(y), y.mean())

    def grow(rows, left_depth, gradient):
        total, best = gradient[rows].sum() ** 2 / len(rows), (1e-9, None, None)
        for j in range(x.shape[1]) if left_depth else []:
            values = np.unique(x[rows, j])
            for a, b in zip(values, values[1:]):
                below = x[rows, j] <= (a + b) / 2
                if min(below.sum(), (~below).sum()) >= least:
                    left, right = gradient[rows[below]], gradient[rows[~below]]
                    gain = left.sum() ** 2 / len(left) + right.sum() ** 2 / len(right) - total
                    if gain > best[0] + 1e-9:
                        best = gain, j, (a + b) / 2
        if best[1] is None:
            scores[rows] += rate * gradient[rows].mean()
        else:
            below = x[rows, best[1]] <= best[2]
            grow(rows[below], left_depth - 1, gradient)
            grow(rows[~below], left_depth - 1, gradient)

    for _ in range(rounds):
        grow(np.arange(len(y)), depth, y - scores)
    return scores


def test_boosting_equals_plain_version(spark):
    rows = table(1, 220, 4)
    x, y = arrays(rows)
    model = B.fit_boosted(spark.createDataFrame(rows, SCHEMA), [B.Settings("m", 0, 6, 3, rate=0.3, least_rows=5)])[0, "m"]
    got, want = model.scores(x)[:, 0], plain_boosting(x, y, 6, 3, 0.3, 5)
    assert ((got - y) ** 2).mean() == pytest.approx(((want - y) ** 2).mean(), rel=0.02)
    assert np.abs(got - want).max() < 1e-3
    column = model.transform(spark.createDataFrame(rows, SCHEMA)).orderBy("row").select("m").toPandas()["m"]
    assert np.allclose(column, got)


MODELS = [
    B.Settings("hist", 0, 12, 4, least_rows=3, leaves=7), B.Settings("part", 0, 3, 2, sample=0.5), B.Settings("hist", 1, 4, 3, penalty=1.0, least_weight=1.0, sample=0.8),
    B.Settings("classes", 2, 3, 3, penalty=1.0, least_weight=1.0, classes=3),
]


def same_trees(a, b):
    for (_, left), (_, right) in zip(sorted(a.items()), sorted(b.items())):
        for s, t in zip([t for r in left.trees for t in r], [t for r in right.trees for t in r]):
            assert s.feature.tolist() == t.feature.tolist() and s.cut.tolist() == t.cut.tolist() and np.array_equal(s.value, t.value)


def test_boosting_by_levels_and_in_tasks_and_partitions(spark):
    rows = table(2, 260, 40, (0, 1))
    rows += [(2, i, v, float(i % 3)) for i, (_, _, v, _) in enumerate(rows[:150])]
    df = spark.createDataFrame(rows, SCHEMA)
    one = B.fit_boosted(df.repartition(1), MODELS)
    same_trees(one, B.fit_boosted(df.repartition(7, F.rand(3)), MODELS))
    same_trees(one, B.fit_boosted(df.repartition(3, F.rand(5)), MODELS, in_task_rows=0))
    assert max((t.feature < 0).sum() for r in one[0, "hist"].trees for t in r) <= 7
    x, y = arrays(rows)
    assert ((one[0, "hist"].scores(x)[:, 0] - y) ** 2).mean() < 0.6 * y.var()


def test_class_probabilities(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    rows = [(0, i, x[i].tolist(), float((x[i, 0] > 0) + (x[i, 1] > 0.5))) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = B.fit_boosted(df, [B.Settings("c", 0, 20, 3, penalty=1.0, least_weight=1.0, classes=3)])[0, "c"]
    out = model.transform(df).select("label", "proba", "prediction").collect()
    assert all(sum(r["proba"]) == pytest.approx(1) and r["prediction"] == np.argmax(r["proba"]) for r in out)
    assert np.mean([r["label"] == r["prediction"] for r in out]) > 0.97


def test_many_values_are_binned_at_quantiles():
    values = np.random.default_rng(4).normal(size=5000)
    limits = B.bin_limits(values)
    sizes = np.bincount(np.searchsorted(limits, values, side="left"))
    assert len(limits) <= 255 and sizes.max() <= 2 * 5000 / 256 and B.bin_limits(np.array([2.0, 2.0])).tolist() == []


def plain_random_cuts(x, y, s, unit):
    """Recursive growth with the same draws."""
    y = np.rint(y * unit)

    def grow(rows, heap, depth, number):
        value = y[rows].sum() / unit / len(rows)
        if depth == s.depth or len(rows) < 2 * s.least_rows:
            return value
        best, width = (1e-9, None, None), x.shape[1]
        for j in range(width):
            low, high = x[rows, j].min(), x[rows, j].max()
            if high > low:
                draw = B.mixed(np.array([heap * width + j], np.uint64), s.seed * 1_000_003 + number)[0]
                cut = min(low + draw * (high - low), np.nextafter(high, low))
                below = x[rows, j] <= cut
                if min(below.sum(), (~below).sum()) >= s.least_rows:
                    a, b = y[rows[below]].sum() / unit, y[rows[~below]].sum() / unit
                    gain = a**2 / below.sum() + b**2 / (~below).sum() - (a + b) ** 2 / len(rows)
                    if gain > best[0]:
                        best = gain, j, cut
        if best[1] is None:
            return value
        below = x[rows, best[1]] <= best[2]
        return best[1], best[2], grow(rows[below], 2 * heap, depth + 1, number), grow(rows[~below], 2 * heap + 1, depth + 1, number)

    def walk(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    trees = [grow(np.arange(len(y)), 1, 0, number) for number in range(s.trees)]
    return np.array([np.mean([walk(t, row) for t in trees]) for row in x])


def test_random_cuts_equal_plain_version_both_ways(spark):
    rows = table(5, 150, 5, (0, 1))
    rows = [(s, r, [*x[:-1], 1.0], y) for s, r, x, y in rows]  # a feature without a range
    models = [R.Settings("e", 0, 15, 4, least_rows=3), R.Settings("e", 1, 4, 8), R.Settings("f", 0, 3, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    for fitted in (R.fit_random_cuts(df.repartition(5), models), R.fit_random_cuts(df.repartition(3, F.rand(1)), models, in_task_rows=0)):
        for s in models:
            x, y = arrays(rows, s.set)
            assert np.allclose(fitted[s.set, s.name].scores(x), plain_random_cuts(x, y, s, B.UNIT / np.abs(y).max()))
    out = fitted[0, "e"].transform(df.filter("set = 0")).orderBy("row").toPandas()["e"]
    assert np.allclose(out, fitted[0, "e"].scores(arrays(rows)[0]))


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert B.fit_boosted(empty, MODELS) == {} and R.fit_random_cuts(empty, [R.Settings("e", 0, 2, 2)]) == {}
