"""Classifier and regression metrics as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veleta.fixed_values import CLASSES
from veleta.operators.order_stats import with_running_totals


def confusion_matrix(df: DataFrame, actual: str, predicted: str, classes: Sequence[str] = CLASSES) -> DataFrame:
    """Counts of every (actual, predicted) pair of the class list, zeros included."""
    row = df.agg(
        *[
            F.count_if((F.col(actual) == a) & (F.col(predicted) == p)).alias(f"{a}__{p}")
            for a in classes
            for p in classes
        ]
    )
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"{a}__{p}").alias("n"))
            for a in classes
            for p in classes
        ]
    )
    return row.select(F.explode(cells).alias("_c")).select("_c.*")


def _per_class(confusion: DataFrame, classes: Sequence[str]) -> DataFrame:
    """tp, fp, fn, tn per class from the k x k table."""
    total = F.sum("n")
    parts = []
    for c in classes:
        tp = F.sum(F.when((F.col("actual") == c) & (F.col("predicted") == c), F.col("n")).otherwise(0))
        said = F.sum(F.when(F.col("predicted") == c, F.col("n")).otherwise(0))
        real = F.sum(F.when(F.col("actual") == c, F.col("n")).otherwise(0))
        parts.append(
            F.struct(
                F.lit(c).alias("class"), tp.alias("tp"), (said - tp).alias("fp"), (real - tp).alias("fn"),
                (total - said - real + tp).alias("tn"),
            )
        )
    return confusion.agg(F.array(*parts).alias("_p")).select(F.explode("_p").alias("_c")).select("_c.*")


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def class_report(confusion: DataFrame, classes: Sequence[str] = CLASSES) -> DataFrame:
    """Precision, recall, F1, support per class, then macro, weighted and accuracy rows."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    rows = _per_class(confusion, classes).select(
        "class",
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(tp * 2.0, tp * 2 + fp + fn).alias("f1"),
        (tp + fn).alias("support"),
        "tp",
    )
    support = F.sum("support")
    weighted = lambda c: _ratio(F.sum(F.col(c) * F.col("support")), support)
    summary = rows.agg(
        F.array(
            F.struct(
                F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), support.alias("support"),
            ),
            F.struct(
                F.lit("weighted avg").alias("class"), weighted("precision").alias("precision"),
                weighted("recall").alias("recall"), weighted("f1").alias("f1"), support.alias("support"),
            ),
            F.struct(
                F.lit("accuracy").alias("class"), _ratio(F.sum("tp"), support).alias("precision"),
                _ratio(F.sum("tp"), support).alias("recall"), _ratio(F.sum("tp"), support).alias("f1"),
                support.alias("support"),
            ),
        ).alias("_s")
    ).select(F.explode("_s").alias("_r")).select("_r.*")
    return rows.drop("tp").unionByName(summary)


def false_alarm_rate(confusion: DataFrame, classes: Sequence[str] = CLASSES) -> DataFrame:
    return _per_class(confusion, classes).select(
        "class", _ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("false_alarm_rate")
    )


def _one_vs_rest(df: DataFrame, actual: str, scores: dict[str, str]) -> DataFrame:
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("class"),
                F.col(p).cast("double").alias("score"),
                (F.col(actual) == c).cast("int").alias("hit"),
            )
            for c, p in scores.items()
        ]
    )
    return df.select(F.explode(entries).alias("_e")).select("_e.*")


def brier(df: DataFrame, actual: str, scores: dict[str, str]) -> DataFrame:
    """Mean squared probability error of classes that occur."""
    return (
        _one_vs_rest(df, actual, scores)
        .groupBy("class")
        .agg(F.avg(F.pow(F.col("score") - F.col("hit"), F.lit(2.0))).alias("brier"), F.sum("hit").alias("_hits"))
        .filter(F.col("_hits") > 0)
        .drop("_hits")
    )


def pr_auc(df: DataFrame, actual: str, scores: dict[str, str]) -> DataFrame:
    """One-vs-rest area under precision-recall by the trapezoid over score thresholds.

    Rows collapse to distinct scores first; running totals go through bins that follow the scores,
    so no task orders the whole curve. The curve ends at recall 0, precision 1.
    """
    counts = (
        _one_vs_rest(df, actual, scores)
        .groupBy("class", "score")
        .agg(F.sum("hit").cast("long").alias("hits"), F.count(F.lit(1)).alias("rows"))
        # Highest score first: order on the negated score.
        .withColumn("order", -F.col("score"))
    )
    totals = counts.groupBy("class").agg(F.sum("hits").alias("positives")).filter(F.col("positives") > 0)
    curve = with_running_totals(counts, ["class"], "order", ["hits", "rows"]).join(
        F.broadcast(totals), "class"
    )
    # A threshold and the next higher one differ by this score's own hits and rows, so both
    # ends of a trapezoid are on the same row.
    hits_after, rows_after = F.col("hits_before") + F.col("hits"), F.col("rows_before") + F.col("rows")
    precision = hits_after / rows_after
    earlier = F.when(F.col("rows_before") > 0, F.col("hits_before") / F.col("rows_before")).otherwise(F.lit(1.0))
    area = F.col("hits") / F.col("positives") * (precision + earlier) / 2
    return curve.groupBy("class").agg(F.sum(area).alias("pr_auc"))


def reg_metrics(df: DataFrame, actual: str, predictions: Sequence[str], digits: int = 4) -> DataFrame:
    """MAE, RMSE and R² of each prediction column, in one pass."""
    y = F.col(actual)
    sst = F.var_pop(y) * F.count(y)
    row = df.filter(y.isNotNull()).agg(
        *[
            F.struct(
                F.lit(p).alias("model"),
                F.round(F.avg(F.abs(y - F.col(p))), digits).alias("mae"),
                F.round(F.sqrt(F.avg((y - F.col(p)) * (y - F.col(p)))), digits).alias("rmse"),
                F.round(F.lit(1.0) - F.sum((y - F.col(p)) * (y - F.col(p))) / F.nullif(sst, F.lit(0.0)), digits).alias("r2"),
            ).alias(p)
            for p in predictions
        ]
    )
    return row.select(F.explode(F.array(*[F.col(p) for p in predictions])).alias("_m")).select("_m.*")


def ev_weights(metrics: DataFrame) -> DataFrame:
    """Inverse-MAE weights over a table of one row per model; uniform when none is usable."""
    raw = F.when((F.col("r2") > -1.0) & (F.col("mae") > 0), F.lit(1.0) / (F.col("mae") + 1e-4)).otherwise(F.lit(0.0))
    every = Window.partitionBy(F.lit(1))
    total, models = F.sum("_raw").over(every), F.count(F.lit(1)).over(every)
    weight = F.when(total > 0, F.col("_raw") / total).otherwise(F.lit(1.0) / models)
    return metrics.withColumn("_raw", raw).withColumn("weight", F.round(weight, 4)).drop("_raw")
