"""Small helpers for evidence texts and optional columns."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PLACE = re.compile(r"%\+?\.(\d)f")


def said(condition: Column, text: str, *values: Column) -> Column:
    """``text`` where the condition holds, else null. Numbers are rounded half-even."""
    if not values:
        return F.when(condition, F.lit(text))
    digits = [int(d) for d in _PLACE.findall(text)]
    if len(digits) == len(values):
        values = tuple(F.bround(v, d) for v, d in zip(values, digits))
    return F.when(condition, F.format_string(text, *values))


def gathered(*texts: Column) -> Column:
    """The non-null texts in order."""
    return F.array_compact(F.array(*texts))


def optional(df: DataFrame, name: str, kind: str = "double") -> Column:
    """The column, or a typed null where the table lacks it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def flag(df: DataFrame, name: str) -> Column:
    return F.coalesce(optional(df, name, "boolean"), F.lit(False))


def holds(condition: Column) -> Column:
    """Comparisons with a missing value do not hold."""
    return F.coalesce(condition, F.lit(False))


def tiers(*steps: tuple[Column, float]) -> Column:
    """Points of the first step that holds, else 0."""
    out = F.when(steps[0][0], F.lit(float(steps[0][1])))
    for condition, points in steps[1:]:
        out = out.when(condition, F.lit(float(points)))
    return out.otherwise(F.lit(0.0))


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Fix the columns computed so far as columns, and count the rows that pass.

    Filters and projections are not merged through an observed stage. Without it the optimizer
    would inline the scores of one stage into every use in the next, and expressions would
    multiply with each stage.
    """
    return df.observe(f"{name}-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))
