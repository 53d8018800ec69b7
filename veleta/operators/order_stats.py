"""Exact order statistics and running totals without a single-task sort.

Values are counted per distinct value first (map-side combine). They are then dealt to bins of equal width
between the smallest and the largest value, and each bin to such bins of its own range again, so
that bins follow the data at any scale of values. Only the bins that hold a wanted rank are kept, and only these
are ordered. No task sees a whole group; the plain ``percentile`` aggregate is used only where the caller
has checked that its groups are small. Order statistics of whole columns need no shuffle of values: tasks count them per part of
the interval that a wanted rank lies in, and the part that holds it is the next interval.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Distinct values that may sit in the buffers of one aggregation task, all columns together.
SMALL_GROUP_ROWS = 4_000_000
BINS = 4096
PARTS = 1024, 16384  # least and most parts that a pass cuts an interval into; fewer for more intervals
FEW = 2048  # values of an interval that are fetched, times as many as the parts are more than the least


def _bin(value: str) -> Column:
    """Bin of equal width between the columns ``_lo`` and ``_hi``."""
    place = F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BINS)
    return F.when(F.col("_hi") > F.col("_lo"), F.least(F.greatest(place, F.lit(0)), F.lit(BINS - 1))).otherwise(F.lit(0)).cast("int")


def _with_range(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Add the smallest and largest value of the group."""
    span = counts.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    if keys:
        return counts.join(span, list(keys))
    lo, hi = span.first()  # one row
    return counts.withColumns({"_lo": F.lit(lo), "_hi": F.lit(hi)})


def with_running_totals(counts: DataFrame, keys: Sequence[str], value: str, measures: Sequence[str]) -> DataFrame:
    """Add ``<m>_before``: total of ``m`` over smaller values of the same group; ``value`` is numeric.

    Totals of at most BINS bins are summed across bins at each of two levels, the second within the range of
    a bin of the first; rows are summed inside their bin.
    """
    path = list(keys)
    out = _with_range(counts, path, value)
    for level in range(2):
        bin_ = f"_bin{level}"
        out = out.withColumn(bin_, _bin(value)).drop("_lo", "_hi")
        across = Window.partitionBy(*path).orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)
        bins = out.groupBy(*path, bin_).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), *[F.sum(m).alias(f"_{m}") for m in measures])
        before = [F.coalesce(F.sum(f"_{m}").over(across), F.lit(0)).alias(f"_{m}_off{level}") for m in measures]
        out = out.join(bins.select(*path, bin_, "_lo", "_hi", *before), [*path, bin_])
        path.append(bin_)
    inside = Window.partitionBy(*path).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    totals = {
        f"{m}_before": F.col(f"_{m}_off0") + F.col(f"_{m}_off1") + F.coalesce(F.sum(m).over(inside), F.lit(0)) for m in measures
    }
    return out.select(*counts.columns, *[c.alias(n) for n, c in totals.items()])


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    probs: Sequence[float],
    small_groups: bool,
) -> DataFrame:
    """Interpolated quantiles per group as ``<col>_q<i>`` columns; nulls are skipped."""
    keys, cols = list(keys), list(cols)
    if small_groups:
        # One percentile call per column: its buffer of counted values is built once.
        arrays = df.groupBy(*keys).agg(
            *[F.percentile(c, F.array(*[F.lit(float(p)) for p in probs])).alias(c) for c in cols]
        )
        return arrays.select(
            *keys, *[F.col(c)[i].alias(f"{c}_q{i}") for c in cols for i in range(len(probs))]
        )
    return _ranked_quantiles(df, keys, cols, probs) if keys else _whole_quantiles(df, cols, probs)


def _ordinals(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles: equal only for equal ones, NaN last."""
    bits = np.where(np.isnan(values), np.nan, values + 0.0).view(np.int64)
    return bits.view(np.uint64) ^ np.where(bits < 0, np.uint64(2**64 - 1), np.uint64(2**63))


def _doubles(ordinals: np.ndarray) -> np.ndarray:
    ordinals = np.asarray(ordinals, dtype=np.uint64)
    return (ordinals ^ np.where(ordinals >= np.uint64(2**63), np.uint64(2**63), np.uint64(2**64 - 1))).view(np.float64)


def _search(df: DataFrame, spans: Sequence[tuple[str, int, int]], few: Sequence[bool], parts: int) -> list[tuple]:
    """Of the values of each (column, smallest, largest ordinal): all in order where they are few, else their smallest and largest
    and the counts of equal parts.
    """
    at: dict[str, list[tuple[int, int, int]]] = {}
    for i, (c, lo, hi) in enumerate(spans):
        at.setdefault(c, []).append((i, lo, hi))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}
        for batch in batches:
            for c, intervals in at.items():
                known = _ordinals(batch.column(c).drop_null().to_numpy(zero_copy_only=False))
                for i, lo, hi in intervals:
                    inside = known[(known >= lo) & (known <= hi)]
                    if few[i]:
                        seen.setdefault(i, []).append(inside)
                    elif len(inside):
                        part = ((inside - np.uint64(lo)) // np.uint64((hi - lo) // parts + 1)).astype(np.int64)
                        held = seen.setdefault(i, [inside[0], inside[0], np.zeros(parts, dtype=np.int64)])
                        held[:] = min(held[0], inside.min()), max(held[1], inside.max()), held[2] + np.bincount(part, minlength=parts)
        values = [np.concatenate(v).tobytes() if few[i] else np.array(v[:2]).tobytes() + v[2].tobytes() for i, v in seen.items()]
        yield pa.RecordBatch.from_pydict({"span": pa.array(list(seen), pa.int32()), "found": pa.array(values, pa.binary())})

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        if few[frame["span"].iloc[0]]:
            total = np.sort(np.frombuffer(b"".join(frame["found"]), dtype=np.uint64)).tobytes()
        else:
            ends = np.array([np.frombuffer(f[:16], dtype=np.uint64) for f in frame["found"]])
            counts = sum(np.frombuffer(f[16:], dtype=np.int64) for f in frame["found"])
            total = np.array([ends[:, 0].min(), ends[:, 1].max()]).tobytes() + counts.tobytes()
        return pd.DataFrame({"span": frame["span"].iloc[:1], "found": [total]})

    schema = "span INT, found BINARY"
    found = df.select(*at).mapInArrow(count, schema).groupBy("span").applyInPandas(added, schema).collect()  # a row per interval
    by_span = {r["span"]: r["found"] for r in found}
    return [
        (np.frombuffer(by_span[i], dtype=np.uint64),) if few[i] else (*np.frombuffer(by_span[i][:16], dtype=np.uint64), np.frombuffer(by_span[i][16:], dtype=np.int64))
        for i in range(len(spans))
    ]


def column_ranks(df: DataFrame, ranks: Mapping[str, Sequence[int]]) -> dict[str, dict[int, float]]:
    """Values at 0-based ranks of whole columns of doubles; nulls have no rank, and every rank must exist.

    A pass cuts the interval of ordinals that holds a rank to a thousandth, so seven passes are the most, whatever the values. It
    ends early when one value or few ones are left. ``df`` is read in every pass.
    """
    found: dict[str, dict[int, float]] = {c: {} for c in ranks}
    wanted = {c: sorted(set(r)) for c, r in ranks.items() if len(r)}
    # By interval: the number of its values, and ranks with their places in it.
    spans: dict[tuple[str, int, int], tuple[float, list[tuple[int, int]]]] = {(c, 0, 2**64 - 1): (np.inf, [(r, r) for r in rs]) for c, rs in wanted.items()}
    while spans:
        parts = int(np.clip(2**18 // len(spans), *PARTS))
        few = [n <= FEW * parts // PARTS[0] for n, _ in spans.values()]
        smaller: dict[tuple[str, int, int], tuple[float, list[tuple[int, int]]]] = {}
        for ((c, lo, hi), (_, places)), result in zip(spans.items(), _search(df, list(spans), few, parts)):
            if len(result) == 1 or result[0] == result[1]:  # all values, or the only one
                found[c].update({r: float(_doubles(result[0][place] if len(result) == 1 else result[0])) for r, place in places})
                continue
            counts, width = result[2], (hi - lo) // parts + 1
            until = np.cumsum(counts)
            for r, place in places:
                part = int(np.searchsorted(until, place, side="right"))
                start = lo + part * width
                part_ends = max(start, int(result[0])), min(start + width - 1, int(result[1]))
                smaller.setdefault((c, *part_ends), (int(counts[part]), []))[1].append((r, place - int(until[part] - counts[part])))
        spans = smaller
    return found


def between(low: float, high: float, share: float) -> float:
    return low if low == high else low + (high - low) * share


def _whole_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """One row of quantiles of whole columns; the columns are computed once and kept for the passes."""
    held = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).persist()
    counts = held.agg(*[F.count(c).alias(c) for c in cols]).first()
    places = {c: [(counts[c] - 1) * float(p) for p in probs] if counts[c] else [] for c in cols}
    found = column_ranks(held, {c: [int(f(h)) for h in hs for f in (np.floor, np.ceil)] for c, hs in places.items()})
    held.unpersist()
    values = [
        between(found[c][int(np.floor(h))], found[c][int(np.ceil(h))], h - np.floor(h)) if places[c] else None
        for c in cols for h in (places[c] or probs)
    ]
    names = [f"{c}_q{i}" for c in cols for i in range(len(probs))]
    return df.sparkSession.range(1).select(*[F.lit(None if v is None else float(v)).cast("double").alias(n) for n, v in zip(names, values)])


def _ranked_quantiles(
    df: DataFrame, keys: list[str], cols: list[str], probs: Sequence[float]
) -> DataFrame:
    group = [*keys, "_col"]
    long = df.select(
        *keys,
        F.explode(
            F.array(
                *[F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_v")) for c in cols]
            )
        ).alias("_s"),
    ).select(*keys, "_s.*")
    counts = long.filter(F.col("_v").isNotNull()).groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_n"))
    held = counts
    position = [(F.col("_total") - 1) * F.lit(float(p)) for p in probs]
    wanted = [f(h) for h in position for f in (F.floor, F.ceil)]

    def covers(start: Column, width: Column) -> list[Column]:
        return [(start <= w) & (w < start + width) for w in wanted]

    path = list(group)
    held = _with_range(held, path, "_v")
    for level in range(2):
        bin_ = f"_bin{level}"
        known = [F.first(c).alias(c) for c in ("_off", "_total")] if level else []
        held = held.withColumn(bin_, _bin("_v")).drop("_lo", "_hi")
        bins = held.groupBy(*path, bin_).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_in_bin"), *known)
        if not level:
            bins = bins.withColumns({"_off": F.lit(0).cast("long"), "_total": F.sum("_in_bin").over(Window.partitionBy(*path))})
        across = Window.partitionBy(*path).orderBy(bin_)
        bins = bins.withColumn("_off", F.col("_off") + F.sum("_in_bin").over(across) - F.col("_in_bin"))
        hit = reduce(lambda a, b: a | b, covers(F.col("_off"), F.col("_in_bin")))
        hits = bins.filter(hit).select(*path, bin_, "_off", "_total", "_lo", "_hi")
        path.append(bin_)
        held = held.drop("_off", "_total").join(hits, path)
    inside = Window.partitionBy(*path).orderBy("_v")
    placed = held.withColumn("_start", F.col("_off") + F.sum("_n").over(inside) - F.col("_n"))
    picks = covers(F.col("_start"), F.col("_n"))
    picked = placed.groupBy(*group).agg(
        F.max("_total").alias("_total"),
        *[F.max(F.when(c, F.col("_v"))).alias(f"_w{i}") for i, c in enumerate(picks)],
    )
    values = []
    for i, h in enumerate(position):
        low, high = F.col(f"_w{2 * i}"), F.col(f"_w{2 * i + 1}")
        values.append((low + (high - low) * (h - F.floor(h))).alias(f"_q{i}"))
    solved = picked.select(*group, *values)
    aggs = [
        F.max(F.when(F.col("_col") == c, F.col(f"_q{i}"))).alias(f"{c}_q{i}")
        for c in cols
        for i in range(len(probs))
    ]
    return solved.groupBy(*keys).agg(*aggs)


def values_at_ranks(df: DataFrame, value: str, order: Column, ranks: Sequence[int]) -> list:
    """The distinct values of ``value`` at the given 0-based ranks; None beyond the end.

    ``order`` is a number that grows with the value. Only the requested values travel to the driver.
    """
    distinct = df.select(value).filter(F.col(value).isNotNull()).distinct().withColumns({"_one": F.lit(1), "_order": order})
    ranked = with_running_totals(distinct, [], "_order", ["_one"])
    found = {
        r["_one_before"]: r[value]
        for r in ranked.filter(F.col("_one_before").isin([int(r) for r in ranks])).collect()
    }
    return [found.get(r) for r in ranks]
