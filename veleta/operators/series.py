"""Ordered per-station work that survives a station holding a third of all rows.

Windows over a station are cut into time chunks for stations above a row limit. Each chunk
receives copies of the few neighbouring rows its frames reach (context rows), so results equal
those of one whole-station window; stations below the limit stay in a single chunk.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from veleta.fixed_values import SENSORS
from veleta.operators.order_stats import SMALL_GROUP_ROWS

STATION, TIME, SEQ = "station_id", "timestamp", "seq"
ORDER = [TIME, SEQ]
CHUNK, CONTEXT = "_chunk", "_context"

# A station may fill one window task up to this many rows, or up to its share of an
# 8,000-task job where that is larger. It also bounds the list of hot stations to 8,000.
TASK_ROWS = 4_000_000
TASK_SHARE = 8_000


def micros(ts: Column) -> Column:
    """Epoch microseconds of a zone-less or zoned timestamp."""
    return F.unix_micros(ts.cast("timestamp"))


def station_window() -> WindowSpec:
    return Window.partitionBy(STATION).orderBy(*ORDER)


@dataclass(frozen=True)
class SeriesLayout:
    """Measured sizes of a table of station series."""

    rows: int
    stations: int
    max_rows: int
    hot: tuple[str, ...] = ()
    chunk_seconds: int = 0
    empty_sensors: tuple[str, ...] = ()

    @classmethod
    def measure(cls, df: DataFrame, task_rows: int = TASK_ROWS) -> "SeriesLayout":
        """One pre-aggregated pass over station and sensor columns."""
        sensors = [c for c in SENSORS if c in df.columns]
        per_station = df.groupBy(STATION).agg(
            F.count(F.lit(1)).alias("n"),
            F.min(TIME).alias("first"),
            F.max(TIME).alias("last"),
            *[F.count(c).alias(f"n_{c}") for c in sensors],
        )
        total = per_station.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.count(F.lit(1)).alias("stations"),
            F.coalesce(F.max("n"), F.lit(0)).alias("max_rows"),
            *[F.min(f"n_{c}").alias(f"n_{c}") for c in sensors],
        ).first()
        empty = tuple(c for c in sensors if total[f"n_{c}"] == 0)
        limit = max(task_rows, total["rows"] // TASK_SHARE)
        if total["max_rows"] <= limit:
            return cls(total["rows"], total["stations"], total["max_rows"], empty_sensors=empty)
        hot = (
            per_station.filter(F.col("n") > limit)
            .select(STATION, "n", ((micros(F.col("last")) - micros(F.col("first"))) / 1e6).alias("span"))
            .collect()
        )
        names = tuple(sorted(r[STATION] for r in hot))
        seconds = max(1, int(min(r["span"] * limit / r["n"] for r in hot)))
        # Bursts: halve the chunk until the fullest one fits, or it is one second long.
        while seconds > 1:
            fullest = (
                df.filter(F.col(STATION).isin(list(names)))
                .groupBy(STATION, _chunk_of(seconds).alias(CHUNK))
                .count()
                .agg(F.max("count"))
                .first()[0]
            )
            if fullest <= 2 * limit:
                break
            seconds = max(1, seconds // 2)
        return cls(total["rows"], total["stations"], total["max_rows"], names, seconds, empty)

    @property
    def small_groups(self) -> bool:
        """True when a station's distinct values fit one aggregation buffer."""
        return self.max_rows <= SMALL_GROUP_ROWS and not self.hot

    @property
    def small_network(self) -> bool:
        """True when a one-row-per-station table is small enough to broadcast."""
        return self.stations <= 200_000

    @property
    def small_baselines(self) -> bool:
        """True when a table of 24 rows per station is small enough to broadcast."""
        return 24 * self.stations <= 200_000

    def window(self) -> WindowSpec:
        if not self.hot:
            return station_window()
        return Window.partitionBy(STATION, CHUNK).orderBy(*ORDER)

    def is_hot(self) -> Column:
        return F.col(STATION).isin(list(self.hot))

    def with_chunk(self, df: DataFrame) -> DataFrame:
        if not self.hot:
            return df
        return df.withColumn(CHUNK, F.when(self.is_hot(), _chunk_of(self.chunk_seconds)).otherwise(F.lit(0)))

    def run(self, df: DataFrame, fn, before: int = 0, after: int = 0) -> DataFrame:
        """Apply ``fn`` to ``df`` extended by the context rows its frames reach.

        Inside an outer ``run`` the rows are already there, so a chain of operators copies
        context once. Without hot stations this is a plain call.
        """
        if not self.hot or CONTEXT in df.columns:
            return fn(df)
        chunked = self.with_chunk(df)
        hot_rows = chunked.filter(self.is_hot())
        opened = chunked.withColumn(CONTEXT, F.lit(False))
        if before:
            opened = opened.unionByName(_context(hot_rows, before, True))
        if after:
            opened = opened.unionByName(_context(hot_rows, after, False))
        return fn(opened).filter(~F.col(CONTEXT)).drop(CHUNK, CONTEXT)


def _chunk_of(seconds: int) -> Column:
    return F.floor(micros(F.col(TIME)) / F.lit(1e6 * seconds))


def _context(hot_rows: DataFrame, reach: int, before: bool) -> DataFrame:
    """Copies of the ``reach`` rows before (or after) each chunk, labelled with that chunk.

    Every chunk keeps its ``reach`` outermost rows (a group limit that prunes before the
    shuffle); the rows a chunk needs are among those of its ``reach`` nearest neighbours.
    """
    payload = [c for c in hot_rows.columns if c != CHUNK]
    order = [F.col(c).desc() if before else F.col(c).asc() for c in ORDER]
    edge = (
        hot_rows.withColumn("_rn", F.row_number().over(Window.partitionBy(STATION, CHUNK).orderBy(*order)))
        .filter(F.col("_rn") <= reach)
        .groupBy(STATION, CHUNK)
        .agg(F.array_sort(F.collect_list(F.struct(*ORDER, *[c for c in payload if c not in ORDER]))).alias("_edge"))
    )
    chunks = Window.partitionBy(STATION).orderBy(CHUNK)
    frame = chunks.rowsBetween(-reach, -1) if before else chunks.rowsBetween(1, reach)
    near = F.flatten(F.collect_list("_edge").over(frame))
    near = F.slice(near, F.greatest(F.size(near) - reach, F.lit(0)) + 1, reach) if before else F.slice(near, 1, reach)
    return (
        edge.select(CHUNK, near.alias("_near"))
        .select(CHUNK, F.explode("_near").alias("_row"))
        .select(*[F.col(f"_row.{c}").alias(c) for c in payload], CHUNK, F.lit(True).alias(CONTEXT))
    )


def source_column(df: DataFrame, sensor: str) -> str:
    """The cleaned column of a sensor where there is one."""
    clean = f"{sensor}_clean"
    return clean if clean in df.columns else sensor


def present_sensors(df: DataFrame, sensors: Sequence[str] | None = None) -> list[str]:
    return [s for s in (sensors or SENSORS) if s in df.columns or f"{s}_clean" in df.columns]
