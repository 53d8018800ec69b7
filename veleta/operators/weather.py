"""Evidence that an anomaly is genuine weather."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veleta import fixed_values as V
from veleta.functions.texts import clip, flag, gathered, holds, optional, said, staged, tiers


@dataclass(frozen=True)
class Signals:
    """Readings of a row with their defaults, and the optional context columns."""

    rain: Column
    wind: Column
    temp: Column
    rh: Column
    pressure: Column
    temp_residual: Column
    agreement: Column
    temp_delta: Column
    rh_delta: Column
    pressure_delta: Column
    freeze: Column
    spike: Column
    comm: Column

    @classmethod
    def of(cls, df: DataFrame) -> "Signals":
        def reading(name: str, default: float) -> Column:
            return F.coalesce(optional(df, name), F.lit(default))

        return cls(
            reading("rainfall_mm", 0.0),
            reading("wind_speed_kmh", 0.0),
            reading("temperature_c", 25.0),
            reading("relative_humidity_pct", 50.0),
            reading("pressure_hpa", 1013.0),
            reading("temperature_c_residual", 0.0),
            optional(df, "neighbor_agreement_score"),
            optional(df, "temperature_c_delta"),
            optional(df, "relative_humidity_pct_delta"),
            optional(df, "pressure_hpa_delta"),
            flag(df, "rule_freeze"),
            flag(df, "rule_spike"),
            flag(df, "rule_communication"),
        )


Part = tuple[Column, list[Column]]


def _stepped(value: Column, steps: list[tuple[Column, float]], texts: list[str]) -> Part:
    """Exclusive tiers of one reading, each with its text."""
    said_texts, earlier = [], F.lit(False)
    for (condition, _), text in zip(steps, texts):
        said_texts.append(said(condition & ~earlier, text, value))
        earlier = earlier | condition
    return tiers(*steps), said_texts


def wx_rain(s: Signals) -> Part:
    r = s.rain
    return _stepped(r, [(r >= 25.0, 0.50), (r >= 10.0, 0.35), (r > 1.0, 0.20)], V.TEXT_RAIN)


def wx_wind(s: Signals) -> Part:
    w = s.wind
    return _stepped(w, [(w >= 45.0, 0.45), (w >= 30.0, 0.30), (w >= 22.0, 0.15)], V.TEXT_WIND)


def wx_temp_extreme(s: Signals) -> Part:
    t, rh = s.temp, s.rh
    severe = (t >= 44.0) & (rh <= 45.0)
    heat = ~severe & (t >= 40.0) & (rh <= 55.0)
    bitter = (t <= 5.0) & (t >= -20.0)
    cold = ~bitter & (t <= 10.0) & (t >= -20.0)
    points = tiers((severe, 0.50), (heat, 0.35), (bitter, 0.45), (cold, 0.30))
    return points, [
        said(severe, V.TEXT_HEAT_SEVERE, t, rh),
        said(heat, V.TEXT_HEAT, t),
        said(bitter, V.TEXT_COLD_SEVERE, t),
        said(cold, V.TEXT_COLD, t),
    ]


def wx_thermo(s: Signals) -> Part:
    moist = (s.rain >= 5.0) & (s.rh >= 75.0)
    cooling = moist & ((s.temp_residual < -2.0) | ((s.temp < 30.0) & (s.rh >= 80.0)))
    low = (s.pressure < 1004.0) & ((s.rain >= 5.0) | (s.wind >= 25.0))
    points = tiers((moist, 0.30)) + tiers((cooling, 0.20)) + tiers((low, 0.25))
    return points, [
        said(moist, V.TEXT_MOIST, s.rh),
        said(cooling, V.TEXT_COOLING),
        said(low, V.TEXT_LOW_PRESSURE, s.pressure),
    ]


def wx_spatial(s: Signals) -> Part:
    close = holds(s.agreement < 2.0)
    some = ~close & holds(s.agreement < 4.0)
    return tiers((close, 0.35), (some, 0.15)), [
        said(close, V.TEXT_NEIGHBOURS, s.agreement),
        said(some, V.TEXT_NEIGHBOURS_SOME),
    ]


def wx_front(s: Signals) -> Part:
    front = holds((s.temp_delta < -1.5) & (s.rh_delta > 5.0))
    drop = holds(s.pressure_delta < -1.5)
    return tiers((front, 0.25)) + tiers((drop, 0.20)), [
        said(front, V.TEXT_FRONT, s.temp_delta, s.rh_delta),
        said(drop, V.TEXT_PRESSURE_DROP, s.pressure_delta),
    ]


PARTS = {
    "wx_rain": wx_rain,
    "wx_wind": wx_wind,
    "wx_temp_extreme": wx_temp_extreme,
    "wx_thermo": wx_thermo,
    "wx_spatial": wx_spatial,
    "wx_front": wx_front,
}


def disqualified(points: Column, s: Signals) -> Column:
    """Each hardware signature in turn leaves 15 % of the points, 0.10 at most.

    After the first one the cap cannot bind again, so the others only scale.
    """
    signs = s.freeze.cast("int") + s.spike.cast("int") + s.comm.cast("int")
    first = F.least(points * 0.15, F.lit(0.10))
    return F.when(signs == 0, points).otherwise(first * F.pow(F.lit(0.15), signs - 1))


def wx_disqualify(s: Signals) -> list[Column]:
    return [
        said(s.freeze, V.TEXT_NOT_FREEZE),
        said(s.spike, V.TEXT_NOT_SPIKE),
        said(s.comm, V.TEXT_NOT_COMM),
    ]


def points_of(df: DataFrame, *names: str) -> DataFrame:
    """Points of single parts as ``<name>_points`` columns."""
    s = Signals.of(df)
    return df.withColumns({f"{n}_points": F.bround(PARTS[n](s)[0], 4) for n in names})


def wx_score(df: DataFrame) -> DataFrame:
    """``genuine_event_score`` in [0, 1] and its evidence."""
    s = Signals.of(df)
    total, texts = F.lit(0.0), []
    for part in PARTS.values():
        points, said_texts = part(s)
        total = total + points
        texts += said_texts
    df = staged(df.withColumn("_points", total), "event-points")
    score = clip(disqualified(F.col("_points"), s), 0.0, 1.0)
    strong = (
        ((s.rain >= 15.0) & (s.rh >= 70.0)) | (s.wind >= 38.0) | ((s.temp >= 42.0) & (s.rh <= 50.0))
    )
    fair = (
        ((s.rain >= 8.0) & (s.rh >= 65.0)) | (s.wind >= 28.0) | ((s.temp >= 40.0) & (s.rh <= 55.0))
    )
    hardware = s.freeze | s.spike | s.comm
    floor = F.when(hardware, 0.0).when(strong, 0.65).when(fair, 0.45).otherwise(0.0)
    return df.withColumns(
        {
            "genuine_event_score": F.bround(F.greatest(score, floor), 4),
            "genuine_event_evidence": gathered(*texts, *wx_disqualify(s)),
        }
    ).drop("_points")
