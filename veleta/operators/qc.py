"""Row-wise quality checks: a penalty, a violation name and a text per check."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veleta import fixed_values as V
from veleta.functions.texts import flag, gathered, holds, optional

COMM_GAP_HOURS = 3.0


@dataclass(frozen=True)
class Check:
    violation: str
    penalty: float
    fails: Column
    text: Column


def _check(violation: str, penalty: float, condition: Column, text: Column) -> Check:
    return Check(violation, penalty, holds(condition), text)


def _fmt(template: str, digits: int, value: Column) -> Column:
    return F.format_string(template, F.bround(value, digits))


def qc_bounds(df: DataFrame) -> list[Check]:
    checks = []
    for s, (low, high) in V.QC_BOUNDS.items():
        x = optional(df, s)
        text = F.format_string(V.TEXT_QC_BOUNDS.format(sensor=s, low=low, high=high), x.cast("string"))
        checks.append(_check(f"{s}_out_of_bounds", 0.40, (x < low) | (x > high), text))
    return checks


def qc_rate(df: DataFrame) -> list[Check]:
    checks = []
    for s, limit in V.QC_MAX_RATES.items():
        step = F.abs(optional(df, f"{s}_delta"))
        text = _fmt(V.TEXT_QC_RATE.format(sensor=s, limit=limit), 2, step)
        checks.append(_check(f"{s}_rate_of_change_high", 0.25, step > limit, text))
    return checks


def qc_deviation(df: DataFrame) -> list[Check]:
    checks = []
    for s, limit in V.QC_MAX_DEVIATION.items():
        d = optional(df, f"{s}_deviation")
        text = _fmt(V.TEXT_QC_DEVIATION.format(sensor=s), 2, d)
        checks.append(_check(f"{s}_large_baseline_deviation", 0.20, F.abs(d) > limit, text))
    return checks


def qc_volatility(df: DataFrame) -> list[Check]:
    std = optional(df, "temperature_c_roll3_std")
    return [_check("temperature_c_high_volatility", 0.15, std > 4.0, _fmt(V.TEXT_QC_VOLATILITY, 2, std))]


def qc_robust_z(df: DataFrame) -> list[Check]:
    checks = []
    for s in V.QC_ROBUST_Z_SENSORS:
        z = optional(df, f"{s}_robust_z")
        text = _fmt(V.TEXT_QC_Z.format(sensor=s), 2, z)
        checks.append(_check(f"{s}_robust_z_high", 0.20, F.abs(z) >= 3.5, text))
    return checks


def qc_spike(df: DataFrame) -> list[Check]:
    return [_check("spike_detected", 0.35, flag(df, "rule_spike"), F.lit(V.TEXT_QC_SPIKE))]


def qc_freeze(df: DataFrame) -> list[Check]:
    return [_check("freeze_detected", 0.35, flag(df, "rule_freeze"), F.lit(V.TEXT_QC_FREEZE))]


def qc_gap(df: DataFrame) -> list[Check]:
    gap = optional(df, "time_since_prev_obs")
    return [_check("temporal_gap", 0.15, gap > COMM_GAP_HOURS, _fmt(V.TEXT_QC_GAP, 1, gap))]


def qc_duplicate(df: DataFrame) -> list[Check]:
    return [_check("duplicate_timestamp", 0.30, flag(df, "qf_duplicate_ts"), F.lit(V.TEXT_QC_DUPLICATE))]


def qc_cross_sensor(df: DataFrame) -> list[Check]:
    temp, rh, rain = (optional(df, s) for s in ("temperature_c", "relative_humidity_pct", "rainfall_mm"))
    dry_rain = temp.isNotNull() & (rain > 10.0) & (rh < 25.0)
    text = F.format_string(V.TEXT_QC_CROSS, rain.cast("string"), rh.cast("string"))
    return [_check("cross_sensor_rain_humidity_inconsistent", 0.25, dry_rain, text)]


GROUPS = {
    "qc_bounds": qc_bounds,
    "qc_rate": qc_rate,
    "qc_deviation": qc_deviation,
    "qc_volatility": qc_volatility,
    "qc_robust_z": qc_robust_z,
    "qc_spike": qc_spike,
    "qc_freeze": qc_freeze,
    "qc_gap": qc_gap,
    "qc_duplicate": qc_duplicate,
    "qc_cross_sensor": qc_cross_sensor,
}


def penalty(checks: list[Check]) -> Column:
    total = F.lit(0.0)
    for c in checks:
        total = total + F.when(c.fails, F.lit(c.penalty)).otherwise(F.lit(0.0))
    return total


def apply_group(df: DataFrame, name: str) -> DataFrame:
    """Penalty and violations of one check group."""
    checks = GROUPS[name](df)
    return df.withColumns(
        {
            f"{name}_penalty": F.bround(penalty(checks), 4),
            f"{name}_violations": F.array_join(gathered(*[F.when(c.fails, c.violation) for c in checks]), ", "),
        }
    )


def qc_score(df: DataFrame) -> DataFrame:
    """All checks: score in [0, 1], pass flag, violations and evidence."""
    checks = [c for group in GROUPS.values() for c in group(df)]
    failed = gathered(*[F.when(c.fails, c.violation) for c in checks])
    return df.withColumns(
        {
            "statistical_anomaly_score": F.bround(F.least(penalty(checks), F.lit(1.0)), 4),
            "qc_violations": F.array_join(failed, ", "),
            "qc_passed": F.size(failed) == 0,
            "qc_evidence": gathered(*[F.when(c.fails, c.text) for c in checks]),
        }
    )
