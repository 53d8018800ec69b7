"""Fusion of all evidence into a class, a confidence, a severity and an explanation.

Expects per row: ``combined_anomaly_score``, ``anomaly_models_agreeing``, ``anomaly_model_count``,
``statistical_anomaly_score``, ``qc_evidence``, the fault and event columns, and the three
``expected_<target>_model_agreement`` columns (absent ones count as full agreement).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veleta import fixed_values as V
from veleta.functions.texts import clip, gathered, optional, said, staged

FAULT_LIMIT = 0.40
EVENT_LIMIT = 0.35
HARD_FAULTS = ("FREEZE", "SPIKE", "COMMUNICATION_FAILURE")


def score_prelim() -> Column:
    """Worth a diagnosis at all."""
    return (
        (F.col("combined_anomaly_score") > 0.35)
        | (F.col("statistical_anomaly_score") > 0.35)
        | F.col("rule_any_fault")
    )


def fuse_score() -> Column:
    a, q = F.col("combined_anomaly_score"), F.col("statistical_anomaly_score")
    strong_q = F.when(q > 0.5, q).otherwise(F.lit(0.0))
    return clip(a * 0.45 + q * 0.30 + F.greatest(a, strong_q) * 0.25, 0.0, 1.0)


def mean_agreement(df: DataFrame) -> Column:
    parts = [
        F.coalesce(optional(df, f"expected_{t}_model_agreement"), F.lit(1.0)) for t in V.EXPECTED_TARGETS
    ]
    return reduce(lambda a, b: a + b, parts) / 3.0


def detector_conflict() -> Column:
    ratio = F.col("anomaly_models_agreeing") / F.greatest(F.col("anomaly_model_count"), F.lit(1))
    return F.lit(1.0) - F.abs(ratio - 0.5) * 2.0


def fuse_uncertainty(df: DataFrame, coverage: Column) -> Column:
    disagreement = F.lit(1.0) - mean_agreement(df)
    event = F.col("genuine_event_score")
    physical = F.when(event >= 0.40, 0.3).otherwise(1.0)
    torn = F.when((F.col("fault_confidence") > 0.5) & (event > 0.5), 0.5).otherwise(0.0)
    raw = (
        disagreement * physical * 0.35
        + detector_conflict() * 0.25
        + F.greatest(F.lit(0.0), F.lit(1.0) - coverage) * 0.25
        + torn * 0.15
    )
    return clip(raw, 0.02, 0.95)


def fuse_agreement(df: DataFrame) -> Column:
    return clip(mean_agreement(df) * 0.5 + (F.lit(1.0) - detector_conflict()) * 0.5, 0.0, 1.0)


def score_coverage(expected_models: int, detectors: Column) -> Column:
    return F.least(F.lit(1.0), (F.lit(expected_models) + detectors) / 9.0)


def severity(prediction: Column, score: Column, fault_type: Column) -> Column:
    """LOW / MEDIUM / HIGH / CRITICAL from class, fused score and fault type."""

    def graded(*steps: tuple[float, str], low: str) -> Column:
        out = F.when(score >= steps[0][0], steps[0][1])
        for limit, name in steps[1:]:
            out = out.when(score >= limit, name)
        return out.otherwise(low)

    return (
        F.when(prediction == "NORMAL", "LOW")
        .when(prediction == "GENUINE_EXTREME", graded((0.65, "HIGH"), (0.40, "MEDIUM"), low="LOW"))
        .when(
            fault_type.isin("DRIFT", "FREEZE"), graded((0.85, "CRITICAL"), (0.65, "HIGH"), low="MEDIUM")
        )
        .when(fault_type == "SPIKE", graded((0.85, "HIGH"), low="MEDIUM"))
        .otherwise(graded((0.85, "HIGH"), (0.40, "MEDIUM"), low="LOW"))
    )


def confidence_level(confidence: Column, uncertainty: Column) -> Column:
    return (
        F.when((confidence >= 0.80) & (uncertainty <= 0.35), "HIGH")
        .when((confidence >= 0.55) & (uncertainty <= 0.55), "MEDIUM")
        .otherwise("LOW")
    )


def fuse_decision(df: DataFrame) -> DataFrame:
    """Adds ``_case``, ``prediction``, ``_confidence`` and the class probabilities.

    A: genuine extreme; B: sensor fault; C: normal; D1-D3: ambiguous.
    """
    event, fault = F.col("genuine_event_score"), F.col("fault_confidence")
    kind, q = F.col("fault_type"), F.col("statistical_anomaly_score")
    score, uncertain = F.col("_score"), F.col("_uncertainty")
    hard = kind.isin(*HARD_FAULTS)
    extreme = (event >= EVENT_LIMIT) & ~hard & ((event >= fault) | (kind == "NONE"))
    named = (kind != "NONE") & (kind != "UNKNOWN") & (fault >= 0.40)
    faulty = named | hard | ((q >= 0.50) & (event < 0.30))
    normal = (score < FAULT_LIMIT) & (q < 0.35) & (kind == "NONE")
    case = (
        F.when(extreme, "A")
        .when(faulty, "B")
        .when(normal, "C")
        .when(event >= 0.30, "D1")
        .when(uncertain > 0.60, "D2")
        .otherwise("D3")
    )
    df = staged(df.withColumn("_case", case), "case")
    c = F.col("_case")
    confidence = (
        F.when(c == "A", clip(F.lit(0.65) + event * 0.30 - uncertain * 0.15, 0.60, 0.98))
        .when(c == "B", clip(F.greatest(fault, score) * 0.90 + 0.05 - uncertain * 0.15, 0.55, 0.98))
        .when(c == "C", clip(F.lit(1.0) - score * 1.2, 0.60, 0.99))
        .when(c == "D2", 0.40)
        .otherwise(0.65)
    )
    df = staged(df.withColumn("_confidence", confidence), "confidence")
    own = F.bround(F.col("_confidence"), 4)
    rest = F.lit(1.0) - F.col("_confidence")

    def share(a: Column, b: Column, cc: Column, d1: float, d2: float, d3: float) -> Column:
        return F.when(c == "A", a).when(c == "B", b).when(c == "C", cc).when(c == "D1", d1).when(c == "D2", d2).otherwise(d3)

    def part(weight: float) -> Column:
        return F.bround(rest * weight, 4)

    return df.withColumns(
        {
            "prediction": F.when(c.isin("A", "D1"), "GENUINE_EXTREME")
            .when(c == "B", "SENSOR_FAULT")
            .when(c == "D2", "UNKNOWN")
            .otherwise("NORMAL"),
            "p_normal": share(part(0.6), part(0.7), own, 0.15, 0.40, 0.65),
            "p_sensor_fault": share(part(0.4), own, part(0.6), 0.20, 0.35, 0.15),
            "p_genuine_extreme": share(own, part(0.3), part(0.4), 0.65, 0.25, 0.20),
        }
    )


def fuse_reasons() -> Column:
    """Texts that explain the decision."""
    agreeing, total = F.col("anomaly_models_agreeing").cast("int"), F.col("anomaly_model_count").cast("int")
    some = agreeing > 0
    p = F.col("prediction")
    extreme = F.concat(
        F.slice("genuine_event_evidence", 1, 3),
        gathered(said(some, V.TEXT_DETECTORS_EXTREME, agreeing, total)),
    )
    fault = F.concat(
        F.slice("fault_evidence", 1, 3),
        gathered(said(some, V.TEXT_DETECTORS_FAULT, agreeing, total)),
        F.slice("qc_evidence", 1, 1),
    )
    normal = gathered(
        F.lit(V.TEXT_NORMAL_BASE), said(agreeing == 0, V.TEXT_NORMAL_QUIET), F.lit(V.TEXT_NORMAL_AGREE)
    )
    unknown = gathered(
        F.lit(V.TEXT_UNKNOWN), said(F.lit(True), V.TEXT_UNKNOWN_UNCERTAIN, F.col("_uncertainty"))
    )
    return (
        F.when(p == "GENUINE_EXTREME", extreme)
        .when(p == "SENSOR_FAULT", fault)
        .when(p == "NORMAL", normal)
        .otherwise(unknown)
    )


def fuse_action(prediction: Column, fault_type: Column) -> Column:
    by_fault = F.coalesce(
        *[F.when(fault_type == k, F.lit(v)) for k, v in V.FAULT_ACTIONS.items()], F.lit(V.FAULT_ACTION_OTHER)
    )
    return (
        F.when(prediction == "SENSOR_FAULT", by_fault)
        .when(prediction == "GENUINE_EXTREME", V.ACTIONS["GENUINE_EXTREME"])
        .when(prediction == "NORMAL", V.ACTIONS["NORMAL"])
        .otherwise(V.ACTIONS["UNKNOWN"])
    )


def fuse(df: DataFrame, expected_models: int = 3) -> DataFrame:
    """The final decision columns of every row."""
    coverage = score_coverage(expected_models, F.col("anomaly_model_count"))
    df = staged(df, "evidence")
    df = df.withColumns({"_coverage": coverage, "_score": fuse_score()})
    df = df.withColumn("_uncertainty", fuse_uncertainty(df, F.col("_coverage")))
    df = fuse_decision(staged(df, "fused-scores"))
    faulty = F.col("prediction") == "SENSOR_FAULT"
    shown = F.when(faulty, F.col("fault_type")).otherwise("NONE")
    total = F.col("anomaly_model_count").cast("int")
    decided = df.withColumns(
        {
            "confidence": F.bround("_confidence", 4),
            "confidence_level": confidence_level(F.col("_confidence"), F.col("_uncertainty")),
            "uncertainty_score": F.bround("_uncertainty", 4),
            "anomaly_score": F.bround("_score", 4),
            "model_agreement": F.bround(fuse_agreement(df), 4),
            "model_coverage": F.format_string(
                "%d/%d active", F.floor(F.col("_coverage") * total).cast("int"), total
            ),
            "model_coverage_ratio": F.bround("_coverage", 2),
            "severity": severity(F.col("prediction"), F.col("_score"), shown),
            "top_reasons": fuse_reasons(),
            "recommended_action": fuse_action(F.col("prediction"), F.col("fault_type")),
            "shown_fault_type": shown,
            "shown_fault_confidence": F.when(faulty, F.bround("fault_confidence", 4)).otherwise(F.lit(0.0)),
        }
    ).drop("_case", "_confidence", "_uncertainty", "_score", "_coverage")
    return staged(decided, "decision")


def score_correction(df: DataFrame) -> Column:
    """Map target -> observed, estimated, residual for confident sensor faults, else null."""
    confident = (F.col("prediction") == "SENSOR_FAULT") & (F.col("confidence") >= 0.75)
    entries = []
    for t in V.EXPECTED_TARGETS:
        estimate = F.bround(optional(df, f"expected_{t}"), 2)
        observed = optional(df, t)
        entries.append(
            F.when(
                estimate.isNotNull(),
                F.struct(
                    F.lit(t),
                    F.struct(
                        observed.alias("observed"),
                        estimate.alias("estimated"),
                        F.lit(True).alias("correction_applied"),
                        F.bround("confidence", 3).alias("correction_confidence"),
                        F.coalesce(F.bround(observed - estimate, 2), F.lit(0.0)).alias("residual"),
                    ),
                ),
            )
        )
    return F.when(confident, F.map_from_entries(gathered(*entries)))
