"""Batch scoring: observations to full prediction records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veleta.fixed_values import DETECTOR_SHORT, EXPECTED_TARGETS, SENSORS
from veleta.functions.texts import staged
from veleta.operators import diagnosis, fusion, qc, weather
from veleta.operators.anomaly import AnomalyEnsemble
from veleta.operators.expected import ExpectedValues, apply_all
from veleta.operators.health import join_health
from veleta.operators.series import SeriesLayout
from veleta.plans.features import FeatureModel, clean
from veleta.session import scratch_dir


def written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@dataclass
class Engine:
    """Everything that scoring needs; tables inside are one or a few rows per station."""

    features: FeatureModel
    expected: dict[str, ExpectedValues]
    anomaly: AnomalyEnsemble
    health: DataFrame

    def evidence(self, featured: DataFrame) -> DataFrame:
        """Checks, expected values and anomaly scores on a feature table."""
        checked = staged(qc.qc_score(featured), "checks")
        # detectors read the rows twice: for their neighbours and for themselves
        return staged(self.anomaly.transform(written(apply_all(checked, self.expected), "expected")), "scores")

    def decide(self, scored: DataFrame, small_network: bool) -> DataFrame:
        """Diagnosis, weather evidence, fusion and health on scored rows."""
        weathered = weather.wx_score(scored)
        judged = fusion.fuse(diagnosis.fault_evidence(weathered, fusion.score_prelim()), len(self.expected))
        return join_health(judged, self.health, small_network)

    def score_batch(self, observations: DataFrame) -> DataFrame:
        """One nested record per observation; keys of the input must be unique.

        Sizes, missing sensors and neighbours are those of the given table, whatever the models were fitted on. The
        cleaned table is written once, as features of rows and of their neighbours both read it.
        """
        layout = SeriesLayout.measure(observations)
        cleaned = written(clean(observations, layout), "cleaned")
        featured = self.features.for_table(cleaned, layout).transform(cleaned)
        return records(self.decide(self.evidence(featured), layout.small_network))


def records(decided: DataFrame) -> DataFrame:
    def numbers(columns: dict[str, str]):
        return F.map_from_arrays(
            F.array(*[F.lit(k) for k in columns]), F.array(*[F.col(c).cast("double") for c in columns.values()])
        )

    return decided.select(
        "station_id",
        "timestamp",
        "seq",
        "prediction",
        "confidence",
        "confidence_level",
        "uncertainty_score",
        F.create_map(
            F.lit("NORMAL"), "p_normal", F.lit("GENUINE_EXTREME"), "p_genuine_extreme", F.lit("SENSOR_FAULT"), "p_sensor_fault"
        ).alias("class_probabilities"),
        "anomaly_score",
        F.struct(
            F.col("anomaly_models_agreeing").alias("models_agreeing"),
            F.col("anomaly_model_count").alias("models_total"),
            F.bround("anomaly_consensus_score", 4).alias("score"),
            numbers({n: f"{s}_anomaly_score" for n, s in DETECTOR_SHORT.items() if f"{s}_anomaly_score" in decided.columns}).alias("detector_scores"),
        ).alias("anomaly_consensus"),
        "model_agreement",
        "model_coverage",
        F.col("shown_fault_type").alias("fault_type"),
        F.col("shown_fault_confidence").alias("fault_confidence"),
        "fault_evidence",
        "genuine_event_score",
        "genuine_event_evidence",
        "severity",
        "sensor_health",
        "sensor_health_status",
        numbers({t: f"expected_{t}" for t in EXPECTED_TARGETS}).alias("expected_values"),
        numbers({s: s for s in SENSORS}).alias("observed_values"),
        "top_reasons",
        "recommended_action",
        fusion.score_correction(decided).alias("correction"),
    )
