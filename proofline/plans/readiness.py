"""Readiness gates: one aggregate row with counts, coverage, a flag and what falls short."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.constants import FAIL, PASS
from proofline.functions.scalars import ratio, shortfalls
from proofline.plans.cohorts import CohortConfig


def _labels():
    labeled = F.col("label_event_id").isNotNull()
    return [
        F.count_if(labeled).alias("labeled"), F.count_if(~labeled).alias("unlabeled"),
        F.count_if(F.col("actual_value") == FAIL).alias("fail_count"),
        F.count_if(F.col("actual_value") == PASS).alias("pass_count"),
        F.min("snapshot_available_at").alias("snapshot_available_at_min"),
        F.max("snapshot_available_at").alias("snapshot_available_at_max"),
        F.min("label_available_at").alias("label_available_at_min"),
        F.max("label_available_at").alias("label_available_at_max"),
    ]


def _gate(stats: DataFrame, minimums: dict[str, float]) -> DataFrame:
    """``ready`` if no figure is below its minimum; ``reasons`` has the figure's name, its minimum and its value."""
    return stats.withColumn("reasons", shortfalls([(name, F.col(name), least) for name, least in minimums.items()])).withColumn(
        "ready", F.size("reasons") == 0
    )


def training_readiness(cohort: DataFrame, config: CohortConfig) -> DataFrame:
    stats = cohort.agg(
        F.count(F.lit(1)).alias("eligible_sample_count"), *_labels(),
        F.min("snapshot_time").alias("snapshot_time_min"), F.max("snapshot_time").alias("snapshot_time_max"),
    ).withColumnsRenamed({"labeled": "labeled_sample_count", "unlabeled": "unlabeled_sample_count"})
    stats = stats.withColumn(
        "label_coverage", F.coalesce(ratio(F.col("labeled_sample_count"), F.col("eligible_sample_count")), F.lit(0.0))
    )
    return _gate(stats, {
        "labeled_sample_count": config.min_labeled, "label_coverage": config.min_label_coverage,
        "fail_count": config.min_fail_samples, "pass_count": config.min_pass_samples,
    })


def gate_readiness(cohort: DataFrame, config: CohortConfig) -> DataFrame:
    """Adds the distinct source models and thresholds, of which a cohort has a handful."""
    stats = cohort.agg(
        F.count(F.lit(1)).alias("decision_count"), *_labels(), F.count_distinct("sample_id").alias("unique_sample_count"),
        F.min("predicted_at").alias("decision_time_min"), F.max("predicted_at").alias("decision_time_max"),
        F.array_sort(F.collect_set("source_model_run_id")).alias("source_model_run_ids"),
        F.array_sort(F.collect_set("source_threshold")).alias("source_thresholds"),
    ).withColumnsRenamed({"labeled": "labeled_decision_count", "unlabeled": "unlabeled_decision_count"})
    stats = stats.withColumn(
        "label_coverage", F.coalesce(ratio(F.col("labeled_decision_count"), F.col("decision_count")), F.lit(0.0))
    )
    return _gate(stats, {
        "decision_count": config.min_decisions, "labeled_decision_count": config.min_labeled,
        "label_coverage": config.min_label_coverage, "fail_count": config.min_fail_samples, "pass_count": config.min_pass_samples,
    })


def training_summary(cohort: DataFrame, selected: DataFrame) -> DataFrame:
    """Lineage figures of a training run: the whole cohort next to the selected development rows."""
    order = F.struct("snapshot_available_at", "sample_id", "serving_snapshot_id")
    labeled = F.col("label_event_id").isNotNull()
    whole = cohort.agg(
        F.count(F.lit(1)).alias("eligible_cohort_count"), F.count_if(labeled).alias("labeled_cohort_count"),
        F.count_if(~labeled).alias("unlabeled_cohort_count"), F.avg(labeled.cast("int")).alias("label_coverage"),
        F.min("snapshot_available_at").alias("eligible_decision_time_min"),
        F.max("snapshot_available_at").alias("eligible_decision_time_max"),
        F.min_by("sample_id", order).alias("first_eligible_sample_id"),
        F.max_by("sample_id", order).alias("last_eligible_sample_id"),
    )
    ends = []
    for column, source in (
        ("decision_time", "snapshot_available_at"), ("snapshot_time", "snapshot_time"),
        ("snapshot_version", "snapshot_version"), ("label_revision", "label_revision"),
        ("label_measured_at", "label_measured_at"), ("label_available_at", "label_available_at"),
    ):
        ends += [F.min(source).alias(f"{column}_min"), F.max(source).alias(f"{column}_max")]
    for column, source in (
        ("sample_id", "sample_id"), ("snapshot_id", "serving_snapshot_id"), ("label_event_id", "label_event_id"),
    ):
        ends += [F.min_by(source, order).alias(f"first_{column}"), F.max_by(source, order).alias(f"last_{column}")]
    part = selected.agg(
        F.count(F.lit(1)).alias("sample_count"), F.count_if(F.col("actual_value") == FAIL).alias("fail_count"),
        F.count_if(F.col("actual_value") == PASS).alias("pass_count"),
        F.min("window_start").alias("window_start_min"), F.max("window_end").alias("window_end_max"),
        F.avg("serving_missing_count").alias("serving_missing_count_avg"),
        F.max("serving_missing_count").alias("serving_missing_count_max"), *ends,
    )
    # Two single rows with different columns: stacked, each column has one value.
    both = whole.unionByName(part, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def training_gate(summary: DataFrame, min_samples: int, min_coverage: float, min_fail: int, min_pass: int) -> DataFrame:
    return _gate(summary, {
        "sample_count": min_samples, "label_coverage": min_coverage, "fail_count": min_fail, "pass_count": min_pass,
    })
