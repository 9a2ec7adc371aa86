"""Label maturity: how much of each decision cohort has a label after so many age steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.functions.scalars import finite_time, ratio, time_bucket
from proofline.operators.latest import first_complete, first_decisions, first_label_arrivals


def anchors(snapshots: DataFrame, predictions: DataFrame, now: float) -> DataFrame:
    """Observations whose labels are awaited: first complete snapshots and first release decisions."""
    offline = first_complete(snapshots.where(finite_time(F.col("available_at")))).select(
        F.lit("offline").alias("maturity_scope"), "sample_id", F.col("available_at").alias("anchor_at"),
        F.lit(None).cast("string").alias("model_run_id"),
    )
    release = predictions.where((F.col("runtime_slot") == "release") & finite_time(F.col("predicted_at")))
    serving = first_decisions(release).select(
        F.lit("serving").alias("maturity_scope"), "sample_id", F.col("predicted_at").alias("anchor_at"), "model_run_id"
    )
    return offline.unionByName(serving).where(F.col("anchor_at") <= F.lit(float(now)))


def label_maturity(
    snapshots: DataFrame, predictions: DataFrame, labels: DataFrame, now: float, cohort_seconds: float = 600.0,
    offset_seconds: float = 60.0, age_seconds: float = 60.0, ages: int = 10,
) -> DataFrame:
    """Coverage per (scope, cohort, age). Ages the whole cohort cannot have reached yet are null.

    All ages are counted in one aggregate and unfolded afterwards, so observations are not multiplied by age.
    """
    arrivals = first_label_arrivals(labels, now)
    seen = anchors(snapshots, predictions, now).join(arrivals, "sample_id", "left")
    start = time_bucket(F.col("anchor_at"), cohort_seconds, offset_seconds)
    wait = F.col("first_label_available_at")
    # Counting per model first makes the number of models a plain count and keeps every sum map-side.
    per_model = seen.withColumn("cohort_start", start).groupBy("maturity_scope", "cohort_start", "model_run_id").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(wait <= F.col("anchor_at") + a * age_seconds).alias(f"_a{a}") for a in range(ages + 1)],
    )
    counts = per_model.groupBy("maturity_scope", "cohort_start").agg(
        F.sum("_n").alias("cohort_size_seen_at_refresh"), F.count("model_run_id").alias("_models"),
        *[F.sum(f"_a{a}").alias(f"_a{a}") for a in range(ages + 1)],
    )
    unfolded = counts.select(
        "maturity_scope", "cohort_start", "cohort_size_seen_at_refresh", "_models",
        F.inline(F.array(*[
            F.struct(F.lit(a).alias("age"), F.col(f"_a{a}").alias("_labeled")) for a in range(ages + 1)
        ])),
    )
    clock = F.lit(float(now))
    end = F.col("cohort_start") + cohort_seconds
    observable_at = end + F.col("age") * age_seconds
    closed, observable = clock >= end, clock >= observable_at
    size, labeled = F.col("cohort_size_seen_at_refresh"), F.col("_labeled")
    status = F.when(~closed, "open").when(clock < end + ages * age_seconds, "observing").otherwise("complete")
    return unfolded.select(
        "maturity_scope", "cohort_start", end.alias("cohort_end"), "age", observable_at.alias("observable_at"),
        closed.alias("cohort_closed"), size.alias("cohort_size_seen_at_refresh"), F.when(closed, size).alias("cohort_size"),
        F.when(observable, labeled).alias("labeled_count"), F.when(observable, size - labeled).alias("unlabeled_count"),
        F.when(observable, F.round(ratio(labeled, size), 6)).alias("label_coverage"),
        F.nullif("_models", F.lit(0).cast("bigint")).alias("model_run_count"), observable.alias("is_observable"),
        status.alias("cohort_status"), clock.alias("computed_at"),
    )
