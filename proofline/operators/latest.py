"""One row per key: first, latest, latest as of a cutoff, identity conflicts.

A rank filter of 1 is planned by Spark with a group limit on the map side, so each task
ships at most one row per key and a hot key never gathers in one place.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proofline.functions.scalars import finite_time, half_open

FIRST_COMPLETE = ("available_at", "snapshot_version", "serving_snapshot_id")
FIRST_DECISION = ("predicted_at", "prediction_id")
DECISION_KEYS = ("model_run_id", "threshold", "sample_id", "serving_snapshot_id", "snapshot_version")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], count: int = 1) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= count).drop("_rank")


def first_complete(snapshots: DataFrame) -> DataFrame:
    """The first complete snapshot of each sample over all history."""
    complete = snapshots.where(F.col("is_complete") & (F.col("snapshot_status") == "complete"))
    return top_per_key(complete, ["sample_id"], FIRST_COMPLETE)


def labels_at(labels: DataFrame, cutoff: float | Column) -> DataFrame:
    """The highest label revision of each sample among those available at the cutoff."""
    limit = cutoff if isinstance(cutoff, Column) else F.lit(float(cutoff))
    visible = labels.where(F.col("available_at") <= limit)
    order = [F.col("label_revision").desc(), F.col("available_at").desc(), F.col("label_event_id").asc()]
    return top_per_key(visible, ["sample_id"], order)


def label_columns(labels: DataFrame) -> DataFrame:
    return labels.select(
        "sample_id", "label_event_id", "label_revision", F.col("measured_at").alias("label_measured_at"),
        F.col("available_at").alias("label_available_at"), "actual_value", "actual_label",
    )


def labels_as_of(points: DataFrame, labels: DataFrame, cutoff: str, key: str) -> DataFrame:
    """Point-in-time join with a cutoff per row: one row per ``key``, label columns null if none.

    ``points`` has one row per sample, so the join emits each label at most once.
    """
    joined = points.select(key, "sample_id", cutoff).join(label_columns(labels), "sample_id")
    visible = joined.where(F.col("label_available_at") <= F.col(cutoff))
    order = [F.col("label_revision").desc(), F.col("label_available_at").desc(), F.col("label_event_id").asc()]
    best = top_per_key(visible, [key], order).drop("sample_id", cutoff)
    return points.join(best, key, "left")


def first_decisions(predictions: DataFrame) -> DataFrame:
    """The first decision per model, threshold, sample and snapshot, over all history."""
    return top_per_key(predictions, DECISION_KEYS, FIRST_DECISION)


def first_release_decisions(predictions: DataFrame) -> DataFrame:
    """First release decision per (sample, version), flagged if its repeats disagree on the snapshot.

    One aggregate finds the first row and compares the identities of all of them.
    """
    release = predictions.where(F.col("runtime_slot") == "release")
    keys = ["sample_id", "snapshot_version"]
    rest = [c for c in release.columns if c not in keys]
    firsts = release.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*FIRST_DECISION)).alias("_first"),
        (
            (F.min("serving_snapshot_id") != F.max("serving_snapshot_id"))
            | (F.min("feature_hash") != F.max("feature_hash"))
        ).alias("identity_conflict"),
    )
    return firsts.select(*keys, "_first.*", "identity_conflict")


def conflicting_identities(predictions: DataFrame) -> DataFrame:
    """Release decisions whose (sample, version) is also recorded with another snapshot or hash."""
    release = predictions.where(F.col("runtime_slot") == "release")
    keys = ["sample_id", "snapshot_version"]
    clashes = release.groupBy(*keys).agg(
        F.min("serving_snapshot_id").alias("_s0"), F.max("serving_snapshot_id").alias("_s1"),
        F.min("feature_hash").alias("_h0"), F.max("feature_hash").alias("_h1"),
    ).where((F.col("_s0") != F.col("_s1")) | (F.col("_h0") != F.col("_h1")))
    return release.join(clashes.select(*keys), keys, "left_semi")


def resolved_predictions(predictions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Predictions whose snapshot exists with the same id, sample, version and feature hash."""
    keys = ["serving_snapshot_id", "sample_id", "snapshot_version", "feature_hash"]
    return predictions.join(snapshots.select(*keys, "features"), keys, "inner")


def decisions_between(predictions: DataFrame, start: float, end: float) -> DataFrame:
    """First decisions over all history whose time lies in ``[start, end)``."""
    return first_decisions(predictions).where(half_open(F.col("predicted_at"), start, end))


def latest_per_status(df: DataFrame, keys: Sequence[str], at: str, tie: str, statuses: Sequence[str]) -> DataFrame:
    return top_per_key(df.where(F.col("status").isin(*statuses)), keys, [F.col(at).desc(), F.col(tie).desc()])


def rows_of_latest(df: DataFrame, id_column: str, at: str) -> DataFrame:
    """All rows of the evaluation with the newest ``at`` (ties by id)."""
    newest = df.agg(F.max_by(F.col(id_column), F.struct(at, id_column)).alias("_newest"))
    return df.where(F.col(id_column) == newest.scalar())


def first_label_arrivals(labels: DataFrame, now: float) -> DataFrame:
    seen = labels.where(finite_time(F.col("available_at")) & (F.col("available_at") <= F.lit(float(now))))
    return seen.groupBy("sample_id").agg(F.min("available_at").alias("first_label_available_at"))
