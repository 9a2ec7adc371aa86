"""Candidate windows for a new drift baseline."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.constants import FAIL
from proofline.functions.scalars import ratio
from proofline.operators.scale import attach
from proofline.operators.stats import percentile_columns


def covering_windows(at: Column, start: float, end: float, size: float, step: float) -> Column:
    """Indexes of the windows ``(start + i*step, start + i*step + size]`` inside ``[start, end]`` around ``at``."""
    last = int((end + 0.000001 - size - start) // step)
    if last < 0:
        return F.array().cast("array<bigint>")
    low = F.greatest(F.ceil((at - (start + size)) / step), F.lit(0).cast("bigint"))
    high = F.least(F.ceil((at - start) / step) - 1, F.lit(last).cast("bigint"))
    return F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


def propose_windows(
    predictions: DataFrame, keys: Sequence[str], lookback_start: float, lookback_end: float, window_seconds: float,
    step_seconds: float | None = None, min_samples: int = 500, exclusions: Sequence[tuple[float, float]] = (),
    top: int = 5,
) -> DataFrame:
    """Summaries of the sliding windows with enough rows, largest and then newest first, per group.

    Each row is sent to the windows covering it (size/step of them); no window is queried on its own.
    """
    step = window_seconds if step_seconds is None else step_seconds
    at = F.col("predicted_at")
    start = lookback_start + F.col("window") * step
    rows = predictions.where((at > lookback_start) & (at <= lookback_end)).select(
        *keys, "predicted_at", "fail_probability", "missing_count", "predicted_value",
        F.explode(covering_windows(at, lookback_start, lookback_end, window_seconds, step)).alias("window"),
    )
    rows = rows.withColumn("source_start", start).withColumn("source_end", start + window_seconds)
    for begin, finish in exclusions:
        rows = rows.where(~((F.col("source_start") < float(finish)) & (F.col("source_end") > float(begin))))
    group = [*keys, "source_start", "source_end"]
    counts = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("sample_count"), F.min("predicted_at").alias("first_predicted_at"),
        F.max("predicted_at").alias("last_predicted_at"),
        ratio(F.count_if(F.col("predicted_value") == FAIL), F.count(F.lit(1))).alias("predicted_fail_ratio"),
        F.avg("fail_probability").alias("fail_probability_avg"), F.avg("missing_count").alias("missing_count_avg"),
        F.max("missing_count").cast("double").alias("missing_count_max"),
    ).where(F.col("sample_count") >= min_samples)
    wanted = {
        f"{column}_p{int(q * 100)}": (column, q) for column in ("fail_probability", "missing_count") for q in (0.5, 0.95)
    }
    found = attach(counts, percentile_columns(rows, group, wanted), group)
    order = [F.col("sample_count").desc(), F.col("source_end").desc()]
    if keys:
        from proofline.operators.latest import top_per_key

        return top_per_key(found, keys, order, top)
    return found.orderBy(*order).limit(top)


def prediction_range(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    return predictions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"), F.min("predicted_at").alias("first_predicted_at"),
        F.max("predicted_at").alias("last_predicted_at"),
    )


def baseline_name(alias: str, start: Column, end: Column) -> Column:
    """The alias and the interval in whole seconds."""
    return F.concat(F.lit(f"{alias}["), F.floor(start).cast("string"), F.lit(","), F.floor(end).cast("string"), F.lit(")"))
