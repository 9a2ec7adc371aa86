"""Descriptive statistics over features (long form) and prediction windows."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proofline.constants import FAIL, PASS
from proofline.functions.scalars import ratio
from proofline.operators.quality import metric_rows
from proofline.operators.scale import attach, exact_quantiles

WINDOW_METRICS = (
    "prediction_count", "request_count", "predicted_fail_count", "predicted_pass_count", "predicted_fail_ratio",
    "fail_probability_mean", "fail_probability_p50", "fail_probability_p95", "fail_probability_min",
    "fail_probability_max", "missing_count_mean", "missing_count_p50", "missing_count_p95", "missing_count_max",
    "latency_ms_mean", "latency_ms_p95",
)


def feature_stats(long: DataFrame, keys: Sequence[str], few: float | None = None) -> DataFrame:
    """Counts, sums, mean and sample deviation per (keys, feature).

    ``few`` is the deviation reported for fewer than two values.
    """
    value = F.col("value")
    return long.groupBy(*keys, "feature_index", "feature_name").agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(value.isNull()).alias("null_count"),
        F.count(value).alias("non_null"), F.sum(value).alias("sum"), F.sum(value * value).alias("sum_sq"),
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("_std"),
    ).withColumn("std", F.when(F.col("non_null") < 2, F.lit(few).cast("double")).otherwise(F.col("_std"))).drop("_std")


def feature_medians(long: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Median of the non-null values per feature; features without any value are absent."""
    middle = exact_quantiles(long, [*keys, "feature_name"], "value", [0.5])
    return middle.select(*keys, "feature_name", F.col("_q")[0].alias("median"))


def median_values(long: DataFrame) -> dict[str, float]:
    """All medians on the driver; one number per feature."""
    return {r["feature_name"]: r["median"] for r in feature_medians(long).collect()}


def percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], lower: bool = False,
                names: Sequence[str] | None = None) -> DataFrame:
    """Exact percentiles as columns, linear or (``lower``) the element at floor((n-1)q)."""
    names = names or [f"p{int(q * 100)}" for q in probs]
    found = exact_quantiles(df, keys, value, probs, lower=lower)
    return found.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])


def percentile_columns(df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Exact percentiles of several columns at once: output name to (column, q)."""
    columns = sorted({column for column, _ in wanted.values()})
    probs = sorted({q for _, q in wanted.values()})
    pairs = F.array(*[F.struct(F.lit(c).alias("_which"), F.col(c).cast("double").alias("_value")) for c in columns])
    found = exact_quantiles(df.select(*keys, F.inline(pairs)), [*keys, "_which"], "_value", probs)
    return found.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_which") == column, F.col("_q")[probs.index(q)])).alias(name)
        for name, (column, q) in wanted.items()
    ])


def prediction_window_metrics(
    predictions: DataFrame, limit: int | None = 500, model_run_id: str | None = None,
) -> DataFrame:
    """Summary of the newest ``limit`` predictions over all models, per (model, threshold), as long rows.

    Nothing is returned when fewer than ``limit`` predictions exist.
    """
    rows = predictions if model_run_id is None else predictions.where(F.col("model_run_id") == model_run_id)
    if limit is not None:
        rows = rows.orderBy(F.col("predicted_at").desc(), F.col("prediction_id").desc()).limit(limit)
    keys = ["model_run_id", "threshold"]
    counts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("prediction_count"), F.count_distinct("request_id").alias("request_count"),
        F.count_if(F.col("predicted_value") == FAIL).alias("predicted_fail_count"),
        F.count_if(F.col("predicted_value") == PASS).alias("predicted_pass_count"),
        F.avg("fail_probability").alias("fail_probability_mean"), F.min("fail_probability").alias("fail_probability_min"),
        F.max("fail_probability").alias("fail_probability_max"), F.avg("missing_count").alias("missing_count_mean"),
        F.max("missing_count").alias("missing_count_max"), F.avg("latency_ms").alias("latency_ms_mean"),
        F.min("predicted_at").alias("window_start"), F.max("predicted_at").alias("window_end"),
        *([] if limit is None else [  # at most ``limit`` rows: the builtin is safe
            F.percentile("fail_probability", 0.5).alias("fail_probability_p50"),
            F.percentile("fail_probability", 0.95).alias("fail_probability_p95"),
            F.percentile("missing_count", 0.5).alias("missing_count_p50"),
            F.percentile("missing_count", 0.95).alias("missing_count_p95"),
            F.percentile("latency_ms", 0.95).alias("latency_ms_p95"),
        ]),
    )
    if limit is None:
        wanted = {
            f"{column}_p{int(q * 100)}": (column, q)
            for column, q in (("fail_probability", 0.5), ("fail_probability", 0.95), ("missing_count", 0.5),
                              ("missing_count", 0.95), ("latency_ms", 0.95))
        }
        counts = attach(counts, percentile_columns(rows, keys, wanted), keys)
    else:
        total = F.sum("prediction_count").over(W.partitionBy())  # a handful of groups
        counts = counts.withColumn("_total", total).where(F.col("_total") >= limit).drop("_total")
    counts = counts.withColumn("predicted_fail_ratio", ratio(F.col("predicted_fail_count"), F.col("prediction_count")))
    kept = counts.withColumn("n_predictions", F.col("prediction_count"))
    return metric_rows(kept, [*keys, "window_start", "window_end", "n_predictions"], WINDOW_METRICS)
