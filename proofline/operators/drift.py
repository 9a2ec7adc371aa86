"""Drift of predictions, inputs and features: recent against previous window, or a fixed reference."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.constants import FAIL, PSI_EPSILON, STD_FLOOR
from proofline.functions.features import lengthen
from proofline.functions.scalars import first_present, ratio
from proofline.operators.bins import feature_psi, reference_bins
from proofline.operators.latest import resolved_predictions, top_per_key
from proofline.operators.scale import attach, small_table
from proofline.operators.stats import feature_stats, percentile_columns
from proofline.session import pinned
from proofline.sources.days import DayTable

GROUP = ("model_run_id", "threshold")
OUTPUT = ("prediction_count", "predicted_fail_ratio", "fail_probability_avg", "fail_probability_p50", "fail_probability_p95")
INPUT = ("missing_count_avg", "missing_count_p95", "missing_count_max")
NAMES = ("model_name", "model_version", "model_alias")


def newest_rows(
    predictions: DataFrame, snapshots: DataFrame | None, keys: Sequence[str], seconds: float, spare: float,
    tops: DataFrame | None = None,
) -> DataFrame:
    """Resolved predictions of the last ``seconds`` before each group's newest one, with ``current_end``.

    Only resolved predictions count as newest, but resolving all history to find them would join everything. So the newest
    predictions are found first and resolved with ``spare`` seconds of older ones; only groups where
    that does not reach a full window are resolved completely. The rows are evaluated once: several aggregates follow.
    ``tops`` has the newest time ``_top`` of each group where it is known, as from ``DayTable.newest``; else all history is asked.
    """
    if tops is None:
        tops = small_table(predictions.groupBy(*keys).agg(F.max("predicted_at").alias("_top")))
    oldest = tops.agg(F.min("_top")).first()[0]
    at = F.col("predicted_at")
    near = predictions if oldest is None else predictions.where(at > F.lit(oldest - seconds - spare))
    near = attach(near, tops, keys, "inner").where(at > F.col("_top") - (seconds + spare)).drop("_top")
    rows = pinned(near if snapshots is None else resolved_predictions(near, snapshots))

    def newest(df):
        return df.groupBy(*keys).agg(F.max("predicted_at").alias("current_end"))

    ends = small_table(newest(rows))
    covered = attach(tops, ends, keys)
    short = covered.where(F.col("current_end").isNull() | (F.col("current_end") < F.col("_top") - spare)).select(*keys)
    if snapshots is not None and not short.isEmpty():
        again = resolved_predictions(attach(predictions, small_table(short), keys, "left_semi"), snapshots)
        again_ends = small_table(newest(again))
        kept = attach(rows, small_table(short), keys, "left_anti")
        kept_ends = attach(ends, small_table(short), keys, "left_anti")
        ends = small_table(kept_ends.unionByName(again_ends))
        rows = kept.unionByName(again)
    found = attach(rows, ends, keys, "inner")
    return found.where((at > F.col("current_end") - seconds) & (at <= F.col("current_end")))


def with_sides(
    predictions: DataFrame, window_seconds: float, snapshots: DataFrame | None = None, spare: float | None = None,
    tops: DataFrame | None = None,
) -> DataFrame:
    """The windows ``(end-2w, end-w]`` and ``(end-w, end]`` of each (model, threshold), marked by side."""
    seconds = 2.0 * window_seconds
    rows = newest_rows(predictions, snapshots, GROUP, seconds, seconds if spare is None else spare, tops)
    current = F.col("predicted_at") > F.col("current_end") - F.lit(float(window_seconds))
    return rows.withColumn("side", F.when(current, "current").otherwise("baseline"))


def window_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The output and input drift metrics of each group."""
    basic = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.lit(1)).cast("double").alias("prediction_count"),
        ratio(F.count_if(F.col("predicted_value") == FAIL), F.count(F.lit(1))).alias("predicted_fail_ratio"),
        F.avg("fail_probability").alias("fail_probability_avg"),
        F.avg(F.col("missing_count").cast("double")).alias("missing_count_avg"),
        F.max(F.col("missing_count").cast("double")).alias("missing_count_max"),
    )
    wanted = {
        "fail_probability_p50": ("fail_probability", 0.5), "fail_probability_p95": ("fail_probability", 0.95),
        "missing_count_p95": ("missing_count", 0.95),
    }
    return attach(basic, percentile_columns(rows, keys, wanted), keys)


def _family_rows(df: DataFrame, keep: Sequence[str], samples: tuple[str, str]) -> DataFrame:
    """Wide ``b_*`` / ``c_*`` columns to one row per output and input metric."""
    lines = []
    for family, names in (("output", OUTPUT), ("input", INPUT)):
        for name in names:
            lines.append(F.struct(
                F.lit(family).alias("metric_family"), F.lit(name).alias("metric_name"),
                F.lit(None).cast("string").alias("feature_name"), F.col(f"c_{name}").alias("metric_value"),
                F.col(f"b_{name}").alias("baseline_value"), F.col(f"c_{name}").alias("current_value"),
                (F.col(f"c_{name}") - F.col(f"b_{name}")).alias("delta_value"),
                F.col(f"{samples[0]}_{name}" if samples[0] == "bn" else samples[0]).alias("baseline_samples"),
                F.col(samples[1]).alias("current_samples"),
            ))
    return df.select(*keep, F.inline(F.array(*lines)))


def _ranked(df: DataFrame, keys: Sequence[str], top: int) -> DataFrame:
    best = top_per_key(df, [*keys, "metric_name"], [F.col("metric_value").desc(), F.col("feature_index")], top)
    return best.select(
        *keys, F.lit("feature").alias("metric_family"), "metric_name", "feature_name", "metric_value",
        "baseline_value", "current_value", (F.col("current_value") - F.col("baseline_value")).alias("delta_value"),
        "baseline_samples", "current_samples",
    )


def _score_lines(mean_ok, missing_ok):
    """The two per-feature scores from ``b_*`` and ``c_*`` statistics; a failed gate drops its line."""
    floor = F.lit(STD_FLOOR)
    b_missing, c_missing = ratio(F.col("b_null_count"), F.col("b_samples")), ratio(F.col("c_null_count"), F.col("c_samples"))
    spread = F.greatest(F.abs(F.coalesce("b_std", F.lit(0.0))), F.abs(F.coalesce("c_std", F.lit(0.0))), floor)

    def line(name, score, baseline, current, b_n, c_n):
        return F.struct(
            F.lit(name).alias("metric_name"), score.alias("metric_value"), baseline.alias("baseline_value"),
            current.alias("current_value"), b_n.alias("baseline_samples"), c_n.alias("current_samples"),
        )

    return F.array_compact(F.array(
        F.when(mean_ok, line("feature_mean_standardized_delta", F.abs(F.col("c_mean") - F.col("b_mean")) / spread,
                             F.col("b_mean"), F.col("c_mean"), F.col("b_non_null"), F.col("c_non_null"))),
        F.when(missing_ok, line("feature_missing_ratio_abs_delta", F.abs(c_missing - b_missing),
                                b_missing, c_missing, F.col("b_samples"), F.col("c_samples"))),
    ))


def _pivot(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Baseline and current rows of each key side by side as ``b_*`` and ``c_*``."""
    return df.groupBy(*keys).agg(*[
        F.max(F.when(F.col("side") == side, F.col(v))).alias(f"{side[0]}_{v}")
        for side in ("baseline", "current") for v in values
    ])


def recent_feature_scores(sided: DataFrame, top: int, min_non_null: int, min_samples: int) -> DataFrame:
    long = lengthen(sided, [*GROUP, "side"])
    stats = feature_stats(long, [*GROUP, "side"], few=0.0)
    both = _pivot(stats, [*GROUP, "feature_index", "feature_name"], ["samples", "null_count", "non_null", "mean", "std"])
    mean_ok = (F.col("b_non_null") >= min_non_null) & (F.col("c_non_null") >= min_non_null)
    missing_ok = (F.col("b_samples") >= min_samples) & (F.col("c_samples") >= min_samples)
    scored = both.select(*GROUP, "feature_index", "feature_name", F.inline(_score_lines(mean_ok, missing_ok)))
    return _ranked(scored, GROUP, top)


def recent_drift(
    predictions: DataFrame, snapshots: DataFrame | None = None, window_minutes: float = 5, top_n_features: int = 30, min_feature_non_null: int = 30,
    min_feature_samples: int = 30, evaluation_id: str | None = None, computed_at: float | None = None,
    tops: DataFrame | None = None,
) -> DataFrame:
    """All drift metrics per (model, threshold), the newest window against the one before it.

    Without ``snapshots`` the predictions must already be resolved and carry ``features``. An empty previous window gives null baselines, except a prediction count of 0.
    """
    seconds = float(window_minutes) * 60.0
    sided = with_sides(predictions, seconds, snapshots, tops=tops)
    summary = window_summary(sided, [*GROUP, "side"])
    both = _pivot(summary, GROUP, ["rows", *OUTPUT, *INPUT]).withColumns({
        "b_rows": F.coalesce("b_rows", F.lit(0).cast("bigint")),
        "b_prediction_count": F.coalesce("b_prediction_count", F.lit(0.0)),
    })
    families = _family_rows(both, GROUP, ("b_rows", "c_rows"))
    features = recent_feature_scores(sided, top_n_features, min_feature_non_null, min_feature_samples)
    metrics = families.unionByName(features)
    facts = sided.groupBy(*GROUP).agg(F.max("current_end").alias("current_end"), *_model_names(sided))
    described = attach(metrics, facts, GROUP, "inner")
    end = F.col("current_end")
    described = described.withColumns({
        "window_type": F.lit("recent_vs_previous_time_window"), "window_minutes": F.lit(float(window_minutes)),
        "baseline_start": end - 2.0 * seconds, "baseline_end": end - seconds, "current_start": end - seconds,
    })
    return _stamped(described, evaluation_id, computed_at)


def stored_recent_drift(
    table: DayTable, spark: SparkSession, models: DataFrame, window_minutes: float = 5, known: DataFrame | None = None, **options,
) -> DataFrame:
    """``recent_drift`` of ``models`` (model, threshold) over resolved predictions stored by day; only the newest days are read."""
    tops = table.newest(spark, GROUP, models, known)
    oldest = tops.agg(F.min("_top")).first()[0]
    reach = 4.0 * float(window_minutes) * 60.0  # two windows, and as much again for groups whose newest rows do not resolve
    rows = attach(table.read(spark, None if oldest is None else oldest - reach), tops.select(*GROUP), GROUP, "left_semi")
    return recent_drift(rows, None, window_minutes, tops=tops, **options)


def _model_names(df: DataFrame):
    order = F.struct("predicted_at", "prediction_id")
    return [first_present(F.col(n), order).alias(n) for n in NAMES if n in df.columns]


def _stamped(df: DataFrame, evaluation_id: str | None, computed_at: float | None) -> DataFrame:
    if evaluation_id is not None:
        df = df.withColumn("evaluation_id", F.lit(evaluation_id))
    if computed_at is not None:
        df = df.withColumns({"computed_at": F.lit(float(computed_at)), "created_at": F.lit(float(computed_at))})
    return df


def reference_rows(
    resolved: DataFrame, model_run_id: str, threshold: float, start: float, end: float, baseline_id: str,
) -> DataFrame:
    """The resolved predictions of one model in ``(start, end]``, marked with their baseline."""
    at = F.col("predicted_at")
    return resolved.where(
        (F.col("model_run_id") == model_run_id) & (F.col("threshold") == float(threshold)) & (at > start) & (at <= end)
    ).withColumn("baseline_id", F.lit(baseline_id))


def reference_stats(
    rows: DataFrame, min_feature_non_null: int = 30, min_feature_samples: int = 30, bins: int = 10,
    min_psi_non_null: int = 30,
) -> DataFrame:
    """Long reference statistics per ``baseline_id``: output, input, feature moments and feature bins."""
    key = ["baseline_id"]
    summary = window_summary(rows, key)
    none, counted = F.lit(None).cast("bigint"), F.col("rows")
    lines = []
    for family, names in (("output", OUTPUT), ("input", INPUT)):
        for name in names:
            plain = name in ("prediction_count", "predicted_fail_ratio")
            lines.append(F.struct(
                F.lit(family).alias("metric_family"), F.lit(name).alias("metric_name"),
                F.lit(None).cast("string").alias("feature_name"), F.col(name).alias("metric_value"),
                counted.alias("sample_count"), (none if plain else counted).alias("non_null_count"),
                none.alias("null_count"),
            ))
    totals = summary.select(*key, F.inline(F.array(*lines)))
    long = lengthen(rows, key)
    stats = feature_stats(long, key)

    def line(name, value):
        return F.struct(F.lit(name).alias("metric_name"), value.alias("metric_value"))

    enough = F.col("non_null") >= min_feature_non_null
    per_feature = stats.select(
        *key, F.lit("feature").alias("metric_family"), "feature_name", F.col("samples").alias("sample_count"),
        F.col("non_null").alias("non_null_count"), "null_count",
        F.inline(F.array_compact(F.array(
            F.when(F.col("samples") >= min_feature_samples,
                   line("feature_missing_ratio", ratio(F.col("null_count"), F.col("samples")))),
            F.when(enough, line("feature_mean", F.col("mean"))), F.when(enough, line("feature_std", F.col("std"))),
        ))),
    )
    binned = reference_bins(long, [*key, "feature_name"], bins).where(F.col("non_null_count") >= min_psi_non_null)
    sizes = stats.select(*key, "feature_name", F.col("samples").alias("sample_count"), "null_count")
    distributions = attach(binned, sizes, [*key, "feature_name"]).select(
        *key, F.lit("feature").alias("metric_family"), F.lit("feature_distribution_bins").alias("metric_name"),
        "feature_name", F.lit(None).cast("double").alias("metric_value"), "sample_count", "non_null_count",
        "null_count", "binning", "bin_edges", "bin_counts", "bin_ratios",
    )
    return totals.unionByName(per_feature).unionByName(distributions, allowMissingColumns=True)


def fixed_drift(
    predictions: DataFrame, baselines: DataFrame, stats: DataFrame, snapshots: DataFrame | None = None,
    window_minutes: float = 3, top_n_features: int = 30,
    min_feature_non_null: int = 30, min_feature_samples: int = 30, min_psi_non_null: int = 30,
    epsilon: float = PSI_EPSILON, evaluation_id: str | None = None, computed_at: float | None = None,
) -> DataFrame:
    """Newest window of every baseline's model against the stored reference statistics.

    ``baselines`` has ``baseline_id``, ``model_run_id``, ``threshold``, ``source_start``, ``source_end``.
    """
    seconds = float(window_minutes) * 60.0
    key = ["baseline_id"]
    known = small_table(baselines.select("baseline_id", *GROUP, "source_start", "source_end"))
    rows = newest_rows(attach(predictions, known, GROUP, "inner"), snapshots, key, seconds, seconds)
    stored = small_table(stats)

    current = window_summary(rows, key)
    current = current.select(*key, F.col("rows").alias("c_rows"), *[F.col(n).alias(f"c_{n}") for n in (*OUTPUT, *INPUT)])

    def stored_value(name, column, default=None):
        hit = F.max(F.when(F.col("metric_name") == name, F.col(column)))
        return hit if default is None else F.coalesce(hit, F.lit(default).cast("bigint"))

    wide = stored.where(F.col("metric_family").isin("output", "input")).groupBy(*key).agg(
        *[stored_value(n, "metric_value").alias(f"b_{n}") for n in (*OUTPUT, *INPUT)],
        *[stored_value(n, "sample_count", 0).alias(f"bn_{n}") for n in (*OUTPUT, *INPUT)],
    )
    joined = attach(current, wide, key)
    joined = joined.withColumns({f"bn_{n}": F.coalesce(f"bn_{n}", F.lit(0).cast("bigint")) for n in (*OUTPUT, *INPUT)})
    families = _family_rows(joined, key, ("bn", "c_rows"))

    long = lengthen(rows, key)
    moments = feature_stats(long, key).select(
        *key, "feature_index", "feature_name",
        *[F.col(c).alias(f"c_{c}") for c in ("samples", "null_count", "non_null", "mean", "std")],
    )
    marks = stored.where(F.col("metric_family") == "feature").groupBy(*key, "feature_name").agg(
        stored_value("feature_mean", "metric_value").alias("b_mean"),
        stored_value("feature_std", "metric_value").alias("b_std"),
        stored_value("feature_missing_ratio", "metric_value").alias("b_missing"),
        F.max(F.when(F.col("metric_name") == "feature_mean", F.coalesce("non_null_count", "sample_count"))).alias("b_non_null"),
        stored_value("feature_missing_ratio", "sample_count").alias("b_samples"),
        stored_value("feature_missing_ratio", "null_count").alias("b_null_count"),
    )
    faced = attach(moments, marks, [*key, "feature_name"], "inner")
    mean_ok = F.col("b_mean").isNotNull() & (F.col("c_non_null") >= min_feature_non_null) & F.col("c_mean").isNotNull()
    missing_ok = F.col("b_missing").isNotNull() & (F.col("c_samples") >= min_feature_samples)
    scored = faced.select(*key, "feature_index", "feature_name", F.inline(_score_lines(mean_ok, missing_ok)))
    reference = stored.where(F.col("metric_name") == "feature_distribution_bins").select(
        *key, "feature_name", "non_null_count", "bin_edges", "bin_ratios"
    )
    psi = feature_psi(long, reference, [*key, "feature_name"], min_psi_non_null, epsilon)
    index = F.substring("feature_name", 2, 9).cast("int")
    psi_lines = psi.select(
        *key, index.alias("feature_index"), "feature_name", F.lit("feature_psi").alias("metric_name"),
        F.col("psi").alias("metric_value"), F.lit(0.0).alias("baseline_value"), F.col("psi").alias("current_value"),
        F.col("non_null_count").alias("baseline_samples"), F.col("current_non_null").alias("current_samples"),
    )
    features = _ranked(scored.unionByName(psi_lines), key, top_n_features)
    metrics = families.unionByName(features)
    facts = rows.groupBy(*key, *GROUP, "source_start", "source_end").agg(
        F.max("current_end").alias("current_end"), *_model_names(rows)
    )
    described = attach(metrics, facts, key, "inner").withColumns({
        "window_type": F.lit("fixed_reference_time_window"), "window_minutes": F.lit(float(window_minutes)),
        "current_start": F.col("current_end") - seconds,
    })
    described = described.withColumnsRenamed({
        "source_start": "baseline_start", "source_end": "baseline_end", "baseline_id": "reference_baseline_id",
    })
    return _stamped(described, evaluation_id, computed_at)


def baseline_row(
    rows: DataFrame, baseline_name: str, source_start: float, source_end: float, feature_count: int,
    min_rows: int, created_at: float, created_by: str | None = None, notes: str | None = None,
) -> DataFrame:
    """The catalog row of a new baseline; fails when fewer than ``min_rows`` rows support it."""
    order = F.struct("predicted_at", "prediction_id")
    counted = rows.groupBy("baseline_id", *GROUP).agg(
        F.count(F.lit(1)).alias("sample_count"),
        *[first_present(F.col(n), order).alias(n) for n in NAMES if n in rows.columns],
    )
    short = F.raise_error(F.lit(f"not enough rows for a baseline: required={min_rows}")).cast("bigint")
    return counted.withColumn(
        "sample_count", F.when(F.col("sample_count") >= min_rows, F.col("sample_count")).otherwise(short)
    ).withColumns({
        "baseline_name": F.lit(baseline_name), "baseline_type": F.lit("fixed_reference"),
        "source_table": F.lit("prediction_logs"), "source_start": F.lit(float(source_start)),
        "source_end": F.lit(float(source_end)), "feature_count": F.lit(feature_count), "status": F.lit("active"),
        "notes": F.lit(notes), "created_by": F.lit(created_by), "created_at": F.lit(float(created_at)),
    })


def retire_active(baselines: DataFrame, model_run_id: str) -> DataFrame:
    """Mark the active fixed references of a model as retired."""
    hit = (
        (F.col("baseline_type") == "fixed_reference") & (F.col("status") == "active")
        & (F.col("model_run_id") == model_run_id)
    )
    return baselines.withColumn("status", F.when(hit, "retired").otherwise(F.col("status")))
