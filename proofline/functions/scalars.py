"""Scalar column expressions shared by all jobs."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofline.constants import FAIL, PASS


def delta(current: Column, baseline: Column) -> Column:
    return current - baseline


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null for a zero denominator (plain division raises under ANSI)."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def is_finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def metric_value(value: Column) -> Column:
    """Non-finite numbers become null."""
    number = value.cast("double")
    return F.when(is_finite(number), number)


def clean_feature(value: Column, non_finite: str = "none") -> Column:
    """Apply a policy to NaN and infinities: ``none`` (null), ``allow`` or ``error``."""
    if non_finite == "allow":
        return value
    if non_finite == "none":
        return metric_value(value)
    if non_finite == "error":
        complaint = F.raise_error(F.lit("feature value must be finite")).cast("double")
        return F.when(value.isNull() | is_finite(value), value).otherwise(complaint)
    raise ValueError(f"unknown non_finite policy: {non_finite}")


def time_bucket(at: Column, width: float, offset: float = 0.0) -> Column:
    """Start of the ``width``-second bucket, buckets being shifted by ``offset``."""
    return F.floor((at - F.lit(offset)) / F.lit(width)) * F.lit(width) + F.lit(offset)


def finite_time(at: Column) -> Column:
    return (at >= 0.0) & (at < F.lit(float("inf")))


def half_open(at: Column, start: float, end: float) -> Column:
    return (at >= F.lit(float(start))) & (at < F.lit(float(end)))


def class_name(value: Column) -> Column:
    return F.when(value == FAIL, "fail").when(value == PASS, "pass")


def decide(probability: Column, threshold: Column) -> Column:
    return F.when(probability >= threshold, F.lit(FAIL)).otherwise(F.lit(PASS)).cast("int")


def snapshot_id(sample: Column, at: Column, version: Column) -> Column:
    millis = (at * 1000).cast("bigint")
    return F.concat(F.lit("state:"), sample, F.lit(":"), millis.cast("string"), F.lit(":"), version.cast("string"))


def offline_id(sample: Column, cutoff: Column) -> Column:
    return F.concat(F.lit("offline:"), sample, F.lit(":"), F.format_string("%.6f", cutoff))


def epoch_seconds(timestamp: Column) -> Column:
    return F.unix_micros(timestamp.cast("timestamp")) / F.lit(1e6)


def iso_utc(at: Column) -> Column:
    """Epoch seconds to ISO text. The session time zone is UTC."""
    return F.date_format(F.timestamp_seconds(at), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def parse_time(text: Column, zone: str = "UTC") -> Column:
    """Epoch number or ISO text to epoch seconds; text without a zone is read in ``zone``."""
    number = text.try_cast("double")
    has_zone = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    moment = F.when(has_zone, F.try_to_timestamp(text)).otherwise(
        F.to_utc_timestamp(F.try_to_timestamp(text), zone)
    )
    return F.coalesce(number, epoch_seconds(moment))


def first_present(value: Column, order: Column) -> Column:
    """Aggregate: the first non-null, non-empty value in ``order``."""
    present = F.nullif(value, F.lit(""))
    return F.min_by(present, F.when(present.isNotNull(), order))


def request_outcome(status: Column, retryable: Column) -> Column:
    return (
        F.when(status.isNull(), "request_error")
        .when(status == 200, "predicted")
        .when(status == 404, "not_found")
        .when((status == 409) & F.coalesce(retryable, F.lit(False)), "partial")
        .when(status == 409, "not_ready_final")
        .when(status == 502, "model_gateway_error")
        .when(status == 503, "feature_store_unavailable")
        .otherwise("failed")
    )


def serve_disposition(status: Column, is_complete: Column) -> Column:
    """What scoring does with a snapshot: score it, ask again later, or give up."""
    return (
        F.when(is_complete & (status == "complete"), "score")
        .when(status == "timed_out", "not_ready_final")
        .otherwise("not_ready_retry")
    )


def bisect(edges: Column, value: Column) -> Column:
    """Number of sorted ``edges`` strictly below ``value`` (right-closed buckets)."""
    return F.size(F.filter(edges, lambda edge: edge < value))


def reasons(checks: Sequence[tuple[Column, Column]]) -> Column:
    """Array of the messages whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(failed, text) for failed, text in checks]))


def shortfalls(checks: Sequence[tuple[str, Column, float]]) -> Column:
    """Array of ``(code, required, actual)`` for each figure below its minimum, in order; a missing figure counts as below."""
    def entry(code: str, actual: Column, required: float) -> Column:
        found = F.struct(F.lit(code).alias("code"), F.lit(float(required)).alias("required"), actual.cast("double").alias("actual"))
        return F.when(actual.isNull() | (actual < required), found)

    return F.array_compact(F.array(*[entry(code, actual, required) for code, actual, required in checks]))
