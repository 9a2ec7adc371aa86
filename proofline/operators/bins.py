"""Quantile bins of a reference distribution and the population stability index against them."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.constants import PSI_EPSILON
from proofline.functions.scalars import bisect, is_finite
from proofline.operators.scale import attach, quantiles_of_counts, value_counts


def previous_double():
    """Pandas UDF: the largest double below each value. Runs on one row per constant feature."""

    @F.pandas_udf("double")
    def below(values):
        import numpy as np
        import pandas as pd

        return pd.Series(np.nextafter(values.to_numpy("float64"), -np.inf))

    return below


def bin_edges(long: DataFrame, keys: Sequence[str], bins: int = 10) -> DataFrame:
    return edges_of_counts(value_counts(long, keys, "value"), keys, bins)


def edges_of_counts(counts: DataFrame, keys: Sequence[str], bins: int = 10) -> DataFrame:
    """Strictly increasing inner edges per group; a constant group gets the buckets below, equal, above."""
    probs = [0.0, *[i / bins for i in range(1, bins)], 1.0]
    q = quantiles_of_counts(counts, keys, probs)
    low, high = F.col("_q")[0], F.element_at("_q", -1)
    inner = F.array_sort(F.array_distinct(F.filter(F.slice("_q", 2, bins - 1), is_finite)))
    edges = (
        F.when(low == high, F.array(previous_double()(low), low))
        .when(F.size(inner) == 0, F.array((low + high) / 2.0)).otherwise(inner)
    )
    return q.select(
        *keys, F.col("_n").alias("non_null_count"), low.alias("min_value"), high.alias("max_value"),
        F.when(low == high, "constant_baseline_anchor").otherwise("baseline_quantile").alias("binning"),
        edges.alias("bin_edges"),
    )


def bucket_counts(long: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Values per right-closed bucket, empty buckets included, as an array per group.

    The edges of a group say how many buckets it has, whatever that number is. Rows are counted per bucket before anything is
    shuffled; an array holds one count per bucket.
    """
    return buckets_of_counts(value_counts(long, keys, "value"), edges, keys)


def buckets_of_counts(counts: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``bucket_counts`` from ``value_counts``."""
    placed = attach(counts, edges.select(*keys, "bin_edges"), keys, "inner").select(
        *keys, "bin_edges", bisect(F.col("bin_edges"), F.col("_v")).cast("int").alias("_bucket"), "_rows"
    )
    counted = placed.groupBy(*keys, "bin_edges", "_bucket").agg(F.sum("_rows").alias("_rows"))
    found = counted.groupBy(*keys, "bin_edges").agg(
        F.map_from_entries(F.collect_list(F.struct("_bucket", "_rows"))).alias("_found")
    )
    every = F.transform(
        F.sequence(F.lit(0), F.size("bin_edges")),
        lambda i: F.coalesce(F.try_element_at("_found", i), F.lit(0).cast("bigint")),
    )
    return found.select(*keys, every.alias("bin_counts"))


def shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.when(total > 0, F.transform(counts, lambda c: c / total)).otherwise(F.array().cast("array<double>"))


def reference_bins(long: DataFrame, keys: Sequence[str], bins: int = 10) -> DataFrame:
    """Edges, counts and ratios of the reference distribution per group, all from one count of the values."""
    values = value_counts(long, keys, "value")
    edges = edges_of_counts(values, keys, bins)
    counts = buckets_of_counts(values, edges, keys)
    return attach(edges, counts, keys).withColumn("bin_ratios", shares(F.col("bin_counts")))


def stability_index(expected: Column, actual: Column, epsilon: float = PSI_EPSILON) -> Column:
    """Sum of (a-e) ln(a/e) over bins, shares floored at ``epsilon``; null unless both have the same bins."""
    floor = F.lit(epsilon)

    def term(e, a):
        e, a = F.greatest(e, floor), F.greatest(a, floor)
        return (a - e) * F.ln(a / e)

    usable = (F.size(expected) == F.size(actual)) & (F.size(expected) > 0)
    return F.when(usable, F.aggregate(F.zip_with(expected, actual, term), F.lit(0.0), lambda s, x: s + x))


def feature_psi(
    long: DataFrame, reference: DataFrame, keys: Sequence[str], min_rows: int = 1, epsilon: float = PSI_EPSILON,
) -> DataFrame:
    """Stability index of the current long rows per group of ``reference`` (edges, counts, ratios)."""
    stored = reference.where(
        (F.col("non_null_count") >= min_rows) & (F.size("bin_ratios") == F.size("bin_edges") + 1)
    )
    counts = bucket_counts(long, stored, keys)
    total = F.aggregate("bin_counts", F.lit(0).cast("bigint"), lambda a, x: a + x)
    current = counts.withColumn("current_non_null", total).where(F.col("current_non_null") >= min_rows)
    joined = attach(current, stored.select(*keys, "bin_ratios", "non_null_count"), keys, "inner")
    return joined.select(
        *keys, "non_null_count", "current_non_null",
        stability_index(F.col("bin_ratios"), shares(F.col("bin_counts")), epsilon).alias("psi"),
    ).where(F.col("psi").isNotNull())
