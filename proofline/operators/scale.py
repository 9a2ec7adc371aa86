"""Building blocks that keep hot groups out of single tasks.

A group (one sample, one model) may hold a large part of all rows. Whatever needs
an order inside a group is therefore done in pieces: the group's order column is cut at
approximate quantiles, each piece is processed on its own, and what the earlier pieces
contribute is carried over. Any monotone cut gives exact results; the quantiles only
balance the work.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proofline.functions.scalars import bisect
from proofline.session import pinned

PIECE_ROWS = 5_000_000
PIECES = 1024
STRIDE = 32
SKETCH_ACCURACY = 10_000
BINS_PER_E = 4096
SMALL_TABLE_BYTES = 32 * 1024 * 1024


def small_table(df: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """Evaluate a table expected to be small, once.

    Up to ``max_rows`` rows and 32 MB it becomes a local relation, whose exact size lets Spark choose
    a broadcast by itself. A larger one is checkpointed and joined by shuffle.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows <= max_rows and rows.nbytes <= SMALL_TABLE_BYTES:
        return df.sparkSession.createDataFrame(rows, df.schema)
    return pinned(df)


def attach(df: DataFrame, extra: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join ``extra``, usually a small table, on ``keys``, null keys matching each other."""
    renamed = extra
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"_k_{key}")
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    return df.join(renamed, condition, how).drop(*[f"_k_{key}" for key in keys])


def hot_cuts(df: DataFrame, keys: Sequence[str], order: str, piece_rows: int | None = None) -> DataFrame | None:
    """Cut points for every group above ``piece_rows`` rows, or None if there is none.

    At most rows / piece_rows groups can be hot, so the result is small. The cuts are evaluated
    once: two evaluations of an approximate quantile need not agree.
    """
    limit = PIECE_ROWS if piece_rows is None else piece_rows
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(*keys)
    hot = small_table(hot)
    if hot.isEmpty():
        return None
    points = [i / PIECES for i in range(1, PIECES)]
    marked = attach(df.select(*keys, order), hot.withColumn("_hot", F.lit(True)), keys, "inner")
    cuts = marked.groupBy(*keys).agg(
        F.array_sort(F.array_distinct(F.percentile_approx(order, points, SKETCH_ACCURACY))).alias("_cuts")
    )
    coarse = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.size("_cuts") / STRIDE).cast("int"))),
        lambda i: F.element_at("_cuts", F.least(i * STRIDE, F.size("_cuts"))),
    )
    return small_table(cuts.withColumn("_coarse", coarse))


def with_piece(df: DataFrame, keys: Sequence[str], order: str, cuts: DataFrame | None) -> DataFrame:
    """Add ``_piece``: 0 for ordinary groups, else the index of the interval ``order`` falls into."""
    if cuts is None:
        return df.withColumn("_piece", F.lit(0))
    block = F.least(bisect(F.col("_coarse"), F.col(order)), F.size("_coarse") - 1)
    fine = F.slice("_cuts", block * STRIDE + 1, STRIDE)
    piece = F.when(F.col("_cuts").isNull(), 0).otherwise(block * STRIDE + bisect(fine, F.col(order)))
    return attach(df, cuts, keys).withColumn("_piece", piece).drop("_cuts", "_coarse")


def running_sums(
    df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], descending: bool = False,
    piece_rows: int | None = None,
) -> DataFrame:
    """Add ``cum_<column>``: the sum over the group's rows up to and including this ``order`` value.

    ``df`` has one row per (keys, order) and only columns derived from pre-aggregation.
    """
    cuts = hot_cuts(df, keys, order, piece_rows)
    pieces = with_piece(df, keys, order, cuts)

    def direction(name):
        return F.col(name).desc() if descending else F.col(name).asc()

    inside = W.partitionBy(*keys, "_piece").orderBy(direction(order)).rowsBetween(W.unboundedPreceding, 0)
    result = pieces.select("*", *[F.sum(c).over(inside).alias(f"cum_{c}") for c in columns])
    if cuts is None:
        return result.drop("_piece")
    hot = attach(pieces, cuts.select(*keys).withColumn("_hot", F.lit(True)), keys, "inner")
    earlier = W.partitionBy(*keys).orderBy(direction("_piece")).rowsBetween(W.unboundedPreceding, -1)
    totals = hot.groupBy(*keys, "_piece").agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])
    carry = totals.select(
        *keys, "_piece", *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_c_{c}") for c in columns]
    )
    carry = small_table(carry, 1_000_000)
    result = attach(result, carry, [*keys, "_piece"])
    for c in columns:
        result = result.withColumn(f"cum_{c}", F.col(f"cum_{c}") + F.coalesce(F.col(f"_c_{c}"), F.lit(0)))
    return result.drop("_piece", *[f"_c_{c}" for c in columns])


def ordered_bin(value: Column) -> Column:
    """A whole number that never falls as ``value`` rises: ``BINS_PER_E`` bins to each factor e, on both sides of zero."""
    size = F.floor(F.ln(F.abs(value)) * BINS_PER_E) + 800 * BINS_PER_E  # the least double is e^-745
    endless = F.abs(value) == F.lit(float("inf"))
    wide = F.when(endless, F.lit(2000 * BINS_PER_E)).otherwise(size)
    return F.when(value == 0, 0).when(value > 0, wide).otherwise(-wide).cast("bigint")


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``_v`` and ``_rows`` per group: how often each value occurs, nulls and NaN left out. Reduced before its one shuffle.

    What is derived from it in one plan, quantiles, edges and bucket counts, shares that shuffle.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")).where(~F.isnan("_v"))
    return rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_rows"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], lower: bool = False) -> DataFrame:
    """One row per group: ``_n`` and ``_q``, the exact quantiles of the values that are neither null nor NaN.

    Linear interpolation at position (n-1)q, or with ``lower`` the element at floor((n-1)q).
    """
    return quantiles_of_counts(value_counts(df, keys, value), keys, probs, lower)


def quantiles_of_counts(counts: DataFrame, keys: Sequence[str], probs: Sequence[float], lower: bool = False) -> DataFrame:
    """``exact_quantiles`` from ``value_counts``. Nothing runs while the plan is built.

    Counts are spread by value, so a hot group is too. The sums of ordered bins of values, a thin line each, say which bin holds
    each position and how far into it; only the values of those bins are put in order, each bin by itself.
    """
    counts = counts.withColumn("_bin", ordered_bin(F.col("_v")))
    group = W.partitionBy(*keys)
    upto = F.sum("_in").over(group.orderBy("_bin").rowsBetween(W.unboundedPreceding, 0))
    whole = F.sum("_in").over(group.orderBy("_bin").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    bins = counts.groupBy(*keys, "_bin").agg(F.sum("_rows").alias("_in")).select("*", upto.alias("_upto"), whole.alias("_n"))
    places = [(F.col("_n") - 1) * F.lit(float(q)) for q in probs]
    ends = [end for at in places for end in (F.floor(at), F.ceil(at))]
    wanted = F.array(*[F.struct(F.lit(i).alias("slot"), end.cast("bigint").alias("at")) for i, end in enumerate(ends)])
    before = F.col("_upto") - F.col("_in")
    here = F.filter(wanted, lambda w: (w["at"] >= before) & (w["at"] < F.col("_upto")))
    local = F.transform(here, lambda w: F.struct(w["slot"].alias("slot"), (w["at"] - before).alias("at")))
    picked = bins.select(*keys, "_bin", "_n", local.alias("_wanted")).where(F.size("_wanted") > 0)
    inside = attach(counts, picked, [*keys, "_bin"], "inner")
    through = F.sum("_rows").over(W.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    ranked = inside.withColumn("_through", through)
    hits = F.filter("_wanted", lambda w: (w["at"] < F.col("_through")) & (w["at"] >= F.col("_through") - F.col("_rows")))
    found = ranked.select(*keys, "_n", "_v", F.explode(F.transform(hits, lambda w: w["slot"])).alias("_slot"))
    slots = found.groupBy(*keys, "_n").agg(*[F.max(F.when(F.col("_slot") == i, F.col("_v"))).alias(f"_s{i}") for i in range(len(ends))])

    def quantile(i: int, at: Column) -> Column:
        low, high, weight = F.col(f"_s{2 * i}"), F.col(f"_s{2 * i + 1}"), at - F.floor(at)
        # Equal neighbours need no arithmetic; it would move the value by a rounding error.
        return low if lower else F.when((weight == 0) | (low == high), low).otherwise(low * (1 - weight) + high * weight)

    return slots.select(*keys, "_n", F.array(*[quantile(i, at) for i, at in enumerate(places)]).alias("_q"))


def smallest_by_order(df: DataFrame, keys: Sequence[str], order: str, tie: str, wanted: Column) -> DataFrame:
    """Flag ``_picked`` the ``wanted`` rows (a column constant per group) with the smallest ``order``.

    Runs as a running count over distinct order values, so no group is sorted in one task.
    """
    counts = df.groupBy(*keys, order).agg(F.count(F.lit(1)).alias("_rows"))
    edges = running_sums(counts, keys, order, ["_rows"])
    edges = edges.withColumnRenamed("cum__rows", "_upto")
    marked = attach(df, edges, [*keys, order], "inner")
    remaining = wanted - (F.col("_upto") - F.col("_rows"))
    # Rows sharing an order value are few; only these are ranked by the tie column.
    within = W.partitionBy(*keys, order).orderBy(tie)
    ranked = marked.withColumn("_rank", F.row_number().over(within))
    return ranked.withColumn("_picked", F.col("_rank") <= remaining).drop("_rows", "_upto", "_rank")
