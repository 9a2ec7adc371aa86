"""Feature assembly in batch: replay in arrival order, reconstruction in event-time order."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proofline.functions.features import canonical, null_count
from proofline.functions.scalars import is_finite, offline_id, snapshot_id
from proofline.operators.scale import attach, hot_cuts, small_table, with_piece
from proofline.session import pinned

CARRIED = ("feature_group", "event_id", "simulation_run_id", "drift_segment")
# Beyond so many features the values are filled forward over change lists instead of by a window column each.
NARROW = 64


def checked_values(features: Column) -> Column:
    """``features``, or an error where a number is infinite or NaN."""
    values = F.map_values(features)  # NaN is the greatest of all numbers
    endless = ~is_finite(F.array_max(values)) | ~is_finite(F.array_min(values))
    return F.when(endless, F.raise_error(F.lit("feature value is not a finite number"))).otherwise(features)


def checked_patch(features: Column, keys: Sequence[str]) -> Column:
    """``features``, or an error where a key is unknown or a number infinite or NaN: batch and stream stop at the same patches."""
    unknown = F.array_except(F.map_keys(features), F.array(*[F.lit(k) for k in keys]))
    return F.when(
        F.size(unknown) > 0, F.raise_error(F.concat(F.lit("unexpected feature key: "), F.array_join(unknown, ",")))
    ).otherwise(checked_values(features))


def assemble_replay(
    patches: DataFrame, keys: Sequence[str], arrival: str = "arrival", piece_rows: int | None = None,
) -> DataFrame:
    """Every patch gives the full snapshot of its sample after merging it, in arrival order.

    A patched null overwrites an earlier number; an absent key does not. ``arrival`` is a number that
    is unique per sample. A sample above ``piece_rows`` patches is folded in pieces of its arrival
    range, each starting from the last state of the pieces before it. An unknown key or a number that is not finite stops the job.
    Beyond ``NARROW`` features ``assemble_wide`` does the same.
    """
    if len(keys) > NARROW:
        return assemble_wide(patches, keys, arrival, piece_rows)
    patches = patches.withColumn("features", checked_patch(F.col("features"), keys))
    present = [c for c in CARRIED if c in patches.columns]
    slots = [f"_s{i}" for i in range(len(keys))]

    def slot(key):
        return F.when(F.map_contains_key("features", key), F.struct(F.col("features")[key].alias("v")))

    cuts = hot_cuts(patches, ["sample_id"], arrival, piece_rows)
    spread = patches.select(
        "sample_id", "event_time", arrival, *present,
        *[c for c in patches.columns if c not in ("sample_id", "event_time", arrival, "features", *present)],
        *[slot(k).alias(s) for k, s in zip(keys, slots)],
    )
    spread = with_piece(spread, ["sample_id"], arrival, cuts)
    so_far = W.partitionBy("sample_id", "_piece").orderBy(arrival).rowsBetween(W.unboundedPreceding, 0)
    others = [c for c in spread.columns if c not in (*slots, *present)]
    folded = spread.select(
        *others,
        F.row_number().over(so_far.rowsBetween(W.unboundedPreceding, 0)).cast("bigint").alias("_count"),
        F.min("event_time").over(so_far).alias("_start"),
        F.max("event_time").over(so_far).alias("_end"),
        *[c for c in present],
        *[F.last(c, True).over(so_far).alias(f"_last_{c}") for c in present],
        *[F.last(s, True).over(so_far).alias(s) for s in slots],
    )
    if cuts is not None:
        folded = _carry_over(folded, spread, cuts, arrival, present, slots)
    observed = F.array(*[F.col(s) for s in slots])
    features = F.map_from_arrays(
        F.array(*[F.lit(k) for k in keys]), F.array(*[F.col(s)["v"] for s in slots])
    )
    result = folded.select(
        *[c for c in others if c != "_piece"], *present,
        F.col("_count").alias("snapshot_version"),
        F.col("_start").alias("window_start"), F.col("_end").alias("window_end"),
        F.col("_end").alias("snapshot_time"), F.col("_count").alias("source_event_count"),
        F.size(F.filter(observed, lambda s: s.isNotNull())).alias("feature_count"),
        features.alias("features"),
        *[F.col(f"_last_{c}").alias(f"last_{c}") for c in present],
    )
    return _described(result, len(keys))


def _carry_over(folded, spread, cuts, arrival, present, slots):
    """Add what earlier pieces of the hot samples contribute. One row per piece, 1024 pieces at most."""
    hot = attach(spread, cuts.select("sample_id").withColumn("_hot", F.lit(True)), ["sample_id"], "inner")
    kept = [*present, *slots]
    ends = hot.groupBy("sample_id", "_piece").agg(
        F.count(F.lit(1)).alias("_n"), F.min("event_time").alias("_t0"), F.max("event_time").alias("_t1"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(arrival))).alias(c) for c in kept],
    )
    before = W.partitionBy("sample_id").orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    carry = ends.select(
        "sample_id", "_piece", F.sum("_n").over(before).alias("_n"),
        F.min("_t0").over(before).alias("_t0"), F.max("_t1").over(before).alias("_t1"),
        *[F.last(c, True).over(before).alias(f"_c{c}") for c in kept],
    )
    joined = attach(folded, small_table(carry, 1_000_000), ["sample_id", "_piece"])
    return joined.select(
        *[c for c in folded.columns if c not in ("_count", "_start", "_end", *slots) and not c.startswith("_last_")],
        (F.col("_count") + F.coalesce("_n", F.lit(0))).alias("_count"),
        F.least("_start", "_t0").alias("_start"), F.greatest("_end", "_t1").alias("_end"),
        *[F.coalesce(f"_last_{c}", f"_c{c}").alias(f"_last_{c}") for c in present],
        *[F.coalesce(s, f"_c{s}").alias(s) for s in slots],
    )


def assemble_wide(
    patches: DataFrame, keys: Sequence[str], arrival: str = "arrival", piece_rows: int | None = None,
) -> DataFrame:
    """``assemble_replay`` for hundreds of features, with the vector as ``feature_values`` besides.

    One exchange by sample (and piece, for hot samples). Counts, times and carried texts are windows over it; the vectors are
    filled forward in the same order, a block of rows at a time, from the changes alone.
    """
    from proofline.operators.widefold import folded_batches

    names = list(keys)
    present = [c for c in CARRIED if c in patches.columns]
    others = [c for c in patches.columns if c not in ("sample_id", "event_time", arrival, "features", *present)]
    cuts = hot_cuts(patches, ["sample_id"], arrival, piece_rows)
    rows = with_piece(patches, ["sample_id"], arrival, cuts)
    rows = _with_earlier(rows, cuts, arrival, present)
    so_far = W.partitionBy("sample_id", "_piece").orderBy(arrival).rowsBetween(W.unboundedPreceding, 0)
    number = F.row_number().over(W.partitionBy("sample_id", "_piece").orderBy(arrival))
    folded = rows.select(
        "sample_id", "_piece", "event_time", arrival, *others, *present, "features",
        F.when(number == 1, F.col("_before")).alias("_before"),
        (number + F.coalesce("_n", F.lit(0))).cast("bigint").alias("snapshot_version"),
        F.least(F.min("event_time").over(so_far), "_t0").alias("window_start"),
        F.greatest(F.max("event_time").over(so_far), "_t1").alias("window_end"),
        *[F.coalesce(F.last(c, True).over(so_far), f"_c{c}").alias(f"last_{c}") for c in present],
    ).sortWithinPartitions("sample_id", "_piece", arrival)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in folded.schema if f.name not in ("features", "_before"))
    filled = folded.mapInArrow(
        lambda batches: folded_batches(batches, names, ("sample_id", "_piece"), "_before"),
        f"{kept}, feature_values array<double>, feature_count int, missing_count int",
    )
    result = filled.select(
        "sample_id", "event_time", arrival, *others, *present, "snapshot_version", "window_start", "window_end",
        F.col("window_end").alias("snapshot_time"), F.col("snapshot_version").alias("source_event_count"), "feature_count",
        F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.col("feature_values")).alias("features"),
        *[f"last_{c}" for c in present], "feature_values", "missing_count",
    )
    return _described(result, len(keys))


def _with_earlier(rows: DataFrame, cuts: DataFrame | None, arrival: str, present: Sequence[str]) -> DataFrame:
    """Add what the earlier pieces of a hot sample left: ``_n``, ``_t0``, ``_t1``, the carried texts and the map ``_before``."""
    kinds = {"_n": "bigint", "_t0": "double", "_t1": "double", **{f"_c{c}": "string" for c in present}, "_before": "map<string,double>"}
    if cuts is None:
        return rows.withColumns({name: F.lit(None).cast(kind) for name, kind in kinds.items()})
    hot = attach(rows, cuts.select("sample_id").withColumn("_hot", F.lit(True)), ["sample_id"], "inner")
    ends = hot.groupBy("sample_id", "_piece").agg(
        F.count(F.lit(1)).alias("_n"), F.min("event_time").alias("_t0"), F.max("event_time").alias("_t1"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(arrival))).alias(c) for c in present],
    )
    before = W.partitionBy("sample_id").orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    totals = ends.select(
        "sample_id", "_piece", F.sum("_n").over(before).alias("_n"), F.min("_t0").over(before).alias("_t0"),
        F.max("_t1").over(before).alias("_t1"), *[F.last(c, True).over(before).alias(f"_c{c}") for c in present],
        F.max("_piece").over(W.partitionBy("sample_id")).alias("_last"),
    )
    # A feature's last value in a piece holds for the pieces after it, up to the next piece that sets the feature.
    value = F.max_by(F.struct(F.col("_value").alias("v")), F.col(arrival)).alias("_set")
    changes = hot.select("sample_id", "_piece", arrival, F.explode("features").alias("_key", "_value")).groupBy("sample_id", "_key", "_piece").agg(value)
    spans = changes.withColumn("_next", F.lead("_piece").over(W.partitionBy("sample_id", "_key").orderBy("_piece")))
    spans = attach(spans, totals.groupBy("sample_id").agg(F.max("_last").alias("_last")), ["sample_id"])
    reach = F.coalesce("_next", "_last")
    held = spans.where(reach > F.col("_piece")).select(
        "sample_id", F.explode(F.sequence(F.col("_piece") + 1, reach)).alias("_piece"), "_key", F.col("_set.v").alias("_value")
    ).groupBy("sample_id", "_piece").agg(F.map_from_entries(F.collect_list(F.struct("_key", "_value"))).alias("_before"))
    carried = attach(totals.drop("_last"), held, ["sample_id", "_piece"])
    return attach(rows, pinned(carried), ["sample_id", "_piece"])


def first_complete_versions(patches: DataFrame, keys: Sequence[str], arrival: str = "arrival") -> DataFrame:
    """Per sample the arrival at which its last missing feature came: the first complete version, without folding any history.

    A sample is complete once every feature has been sent, null included, so that is the greatest over the features of their first
    arrivals. Features that are always sent together have the same first arrivals, so one of each such class is followed; the classes
    are found once, by a job over the distinct sets of features. Two aggregates, both reduced before their shuffle; samples that
    never become complete give no row.
    """
    features = checked_values(F.col("features"))
    followed = _followed(patches, keys)
    if followed is None:  # a feature that no patch sends
        return patches.select("sample_id", F.col(arrival).alias("complete_at")).where(features.isNull() & F.lit(False))
    held = F.array_intersect(F.map_keys(features), F.array(*[F.lit(k) for k in followed]))
    sent = patches.select("sample_id", arrival, F.explode(held).alias("_key"))
    firsts = sent.groupBy("sample_id", "_key").agg(F.min(arrival).alias("_first"))
    return firsts.groupBy("sample_id").agg(F.max("_first").alias("complete_at"), F.count(F.lit(1)).alias("_features")).where(
        F.col("_features") == len(followed)
    ).drop("_features")


def _followed(patches: DataFrame, keys: Sequence[str]) -> list[str] | None:
    """One of the features of each class that all patches send together; None if there is a feature that none sends.

    Each distinct set of features has two hashes, and features of the same number and sums of them are in the same sets. The
    result has one name per class, ``len(keys)`` at most. An unknown feature stops the job.
    """
    names = F.map_keys("features")
    sets = patches.select(names.alias("_set")).where(F.size("_set") > 0).distinct()
    marks = [F.xxhash64("_set"), F.xxhash64(F.lit(1), "_set")]
    known = F.array_except("_set", F.array(*[F.lit(k) for k in keys]))
    checked = F.when(F.size(known) == 0, F.col("_set")).otherwise(
        F.raise_error(F.concat(F.lit("unexpected feature key: "), F.array_join(known, ",")))
    )
    members = sets.select(*[m.cast("decimal(38,0)").alias(f"_m{i}") for i, m in enumerate(marks)], F.explode(checked).alias("_key"))
    sums = [F.sum(f"_m{i}").alias(f"_m{i}") for i in range(len(marks))]
    of_key = members.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), *sums)
    classes = of_key.groupBy("_n", "_m0", "_m1").agg(F.min("_key").alias("name"), F.count(F.lit(1)).alias("size")).collect()
    return sorted(c["name"] for c in classes) if sum(c["size"] for c in classes) == len(keys) else None


def _described(df: DataFrame, width: int) -> DataFrame:
    """Add the columns that follow from the folded state."""
    complete = F.col("feature_count") == width
    return df.select(
        snapshot_id(F.col("sample_id"), F.col("snapshot_time"), F.col("snapshot_version")).alias("serving_snapshot_id"),
        *df.columns,
        *([] if "missing_count" in df.columns else [null_count(F.col("features")).alias("missing_count")]),
        complete.alias("is_complete"),
        F.when(complete, "complete").otherwise("partial").alias("snapshot_status"),
    )


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot per sample."""
    from proofline.operators.latest import top_per_key

    return top_per_key(snapshots, ["sample_id"], [F.col("snapshot_version").desc()])


def reconstruct(
    events: DataFrame, keys: Sequence[str], cutoff: float | Column, created_at: float | None = None,
) -> DataFrame:
    """Features per sample as of ``cutoff``: the value with the latest event time wins.

    Ties go to the later ``created_at``, then the higher event id. Values are reduced per (sample,
    feature) before the shuffle, so a sample with many patches costs no more than its feature count.
    """
    limit = cutoff if isinstance(cutoff, Column) else F.lit(float(cutoff))
    seen = events.where(F.col("event_time") <= limit)
    order = F.struct("event_time", "created_at", "event_id")
    values = (
        seen.select("sample_id", order.alias("_order"), F.explode("features").alias("_key", "_value"))
        .groupBy("sample_id", "_key")
        .agg(F.max_by(F.struct(F.col("_value").alias("v")), F.col("_order")).alias("_state"))
    )
    states = values.groupBy("sample_id").agg(
        F.map_from_entries(F.collect_list(F.struct("_key", F.col("_state.v")))).alias("_observed")
    )
    totals = seen.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("source_event_count"), F.max("event_time").alias("max_event_time"),
    )
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    joined = totals.join(states, "sample_id", "left").withColumn("_observed", F.coalesce("_observed", empty))
    unknown = F.array_except(F.map_keys("_observed"), F.array(*[F.lit(k) for k in keys]))
    checked = F.when(F.size(unknown) == 0, F.col("_observed")).otherwise(
        F.raise_error(F.concat(F.lit("unexpected feature key: "), F.array_join(unknown, ",")))
    )
    rebuilt = joined.select(
        offline_id(F.col("sample_id"), limit).alias("offline_snapshot_id"), "sample_id",
        limit.alias("build_cutoff_time"),
        F.size("_observed").alias("feature_count"), canonical(checked, keys).alias("features"),
        "source_event_count", "max_event_time",
    )
    rebuilt = rebuilt.withColumn("missing_count", null_count(F.col("features"))).withColumn(
        "is_complete", F.col("feature_count") == len(keys)
    )
    return rebuilt if created_at is None else rebuilt.withColumn("created_at", F.lit(float(created_at)))
