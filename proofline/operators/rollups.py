"""Roll-ups, set comparisons and audit reads over evidence tables."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.functions.scalars import class_name
from proofline.operators.latest import top_per_key


def patch_coverage(events: DataFrame, newest: int = 20) -> DataFrame:
    """Patches per sample for the ``newest`` sample ids: how many, of which groups, how many keys.

    The group list has one entry per patch; it is built from counts per group.
    """
    samples = events.select("sample_id").distinct().orderBy(F.col("sample_id").desc()).limit(newest)
    per_group = events.join(F.broadcast(samples), "sample_id", "left_semi").groupBy("sample_id", "feature_group").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.size(F.map_keys("features"))).alias("_keys")
    )
    listed = F.array_sort(F.collect_list(F.struct("feature_group", F.col("_n").cast("int").alias("n"))))
    return per_group.groupBy("sample_id").agg(
        F.sum("_n").alias("patch_count"),
        F.flatten(F.transform(listed, lambda g: F.array_repeat(g["feature_group"], g["n"]))).alias("feature_groups"),
        F.sum("_keys").alias("observed_feature_count"),
    )


def rollup(df: DataFrame, distinct: Sequence[str] = (), ends: Sequence[str] = (), label: str | None = None) -> DataFrame:
    """One row: rows, distinct counts, pass and fail counts, smallest and largest values."""
    columns: list[Column] = [F.count(F.lit(1)).alias("row_count")]
    columns += [F.count_distinct(c).alias(f"distinct_{c}") for c in distinct]
    if label is not None:
        columns += [F.count_if(F.col(label) == n).alias(f"{n}_count") for n in ("fail", "pass")]
    for c in ends:
        columns += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    return df.agg(*columns)


def inventory(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key combination, largest first; null keys form their own group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).orderBy(F.col("row_count").desc(), *keys)


def status_summary(df: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"), F.min(at).alias(f"first_{at}"), F.max(at).alias(f"last_{at}")
    )


def leading_successes(results: DataFrame, keys: Sequence[str] = (), index: str = "index", ok: str = "ok") -> DataFrame:
    """Length of the run of successes at the start of each group, in ``index`` order."""
    first_failure = F.min(F.when(~F.col(ok), F.col(index)))
    return results.groupBy(*keys).agg(
        (F.coalesce(first_failure, F.max(index) + 1) - F.min(index)).alias("leading_successes")
    )


def membership_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows in only one of two selections, with the side they are on; empty if the selections are equal.

    Copies count: a row that is on one side n times more is given n times. One aggregate over both sides, null equal to null.
    """
    names = left.columns
    both = left.withColumn("_side", F.lit(1)).unionByName(right.select(*names).withColumn("_side", F.lit(-1)))
    surplus = both.groupBy(*names).agg(F.sum("_side").cast("int").alias("_more")).where(F.col("_more") != 0)
    copies = F.explode(F.array_repeat(F.when(F.col("_more") > 0, "left").otherwise("right"), F.abs("_more")))
    return surplus.select(*names, copies.alias("only_in"))


ELIGIBLE = {
    "deployable": ("not_started", "promoted", "canary_reloading", "canary_ready"),
    "releasable": ("canary_ready", "release_reloading"),
    "rollback": ("promoted", "canary_reloading", "canary_ready", "release_reloading", "failed"),
    "approved": ("not_started", "promoted", "canary_reloading", "canary_ready", "release_reloading"),
}


def next_eligible(requests: DataFrame, purpose: str, eval_type: str | None = None) -> DataFrame:
    """Newest approved request per (model, alias) whose rollout allows ``purpose``.

    Every purpose but rollback also needs a passed evaluation.
    """
    rows = requests.where(
        (F.col("approval_status") == "approved") & F.col("rollout_status").isin(*ELIGIBLE[purpose])
    )
    if purpose != "rollback":
        rows = rows.where(F.col("eval_status") == "passed")
        if eval_type is not None:
            rows = rows.where(F.col("eval_type") == eval_type)
    return top_per_key(rows, ["model_name", "target_alias"], [F.col("requested_at").desc(), F.col("request_id").desc()])


def newest_rows(df: DataFrame, at: str, tie: str, limit: int) -> DataFrame:
    return df.orderBy(F.col(at).desc(), F.col(tie).desc()).limit(limit)


def active_baselines(baselines: DataFrame) -> DataFrame:
    """Active fixed references per model: their number, and the id where it is unique."""
    active = baselines.where((F.col("baseline_type") == "fixed_reference") & (F.col("status") == "active"))
    count = F.count(F.lit(1))
    return active.groupBy("model_run_id").agg(
        count.alias("active_count"), F.when(count == 1, F.max("baseline_id")).alias("baseline_id")
    )


def the_active_baseline(baselines: DataFrame, model_run_id: str) -> str | None:
    """The only active baseline of a model; None without one, an error with several."""
    row = active_baselines(baselines.where(F.col("model_run_id") == model_run_id)).first()
    if row is None:
        return None
    if row["active_count"] > 1:
        raise RuntimeError(f"{row['active_count']} active fixed-reference baselines for {model_run_id}")
    return row["baseline_id"]


def appended_note(notes: Column, note: Column) -> Column:
    """Existing notes with another line; an empty note changes nothing."""
    empty = F.coalesce(note, F.lit("")) == ""
    blank = F.coalesce(notes, F.lit("")) == ""
    return F.when(empty, notes).when(blank, note).otherwise(F.concat(notes, F.lit("\n"), note))


def labeled(df: DataFrame) -> DataFrame:
    return df.withColumn("actual_label", class_name(F.col("actual_value")))
