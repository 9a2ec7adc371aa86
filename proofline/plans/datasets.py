"""Versioned datasets: identity, build log, writing and verification."""

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.constants import FAIL, HASH_PREFIX, PASS, model_columns
from proofline.functions.features import missing_keys, null_count, unexpected_keys, widen
from proofline.functions.scalars import is_finite, ratio, reasons
from proofline.operators.latest import top_per_key
from proofline.plans.cohorts import OPTIONAL, CohortConfig, label_violations
from proofline.schemas import evidence_schemas
from proofline.sources.sinks import Table

# The columns of a stored member, in stored order.
TRAINING_MEMBERS = (
    "sample_id", "serving_snapshot_id", "snapshot_version", "feature_hash", "snapshot_time", "snapshot_available_at",
    "window_start", "window_end", "feature_count", "serving_missing_count", "simulation_run_id", "drift_segment",
    "label_event_id", "label_revision", "label_measured_at", "label_available_at", "actual_value", "actual_label",
)
GATE_MEMBERS = (
    "prediction_id", "request_id", "source_model_run_id", "runtime_slot", "source_threshold", "predicted_at",
    *TRAINING_MEMBERS,
)
LIMBS = 8


def canonical_text(columns: Sequence[str]) -> Column:
    """One unambiguous text per row: each value with its length, null as '-'; doubles in full precision."""

    def text(name):
        shown = F.col(name).cast("string")
        return F.coalesce(F.concat(F.length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))

    return F.concat_ws("|", *[text(c) for c in columns])


def with_row_digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumn("row_digest", F.sha2(canonical_text(columns), 256))


def selection_digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count and a digest of the rows as a multiset, in one aggregate.

    The row digests are added up limb by limb, so neither order nor partitioning matters and only nine
    numbers per task are shuffled.
    """
    rows = with_row_digest(df, columns).select("row_digest")

    def limb(i):
        return F.sum(F.conv(F.substring("row_digest", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")).alias(f"_l{i}")

    sums = rows.agg(F.count(F.lit(1)).alias("row_count"), *[limb(i) for i in range(LIMBS)])
    parts = [F.coalesce(F.col(f"_l{i}").cast("string"), F.lit("0")) for i in range(LIMBS)]
    text = F.concat_ws(":", F.col("row_count").cast("string"), *parts)
    return sums.select("row_count", F.sha2(text, 256).alias("digest"))


@dataclass(frozen=True)
class Identity:
    dataset_id: str
    manifest_hash: str
    row_count: int
    rows_digest: str
    payload: dict


def build_identity(cohort: DataFrame, members: Sequence[str], kind: dict, config: CohortConfig) -> Identity:
    """Identity of a membership: the rows, how they were selected and the cohort bounds."""
    present = [c for c in members if c in cohort.columns]
    row = selection_digest(cohort, present).first()
    bounds = {"from": config.cohort_start_time, "maturity": config.label_maturity_seconds}
    if kind["dataset_type"] == "serving_gate":
        bounds["to"] = config.cohort_end_time
    payload = {
        "selector": kind, "bounds": bounds, "only": {name: getattr(config, name) for name in OPTIONAL},
        "rows": {"count": row["row_count"], "digest": row["digest"], "columns": present},
    }
    digest = payload_digest(payload)
    return Identity(f"{kind['dataset_type']}_{digest[:16]}", HASH_PREFIX + digest, row["row_count"], row["digest"], payload)


def payload_digest(payload: dict) -> str:
    """Digest of a nested payload: one line per leaf, its path and its value as Python writes it, sorted."""
    lines, rest = [], [("", payload)]
    while rest:
        path, value = rest.pop()
        if isinstance(value, dict):
            rest += [(f"{path}/{name}", v) for name, v in value.items()]
        elif isinstance(value, list):
            rest += [(f"{path}/{i}", v) for i, v in enumerate(value)]
        else:
            lines.append(f"{path} {value!r}\n")
    return hashlib.sha256("".join(sorted(lines)).encode("utf-8")).hexdigest()


def checked_features(cohort: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fail on rows whose feature map has not exactly ``keys`` or whose null count differs from the stored one."""
    why = reasons([
        (F.col("features").isNull(), F.lit("no features")),
        (F.col("feature_count") != len(keys), F.lit("feature_count")),
        (F.size(unexpected_keys(F.col("features"), keys)) > 0, F.lit("unexpected keys")),
        (F.size(missing_keys(F.col("features"), keys)) > 0, F.lit("missing keys")),
        (null_count(F.transform_values("features", lambda _, v: F.when(is_finite(v), v))) != F.col("serving_missing_count"),
         F.lit("missing_count")),
    ])
    complaint = F.raise_error(F.concat(F.lit("bad dataset row "), F.col("sample_id"), F.lit(": "), F.array_join(why, ",")))
    return cohort.where(F.when(F.size(why) == 0, True).otherwise(complaint.cast("boolean")))


def dataset_frame(cohort: DataFrame, dataset_id: str, members: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """The stored form: dataset id, metadata and one double column per feature, in a fixed order."""
    rows = checked_features(cohort, keys)
    for name in ("simulation_run_id", "drift_segment"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    metadata = [m for m in members if m != "feature_count"]
    return widen(rows.select(F.lit(dataset_id).alias("dataset_id"), *metadata, "features"), keys)


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    target, system = _folder(spark, path)
    stream = system.create(target, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def log_build(builds: Table, spark: SparkSession, **event) -> None:
    schema = evidence_schemas()["dataset_build_events"]
    row = {f.name: event.get(f.name) for f in schema.fields}
    if row["error_message"]:
        row["error_message"] = row["error_message"][:4000]
    builds.append(spark.createDataFrame([tuple(row[f.name] for f in schema.fields)], schema).coalesce(1))


def build_states(events: DataFrame) -> DataFrame:
    """Current state per membership: once READY always READY, else the newest event."""
    ready = (F.col("status") == "READY").cast("int")
    return top_per_key(
        events, ["dataset_type", "manifest_hash"], [ready.desc(), F.col("recorded_at").desc(), F.col("status").desc()]
    )


def reusable(builds: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted memberships that already have a READY dataset."""
    keys = ["dataset_type", "manifest_hash"]
    return wanted.join(builds.where(F.col("status") == "READY").select(*keys).distinct(), keys, "left_semi")


def write_dataset(
    cohort: DataFrame, stats: DataFrame, config: CohortConfig, kind: dict, members: Sequence[str], keys: Sequence[str],
    root: str, builds: Table, now: float,
) -> Identity:
    """Persist a ready cohort as Parquet with manifest and statistics, or reuse the READY one.

    ``stats`` is the readiness row. The files are written under a temporary name, read back, compared
    with the membership and only then moved into place.
    """
    spark = cohort.sparkSession
    facts = stats.first().asDict()
    if not facts["ready"]:
        raise ValueError(f"the cohort misses: {[tuple(r) for r in facts['reasons']]}")
    identity = build_identity(cohort, members, kind, config)
    logged = builds.read(spark)
    if logged is not None:
        known = logged.where((F.col("manifest_hash") == identity.manifest_hash) & (F.col("status") == "READY"))
        if not known.isEmpty():
            return identity
    counts = {
        "eligible_sample_count": identity.row_count, "label_coverage": facts["label_coverage"],
        "labeled_sample_count": facts.get("labeled_sample_count", facts.get("labeled_decision_count")),
        "unlabeled_sample_count": facts.get("unlabeled_sample_count", facts.get("unlabeled_decision_count")),
        "fail_count": facts["fail_count"], "pass_count": facts["pass_count"],
    }
    common = {
        "dataset_id": identity.dataset_id, "dataset_type": kind["dataset_type"], "manifest_hash": identity.manifest_hash,
        "cohort_start_time": config.cohort_start_time, "cutoff_time": config.cutoff_time,
        "label_maturity_seconds": config.label_maturity_seconds, "recorded_at": now, **counts,
    }
    log_build(builds, spark, status="BUILDING", **common)
    final, staged = f"{root}/{identity.dataset_id}", f"{root}/_staged_{identity.dataset_id}"
    try:
        frame = dataset_frame(cohort, identity.dataset_id, members, keys)
        frame.write.mode("overwrite").parquet(f"{staged}/data")
        stored = spark.read.parquet(f"{staged}/data")
        if stored.columns != frame.columns:
            raise RuntimeError("stored columns differ from the dataset columns")
        back = selection_digest(stored.withColumn("feature_count", F.lit(len(keys))), identity.payload["rows"]["columns"]).first()
        if (back["row_count"], back["digest"]) != (identity.row_count, identity.rows_digest):
            raise RuntimeError("stored rows differ from the selected members")
        content = selection_digest(stored, stored.columns).first()["digest"]
        manifest = {
            "dataset_id": identity.dataset_id, "manifest_hash": identity.manifest_hash, "identity": identity.payload,
            "build_context": {**asdict(config), "cohort_end_time": config.cohort_end_time},
            "artifact": {"path": "data", "columns": frame.columns, "row_count": identity.row_count, "digest": content},
            "stats": counts,
        }
        write_text(spark, f"{staged}/manifest.json", json.dumps(manifest, sort_keys=True))
        write_text(spark, f"{staged}/stats.json", json.dumps(facts, sort_keys=True))
        target, system = _folder(spark, final)
        system.delete(target, True)
        if not system.rename(_folder(spark, staged)[0], target):
            raise RuntimeError(f"cannot move the dataset to {final}")
    except Exception as error:
        log_build(builds, spark, status="FAILED", error_message=str(error), **common)
        raise
    log_build(builds, spark, status="READY", artifact_uri=final, artifact_digest=content, **common)
    return identity


def row_violations(frame: DataFrame, width: int, key: Sequence[str]) -> DataFrame:
    """Violations of a stored dataset per rule, from one aggregate plus one over the key."""
    features = F.array(*[F.col(c) for c in model_columns(width)])
    nulls = F.size(F.filter(features, lambda v: v.isNull()))
    infinite = F.exists(features, lambda v: v.isNotNull() & ~is_finite(v))
    rules = [
        ("missing_count", nulls != F.col("serving_missing_count")), ("non_finite", infinite),
        *[(f"label_{i}", condition) for i, (condition, _) in enumerate(label_violations())],
    ]
    counted = frame.agg(*[F.count_if(condition).alias(name) for name, condition in rules])
    copies = frame.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).agg(F.count_if(F.col("_n") > 1).alias("duplicate_keys"))
    lines = F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n, _ in rules]))
    return counted.select(lines).unionByName(
        copies.select(F.lit("duplicate_keys").alias("rule"), F.col("duplicate_keys").alias("violations"))
    )


def verified_dataset(
    spark: SparkSession, root: str, builds: Table, dataset_id: str, kind: dict, keys: Sequence[str],
    key: Sequence[str] = ("sample_id",),
) -> DataFrame:
    """Load a READY dataset after checking catalog, manifest, content and row contracts."""
    entry = build_states(builds.read(spark)).where(F.col("dataset_id") == dataset_id).first()
    if entry is None or entry["status"] != "READY":
        raise RuntimeError(f"no READY dataset {dataset_id}")
    manifest = json.loads(read_text(spark, f"{root}/{dataset_id}/manifest.json"))
    frame = spark.read.parquet(f"{root}/{dataset_id}/data")
    content = selection_digest(frame, frame.columns).first()
    labeled = F.col("label_event_id").isNotNull()
    totals = frame.agg(
        F.count_if(labeled).alias("labeled"), F.count_if(F.col("actual_value") == FAIL).alias("fail"),
        F.count_if(F.col("actual_value") == PASS).alias("passed"),
        F.count_if(F.col("dataset_id") != dataset_id).alias("foreign"),
        ratio(F.count_if(labeled), F.count(F.lit(1))).alias("coverage"),
    ).first()
    digest = payload_digest(manifest["identity"])
    expected = {
        "manifest.dataset_id": (manifest["dataset_id"], dataset_id),
        "manifest.hash": (manifest["manifest_hash"], entry["manifest_hash"]),
        "identity.hash": (HASH_PREFIX + digest, entry["manifest_hash"]),
        "dataset_id": (f"{kind['dataset_type']}_{digest[:16]}", dataset_id),
        **{f"identity.{n}": (manifest["identity"]["selector"].get(n), v) for n, v in kind.items()},
        "columns": (manifest["artifact"]["columns"], frame.columns),
        "row_count": (manifest["artifact"]["row_count"], content["row_count"]),
        "content": (manifest["artifact"]["digest"], content["digest"]),
        "catalog.content": (entry["artifact_digest"], content["digest"]),
        "labeled": (entry["labeled_sample_count"], totals["labeled"]),
        "fail": (entry["fail_count"], totals["fail"]), "pass": (entry["pass_count"], totals["passed"]),
        "coverage": (round(entry["label_coverage"], 9), round(totals["coverage"] or 0.0, 9)),
        "foreign rows": (totals["foreign"], 0),
        "cutoff_time": (entry["cutoff_time"], manifest["build_context"]["cutoff_time"]),
    }
    wrong = [f"{name}: {found} is not {want}" for name, (found, want) in expected.items() if found != want]
    broken = row_violations(frame, len(keys), key).where(F.col("violations") > 0).collect()
    wrong += [f"{r['rule']}: {r['violations']} rows" for r in broken]
    if wrong:
        raise RuntimeError(f"dataset {dataset_id} failed verification: " + "; ".join(wrong))
    return frame
