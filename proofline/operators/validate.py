"""Contracts for raw events and for stored tables.

An event contract parses each JSON value once into a variant, checks strict types and rules, and
returns typed columns with the list of broken rules. It is a projection: no shuffle, no Python.
"""

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from proofline import constants as K
from proofline.functions.scalars import class_name, is_finite, reasons

Rule = tuple[str, Column]


@dataclass(frozen=True)
class Field:
    """One JSON field. ``kind`` is text, number, long, int, boolean or object."""

    name: str
    kind: str
    required: bool = True
    blank_allowed: bool = False


@dataclass(frozen=True)
class Contract:
    """Typed fields plus ``rules``, named conditions that must hold (null counts as holding)."""

    fields: Sequence[Field]
    rules: Sequence[Callable[[], Rule]] = ()
    features: str | None = None
    feature_count: int = K.FEATURE_COUNT
    defaults: dict[str, Callable[[], Column]] = field(default_factory=dict)


SQL_TYPES = {"text": "string", "number": "double", "long": "bigint", "int": "int", "boolean": "boolean"}


def _typed(kind: str, json_type: Column, variant: Column, path: str, blank_allowed: bool) -> tuple[Column, Column]:
    """(value, is it of the right strict type)."""
    if kind == "text":
        text = F.try_variant_get(variant, path, "string")
        return text, (json_type == "STRING") & (F.lit(True) if blank_allowed else text.rlike(r"\S"))
    if kind == "number":
        number = F.try_variant_get(variant, path, "double")
        return number, json_type.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & is_finite(number)
    if kind in ("long", "int"):
        number = F.try_variant_get(variant, path, SQL_TYPES[kind])
        return number, (json_type == "BIGINT") & number.isNotNull()
    if kind == "boolean":
        return F.try_variant_get(variant, path, "boolean"), json_type == "BOOLEAN"
    if kind == "object":
        # The schema text of a whole feature map would be long; only an object converts to a map.
        members = F.try_variant_get(variant, path, "map<string,variant>")
        return members, members.isNotNull()
    raise ValueError(f"unknown kind: {kind}")


def check(df: DataFrame, contract: Contract) -> DataFrame:
    """Add the typed fields and ``reasons`` to raw ``key`` / ``value`` rows."""
    parsed = df.withColumn("_v", F.try_parse_json("value"))
    # Valid JSON that begins with a brace is an object.
    is_object = F.col("_v").isNotNull() & F.col("value").rlike(r"^\s*\{")
    parsed = parsed.withColumn("_ok", F.coalesce(is_object, F.lit(False)))
    columns, problems = {}, [("payload", ~F.col("_ok"))]
    for item in contract.fields:
        path = f"$.{item.name}"
        json_type = F.schema_of_variant(F.try_variant_get("_v", path, "variant"))
        value, fits = _typed(item.kind, json_type, F.col("_v"), path, item.blank_allowed)
        absent = json_type.isNull() | (json_type == "VOID")
        good = F.coalesce(fits, F.lit(False)) if item.required else (absent | F.coalesce(fits, F.lit(False)))
        columns[item.name] = F.when(F.coalesce(fits, F.lit(False)), value)
        problems.append((f"field:{item.name}", F.col("_ok") & ~good))
    rows = parsed.select(*df.columns, "_ok", *[c.alias(f"_bad_{i}") for i, (_, c) in enumerate(problems)],
                         *[c.alias(n) for n, c in columns.items()])
    if contract.features is not None:
        rows = _with_features(rows, contract.features)
    later = [rule() for rule in contract.rules]
    broken = [(F.col(f"_bad_{i}"), F.lit(name)) for i, (name, _) in enumerate(problems)]
    broken += [(F.col("_ok") & ~F.coalesce(holds, F.lit(True)), F.lit(name)) for name, holds in later]
    result = rows.withColumn("reasons", reasons(broken))
    for name, default in contract.defaults.items():
        result = result.withColumn(name, F.coalesce(name, default()))
    # Emitting the checked fields through a generator keeps later filters on them from being pushed into
    # the parsing expressions, which would repeat the parsing for every reference.
    return result.select(*df.columns, F.inline(F.array(F.struct("reasons", *columns))))


def _with_features(rows: DataFrame, name: str) -> DataFrame:
    types = F.transform_values(name, lambda _, v: F.coalesce(F.schema_of_variant(v), F.lit("VOID")))
    numbers = F.transform_values(name, lambda _, v: F.try_variant_get(v, "$", "double"))
    return rows.withColumn("_types", types).withColumn(name, numbers)


def validate(df: DataFrame, contract: Contract, mode: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with reasons). ``failfast`` fails the job on the first bad row."""
    checked = check(df, contract)
    if mode == "failfast":
        complaint = F.raise_error(F.concat(F.lit("invalid event: "), F.array_join("reasons", ","))).cast("boolean")
        valid = checked.where(F.when(F.size("reasons") == 0, True).otherwise(complaint))
    elif mode == "quarantine":
        valid = checked.where(F.size("reasons") == 0)
    else:
        raise ValueError(f"unknown mode: {mode}")
    raw = [c for c in df.columns if c != "value"]
    return valid.drop("value", "reasons", *raw), checked.where(F.size("reasons") > 0).select(*df.columns, "reasons")


def _matches(name: str, pattern: str):
    return lambda: (f"pattern:{name}", F.col(name).rlike(pattern))


def _same_key():
    return "key", F.col("key").isNull() | (F.col("key") == F.col("sample_id"))


def _at_least(name: str, floor):
    return lambda: (f"range:{name}", F.col(name) >= floor)


def _between(name: str, low, high):
    return lambda: (f"range:{name}", F.col(name).between(low, high))


def _one_of(name: str, values: Sequence):
    return lambda: (f"enum:{name}", F.col(name).isin(*values))


def _label_agrees(value: str, label: str):
    return lambda: (f"agree:{label}", ~F.col(value).isin(K.FAIL, K.PASS) | (F.col(label) == class_name(F.col(value))))


def _feature_rules(count: int) -> list[Callable[[], Rule]]:
    def keys():
        return "feature_key", F.forall(
            F.map_keys("features"),
            lambda k: k.rlike(K.FEATURE_KEY_PATTERN) & (F.coalesce(F.substring(k, 2, 3).try_cast("int"), F.lit(count)) < count),
        )

    def values():
        return "feature_value", F.forall(
            F.map_values("_types"), lambda t: (t == "VOID") | t.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        )

    def finite():
        return "feature_finite", F.forall(F.map_values("features"), lambda v: v.isNull() | is_finite(v))

    return [keys, values, finite]


def feature_event_contract(
    sample_pattern: str = K.SAMPLE_ID_PATTERN, groups: Sequence[str] = K.FEATURE_GROUPS,
    feature_count: int = K.FEATURE_COUNT, created_at: float | None = None,
) -> Contract:
    def some():
        return "features_empty", F.size("features") > 0

    return Contract(
        fields=[
            Field("event_id", "text"), Field("sample_id", "text"), Field("event_time", "number"),
            Field("feature_group", "text"), Field("features", "object"),
            Field("simulation_run_id", "text", False, True), Field("drift_segment", "text", False, True),
            Field("created_at", "number", False),
        ],
        rules=[
            _matches("sample_id", sample_pattern), _same_key, _at_least("event_time", 0.0),
            _one_of("feature_group", groups), some, *_feature_rules(feature_count),
        ],
        features="features", feature_count=feature_count,
        defaults={} if created_at is None else {"created_at": lambda: F.lit(float(created_at))},
    )


def label_contract(sample_pattern: str = K.SAMPLE_ID_PATTERN) -> Contract:
    return Contract(
        fields=[
            Field("label_event_id", "text"), Field("sample_id", "text"), Field("label_revision", "long"),
            Field("measured_at", "number"), Field("actual_value", "int"), Field("actual_label", "text"),
        ],
        rules=[
            _matches("sample_id", sample_pattern), _same_key, _at_least("label_revision", 1),
            _at_least("measured_at", 0.0), _one_of("actual_value", (K.PASS, K.FAIL)),
            _label_agrees("actual_value", "actual_label"),
        ],
    )


def prediction_contract(
    sample_pattern: str = K.SAMPLE_ID_PATTERN, hash_pattern: str = K.HASH_PATTERN, feature_count: int = K.FEATURE_COUNT,
) -> Contract:
    optional = ("model_name", "model_version", "model_alias", "model_uri", "runtime_slot")
    return Contract(
        fields=[
            Field("prediction_id", "text"), Field("request_id", "text"), Field("sample_id", "text"),
            Field("serving_snapshot_id", "text"), Field("snapshot_version", "long"), Field("feature_hash", "text"),
            Field("model_run_id", "text"), *[Field(n, "text", False) for n in optional],
            Field("predicted_at", "number"), Field("fail_probability", "number"), Field("predicted_value", "int"),
            Field("predicted_label", "text"), Field("threshold", "number"), Field("missing_count", "int"),
            Field("latency_ms", "number"),
        ],
        rules=[
            _matches("sample_id", sample_pattern), _same_key, _matches("feature_hash", hash_pattern),
            _at_least("snapshot_version", 1), _at_least("predicted_at", 0.0), _between("fail_probability", 0.0, 1.0),
            _one_of("predicted_value", (K.PASS, K.FAIL)), _label_agrees("predicted_value", "predicted_label"),
            _between("threshold", 0.0, 1.0), _between("missing_count", 0, feature_count), _at_least("latency_ms", 0.0),
        ],
        defaults={"runtime_slot": lambda: F.lit("unknown")},
    )


def snapshot_contract(
    sample_pattern: str = K.SAMPLE_ID_PATTERN, hash_pattern: str = K.HASH_PATTERN, feature_count: int = K.FEATURE_COUNT,
) -> Contract:
    def window():
        return "window_order", F.col("window_end") >= F.col("window_start")

    def version():
        return "version_count", F.col("snapshot_version") == F.col("source_event_count")

    def completeness():
        return "completeness", F.col("is_complete") == (F.col("feature_count") == feature_count)

    def status():
        expected = F.when(F.col("is_complete"), "complete").when(~F.col("is_complete"), "partial")
        return "status", F.col("snapshot_status") == expected

    def full():
        return "features_canonical", F.size("features") == feature_count

    def nulls():
        observed = F.size(F.filter(F.map_values("_types"), lambda t: t == "VOID"))
        return "missing_count", F.col("missing_count") == observed

    return Contract(
        fields=[
            Field("serving_snapshot_id", "text"), Field("sample_id", "text"), Field("source_event_count", "long"),
            Field("snapshot_version", "long"), Field("feature_hash", "text"), Field("snapshot_time", "number"),
            Field("window_start", "number"), Field("window_end", "number"), Field("snapshot_status", "text"),
            Field("feature_count", "int"), Field("missing_count", "int"), Field("is_complete", "boolean"),
            Field("features", "object"), Field("simulation_run_id", "text", False, True),
            Field("drift_segment", "text", False, True),
        ],
        rules=[
            _matches("sample_id", sample_pattern), _same_key, _at_least("source_event_count", 1),
            _at_least("snapshot_version", 1), version, _matches("feature_hash", hash_pattern),
            _at_least("snapshot_time", 0.0), _at_least("window_start", 0.0), _at_least("window_end", 0.0), window,
            _one_of("snapshot_status", K.STREAM_STATUSES), _between("feature_count", 0, feature_count),
            _between("missing_count", 0, feature_count), completeness, status, full, *_feature_rules(feature_count),
            nulls,
        ],
        features="features", feature_count=feature_count,
    )


def scoring_input_violations(df: DataFrame, feature_count: int, sample_pattern: str = K.SAMPLE_ID_PATTERN) -> DataFrame:
    """Scoring requests: an id of the right form and exactly ``feature_count`` nullable finite numbers."""
    return df.withColumn("violations", reasons([
        (~F.coalesce(F.col("sample_id").rlike(sample_pattern), F.lit(False)), F.lit("sample_id")),
        (F.coalesce(F.size("values"), F.lit(-1)) != feature_count, F.lit("width")),
        (F.exists("values", lambda v: v.isNotNull() & ~is_finite(v)), F.lit("finite")),
    ]))


def audit(df: DataFrame, checks: dict[str, str], **values) -> DataFrame:
    """Violations per table check, in one pass. As in SQL, a check that is null is not violated."""
    counted = df.agg(*[
        F.count_if(~F.expr(text.format(**values))).alias(f"_c{i}") for i, text in enumerate(checks.values())
    ])
    lines = [
        F.struct(F.lit(name).alias("rule"), F.col(f"_c{i}").alias("violations")) for i, name in enumerate(checks)
    ]
    return counted.select(F.inline(F.array(*lines)))


def table_rules(table: str, schema, **values) -> dict[str, Column]:
    """Rule name to the condition under which a row of the evidence table breaks it: its checks, and nulls in required columns.

    As in SQL, a check that is null is not broken.
    """
    checks = {name: ~F.coalesce(F.expr(text.format(**values)), F.lit(True)) for name, text in TABLE_CHECKS.get(table, {}).items()}
    return checks | {f"null:{f.name}": F.col(f.name).isNull() for f in schema.fields if not f.nullable}


class Counted:
    """A table with its rules counted by whatever job reads it next, such as the one that writes it: no second scan."""

    def __init__(self, df: DataFrame, table: str, rules: dict[str, Column]) -> None:
        self.table, self.rules, self.seen = table, list(rules), Observation(f"rules of {table}")
        counters = [F.count_if(broken).alias(f"_r{i}") for i, broken in enumerate(rules.values())]
        self.rows = df.observe(self.seen, F.count(F.lit(1)).alias("_rows"), *counters)
        self.session = df.sparkSession

    def report(self) -> DataFrame:
        """One row per rule: table, rule, rows, violations. Waits for the job that reads ``rows``."""
        found = self.seen.get
        lines = [(self.table, rule, found["_rows"], found[f"_r{i}"]) for i, rule in enumerate(self.rules)]
        return self.session.createDataFrame(lines, "table_name string, rule string, rows_ bigint, violations bigint")


def _listed(values: Sequence[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


# Table checks: rule name to the condition every row must meet. ``{n}`` is the number of features.
TABLE_CHECKS = {
    "feature_events": {
        "event_time": "event_time >= 0", "feature_group": "length(feature_group) > 0",
    },
    "serving_feature_snapshots": {
        "version": "snapshot_version > 0", "times": "snapshot_time >= 0 and window_start >= 0 and window_end >= window_start",
        "available_at": "available_at >= 0", "status": f"snapshot_status in ({_listed(K.STORED_STATUSES)})",
        "counts": "feature_count between 0 and {n} and missing_count between 0 and {n}",
        "complete": "not is_complete or (snapshot_status = 'complete' and feature_count = {n})",
    },
    "offline_feature_snapshots": {
        "times": "build_cutoff_time >= 0 and (max_event_time is null or max_event_time <= build_cutoff_time)",
        "counts": "feature_count between 0 and {n} and missing_count between 0 and {n} and source_event_count >= 0",
        "complete": "not is_complete or feature_count = {n}",
    },
    "label_events": {
        "revision": "label_revision > 0", "times": "measured_at >= 0 and available_at >= 0",
        "value": "actual_value in (-1, 1)", "label": "actual_label in ('pass', 'fail')",
    },
    "prediction_logs": {
        "version": "snapshot_version > 0", "time": "predicted_at >= 0", "probability": "fail_probability between 0 and 1",
        "threshold": "threshold between 0 and 1", "value": "predicted_value in (-1, 1)",
        "label": "predicted_label in ('pass', 'fail')", "missing": "missing_count between 0 and {n}",
        "latency": "latency_ms >= 0",
    },
    "live_model_quality_evaluations": {
        "threshold": "threshold between 0 and 1",
        "counts": "n_samples <= n_decisions and n_pass_samples + n_fail_samples = n_samples",
        "coverage": "label_coverage between 0 and 1",
        "status": f"evaluation_status in ({_listed(K.QUALITY_STATUSES)})",
        "ranges": "accuracy between 0 and 1 and fail_precision between 0 and 1 and fail_recall between 0 and 1 "
                  "and fail_f1 between 0 and 1 and fail_average_precision between 0 and 1",
        "confusion_total": "true_negative + false_positive + false_negative + true_positive = n_samples",
        "confusion_classes": "true_positive + false_negative = n_fail_samples and true_negative + false_positive = n_pass_samples",
    },
    "drift_reference_baselines": {
        "times": "source_start >= 0 and source_end >= source_start", "threshold": "threshold between 0 and 1",
        "counts": "feature_count >= 0 and sample_count >= 0", "status": "status in ('active', 'retired')",
    },
    "drift_reference_stats": {
        "family": "metric_family in ('output', 'input', 'feature')",
        "counts": "sample_count >= 0 and coalesce(non_null_count, 0) >= 0 and coalesce(null_count, 0) >= 0",
    },
    "model_deployment_requests": {
        "eval_status": f"eval_status in ({_listed(K.EVAL_STATUSES)})",
        "approval_status": f"approval_status in ({_listed(K.APPROVAL_STATUSES)})",
        "rollout_status": f"rollout_status in ({_listed(K.ROLLOUT_STATUSES)})",
    },
    "model_runtime_reload_events": {"reload_status": f"reload_status in ({_listed(K.RELOAD_STATUSES)})"},
}


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def orphans(df: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose foreign key has no parent."""
    return df.join(parent.select(*keys), list(keys), "left_anti")
