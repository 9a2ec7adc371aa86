"""Explicit schemas of the evidence tables. All times are epoch seconds as doubles."""

from pyspark.sql import types as T

FEATURES = T.MapType(T.StringType(), T.DoubleType(), True)


def _table(text: str) -> T.StructType:
    """Schema from ``name type`` pairs; a ``!`` after the type marks a required column."""
    fields = []
    for pair in text.replace("\n", " ").split(","):
        name, kind = pair.split()
        required = kind.endswith("!")
        kind = kind.rstrip("!")
        data_type = FEATURES if kind == "features" else T._parse_datatype_string(kind)
        fields.append(T.StructField(name, data_type, not required))
    return T.StructType(fields)


RAW_EVENT_DDL = "key string, value string"


def evidence_schemas() -> dict[str, T.StructType]:
    """Table name to schema. Needs an active session (types are parsed by Spark)."""
    return {name: _table(text) for name, text in _TABLES.items()}


_TABLES = {
    "feature_events": """event_id string!, sample_id string!, event_time double!, feature_group string!,
        features features!, simulation_run_id string, drift_segment string, created_at double!""",
    "serving_feature_snapshots": """serving_snapshot_id string!, sample_id string!, snapshot_version bigint!,
        feature_hash string!, snapshot_time double!, window_start double!, window_end double!,
        snapshot_status string!, feature_count int!, missing_count int!, is_complete boolean!,
        features features!, simulation_run_id string, drift_segment string, available_at double!""",
    "offline_feature_snapshots": """offline_snapshot_id string!, sample_id string!, build_cutoff_time double!,
        feature_count int!, missing_count int!, is_complete boolean!, features features!,
        source_event_count bigint!, max_event_time double, simulation_run_id string, drift_segment string,
        created_at double!""",
    "offline_prediction_logs": """offline_prediction_id string!, offline_snapshot_id string!, sample_id string!,
        build_cutoff_time double!, model_run_id string!, predicted_at double!, fail_probability double!,
        predicted_value int!, predicted_label string!, threshold double!, missing_count int!,
        latency_ms double!, created_at double!""",
    "label_events": """label_event_id string!, sample_id string!, label_revision bigint!, measured_at double!,
        available_at double!, actual_value int!, actual_label string!""",
    "prediction_logs": """prediction_id string!, request_id string!, sample_id string!,
        serving_snapshot_id string!, snapshot_version bigint!, feature_hash string!, model_run_id string!,
        model_name string, model_version string, model_alias string, model_uri string, runtime_slot string!,
        predicted_at double!, fail_probability double!, predicted_value int!, predicted_label string!,
        threshold double!, missing_count int!, latency_ms double!""",
    "model_metrics": """evaluation_id string!, computed_at double!, model_run_id string!, threshold double,
        window_type string!, window_size bigint, window_start double, window_end double,
        metric_name string!, metric_value double, n_samples bigint!, n_fail_samples bigint!,
        positive_class int!, created_at double!""",
    "prediction_window_metrics": """evaluation_id string!, computed_at double!, model_run_id string!,
        threshold double, window_type string!, window_size bigint, window_start double, window_end double,
        metric_name string!, metric_value double, n_predictions bigint!, created_at double!""",
    "drift_reference_baselines": """baseline_id string!, baseline_name string!, baseline_type string!,
        source_table string!, source_start double!, source_end double!, model_name string,
        model_version string, model_alias string, model_run_id string!, threshold double!,
        feature_count int!, sample_count bigint!, status string!, notes string, created_by string,
        created_at double!""",
    "drift_metrics": """evaluation_id string!, reference_baseline_id string, computed_at double!,
        window_type string!, window_minutes double!, baseline_start double!, baseline_end double!,
        current_start double!, current_end double!, model_name string, model_version string,
        model_alias string, model_run_id string!, threshold double!, metric_family string!,
        metric_name string!, feature_name string, metric_value double, baseline_value double,
        current_value double, delta_value double, baseline_samples bigint!, current_samples bigint!,
        created_at double!""",
    "dataset_build_events": """dataset_id string!, dataset_type string!, manifest_hash string!, status string!,
        recorded_at double!, cohort_start_time double, cutoff_time double, label_maturity_seconds double,
        eligible_sample_count bigint, labeled_sample_count bigint, unlabeled_sample_count bigint,
        label_coverage double, fail_count bigint, pass_count bigint, artifact_uri string,
        artifact_digest string, error_message string""",
    "model_deployment_requests": """request_id string!, model_name string!, target_alias string!,
        source_version string!, source_run_id string!, eval_type string!, eval_status string!,
        approval_status string!, rollout_status string!, notes string, requested_at double!,
        updated_at double!""",
}
