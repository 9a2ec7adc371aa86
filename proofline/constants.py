"""They must equal what producers and stored evidence use."""

# Feature space.
FEATURE_COUNT = 590
FEATURE_KEY_PATTERN = r"^f\d{3}$"
SAMPLE_ID_PATTERN = r"^secom-\d{7}$"
FEATURE_GROUPS = ("early", "middle", "late")
FEATURE_GROUP_STARTS = {"early": 0, "middle": 197, "late": 394}

# Feature vector hash.
HASH_DOMAIN = b"secom-feature-vector:v1\x00"
HASH_PREFIX = "sha256:v1:"
HASH_PATTERN = r"^sha256:v1:[0-9a-f]{64}$"

# Classes.
FAIL = 1
PASS = -1

# Statuses.
STREAM_STATUSES = ("partial", "complete")
STORED_STATUSES = ("partial", "timed_out", "complete", "late_update")
EVAL_STATUSES = ("passed", "failed", "insufficient_data", "skipped", "unknown")
APPROVAL_STATUSES = ("pending", "approved", "rejected")
ROLLOUT_STATUSES = (
    "not_started", "promoted", "canary_reloading", "canary_ready", "release_reloading",
    "deployed", "failed", "rolled_back", "superseded",
)
RELOAD_STATUSES = ("started", "succeeded", "failed")
QUALITY_STATUSES = (
    "ok", "insufficient_decisions", "insufficient_label_coverage",
    "insufficient_fail_labels", "insufficient_pass_labels",
)

# Dataset identities.
TRAINING_IDENTITY = {
    "dataset_type": "training",
    "dataset_schema_version": "training_source_dataset.v1",
    "selector_version": "sample_first_complete_point_in_time.v1",
}
GATE_IDENTITY = {
    "dataset_type": "serving_gate",
    "dataset_schema_version": "serving_gate_dataset.v1",
    "selector_version": "first_release_decision_per_sample_snapshot.v1",
}

# Drift score floor and probability floor.
STD_FLOOR = 1e-9
PSI_EPSILON = 1e-6


def feature_key(index: int) -> str:
    return f"f{index:03d}"


def feature_keys(count: int = FEATURE_COUNT) -> list[str]:
    return [feature_key(i) for i in range(count)]


def model_columns(count: int = FEATURE_COUNT) -> list[str]:
    return [f"feature_{i:03d}" for i in range(count)]
