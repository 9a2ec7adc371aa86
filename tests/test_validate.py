"""Accept and reject cases of the event contracts, with the reason expected."""

import json

import pytest
from pyspark.sql import functions as F

from proofline.operators import validate

SID = "secom-4081516"
KEYS = [f"f{i:03d}" for i in range(590)]
HASH = "sha256:v1:" + "07e9" * 16

FEATURE = {"event_id": "patch/77", "sample_id": SID, "event_time": 930.25, "feature_group": "late", "features": {"f411": -8.75, "f402": None}}
LABEL = {"label_event_id": "revision/9", "sample_id": SID, "label_revision": 6, "measured_at": 77000.5, "actual_value": 1, "actual_label": "fail"}
PREDICTION = {
    "prediction_id": "decision/31", "request_id": "call/12", "sample_id": SID, "serving_snapshot_id": "kept/5", "snapshot_version": 8,
    "feature_hash": HASH, "model_run_id": "forest/2", "predicted_at": 88100.0, "fail_probability": 0.41, "predicted_value": -1,
    "predicted_label": "pass", "threshold": 0.62, "missing_count": 13, "latency_ms": 21.25,
}
SNAPSHOT = {
    "serving_snapshot_id": "kept/5", "sample_id": SID, "source_event_count": 2, "snapshot_version": 2, "feature_hash": HASH,
    "snapshot_time": 640.0, "window_start": 512.0, "window_end": 640.0, "snapshot_status": "complete", "feature_count": 590,
    "missing_count": 1, "is_complete": True, "features": {k: (None if k == "f003" else 1.5) for k in KEYS},
}
DROP = object()


def changed(base, **changes):
    out = {**base, **changes}
    return json.dumps({k: v for k, v in out.items() if v is not DROP})


CASES = {
    "feature": (validate.feature_event_contract(created_at=5.0), [
        (changed(FEATURE), SID, []), (changed(FEATURE), None, []), (changed(FEATURE), "other", ["key"]),
        (None, SID, ["payload"]), ("nope", SID, ["payload"]), ("[1]", SID, ["payload"]), (" " + changed(FEATURE), SID, []),
        (changed(FEATURE, sample_id=5), SID, ["field:sample_id"]), (changed(FEATURE, event_id="  "), SID, ["field:event_id"]),
        (changed(FEATURE, event_time="12"), SID, ["field:event_time"]), (changed(FEATURE, event_time=DROP), SID, ["field:event_time"]),
        (changed(FEATURE).replace("930.25", "1e400"), SID, ["field:event_time"]), (changed(FEATURE, event_time=-0.1), SID, ["range:event_time"]),
        (changed(FEATURE, sample_id="secom-1"), None, ["pattern:sample_id"]), (changed(FEATURE, feature_group="other"), SID, ["enum:feature_group"]),
        (changed(FEATURE, features=[]), SID, ["field:features"]), (changed(FEATURE, features={}), SID, ["features_empty"]),
        (changed(FEATURE, features={"f590": 1}), SID, ["feature_key"]), (changed(FEATURE, features={"x": 1}), SID, ["feature_key"]),
        (changed(FEATURE, features={"f001": "1"}), SID, ["feature_value"]), (changed(FEATURE, features={"f001": True}), SID, ["feature_value"]),
        (changed(FEATURE).replace("-8.75", "1e400"), SID, ["feature_finite"]), (changed(FEATURE, simulation_run_id=3), SID, ["field:simulation_run_id"]),
        (changed(FEATURE, drift_segment=""), SID, []), (changed(FEATURE, created_at="x"), SID, ["field:created_at"]),
    ]),
    "label": (validate.label_contract(), [
        (changed(LABEL), SID, []), (changed(LABEL, actual_value=-1, actual_label="pass"), SID, []),
        (changed(LABEL, label_revision=1.5), SID, ["field:label_revision"]), (changed(LABEL, label_revision=3_000_000_000), SID, []),
        (changed(LABEL, label_revision=0), SID, ["range:label_revision"]), (changed(LABEL, actual_value=3_000_000_000), SID, ["field:actual_value"]),
        (changed(LABEL, actual_value=0), SID, ["enum:actual_value"]), (changed(LABEL, actual_label="pass"), SID, ["agree:actual_label"]),
        (changed(LABEL, measured_at=-1), SID, ["range:measured_at"]),
    ]),
    "prediction": (validate.prediction_contract(), [
        (changed(PREDICTION), SID, []), (changed(PREDICTION, model_name=" "), SID, ["field:model_name"]),
        (changed(PREDICTION, feature_hash="sha256:v1:x"), SID, ["pattern:feature_hash"]), (changed(PREDICTION, threshold=1.1), SID, ["range:threshold"]),
        (changed(PREDICTION, missing_count=591), SID, ["range:missing_count"]), (changed(PREDICTION, snapshot_version=0), SID, ["range:snapshot_version"]),
        (changed(PREDICTION, predicted_value=1), SID, ["agree:predicted_label"]), (changed(PREDICTION, latency_ms=-1), SID, ["range:latency_ms"]),
    ]),
    "snapshot": (validate.snapshot_contract(), [
        (changed(SNAPSHOT), SID, []), (changed(SNAPSHOT, missing_count=2), SID, ["missing_count"]),
        (changed(SNAPSHOT, snapshot_version=3), SID, ["version_count"]), (changed(SNAPSHOT, window_end=511.0), SID, ["window_order"]),
        (changed(SNAPSHOT, snapshot_status="partial"), SID, ["status"]), (changed(SNAPSHOT, snapshot_status="timed_out"), SID, ["enum:snapshot_status", "status"]),
        (changed(SNAPSHOT, is_complete="true"), SID, ["field:is_complete"]), (changed(SNAPSHOT, feature_count=589), SID, ["completeness"]),
        (changed(SNAPSHOT, features={"f000": 1.0}), SID, ["features_canonical", "missing_count"]),
    ]),
}


@pytest.mark.parametrize("name", CASES)
def test_contract(spark, name):
    contract, cases = CASES[name]
    df = spark.createDataFrame([(i, key, value) for i, (value, key, _) in enumerate(cases)], "i int, key string, value string")
    found = {r.i: r.reasons for r in validate.check(df, contract).collect()}
    for i, (value, _, reasons) in enumerate(cases):
        assert found[i] == reasons, (name, value)


def test_defaults_and_typed_columns(spark):
    df = spark.createDataFrame([(SID, changed(FEATURE))], "key string, value string")
    valid, rejected = validate.validate(df, validate.feature_event_contract(created_at=5.0))
    row = valid.first()
    assert (row.created_at, row.features) == (5.0, {"f411": -8.75, "f402": None})
    assert rejected.count() == 0
    slots = spark.createDataFrame([(SID, changed(PREDICTION))], "key string, value string")
    assert validate.validate(slots, validate.prediction_contract())[0].first().runtime_slot == "unknown"


def test_failfast(spark):
    df = spark.createDataFrame([(SID, "nope")], "key string, value string")
    with pytest.raises(Exception, match="invalid event"):
        validate.validate(df, validate.label_contract(), "failfast")[0].collect()
    with pytest.raises(ValueError):
        validate.validate(df, validate.label_contract(), "other")


def test_audit_treats_null_as_holding(spark):
    df = spark.range(3).select(F.when(F.col("id") > 0, F.col("id") - 1).alias("x"))
    assert validate.audit(df, {"positive": "x > 0"}).first().violations == 1


@pytest.mark.parametrize("table", sorted(validate.TABLE_CHECKS))
def test_table_checks_parse(spark, table):
    for text in validate.TABLE_CHECKS[table].values():
        F.expr(text.format(n=590))
