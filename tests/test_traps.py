"""One small fixture per semantic trap."""

import math

import pytest
from pyspark.sql import functions as F

from proofline.functions import scalars as sc
from proofline.functions.features import lengthen, with_vector_hash
from proofline.operators import bins, drift, latest, quality, stats
from proofline.operators.assemble import assemble_replay, reconstruct
from proofline.plans import cohorts, maturity
from proofline.sources import sinks

KEYS = ["f000", "f001"]
SNAPSHOTS = """serving_snapshot_id string, sample_id string, snapshot_version bigint, feature_hash string, snapshot_time double,
    window_start double, window_end double, feature_count int, missing_count int, snapshot_status string, is_complete boolean,
    available_at double, features map<string,double>"""
LABELS = "label_event_id string, sample_id string, label_revision bigint, measured_at double, available_at double, actual_value int, actual_label string"
SCORES = "model_run_id string, threshold double, fail_probability double, predicted_value int, actual_value int"


def snapshot(sample, version, at, complete=True):
    return (f"{sample}:{version}", sample, version, "h", at, 0.0, at, 2 if complete else 1, 0, "complete" if complete else "partial",
            complete, at, {"f000": 1.0, "f001": 2.0})


def cohort(spark, snapshots, labels, start=10.0, cutoff=30.0, maturity_seconds=10.0):
    config = cohorts.CohortConfig(start, cutoff, maturity_seconds)
    return cohorts.training_cohort(
        spark.createDataFrame(snapshots, SNAPSHOTS), spark.createDataFrame(labels, LABELS), config
    ).collect()


def test_rank_runs_before_the_time_filter(spark):
    assert cohort(spark, [snapshot("a", 1, 5.0), snapshot("a", 2, 15.0)], []) == []


def test_cohort_is_half_open(spark):
    rows = cohort(spark, [snapshot("in", 1, 10.0), snapshot("out", 1, 20.0)], [])
    assert [r.sample_id for r in rows] == ["in"]


def test_label_is_what_was_known_at_the_cutoff(spark):
    labels = [("l1", "a", 1, 1.0, 30.0, 1, "fail"), ("l2", "a", 2, 1.0, 31.0, -1, "pass")]
    assert [r.label_event_id for r in cohort(spark, [snapshot("a", 1, 12.0)], labels)] == ["l1"]


def test_config_is_checked():
    with pytest.raises(ValueError):
        cohorts.CohortConfig(10.0, 5.0).validate()
    with pytest.raises(ValueError):
        cohorts.CohortConfig(0.0, math.inf).validate()


PATCH = "event_id string, sample_id string, event_time double, created_at double, arrival bigint, features map<string,double>"


def test_null_overwrites_and_counts_as_observed(spark):
    rows = [("e1", "a", 1.0, 1.0, 1, {"f000": 1.2}), ("e2", "a", 2.0, 2.0, 2, {"f000": None})]
    last = assemble_replay(spark.createDataFrame(rows, PATCH), KEYS).where("snapshot_version = 2").first()
    assert (last.features["f000"], last.feature_count, last.missing_count, last.is_complete) == (None, 1, 2, False)


def test_arrival_order_and_event_order_differ(spark):
    rows = [("e1", "a", 10.0, 1.0, 1, {"f000": 1.0}), ("e2", "a", 8.0, 2.0, 2, {"f000": 2.0})]
    df = spark.createDataFrame(rows, PATCH)
    last = assemble_replay(df, KEYS).where("snapshot_version = 2").first()
    assert (last.features["f000"], last.serving_snapshot_id, last.window_start, last.window_end) == (2.0, "state:a:10000:2", 8.0, 10.0)
    assert reconstruct(df, KEYS, 20.0).first().features["f000"] == 1.0
    assert reconstruct(df, KEYS, 9.0).first().features["f000"] == 2.0


def test_reconstruction_keeps_samples_with_empty_patches_and_rejects_unknown_keys(spark):
    df = spark.createDataFrame([("e", "a", 1.0, 1.0, 1, {})], PATCH)
    row = reconstruct(df, KEYS, 5.0).first()
    assert (row.feature_count, row.missing_count, row.source_event_count) == (0, 2, 1)
    with pytest.raises(Exception, match="unexpected feature key"):
        reconstruct(spark.createDataFrame([("e", "a", 1.0, 1.0, 1, {"zzz": 1.0})], PATCH), KEYS, 5.0).collect()


PREDICTIONS = """prediction_id string, model_run_id string, threshold double, predicted_at double, fail_probability double,
    predicted_value int, missing_count int, features map<string,double>"""


def predictions(spark, times, value=3.0):
    rows = [(f"p{i}", "m", 0.5, float(t), 0.4, -1, 1, {"f000": value, "f001": None}) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, PREDICTIONS)


def test_empty_baseline_side(spark):
    found = drift.recent_drift(predictions(spark, [1000.0, 1001.0]), None, 5, 3, 1, 1).collect()
    by_name = {r.metric_name: r for r in found}
    assert (by_name["prediction_count"].baseline_value, by_name["prediction_count"].current_value) == (0.0, 2.0)
    assert by_name["fail_probability_avg"].baseline_value is None
    assert by_name["fail_probability_avg"].metric_value == 0.4
    assert {r.metric_family for r in found} == {"output", "input"}


def test_drift_windows_are_open_below_and_closed_above(spark):
    found = drift.recent_drift(predictions(spark, [400.0, 700.0, 701.0, 1000.0]), None, 5, 3, 1, 1)
    row = found.where("metric_name = 'prediction_count'").first()
    assert (row.baseline_value, row.current_value) == (1.0, 2.0)
    assert (row.baseline_start, row.current_start, row.current_end) == (400.0, 700.0, 1000.0)


def test_newest_window_counts_resolved_predictions_only(spark):
    rows = predictions(spark, [100.0, 400.0, 450.0, 90000.0, 90001.0]).drop("features")
    ids = F.struct("prediction_id")["prediction_id"]
    rows = rows.withColumns({"serving_snapshot_id": ids, "sample_id": F.lit("s"), "snapshot_version": F.lit(1), "feature_hash": F.lit("h")})
    held = rows.where("predicted_at < 1000").select("serving_snapshot_id", "sample_id", "snapshot_version", "feature_hash").withColumn(
        "features", F.create_map(F.lit("f000"), F.lit(1.0)))
    row = drift.recent_drift(rows, held, 5, 3, 1, 1).where("metric_name = 'prediction_count'").first()
    assert (row.current_end, row.baseline_value, row.current_value) == (450.0, 1.0, 2.0)


def test_constant_features_have_a_floor_and_all_null_features_do_not_fail(spark):
    found = drift.recent_drift(predictions(spark, [600.0, 650.0, 900.0, 1000.0]), None, 5, 3, 1, 1).where("metric_family = 'feature'").collect()
    scores = {(r.metric_name, r.feature_name): r.metric_value for r in found}
    assert scores[("feature_mean_standardized_delta", "f000")] == 0.0
    assert ("feature_mean_standardized_delta", "f001") not in scores
    assert scores[("feature_missing_ratio_abs_delta", "f001")] == 0.0


def test_tied_scores_form_one_step(spark):
    df = spark.createDataFrame([("m", 0.5, 0.5, 1, y) for y in (1, -1, 1)], SCORES)
    assert quality.average_precision(df, ["model_run_id"]).first().average_precision == pytest.approx(2 / 3)


def test_no_positive_label(spark):
    row = quality.quality(spark.createDataFrame([("m", 0.5, 0.7, -1, -1)], SCORES), ["model_run_id"]).first()
    assert row.pr_auc is None
    assert (row.fail_precision, row.fail_recall, row.fail_f1, row.accuracy, row.balanced_accuracy) == (0.0, 0.0, 0.0, 1.0, 1.0)


def test_half_right_everywhere(spark):
    rows = [("m", 0.5, p, 1 if p >= 0.5 else -1, y) for p, y in zip([0.1, 0.8, 0.9, 0.2], [-1, -1, 1, 1])]
    row = quality.quality(spark.createDataFrame(rows, SCORES), ["model_run_id"]).first()
    assert (row.true_negative, row.false_positive, row.false_negative, row.true_positive) == (1, 1, 1, 1)
    assert (row.accuracy, row.fail_precision, row.fail_recall, row.fail_f1) == (0.5, 0.5, 0.5, 0.5)
    assert row.pr_auc == pytest.approx(5 / 6)


def long(spark, values):
    return spark.createDataFrame([("f000", v) for v in values], "feature_name string, value double")


def test_constant_reference_has_three_buckets(spark):
    reference = bins.reference_bins(long(spark, [3.0] * 5), ["feature_name"])
    row = reference.first()
    assert row.bin_edges == [math.nextafter(3.0, -math.inf), 3.0]
    assert (row.binning, row.bin_counts) == ("constant_baseline_anchor", [0, 5, 0])
    now = bins.bucket_counts(long(spark, [2.9, 3.0, 3.1]), reference, ["feature_name"]).first()
    assert now.bin_counts == [1, 1, 1]


def test_value_on_an_edge_falls_below_it(spark):
    edges = spark.createDataFrame([("f000", [1.0, 2.0])], "feature_name string, bin_edges array<double>")
    assert bins.bucket_counts(long(spark, [1.0, 2.0, 2.5]), edges, ["feature_name"]).first().bin_counts == [1, 1, 1]


def test_stability_index_by_hand(spark):
    e, a = [0.5, 0.5, 0.0], [0.25, 0.75, 0.0]
    df = spark.createDataFrame([(e, a, [0.5, 0.5])], "e array<double>, a array<double>, short array<double>")
    row = df.select(bins.stability_index(F.col("e"), F.col("a")).alias("psi"), bins.stability_index(F.col("e"), F.col("short")).alias("none")).first()
    assert row.psi == pytest.approx(-0.25 * math.log(0.5) + 0.25 * math.log(1.5))
    assert row.none is None


def test_all_null_feature_has_no_statistics(spark):
    rows = spark.createDataFrame([(0, "f000", None)], "feature_index int, feature_name string, value double")
    row = stats.feature_stats(rows, []).first()
    assert (row.samples, row.null_count, row.non_null, row.mean, row.std) == (1, 1, 0, None, None)


def test_replayed_label(spark):
    stored = spark.createDataFrame([("l1", "a", 1, 5.0, 1, "fail", 1)], "id string, sample_id string, rev long, measured_at double, v int, name string, arrival long")
    same = stored.withColumn("measured_at", F.lit(9.0))
    other = stored.withColumn("v", F.lit(-1))
    payload = ["sample_id", "rev", "v", "name"]
    assert sinks.replay_conflicts(same, stored, "id", payload, ["arrival"]).count() == 0
    assert sinks.new_rows(same, stored, ["id"], ["arrival"]).count() == 0
    assert sinks.replay_conflicts(other, stored, "id", payload, ["arrival"]).count() == 1


def test_open_cohort_has_no_size(spark):
    snaps = spark.createDataFrame([snapshot("a", 1, 100.0)], SNAPSHOTS)
    none = spark.createDataFrame([], "prediction_id string, sample_id string, model_run_id string, threshold double, serving_snapshot_id string, snapshot_version bigint, predicted_at double, runtime_slot string")
    labels = spark.createDataFrame([("l1", "a", 1, 1.0, 130.0, 1, "fail")], LABELS)
    row = maturity.label_maturity(snaps, none, labels, 200.0).where("age = 1").first()
    assert (row.cohort_start, row.cohort_status, row.cohort_size, row.labeled_count, row.model_run_count) == (60.0, "open", None, None, None)
    row = maturity.label_maturity(snaps, none, labels, 720.0).where("age = 1").first()
    assert (row.cohort_status, row.cohort_size, row.labeled_count, row.label_coverage) == ("observing", 1, 1, 1.0)


def test_non_finite_policies(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "v double")
    assert [r[0] for r in df.select(sc.clean_feature(F.col("v"))).collect()] == [None, None, 1.0]
    assert df.select(sc.clean_feature(F.col("v"), "allow")).collect()[1][0] == float("inf")
    with pytest.raises(Exception, match="finite"):
        df.select(sc.clean_feature(F.col("v"), "error")).collect()


def test_vector_hash_bytes(spark):
    import hashlib
    import struct

    from proofline.constants import HASH_DOMAIN

    rows = [(1, {"f000": 1.5, "f001": None}), (2, {"f000": 0.0, "f001": None}), (3, {"f000": -0.0, "f001": None}), (4, {"f000": None, "f001": None})]
    found = {r.i: r.feature_hash for r in with_vector_hash(spark.createDataFrame(rows, "i int, features map<string,double>"), KEYS).collect()}
    digest = hashlib.sha256(HASH_DOMAIN + b"\x01" + struct.pack(">d", 1.5) + b"\x00").hexdigest()
    assert found[1] == "sha256:v1:" + digest
    assert found[2] == found[3] != found[4]
    with pytest.raises(Exception, match="finite"):
        with_vector_hash(spark.createDataFrame([(1, {"f000": float("inf"), "f001": None})], "i int, features map<string,double>"), KEYS).collect()


def test_prediction_window_is_all_or_nothing(spark):
    rows = predictions(spark, range(5)).withColumns({"request_id": F.lit("r"), "latency_ms": F.lit(1.0)})
    assert stats.prediction_window_metrics(rows, 6).count() == 0
    assert stats.prediction_window_metrics(rows, 5).count() == 16


def test_too_few_labeled_rows_fail(spark):
    df = spark.createDataFrame([("l", 1.0, "a")], "label_event_id string, at double, sample_id string")
    assert quality.latest_labeled(df, "at", ["sample_id"], 1).count() == 1
    with pytest.raises(Exception, match="too few labeled rows"):
        quality.latest_labeled(df, "at", ["sample_id"], 2).collect()


def test_gate_reasons(spark):
    def deltas(**values):
        return spark.createDataFrame([(k, v) for k, v in values.items()], "metric_name string, delta double")

    assert quality.compare_gate(deltas(fail_f1=0.0)).first().gate_status == "passed"
    missing = quality.compare_gate(deltas(fail_recall=0.5)).first()
    assert [tuple(r) for r in missing.reasons] == [("fail_f1", 0.0, None)]
    regressed = quality.compare_gate(deltas(fail_f1=0.1, fail_recall=-0.03, fail_precision=-0.04)).first()
    assert [(r.code, r.required, round(r.actual, 6)) for r in regressed.reasons] == [("fail_recall", -0.02, -0.03)]


def test_labels_as_of_uses_each_rows_cutoff(spark):
    points = spark.createDataFrame([("p1", "a", 10.0), ("p2", "b", 1.0)], "id string, sample_id string, cutoff double")
    labels = spark.createDataFrame([("l1", "a", 1, 0.0, 5.0, 1, "fail"), ("l2", "a", 2, 0.0, 11.0, -1, "pass"), ("l3", "b", 1, 0.0, 2.0, 1, "fail")], LABELS)
    found = {r.id: r.label_event_id for r in latest.labels_as_of(points, labels, "cutoff", "id").collect()}
    assert found == {"p1": "l1", "p2": None}


def test_long_form_indexes(spark):
    df = spark.createDataFrame([({"f007": 1.0, "f589": None},)], "features map<string,double>")
    assert sorted((r.feature_index, r.value) for r in lengthen(df, []).collect()) == [(7, 1.0), (589, None)]


def test_stability_index_takes_its_buckets_from_the_stored_edges(spark):
    values = [float(i) for i in range(200)]
    for n in (5, 10, 20):
        reference = bins.reference_bins(long(spark, values), ["feature_name"], n)
        row = bins.feature_psi(long(spark, [v / 2 for v in values]), reference, ["feature_name"]).first()
        assert row is not None and row.current_non_null == 200 and row.psi > 0
        same = bins.feature_psi(long(spark, values), reference, ["feature_name"]).first()
        assert abs(same.psi) < 1e-12
