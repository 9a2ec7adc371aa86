"""Tables, datasets on disk, readers and training."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from proofline.constants import TRAINING_IDENTITY
from proofline.plans import cohorts, datasets, readiness, training
from proofline.schemas import evidence_schemas
from proofline.sources import readers, sinks
from proofline.sources.sinks import Table

KEYS = ["f000", "f001"]
COHORT = """sample_id string, serving_snapshot_id string, snapshot_version bigint, feature_hash string, snapshot_time double,
    snapshot_available_at double, window_start double, window_end double, feature_count int, serving_missing_count int,
    simulation_run_id string, drift_segment string, label_event_id string, label_revision bigint, label_measured_at double,
    label_available_at double, actual_value int, actual_label string, features map<string,double>"""


def members(spark, count=4, missing=0):
    rows = []
    for i in range(count):
        fail = i % 2 == 0
        rows.append((f"s{i}", f"snap{i}", 1, "h", 1.0, 2.0 + i, 0.0, 1.0, 2, missing, None, "seg", f"l{i}", 1, 1.0, 3.0,
                     1 if fail else -1, "fail" if fail else "pass", {"f000": float(i), "f001": 1.0}))
    return spark.createDataFrame(rows, COHORT)


CONFIG = cohorts.CohortConfig(0.0, 100.0, 10.0, min_labeled=1, min_label_coverage=0.5, min_fail_samples=1, min_pass_samples=1)


def build(spark, folder, rows):
    builds = Table(f"{folder}/builds", ("dataset_id",), 0)
    stats = readiness.training_readiness(rows, CONFIG)
    identity = datasets.write_dataset(
        rows, stats, CONFIG, TRAINING_IDENTITY, datasets.TRAINING_MEMBERS, KEYS, str(folder), builds, 5.0
    )
    return builds, identity


def load(spark, folder, builds, identity):
    return datasets.verified_dataset(spark, str(folder), builds, identity.dataset_id, TRAINING_IDENTITY, KEYS)


def test_dataset_is_written_verified_and_reused(spark, tmp_path):
    builds, identity = build(spark, tmp_path, members(spark))
    assert load(spark, tmp_path, builds, identity).count() == 4
    assert [r.status for r in builds.read(spark).orderBy("status").collect()] == ["BUILDING", "READY"]
    _, again = build(spark, tmp_path, members(spark).repartition(5))
    assert again == identity
    assert builds.read(spark).count() == 2
    assert identity.dataset_id.startswith("training_") and identity.manifest_hash.startswith("sha256:v1:")


def test_other_members_have_another_identity(spark):
    first = datasets.build_identity(members(spark), datasets.TRAINING_MEMBERS, TRAINING_IDENTITY, CONFIG)
    other = datasets.build_identity(members(spark, 3), datasets.TRAINING_MEMBERS, TRAINING_IDENTITY, CONFIG)
    assert first.manifest_hash != other.manifest_hash


def test_tampering_is_found(spark, tmp_path):
    builds, identity = build(spark, tmp_path, members(spark))
    path = f"{tmp_path}/{identity.dataset_id}/data"
    changed = spark.read.parquet(path).withColumn("feature_000", F.lit(7.0)).collect()
    spark.createDataFrame(changed, spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)
    with pytest.raises(RuntimeError, match="content"):
        load(spark, tmp_path, builds, identity)


def test_manifest_must_match(spark, tmp_path):
    builds, identity = build(spark, tmp_path, members(spark))
    path = tmp_path / identity.dataset_id / "manifest.json"
    manifest = json.loads(path.read_text())
    manifest["identity"]["cohort_start_time"] = 1.0
    datasets.write_text(spark, str(path), json.dumps(manifest))
    with pytest.raises(RuntimeError, match="identity.hash"):
        load(spark, tmp_path, builds, identity)


def test_failed_builds_are_logged(spark, tmp_path):
    with pytest.raises(Exception, match="missing_count"):
        build(spark, tmp_path, members(spark, missing=1))
    builds = Table(f"{tmp_path}/builds", ("dataset_id",), 0)
    assert {r.status for r in builds.read(spark).collect()} == {"BUILDING", "FAILED"}
    with pytest.raises(RuntimeError, match="no READY dataset"):
        datasets.verified_dataset(spark, str(tmp_path), builds, "training_x", TRAINING_IDENTITY, KEYS)


def test_refused_cohort_is_not_written(spark, tmp_path):
    stats = readiness.training_readiness(members(spark), cohorts.CohortConfig(0.0, 100.0, 10.0))
    with pytest.raises(ValueError, match=r"labeled_sample_count., 1000.0, 4.0"):
        datasets.write_dataset(members(spark), stats, CONFIG, TRAINING_IDENTITY, datasets.TRAINING_MEMBERS, KEYS,
                               str(tmp_path), Table(f"{tmp_path}/b", ("dataset_id",), 0), 1.0)


def test_empty_cohort_is_not_ready(spark):
    row = readiness.training_readiness(members(spark, 0), CONFIG).first()
    assert (row.ready, row.label_coverage, row.eligible_sample_count) == (False, 0.0, 0)


def test_table_upsert_and_insert_ignore(spark, tmp_path):
    table = Table(str(tmp_path / "t"), ("id",))
    table.upsert(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "id string, v int, own string"), "v")
    table.upsert(spark.createDataFrame([("a", 3, "z"), ("b", 1, "w")], "id string, v int, own string"), "v", keep=["own"])
    assert {tuple(r) for r in table.read(spark).collect()} == {("a", 3, "y"), ("b", 1, "w")}
    table.insert_ignore(spark.createDataFrame([("b", 9, "n"), ("c", 2, "n"), ("c", 1, "n")], "id string, v int, own string"), ["v"])
    assert {(r.id, r.v) for r in table.read(spark).collect()} == {("a", 3), ("b", 1), ("c", 1)}


def test_sensor_matrix_and_labels(spark, tmp_path):
    (tmp_path / "m.txt").write_text("1.5 NaN  3\n 4 5e1 6 \n\n7 8 9\n")
    rows = readers.first_rows(readers.sensor_matrix(spark, str(tmp_path / "m.txt"), 3), 2).orderBy("place").collect()
    assert [r["values"] for r in rows] == [[1.5, None, 3.0], [4.0, 50.0, 6.0]]
    with pytest.raises(Exception, match="wrong width"):
        readers.sensor_matrix(spark, str(tmp_path / "m.txt"), 4).collect()
    with pytest.raises(Exception, match="fewer than 9"):
        readers.first_rows(readers.sensor_matrix(spark, str(tmp_path / "m.txt"), 3), 9).collect()
    (tmp_path / "l.txt").write_text('-1 "19/07/2008 11:55:00"\n1 "19/07/2008 12:32:00"\n')
    labels = readers.label_lines(spark, str(tmp_path / "l.txt")).orderBy("place").collect()
    assert [(r.actual_value, r.actual_label) for r in labels] == [(-1, "pass"), (1, "fail")]
    (tmp_path / "bad.txt").write_text("0 x\n")
    with pytest.raises(Exception, match="-1 or 1"):
        readers.label_lines(spark, str(tmp_path / "bad.txt")).collect()


def test_offline_snapshots_at(spark):
    df = spark.createDataFrame([("b", 5.0, True), ("a", 5.0, True), ("c", 5.0, False), ("d", 6.0, True)], "sample_id string, build_cutoff_time double, is_complete boolean")
    assert [r.sample_id for r in readers.offline_snapshots_at(df, 5.0).collect()] == ["a", "b"]
    assert readers.offline_snapshots_at(df, 5.0, only_complete=False).count() == 3


def test_schemas_cover_the_tables(spark):
    found = evidence_schemas()
    assert found["label_events"]["label_revision"].dataType.simpleString() == "bigint"
    assert not found["label_events"]["label_event_id"].nullable


def test_messages_keep_nulls(spark):
    df = spark.createDataFrame([("s", None)], "sample_id string, x double")
    assert sinks.as_messages(df).first().value == '{"sample_id":"s","x":null}'


def test_training_finds_a_separating_feature(spark):
    rows = spark.range(200).select(
        F.concat(F.lit("s"), "id").alias("sample_id"), F.when(F.col("id") % 4 == 0, 1).otherwise(-1).alias("actual_value"),
        F.when(F.col("id") % 7 != 0, F.when(F.col("id") % 4 == 0, 10.0).otherwise(1.0)).alias("feature_000"),
        F.rand(1).alias("feature_001"), F.lit(None).cast("double").alias("feature_002"),
    )
    columns = ["feature_000", "feature_001", "feature_002"]
    result = training.train(rows, columns, trees=(5,), leaves=(1, 3), thresholds=(0.3, 0.5))
    assert result.search.count() == 4
    assert result.model.columns == ["feature_000", "feature_001"]
    assert result.best["fail_f1"] > 0.8
    scored = result.model.score(rows)
    right = scored.where("predicted_value = actual_value").count()
    assert right > 170
    assert scored.where((F.col("predicted_value") == 1) != (F.col("predicted_label") == "fail")).count() == 0
    holes = spark.createDataFrame([(1.0, None), (4.0, None), (None, None), (10.0, None)], "a double, b double")
    assert training.exact_medians(holes, ["a", "b"]) == {"a": 4.0}
    weights = {r.actual_value: r._weight for r in training.with_class_weight(rows).select("actual_value", "_weight").distinct().collect()}
    assert weights == {1: pytest.approx(2.0), -1: pytest.approx(200 / 300)}


def test_rows_that_keep_their_nodes_give_the_same_forest(spark):
    rows = spark.range(400).select(
        F.when(F.xxhash64("id") % 3 == 0, 1).otherwise(-1).alias("actual_value"), (F.xxhash64("id", F.lit(1)) % 50).cast("double").alias("a"),
        F.sin(F.col("id").cast("double")).alias("b"),
    )
    rows = training.with_class_weight(rows.repartition(3, "b")).localCheckpoint()
    pipeline = training.forest({"a": 0.0, "b": 0.0}, trees=6, leaf=1, seed=3)
    classifier = pipeline.getStages()[-1]
    assert classifier.getCacheNodeIds()
    trees = lambda: [t.toDebugString.split("\n", 1)[1] for t in pipeline.fit(rows).stages[-1].trees]
    kept = trees()
    classifier.setCacheNodeIds(False)
    assert kept == trees() and max(map(len, kept)) > 1000


def files_of(table):
    return {str(f.relative_to(table.path)) for f in Path(table.path).rglob("*.parquet")}


def test_upsert_rewrites_only_the_partitions_it_touches(spark, tmp_path):
    table = Table(str(tmp_path / "t"), ("id",), 32)
    rows = lambda ids, n: spark.createDataFrame([(f"k{i}", n, f"own{n}") for i in ids], "id string, n int, own string")
    table.append(rows(range(200), 1))
    before = files_of(table)
    fresh = rows([3, 4, 900], 2).unionByName(rows([3], 5))
    touched = table.touched(fresh)
    assert 1 <= len(touched) <= 3
    table.upsert(fresh, "n", keep=["own"])
    after = files_of(table)
    outside = lambda names: {f for f in names if int(f.split("/")[0].split("=")[1]) not in touched}
    assert outside(before) == outside(after) and before - after and all(f not in before for f in after - outside(after))
    stored = {r.id: (r.n, r.own) for r in table.read(spark).collect()}
    assert len(stored) == 201 and stored["k3"] == (5, "own1") and stored["k4"] == (2, "own1") and stored["k900"] == (2, "own2") and stored["k5"] == (1, "own1")


def test_lookups_read_only_the_touched_partitions(spark, tmp_path):
    table = Table(str(tmp_path / "t"), ("id",), 32)
    table.append(spark.range(500).selectExpr("concat('k', id) AS id", "id AS n"))
    batch = spark.createDataFrame([("k7", 0)], "id string, n bigint")
    plan = table.read(spark, table.touched(batch))._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull(key_hash_of_32" in plan and "= " + str(table.touched(batch)[0]) in plan
    table.insert_ignore(batch, ["n"])
    assert table.read(spark).count() == 500
    with pytest.raises(ValueError):
        Table(str(tmp_path / "log"), ("id",), 0).upsert(batch, "n")


def test_null_keys_and_null_orders_in_an_upsert(spark):
    stored = spark.createDataFrame([(None, 9, "a"), ("x", 9, None)], "id string, n int, own string")
    fresh = spark.createDataFrame([(None, None, "b"), (None, 1, "c"), ("x", None, "d"), ("y", None, "e")], "id string, n int, own string")
    found = {tuple(r) for r in sinks.merged(stored, fresh, ["id"], "n").collect()}
    assert found == {(None, 1, "c"), ("x", None, "d"), ("y", None, "e")}


def test_a_partition_is_one_file_without_the_adaptive_plan(spark, tmp_path):
    table = Table(str(tmp_path / "table"), ("id",), 4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as in the batches of a stream with state
    try:
        table.append(spark.range(0, 400, 1, 8))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(files_of(table)) == 4
    assert table.read(spark).count() == 400


def test_stored_keys_never_pass_through_the_driver(spark):
    from proofline.sources.sinks import new_rows, replay_conflicts

    rows = spark.range(20).select("id", (F.col("id") % 3).alias("value"), F.col("id").alias("at"))
    stored = rows.where("id < 8")
    conflicts = rows.withColumn("value", F.when(F.col("id") == 5, 9).otherwise(F.col("value")))
    for found, want in ((new_rows(rows, stored, ["id"], ["at"]), {*range(8, 20)}), (replay_conflicts(conflicts, stored, "id", ["value"], ["at"]), {5})):
        assert {r.id for r in found.collect()} == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "LeftAnti, BuildRight" not in plan and "LeftOuter, BuildRight" not in plan
