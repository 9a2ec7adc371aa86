"""Streams against their batch twins, under small micro-batches, replays and conflicts."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofline.constants import feature_keys
from proofline.operators import validate
from proofline.operators.assemble import assemble_replay
from proofline.sources.readers import file_stream
from proofline.sources.sinks import Table
from proofline.streaming import jobs, scoring
from proofline.streaming.assembler import assemble_stream

KEYS = feature_keys(5)
SAMPLE = r"^s-\d+$"


@pytest.fixture
def rocks(spark):
    for name, value in jobs.STREAM_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def write_batches(folder, messages, size):
    folder.mkdir(exist_ok=True)
    for n, begin in enumerate(range(0, len(messages), size)):
        lines = [json.dumps(m) for m in messages[begin:begin + size]]
        path = folder / f"part-{n:05d}.json"
        path.write_text("\n".join(lines))
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))  # files are read in the order of their times


def events(count, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(count):
        sample = f"s-{rng.randint(0, 6)}"
        features = {k: (None if rng.random() < 0.2 else round(rng.random(), 3)) for k in rng.sample(KEYS, 2)}
        body = {"event_id": f"e{i}", "sample_id": sample, "event_time": float(rng.randint(0, 100)), "feature_group": "early", "features": features}
        out.append({"key": sample, "value": json.dumps(body), "arrival": i})
    return out


def typed(df):
    contract = validate.feature_event_contract(SAMPLE, feature_count=5, created_at=0.0)
    checked = validate.check(df, contract)
    return checked.where(F.size("reasons") == 0).select("arrival", "event_id", "sample_id", "event_time", "feature_group", "features")


def test_stateful_assembly_equals_the_replay(rocks, tmp_path):
    messages = events(120)
    write_batches(tmp_path / "in", messages, 17)
    stream = typed(file_stream(rocks, str(tmp_path / "in"), max_files=2))
    query = jobs.start(assemble_stream(stream, KEYS), jobs.batch_append(str(tmp_path / "out")), str(tmp_path / "cp"), "t1", once=True)
    query.awaitTermination()
    names = ["arrival", "serving_snapshot_id", "snapshot_version", "window_start", "window_end", "feature_count", "missing_count",
             "is_complete", "snapshot_status", "features", "last_event_id"]
    got = rocks.read.parquet(str(tmp_path / "out"))
    raw = rocks.read.schema("key string, value string, arrival bigint").json(str(tmp_path / "in"))
    want = assemble_replay(typed(raw), KEYS)

    def rows(df):
        return sorted(str([sorted(r[n].items()) if n == "features" else r[n] for n in names]) for r in df.collect())

    assert rows(got) == rows(want)
    assert got.where(~F.col("feature_hash").rlike("^sha256:v1:[0-9a-f]{64}$")).count() == 0


def test_archive_is_idempotent_and_quarantines(rocks, tmp_path):
    messages = events(30)
    broken = {"key": "s-1", "value": "nope", "arrival": 1000}
    write_batches(tmp_path / "in", [*messages, *messages[:10], broken], 9)
    table = Table(str(tmp_path / "table"), ("event_id",))
    contract = validate.feature_event_contract(SAMPLE, feature_count=5, created_at=1.0)
    step = jobs.archive_step(contract, table, str(tmp_path / "bad"), lambda: 2.0)
    stream = file_stream(rocks, str(tmp_path / "in"), max_files=1)
    jobs.start(stream, step, str(tmp_path / "cp"), "t2", once=True).awaitTermination()
    assert table.read(rocks).count() == 30
    assert rocks.read.parquet(str(tmp_path / "bad")).select("value").collect()[0][0] == "nope"
    # A lost checkpoint delivers everything again.
    jobs.start(stream, step, str(tmp_path / "cp2"), "t3", once=True).awaitTermination()
    assert table.read(rocks).count() == 30


def label(event_id, revision, value, at):
    body = {"label_event_id": event_id, "sample_id": "s-1", "label_revision": revision, "measured_at": at,
            "actual_value": value, "actual_label": "fail" if value == 1 else "pass"}
    return {"key": "s-1", "value": json.dumps(body), "arrival": int(at)}


def test_label_replays_keep_the_first_availability_and_conflicts_fail(rocks, tmp_path):
    table = Table(str(tmp_path / "labels"), ("label_event_id",))
    clock = iter([10.0, 20.0, 30.0])
    step = jobs.archive_step(
        validate.label_contract(SAMPLE), table, str(tmp_path / "bad"), lambda: next(clock), "available_at", jobs.LABEL_PAYLOAD
    )
    schema = "key string, value string, arrival bigint"

    def batch(*messages):
        return rocks.createDataFrame([(m["key"], m["value"], m["arrival"]) for m in messages], schema)

    step(batch(label("l1", 1, 1, 5.0)), 0)
    step(batch(label("l1", 1, 1, 7.0), label("l2", 2, -1, 8.0)), 1)
    assert {(r.label_event_id, r.available_at) for r in table.read(rocks).collect()} == {("l1", 10.0), ("l2", 20.0)}
    with pytest.raises(RuntimeError, match="payload conflict"):
        step(batch(label("l1", 1, -1, 9.0)), 2)


def test_materialize_publishes_then_records_once(rocks, tmp_path):
    history = Table(str(tmp_path / "history"), ("serving_snapshot_id",))
    published = []
    clock = iter([10.0, 20.0])
    step = jobs.materialize_step(history, lambda: next(clock), lambda df: published.append(df.collect()))
    rows = rocks.createDataFrame([("s:1", "s", 1), ("s:2", "s", 2)], "serving_snapshot_id string, sample_id string, snapshot_version bigint")
    step(rows, 0)
    step(rows, 1)
    assert [r.snapshot_version for r in published[0]] == [2]
    assert {r.available_at for r in history.read(rocks).collect()} == {10.0}
    newest = jobs.refreshed_latest(None, history.read(rocks))
    assert [r.serving_snapshot_id for r in newest.collect()] == ["s:2"]
    assert jobs.refreshed_latest(newest, history.read(rocks)).count() == 1


def test_scoring_fans_out_per_slot_and_survives_a_replay(spark, tmp_path):
    rows = spark.createDataFrame(
        [("s:1", "s", 1, "h", True, "complete", {"f000": 0.25, "f001": None}), ("s:2", "s", 2, "h", True, "complete", {"f000": 0.75, "f001": 1.0}),
         ("t:1", "t", 1, "h", False, "partial", {"f000": 9.0})],
        "serving_snapshot_id string, sample_id string, snapshot_version bigint, feature_hash string, is_complete boolean, "
        "snapshot_status string, features map<string,double>",
    )
    models = {"release": scoring.Model("a", 0.5, lambda x: x[:, 0]), "shadow": scoring.Model("b", 0.9, lambda x: np.ones(len(x)))}
    table, clock = Table(str(tmp_path / "decisions"), ("prediction_id",), 4), iter([5.0, 6.0, 7.0])
    step = scoring.scoring_step(models, ["f000", "f001"], lambda: next(clock), table)
    step(rows.where("snapshot_version = 1"), 0)
    step(rows, 1)
    step(rows, 1)  # the batch comes again
    found = {r.prediction_id: (r.fail_probability, r.predicted_value, r.predicted_label, r.missing_count, r.predicted_at) for r in table.read(spark).collect()}
    assert found == {
        "release:s:1": (0.25, -1, "pass", 1, 5.0), "shadow:s:1": (1.0, 1, "fail", 1, 5.0),
        "release:s:2": (0.75, 1, "fail", 0, 6.0), "shadow:s:2": (1.0, 1, "fail", 0, 6.0),
    }
    assert table.read(spark).count() == 4
    newest = Table(str(tmp_path / "newest"), ("prediction_id",), 4)
    scoring.scoring_step(models, ["f000", "f001"], lambda: 8.0, newest, only_newest=True)(rows, 0)
    assert {r.serving_snapshot_id for r in newest.read(spark).collect()} == {"s:2"}
    wrong = {"release": scoring.Model("a", 0.5, lambda x: x[:, 0] + 1.0)}
    with pytest.raises(Exception, match="does not give a probability"):
        scoring.decisions(rows, wrong, ["f000", "f001"], 1.0).collect()
    assert scoring.decisions(rows.limit(0), models, ["f000", "f001"], 1.0).count() == 0


def test_state_based_deduplication(rocks, tmp_path):
    messages = events(20)
    write_batches(tmp_path / "in", [*messages, *messages], 7)
    stream = jobs.dedupe_by_state(typed(file_stream(rocks, str(tmp_path / "in"), max_files=1)), ["event_id"])
    jobs.start(stream, jobs.batch_append(str(tmp_path / "out")), str(tmp_path / "cp"), "t4", once=True).awaitTermination()
    assert rocks.read.parquet(str(tmp_path / "out")).count() == 20


@pytest.mark.parametrize("replayed", [False, True])
def test_ranges_of_many_files_are_one_micro_batch_each(rocks, tmp_path, replayed):
    from catalog.jobs import BATCHES, run_to_end, stream_of

    rows = rocks.range(400).select("id", (F.col("id") % 40).alias("key"))
    seen = []
    rocks.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as many files as a large range has
    try:
        stream = stream_of(rows, "id", "key", str(tmp_path), replayed)
    finally:
        rocks.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    run_to_end(stream, lambda batch, _: seen.append(sorted(r.id for r in batch.collect())), str(tmp_path), f"ranges {replayed}")
    assert 1 < len(seen) <= BATCHES + replayed
    assert [i for ids in seen for i in ids] == [*range(400), *range(100 * replayed)]


@pytest.mark.parametrize("width", [5, 590])
def test_assembly_over_many_samples_calls_the_processor_per_group(rocks, tmp_path, monkeypatch, width):
    from proofline.streaming import assembler

    keys, rng = feature_keys(width), random.Random(7)
    monkeypatch.setattr(assembler, "CHUNK_CELLS", 7 * width)  # chunks end inside samples and just after what they held
    made = []
    for i in range(300):
        sample = None if i % 41 == 0 and width == 5 else f"s-{rng.randint(0, 25)}"
        features = {k: (None if rng.random() < 0.2 else rng.random()) for k in rng.sample(keys, 3)}
        made.append((sample, i, float(rng.randint(0, 100)), f"e{i}", rng.choice(["early", None]), features))
    schema = "sample_id string, arrival long, event_time double, event_id string, feature_group string, features map<string,double>"
    for n in range(3):
        rocks.createDataFrame(made[n * 100:n * 100 + 100], schema).repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = rocks.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    folded = assembler.assemble_stream(stream, keys, hashed=False, groups=3)
    jobs.start(folded, jobs.batch_append(str(tmp_path / "out")), str(tmp_path / "cp"), f"groups {width}", once=True).awaitTermination()
    names = ["arrival", "sample_id", "snapshot_version", "window_start", "window_end", "feature_count", "missing_count", "last_feature_group",
             "last_event_id"]

    def rows(df):
        cells = F.to_json("features", {"ignoreNullFields": "false"}).alias("cells")
        return sorted(map(str, df.select(*names, cells).collect()))

    assert rows(rocks.read.parquet(str(tmp_path / "out"))) == rows(assemble_replay(rocks.createDataFrame(made, schema), keys))
