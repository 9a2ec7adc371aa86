"""Wide assembly: against a plain fold, against the narrow one, with hot samples in pieces, and its plan."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from proofline.constants import feature_keys
from proofline.operators import widefold
from proofline.operators.assemble import assemble_replay, assemble_wide, first_complete_versions

KEYS = feature_keys(7)
SCHEMA = "sample_id string, arrival bigint, event_time double, event_id string, drift_segment string, features map<string,double>"


def patches(count, seed, samples=5):
    rng, out = random.Random(seed), []
    for i in range(count):
        changed = {k: (None if rng.random() < 0.3 else round(rng.random(), 3)) for k in rng.sample(KEYS, rng.randrange(0, 4))}
        sample = "hot" if rng.random() < 0.5 else f"s{rng.randrange(samples)}"
        out.append((sample, i, float(rng.randrange(50)), f"e{i}", rng.choice([None, "x", "y"]), changed))
    return out


def folded(rows):
    """Each patch with the state of its sample after it."""
    states, out = {}, []
    for sample, arrival, at, event, segment, changed in rows:
        s = states.setdefault(sample, {"n": 0, "t0": math.inf, "t1": -math.inf, "seg": None, "f": {}})
        s["n"], s["t0"], s["t1"], s["seg"] = s["n"] + 1, min(s["t0"], at), max(s["t1"], at), segment or s["seg"]
        s["f"].update(changed)
        values = [s["f"].get(k) for k in KEYS]
        out.append((arrival, sample, s["n"], s["t0"], s["t1"], len(s["f"]), values.count(None), s["seg"], values))
    return out


NAMES = ["arrival", "sample_id", "snapshot_version", "window_start", "window_end", "feature_count", "missing_count", "last_drift_segment"]


@pytest.mark.parametrize("piece_rows", [None, 10])
@pytest.mark.parametrize("cells", [2_000_000, 21])
def test_wide_fold(spark, monkeypatch, piece_rows, cells):
    monkeypatch.setattr(widefold, "CELLS", cells)
    rows = patches(400, 3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    made = assemble_wide(df, KEYS, piece_rows=piece_rows).select(*NAMES, "feature_values")
    assert sorted(tuple(r) for r in made.collect()) == sorted(folded(rows), key=lambda r: r[0])
    assert assemble_wide(df.limit(0), KEYS).count() == 0


def test_wide_equals_narrow_in_all_columns(spark):
    df = spark.createDataFrame(patches(200, 8), SCHEMA)
    wide, narrow = assemble_wide(df, KEYS).drop("feature_values"), assemble_replay(df, KEYS)
    assert sorted(wide.columns) == sorted(narrow.columns)
    shown = lambda d: sorted(str({k: sorted(v.items()) if isinstance(v, dict) else v for k, v in r.asDict().items()}) for r in d.select(*narrow.columns).collect())
    assert shown(wide) == shown(narrow)


@pytest.mark.parametrize("features", [{"f009": 1.0}, {"f001": math.inf}, {"f001": math.nan}])
@pytest.mark.parametrize("assemble", [assemble_wide, assemble_replay])
def test_bad_patches_stop_the_job(spark, assemble, features):
    df = spark.createDataFrame([("s", 1, 0.0, "e", None, features)], SCHEMA)
    with pytest.raises(Exception, match="unexpected feature key|not a finite number"):
        assemble(df, KEYS).collect()


def test_first_complete_versions(spark):
    rows = patches(300, 5, samples=30)
    df = spark.createDataFrame(rows, SCHEMA)
    want = {}
    for arrival, sample, *_, count, _, _, _ in ((r[0], r[1], r[5], r[6], r[7], r[8]) for r in folded(rows)):
        if count == len(KEYS):
            want.setdefault(sample, arrival)
    assert want and {tuple(r) for r in first_complete_versions(df, KEYS).collect()} == set(want.items())


def test_one_exchange(spark):
    df = spark.range(100).select(
        F.col("id").cast("string").alias("sample_id"), F.col("id").alias("arrival"), F.lit(0.0).alias("event_time"),
        F.create_map(F.lit("f000"), F.lit(1.0)).alias("features"),
    )
    text = assemble_wide(df, feature_keys(590))._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and text.count("+- Sort") == 1


def test_blocks_of_any_size_give_the_same_vectors(monkeypatch):
    rng, kind = random.Random(2), pa.map_(pa.string(), pa.float64())
    some = lambda n: {k: (None if rng.random() < 0.3 else rng.random()) for k in rng.sample(KEYS, rng.randrange(n))}
    for _ in range(60):
        rows = []
        for group in range(rng.randrange(1, 6)):
            carry = some(4) if rng.random() < 0.4 else None
            rows += [(group, some(4) if rng.random() < 0.9 else None, carry if r == 0 else None) for r in range(rng.randrange(1, 6))]
        monkeypatch.setattr(widefold, "CELLS", rng.choice([7, 14, 10_000]))
        expected, state, before = [], {}, None
        for group, changed, carry in rows:
            state = dict(carry or {}) if group != before else state
            state.update(changed or {})
            before = group
            expected.append([state.get(k) for k in KEYS])
        maps = lambda column, part: pa.array([None if r[column] is None else list(r[column].items()) for r in part], kind)
        cuts = sorted({0, len(rows), *[rng.randrange(len(rows)) for _ in range(3)]})
        batches = [
            pa.RecordBatch.from_arrays([pa.array([r[0] for r in part]), maps(1, part), maps(2, part)], ["g", "features", "carry"])
            for part in (rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False))
        ]
        found = [v for b in widefold.folded_batches(iter(batches), KEYS, ["g"], "carry") for v in b.column("feature_values").to_pylist()]
        assert found == expected
    assert np.isnan(widefold.Vector(3).values).all()


def test_first_complete_follows_one_feature_of_each_class(spark, monkeypatch):
    from proofline.operators import assemble

    sets = [KEYS[0:3], KEYS[2:5], KEYS[5:7], [KEYS[6], KEYS[5]], []]
    rng = random.Random(4)
    made = [(rng.choice(["a", "b", "c", None]), i, {k: None for k in rng.choice(sets)}) for i in range(60)]
    df = spark.createDataFrame([*made, ("d", 99, {KEYS[0]: 1.0})], "sample_id string, arrival bigint, features map<string,double>")
    assert len(assemble._followed(df, KEYS)) == 5  # 0; 1; 2; 3 and 4; 5 and 6
    seen, want = {}, {}
    for sample, at, features in made:
        known = seen.setdefault(sample, set())
        known.update(features)
        if len(known) == len(KEYS):
            want.setdefault(sample, at)
    assert {tuple(r) for r in first_complete_versions(df, KEYS).collect()} == set(want.items()) and want
    assert first_complete_versions(df.where(~F.map_contains_key("features", KEYS[0])), KEYS).collect() == []
    for features in ({"other": 1.0}, {KEYS[0]: float("nan")}, {KEYS[0]: float("-inf"), KEYS[1]: None}):
        bad = df.union(spark.createDataFrame([("e", 1, features)], df.schema))
        with pytest.raises(Exception, match="unexpected feature key|not a finite"):
            first_complete_versions(bad, KEYS).collect()
