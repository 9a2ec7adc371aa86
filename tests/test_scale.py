"""Hot-group paths against brute force: the thresholds are lowered so that small data takes them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import compare
from proofline.constants import feature_keys
from proofline.operators import scale
from proofline.operators.assemble import assemble_replay
from proofline.operators.scale import exact_quantiles, running_sums, small_table, smallest_by_order
from proofline.plans.training import stratified_split


@pytest.fixture
def patches(spark):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        sample = "s-hot" if rng.random() < 0.4 else f"s-{rng.randint(0, 40)}"
        features = {f"f{k:03d}": (None if rng.random() < 0.2 else rng.random()) for k in rng.sample(range(5), rng.randint(1, 2))}
        rows.append((f"e{i}", sample, float(rng.randint(0, 1000)), i, rng.choice(["early", "late", None]), features))
    schema = "event_id string, sample_id string, event_time double, arrival long, feature_group string, features map<string,double>"
    return rows, spark.createDataFrame(rows, schema)


def test_assembly_equals_a_fold_with_and_without_pieces(patches):
    rows, df = patches
    states, expected = {}, {}
    for event, sample, at, _, group, features in rows:
        state = states.setdefault(sample, {"f": {}, "n": 0, "t0": 1e9, "t1": -1.0, "g": None})
        state["f"].update(features)
        state["n"] += 1
        state["t0"], state["t1"] = min(state["t0"], at), max(state["t1"], at)
        state["g"] = group or state["g"]
        expected[event] = (
            state["n"], state["t0"], state["t1"], state["g"], len(state["f"]), tuple(state["f"].get(k) for k in feature_keys(5))
        )
    for piece_rows in (None, 100):
        got = {
            r.event_id: (r.snapshot_version, r.window_start, r.window_end, r.last_feature_group, r.feature_count,
                         tuple(r.features[k] for k in feature_keys(5)))
            for r in assemble_replay(df, feature_keys(5), piece_rows=piece_rows).collect()
        }
        assert got == expected


def values(spark, n=20_000):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice([rng.random(), rng.gauss(0, 1), 1.0, 1.0])) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "g string, v double")


@pytest.mark.parametrize("lower", [False, True])
@pytest.mark.parametrize("bins", [4096, 1, 10**9])
def test_quantiles_are_exact(spark, monkeypatch, lower, bins):
    monkeypatch.setattr(scale, "BINS_PER_E", bins)
    rows, df = values(spark)
    probs = [0.0, 0.05, 0.5, 0.95, 1.0]
    for r in exact_quantiles(df, ["g"], "v", probs, lower=lower).collect():
        own = np.sort([v for g, v in rows if g == r.g])
        want = [own[int((len(own) - 1) * q)] for q in probs] if lower else np.quantile(own, probs)
        assert r._n == len(own)
        assert np.allclose(r._q, want, rtol=0, atol=1e-12)


def test_bins_follow_the_order_of_all_doubles(spark):
    rng = random.Random(3)
    numbers = [0.0, -0.0, 5e-324, -5e-324, 1.7976931348623157e308, -1.7976931348623157e308, float("inf"), float("-inf"), 1.0, -1.0]
    numbers += [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randrange(-320, 308) for _ in range(5000)]
    numbers += [float(np.nextafter(v, 9e9)) for v in numbers[8:2000]]
    placed = spark.createDataFrame([(v,) for v in numbers], "v double").select("v", scale.ordered_bin(F.col("v")).alias("b")).collect()
    bins = [r.b for r in sorted(placed, key=lambda r: r.v)]
    assert bins == sorted(bins)


def test_quantiles_start_no_job_before_they_are_read(spark):
    _, df = values(spark, 1000)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "")
    exact_quantiles(df, ["g"], "v", [0.1, 0.5])
    assert list(tracker.getJobIdsForGroup("planning")) == []
    spark.sparkContext.setJobGroup("", "")


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_in_pieces(spark, descending):
    _, df = values(spark, 5000)
    counts = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    plain = sorted(running_sums(counts, ["g"], "v", ["n"], descending).collect())
    assert plain == sorted(running_sums(counts, ["g"], "v", ["n"], descending, piece_rows=100).collect())


def test_smallest_by_order_breaks_ties(spark):
    df = spark.createDataFrame([("a", 1, i) for i in range(10)] + [("b", i, i) for i in range(10)], "g string, o int, id int")
    got = smallest_by_order(df, ["g"], "o", "id", F.lit(3)).where("_picked").collect()
    assert sorted((r.g, r.id) for r in got) == [(g, i) for g in "ab" for i in range(3)]


def test_split_has_exact_counts_and_repeats(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("key"), F.when(F.col("id") % 10 == 0, 1).otherwise(-1).alias("actual_value"))
    first = {(r.key, r.is_validation) for r in stratified_split(df, "key").collect()}
    assert first == {(r.key, r.is_validation) for r in stratified_split(df.repartition(7), "key").collect()}
    held = [int(k) for k, v in first if v]
    assert len(held) == 200 and sum(k % 10 == 0 for k in held) == 20


def test_small_table_falls_back_to_a_checkpoint(spark):
    big = small_table(spark.range(100), max_rows=10)
    assert big.count() == 100
    assert "LocalTableScan" in small_table(spark.range(5))._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["assemble_replay", "label_at_cutoff", "quality_rates", "linear_percentiles", "column_median"])
def test_registered_queries_with_every_group_hot(spark, monkeypatch, name):
    import __spark_entry__ as registry

    monkeypatch.setattr(scale, "PIECE_ROWS", 10)
    monkeypatch.setattr(scale, "SKETCH_ACCURACY", 200)
    small = "/root/testdata/sf0.001"
    assert compare(registry.queries()[name](spark, small), registry.oracle_sql()[name], small) == []


def test_quantiles_leave_nan_out_at_every_size(spark):
    values = [1.0, 2.0, 2.0, 3.0, float("inf"), float("nan"), None, float("-inf")] * 40
    rows = spark.createDataFrame([("a", v) for v in values], "g string, v double")
    found = exact_quantiles(rows, ["g"], "v", [0.0, 0.25, 0.5, 1.0]).first()
    assert found["_n"] == 240 and found["_q"] == [float("-inf"), 1.0, 2.0, float("inf")]
