"""Physical plans: what must be pushed down, limited on the map side, and kept out."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from catalog import fixtures as fx
from proofline.operators import latest, quality, validate
from proofline.operators.keyfilter import with_wanted_keys
from proofline.plans import cohorts, maturity

SMALL = "/root/testdata/sf0.001"
NO_PYTHON = [
    "assemble_replay", "reconstruct_as_of", "training_cohort", "gate_cohort", "live_quality", "label_maturity", "periodic_cohorts",
    "drift_recent_feature", "feature_stats", "val_feature_rules", "insert_ignore_rows", "upsert_last_wins", "replay_conflicts",
    "membership_diff", "selection_digest", "stratified_split", "training_summary", "patch_coverage",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def tables(spark, tmp_path):
    """Stored evidence, as a deployment has it: plans then start at Parquet scans."""
    out = {}
    for name, df in (
        ("snapshots", fx.snapshots(spark, SMALL)), ("predictions", fx.predictions(spark, SMALL)), ("labels", fx.labels(spark, SMALL)),
    ):
        df.write.parquet(f"{tmp_path}/{name}")
        out[name] = spark.read.parquet(f"{tmp_path}/{name}")
    return out


@pytest.mark.parametrize("name", NO_PYTHON)
def test_no_python_and_no_all_pairs_join(spark, name):
    text = plan(registry.queries()[name](spark, SMALL))
    assert not re.search("EvalPython|FlatMapGroups|MapInPandas|CartesianProduct|BroadcastNestedLoopJoin", text)


def test_cohort_shuffles_each_table_once_and_prunes_features(spark, tables):
    config = cohorts.CohortConfig(fx.START, fx.CUTOFF, fx.MATURITY)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    try:
        text = plan(cohorts.training_cohort(tables["snapshots"], tables["labels"], config, filter_bits=None))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert len(re.findall("Exchange hashpartitioning", text)) == 2
    assert text.count("row_number(), 1, Partial") == 2
    assert "features" not in text
    assert "GreaterThanOrEqual(available_at" not in text  # ranked before the time filter
    assert "LessThanOrEqual(available_at,1.7061408E9)" in text  # labels are cut at the scan
    assert "EqualTo(snapshot_status,complete)" in text


def test_labels_are_cut_to_the_cohort_before_their_shuffle(spark, tables):
    config = cohorts.CohortConfig(fx.START, fx.CUTOFF, fx.MATURITY)
    made = {
        "training": lambda bits: cohorts.training_cohort(tables["snapshots"], tables["labels"], config, filter_bits=bits),
        "gate": lambda bits: cohorts.gate_cohort(tables["predictions"], tables["snapshots"], tables["labels"], config, filter_bits=bits),
        "live": lambda bits: cohorts.live_cohort(tables["predictions"], tables["labels"], fx.CUTOFF, fx.MATURITY, fx.WINDOW, filter_bits=bits),
    }
    for cohort in made.values():
        whole = sorted(map(str, cohort(None).collect()))
        assert whole == sorted(map(str, cohort(1 << 16).collect())) == sorted(map(str, cohort(64).collect()))
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    try:
        made_once = made["training"](1 << 16)
        lines = plan(made_once).splitlines()
        made_once.collect()
        run = plan(made_once)
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    shuffles = [i for i, line in enumerate(lines) if "Exchange hashpartitioning(sample_id" in line]
    cut = [i for i, line in enumerate(lines) if "getbit" in line]
    assert len(shuffles) == 2 and cut[0] > shuffles[1]  # below the shuffle of the labels, above their scan
    assert "ReusedSubquery" in run


def test_key_filter_cuts_most_other_keys_and_no_wanted_one(spark):
    rows, wanted = spark.range(200_000).select(F.concat(F.lit("s"), "id").alias("k")), spark.range(0, 200_000, 20).select(F.concat(F.lit("s"), "id").alias("k"))
    kept = with_wanted_keys(rows, wanted, "k", 1 << 17)
    assert kept.join(wanted, "k", "left_semi").count() == 10_000
    assert kept.count() < 13_000
    assert with_wanted_keys(rows, wanted.limit(0), "k", 64).count() == 0
    nulls = spark.createDataFrame([(None,), ("a",)], "k string")
    assert with_wanted_keys(nulls, nulls, "k", 1 << 10).count() == 2


def test_conflict_flag_shares_the_exchange_of_the_ranking(tables):
    text = plan(latest.first_release_decisions(tables["predictions"]))
    assert text.count("Exchange hashpartitioning") == 1
    assert "EqualTo(runtime_slot,release)" in text
    assert "Window" not in text


def test_quality_reduces_scores_before_the_shuffle(tables):
    rows = tables["predictions"].withColumn("actual_value", F.lit(1))
    text = plan(quality.quality(rows, ["model_run_id", "threshold"]))
    assert "partial_count" in text and text.index("Exchange") < text.index("partial_count")


def test_maturity_counts_without_expanding_by_age(tables):
    text = plan(maturity.label_maturity(tables["snapshots"], tables["predictions"], tables["labels"], fx.CUTOFF))
    assert "Expand" not in text and "CartesianProduct" not in text


def test_filters_stay_above_the_event_parsing(spark):
    raw = spark.range(5).select(F.lit("k").alias("key"), F.concat(F.lit('{"a":'), "id", F.lit("}")).alias("value"))
    valid, _ = validate.validate(raw, validate.label_contract())
    text = plan(valid)
    assert text.index("Filter") < text.index("Generate")
    assert text.count("parseJson") <= 3


def test_latest_per_key_limits_on_the_map_side(tables):
    text = plan(latest.labels_at(tables["labels"], fx.CUTOFF))
    assert "Partial" in text and "WindowGroupLimit" in text
