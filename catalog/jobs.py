"""Queries that run whole jobs: streams, datasets on disk, training and scoring."""

import numpy as np
from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.fixtures import CUTOFF, KEYS, oracle
from catalog.ranking import COHORT_SQL, CONFIG, MEMBER, ORACLES as RANKING_ORACLES, training_members
from catalog.records import (
    EVENT_KEY, FEATURE_HEAD, FEATURE_RULES, FEATURE_TEXT, LABEL_RULES, LABEL_TEXT, PARSED, PREDICTION_RULES, PREDICTION_TEXT,
    SAMPLE, duck, oracle_reasons, spark_text,
)
from proofline.constants import HASH_PATTERN, TRAINING_IDENTITY, feature_keys, model_columns
from proofline.functions.features import lengthen, widen, with_vector_hash
from proofline.operators import quality, validate
from proofline.operators.assemble import assemble_replay, first_complete_versions
from proofline.operators.latest import first_complete, labels_at
from proofline.plans import datasets, readiness, training
from proofline.session import scratch
from proofline.sources.sinks import Table
from proofline.streaming import jobs, scoring
from proofline.streaming.assembler import assemble_stream

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return function
    return register


BATCHES = 4


def stream_of(rows, order, key, folder, replayed=False):
    """``rows`` as a stream of several micro-batches, by ``order``; a key's rows are in one file of each. ``replayed``: the first come twice.

    The ranges are written one after another, and the source takes the files by their time: a trigger takes as many as the range with
    most of them has, so that there are no more micro-batches than ranges, however many files a range needs.
    """
    spark = rows.sparkSession
    low, high = rows.agg(F.min(order), F.max(order)).first()
    cuts = [low + (high + 1 - low) * i // BATCHES for i in range(BATCHES + 1)] if low is not None else [0] * (BATCHES + 1)
    parts = list(zip(cuts, cuts[1:]))
    width, written, most = spark.sparkContext.defaultParallelism, 0, 1
    for begin, end in parts + parts[:1] * replayed:
        part = rows.where((F.col(order) >= begin) & (F.col(order) < end))
        part.repartition(width, key).write.mode("append").parquet(f"{folder}/arriving")
        files = len(spark.read.schema(rows.schema).parquet(f"{folder}/arriving").inputFiles())
        written, most = files, max(most, files - written)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", most).parquet(f"{folder}/arriving")


def stream_of_events(spark, sf, folder, replayed=False):
    return stream_of(fx.table(spark, sf, "events"), "event_id", "user_id", folder, replayed)


def run_to_end(stream, step, folder, name):
    running = jobs.start(stream, step, f"{folder}/checkpoint", name, once=True)
    running.awaitTermination()


def stateful(spark):
    for key, value in jobs.STREAM_SETTINGS.items():
        spark.conf.set(key, value)


@query("stream_assemble")
def stream_assemble(spark, sf):
    stateful(spark)
    folder = scratch(spark, "assemble")
    patches = fx.patches_of(stream_of_events(spark, sf, folder)).select(
        "sample_id", "event_id", F.col("event_id").alias("arrival"), "event_time", "feature_group", "features"
    )
    run_to_end(assemble_stream(patches, KEYS), jobs.batch_append(f"{folder}/out"), folder, "assemble")
    keep = ["event_id", "feature_group", "serving_snapshot_id", "sample_id", "snapshot_version", "window_start",
            "window_end", "feature_count", "snapshot_status", "missing_count"]
    stored = spark.read.parquet(f"{folder}/out").withColumn("event_id", F.col("event_id").cast("bigint"))
    return lengthen(stored, keep).drop("feature_index")


ORACLES["stream_assemble"] = RANKING_ORACLES["assemble_replay"]


@query("stream_archive", "with raw as (select event_id, " + duck(EVENT_KEY) + " as key, " + duck(FEATURE_TEXT) + " as value from (select *, "
       + duck(FEATURE_HEAD) + " as h from events))" + PARSED + ", r as (select event_id, j, " + oracle_reasons(FEATURE_RULES) + """ from t)
select concat('e', event_id) as event_id, j->>'$.sample_id' as sample_id, (j->>'$.event_time')::double as event_time, j->>'$.feature_group' as feature_group,
  99.0::double as created_at, len(json_keys(j, '$.features')) ::int as keys from r where reasons = ''""")
def stream_archive(spark, sf):
    """Some events are delivered again in a later micro-batch; the table holds each valid one once."""
    folder = scratch(spark, "archive")
    contract = validate.feature_event_contract(SAMPLE, fx.EVENT_TYPES, len(KEYS), 99.0)
    rows = stream_of_events(spark, sf, folder, True).withColumn("h", spark_text(FEATURE_HEAD))
    raw = rows.select(spark_text(EVENT_KEY).alias("key"), spark_text(FEATURE_TEXT).alias("value"), F.col("event_id").alias("arrival"))
    return archived(spark, raw, contract, "event_id", folder).select(
        "event_id", "sample_id", "event_time", "feature_group", "created_at", F.size(F.map_keys("features")).alias("keys")
    )


def archived(spark, raw, contract, key, folder, **options):
    table = Table(f"{folder}/table", (key,), 16)
    run_to_end(raw, jobs.archive_step(contract, table, f"{folder}/bad", lambda: 99.0, **options), folder, f"archive {key}")
    return table.read(spark)


@query("stream_label_archive", "with raw as (select " + duck(LABEL_TEXT) + " as value from orders)" + PARSED + ", r as (select j, "
       + oracle_reasons(LABEL_RULES) + """ from t)
select j->>'$.label_event_id' as label_event_id, j->>'$.sample_id' as sample_id, (j->>'$.label_revision')::bigint as label_revision,
  (j->>'$.measured_at')::double as measured_at, (j->>'$.actual_value')::int as actual_value, j->>'$.actual_label' as actual_label,
  99.0::double as available_at from r where reasons = ''""")
def stream_label_archive(spark, sf):
    """Labels with the time they became known; a replayed label must say the same again."""
    folder = scratch(spark, "labels")
    raw = stream_of(fx.table(spark, sf, "orders"), "o_orderkey", "o_custkey", folder, True).select(
        F.lit(None).cast("string").alias("key"), spark_text(LABEL_TEXT).alias("value"), F.col("o_orderkey").alias("arrival")
    )
    stored = archived(spark, raw, validate.label_contract(SAMPLE), "label_event_id", folder, stamp="available_at", payload=jobs.LABEL_PAYLOAD)
    return stored.select("label_event_id", "sample_id", "label_revision", "measured_at", "actual_value", "actual_label", "available_at")


@query("stream_prediction_archive", "with raw as (select event_id, " + duck(PREDICTION_TEXT) + " as value from events)" + PARSED + ", r as (select j, "
       + oracle_reasons(PREDICTION_RULES) + """ from t)
select j->>'$.prediction_id' as prediction_id, j->>'$.sample_id' as sample_id, (j->>'$.snapshot_version')::bigint as snapshot_version,
  coalesce(nullif(j->>'$.runtime_slot', ''), 'unknown') as runtime_slot, (j->>'$.fail_probability')::double as fail_probability,
  (j->>'$.predicted_value')::int as predicted_value from r where reasons = ''""")
def stream_prediction_archive(spark, sf):
    folder = scratch(spark, "predictions")
    raw = stream_of_events(spark, sf, folder, True).select(
        F.concat(F.lit("s-"), F.col("user_id").cast("string")).alias("key"), spark_text(PREDICTION_TEXT).alias("value"),
        F.col("event_id").alias("arrival"),
    )
    contract = validate.prediction_contract(SAMPLE, HASH_PATTERN, len(KEYS))
    return archived(spark, raw, contract, "prediction_id", folder).select(
        "prediction_id", "sample_id", "snapshot_version", "runtime_slot", "fail_probability", "predicted_value"
    )


@query("stream_scoring", """
with newest as (select * from fx_snapshots where is_complete),
models as (select * from (values ('release', 0.2), ('shadow', 0.5)) m(runtime_slot, threshold))
select concat(runtime_slot, ':', serving_snapshot_id) as prediction_id, sample_id, snapshot_version, runtime_slot, threshold::double as threshold,
  case runtime_slot when 'release' then round(least(greatest(coalesce(f0, 0.0) / 500.0, 0.0), 1.0), 9) else round(missing_count / 5.0, 9) end as fail_probability,
  case when case runtime_slot when 'release' then least(greatest(coalesce(f0, 0.0) / 500.0, 0.0), 1.0) else missing_count / 5.0 end >= threshold
    then 1 else -1 end as predicted_value, missing_count from newest cross join models""")
def stream_scoring(spark, sf):
    """Complete snapshots, some of them delivered again, scored by the released and a shadow model; each decision is stored once."""
    folder = scratch(spark, "scoring")
    snaps = fx.snapshots(spark, sf).select(
        "event_id", "serving_snapshot_id", "sample_id", "snapshot_version", "feature_hash", "snapshot_status", "is_complete", "features"
    )
    models = {"release": scoring.Model("run-a", 0.2, first_feature), "shadow": scoring.Model("run-b", 0.5, share_missing)}
    table = Table(f"{folder}/decisions", ("prediction_id",), 16)
    step = scoring.scoring_step(models, KEYS, lambda: 5.0, table)
    run_to_end(stream_of(snaps, "event_id", "sample_id", folder, True), step, folder, "scoring")
    return table.read(spark).select(
        "prediction_id", "sample_id", "snapshot_version", "runtime_slot", "threshold", F.round("fail_probability", 9).alias("fail_probability"),
        "predicted_value", "missing_count",
    )


def first_feature(vectors):
    return np.clip(np.nan_to_num(vectors[:, 0]) / 500.0, 0.0, 1.0)


def share_missing(vectors):
    return np.isnan(vectors).mean(axis=1)


@query("stream_latest", """
select serving_snapshot_id, sample_id, snapshot_version, 7.0::double as available_at from (
  select concat('state:', sample_id, ':', cast(cast(floor(window_end * 1000) as bigint) as varchar), ':', cast(snapshot_version as varchar)) as serving_snapshot_id,
    sample_id, snapshot_version, row_number() over (partition by sample_id order by snapshot_version desc) as r from fx_folded) where r = 1""")
def stream_latest(spark, sf):
    """Assemble, record availability once, and derive the newest snapshot per sample."""
    stateful(spark)
    folder = scratch(spark, "latest")
    history = Table(f"{folder}/history", ("serving_snapshot_id",))
    patches = fx.patches_of(stream_of_events(spark, sf, folder)).select(
        "sample_id", "event_id", F.col("event_id").alias("arrival"), "event_time", "feature_group", "features"
    )
    run_to_end(assemble_stream(patches, KEYS, hashed=False), jobs.materialize_step(history, lambda: 7.0), folder, "latest")
    newest = jobs.refreshed_latest(None, history.read(spark))
    return newest.select("serving_snapshot_id", "sample_id", "snapshot_version", "available_at")


WIDE = feature_keys(590)
# A wide patch sets the 118 features of its group: feature 5 j + group is j + 1 times the event's hundredths, null for every 13th.
WIDE_CTE = """
with runs as (select p.event_id, p.sample_id, row_number() over w as snapshot_version, min(p.event_time) over w as window_start,
    max(p.event_time) over w as window_end, max(if(feature_index = 0, p.event_id, null)) over w as e0,
    max(if(feature_index = 1, p.event_id, null)) over w as e1, max(if(feature_index = 2, p.event_id, null)) over w as e2,
    max(if(feature_index = 3, p.event_id, null)) over w as e3, max(if(feature_index = 4, p.event_id, null)) over w as e4
  from fx_patches p window w as (partition by p.sample_id order by p.event_id)),
cells as (select r.event_id, 5 * j + g.i as feature, e.event_id as setter,
    case when (e.event_id + j) % 13 <> 0 then floor(e.value * 100) * (j + 1) end as v
  from runs r, lateral (values (0, e0), (1, e1), (2, e2), (3, e3), (4, e4)) g(i, e), range(0, 118) t(j), events e where e.event_id = g.e),
sums as (select event_id, count(*) as feature_count, count(v) as filled, sum(v) as value_sum, sum(v * (feature % 101)) as place_sum from cells group by 1)
"""


def wide_features():
    """The features of a wide patch, from columns of its own event."""
    groups = F.array(*[F.array(*[F.lit(k) for k in WIDE[i::5]]) for i in range(5)])
    base = F.floor(F.col("value") * 100).cast("double")
    factors = F.array(*[F.array(*[F.lit(None if (r + j) % 13 == 0 else float(j + 1)) for j in range(118)]) for r in range(13)])
    values = F.transform(F.get(factors, F.pmod("event_id", F.lit(13)).cast("int")), lambda factor: base * factor)
    return F.map_from_arrays(F.get(groups, F.col("feature_index")), values)


WIDE_HEAD = ["sample_id", "event_id", "arrival", "event_time"]


def wide_events(events):
    """Of a table or a stream: what a wide patch is made of."""
    return fx.patches_of(events, "value").select(*WIDE_HEAD[:2], F.col("event_id").alias("arrival"), "event_time", "feature_index", "value")


def wide_patches(spark, sf):
    return wide_events(fx.table(spark, sf, "events")).select(*WIDE_HEAD, wide_features().alias("features"))


def wide_sums(df, vector, keep):
    """Sums over whole vectors that tell values and places apart; whole numbers, so that their order does not matter."""
    filled = F.transform(vector, lambda v: F.coalesce(v, F.lit(0.0)))
    placed = F.transform(filled, lambda v, i: v * (i % 101))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    return df.select(*keep, total(filled).alias("value_sum"), total(placed).alias("place_sum"))


@query("assemble_wide", WIDE_CTE + """
select event_id, sample_id, snapshot_version, window_start, window_end, feature_count::int as feature_count,
  (590 - filled)::int as missing_count, feature_count = 590 as is_complete, coalesce(value_sum, 0.0) as value_sum, coalesce(place_sum, 0.0) as place_sum
from runs join sums using (event_id)""")
def assembled_wide(spark, sf):
    """Every version of every sample over 590 features."""
    folded = assemble_replay(wide_patches(spark, sf), WIDE)
    keep = ["event_id", "sample_id", "snapshot_version", "window_start", "window_end", "feature_count", "missing_count", "is_complete"]
    return wide_sums(folded, F.col("feature_values"), keep)


@query("first_complete_wide", WIDE_CTE + """
select sample_id, min(event_id) as complete_at from runs join sums using (event_id) where feature_count = 590 group by 1""")
def complete_wide(spark, sf):
    return first_complete_versions(wide_patches(spark, sf), WIDE)


@query("stream_assemble_wide", WIDE_CTE + """
select event_id, sample_id, snapshot_version, feature_count::int as feature_count, (590 - filled)::int as missing_count,
  coalesce(value_sum, 0.0) as value_sum, coalesce(place_sum, 0.0) as place_sum from runs join sums using (event_id)""")
def streamed_wide(spark, sf):
    """The same over a stream, with the state in the state store. What is stored and exchanged are events and the sums of each version's vector."""
    stateful(spark)
    folder = scratch(spark, "wide")
    arriving = wide_events(stream_of_events(spark, sf, folder))
    store = jobs.batch_append(f"{folder}/out")
    keep = [F.col("event_id").cast("bigint").alias("event_id"), "sample_id", "snapshot_version", "feature_count", "missing_count"]
    summed = lambda batch, batch_id: store(wide_sums(batch, F.map_values("features"), keep), batch_id)
    run_to_end(assemble_stream(arriving, WIDE, hashed=False, features=wide_features()), summed, folder, "wide")
    return spark.read.parquet(f"{folder}/out").drop("batch")


DIGEST_COLUMNS = ["sample_id", "serving_snapshot_id", "snapshot_version", "label_revision", "actual_label"]


@query("row_digests", COHORT_SQL + """
, texts as (select concat_ws('|', coalesce(length(sample_id::varchar) || ':' || sample_id, '-'), coalesce(length(serving_snapshot_id::varchar) || ':' || serving_snapshot_id, '-'),
    coalesce(length(snapshot_version::varchar) || ':' || snapshot_version, '-'),
    coalesce(length(label_revision::varchar) || ':' || label_revision, '-'), coalesce(length(actual_label::varchar) || ':' || actual_label, '-')) as text from members)
select sha256(text) as row_digest from texts""")
def row_digests(spark, sf):
    return datasets.with_row_digest(training_members(spark, sf), DIGEST_COLUMNS).select("row_digest")


@query("selection_digest", COHORT_SQL + """
, texts as (select sha256(concat_ws('|', coalesce(length(sample_id::varchar) || ':' || sample_id, '-'), coalesce(length(serving_snapshot_id::varchar) || ':' || serving_snapshot_id, '-'),
    coalesce(length(snapshot_version::varchar) || ':' || snapshot_version, '-'),
    coalesce(length(label_revision::varchar) || ':' || label_revision, '-'), coalesce(length(actual_label::varchar) || ':' || actual_label, '-'))) as h from members),
limbs as (select i, sum(('0x' || substr(h, 8 * i + 1, 8))::bigint) as s from texts, (select unnest(range(0, 8)) as i) group by 1)
select (select count(*) from texts) as row_count, sha256(concat((select count(*) from texts), ':', (select string_agg(s::varchar, ':' order by i) from limbs))) as digest""")
def selection(spark, sf):
    return datasets.selection_digest(training_members(spark, sf), DIGEST_COLUMNS)


@query("dataset_roundtrip", COHORT_SQL + f"""
select {', '.join('m.' + c for c in MEMBER if c != 'feature_count')}, m.label_event_id, m.actual_value,
  s.f0 as feature_000, s.f1 as feature_001, s.f2 as feature_002, s.f3 as feature_003, s.f4 as feature_004
from members m join fx_snapshots s on s.serving_snapshot_id = m.serving_snapshot_id""")
def dataset_roundtrip(spark, sf):
    """Write the training dataset with manifest and log, then load it through verification."""
    folder = scratch(spark, "dataset")
    builds = Table(f"{folder}/builds", ("dataset_id",), 0)
    cohort = training_members(spark, sf, features=True)
    small = training_config(1)
    stats = readiness.training_readiness(cohort, small)
    identity = datasets.write_dataset(
        cohort, stats, small, TRAINING_IDENTITY, datasets.TRAINING_MEMBERS, KEYS, folder, builds, CUTOFF
    )
    frame = datasets.verified_dataset(spark, folder, builds, identity.dataset_id, TRAINING_IDENTITY, KEYS)
    kept = [c for c in MEMBER if c != "feature_count"]
    return frame.select(*kept, "label_event_id", "actual_value", *model_columns(len(KEYS)))


def training_config(minimum):
    from dataclasses import replace

    return replace(CONFIG, min_labeled=minimum, min_label_coverage=0.0, min_fail_samples=1, min_pass_samples=1)


@query("dataset_audit", COHORT_SQL + """
, made as (select m.*, s.f0, s.f1, s.f2, s.f3, s.f4, case when m.snapshot_version % 5 = 0 then m.serving_missing_count + 1 else m.serving_missing_count end as stored
  from members m join fx_snapshots s on s.serving_snapshot_id = m.serving_snapshot_id)
select 'missing_count' as rule, count(*) filter (where (f0 is null)::int + (f1 is null)::int + (f2 is null)::int + (f3 is null)::int + (f4 is null)::int <> stored) as violations from made
union all select r, 0 from (values ('non_finite'), ('label_0'), ('label_1'), ('label_2'), ('label_3'), ('duplicate_keys')) v(r)""")
def dataset_audit(spark, sf):
    cohort = training_members(spark, sf, features=True)
    missing = F.col("serving_missing_count")
    made = cohort.withColumn("serving_missing_count", F.when(F.col("snapshot_version") % 5 == 0, missing + 1).otherwise(missing))
    return datasets.row_violations(widen(made, KEYS), len(KEYS), ["sample_id"])


@query("build_states", """
with log as (select concat('d', o_custkey) as dataset_id, 'training' as dataset_type, concat('h', o_custkey) as manifest_hash,
  case o_orderstatus when 'F' then 'FAILED' when 'P' then 'READY' else 'BUILDING' end as status, o_orderkey::double as recorded_at from orders)
select manifest_hash, case when max(case when status = 'READY' then 1 else 0 end) = 1 then 'READY' else arg_max(status, recorded_at) end as status from log group by 1""")
def states(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "P", "READY").otherwise("BUILDING")
    log = fx.table(spark, sf, "orders").select(
        F.lit("training").alias("dataset_type"), F.concat(F.lit("h"), F.col("o_custkey").cast("string")).alias("manifest_hash"),
        status.alias("status"), F.col("o_orderkey").cast("double").alias("recorded_at"),
    )
    return datasets.build_states(log).select("manifest_hash", "status")


@query("feature_hash", """
select count(*) as rows_, count(distinct concat_ws('|', coalesce(f0::varchar, 'n'), coalesce(f1::varchar, 'n'), coalesce(f2::varchar, 'n'), coalesce(f3::varchar, 'n'), coalesce(f4::varchar, 'n'))) as hashes,
  71 as shortest, 74 as longest from fx_snapshots""".replace("71", "74"))
def feature_hash(spark, sf):
    hashed = with_vector_hash(fx.snapshots(spark, sf).select("features"), KEYS)
    size = F.length("feature_hash")
    return hashed.agg(
        F.count(F.lit(1)).alias("rows_"), F.count_distinct("feature_hash").alias("hashes"),
        F.min(size).alias("shortest"), F.max(size).alias("longest"),
    )


@query("training_summary", COHORT_SQL + """
, chosen as (select * from members where label_event_id is not null order by snapshot_available_at desc, sample_id desc, serving_snapshot_id desc limit 10)
select (select count(*) from members) as eligible_cohort_count, (select count(label_event_id) from members) as labeled_cohort_count,
  (select arg_min(sample_id, snapshot_available_at) from members) as first_eligible_sample_id, count(*) as sample_count, count(*) filter (where actual_value = 1) as fail_count,
  min(snapshot_available_at) as decision_time_min, max(snapshot_available_at) as decision_time_max, max(label_revision) as label_revision_max,
  round(avg(serving_missing_count), 6) as serving_missing_count_avg, arg_min(sample_id, snapshot_available_at) as first_sample_id,
  arg_max(serving_snapshot_id, snapshot_available_at) as last_snapshot_id from chosen""")
def summary(spark, sf):
    cohort = training_members(spark, sf)
    chosen = quality.latest_labeled(cohort, "snapshot_available_at", ["sample_id", "serving_snapshot_id"], 10)
    found = readiness.training_summary(cohort, chosen)
    return found.select(
        "eligible_cohort_count", "labeled_cohort_count", "first_eligible_sample_id", "sample_count", "fail_count",
        "decision_time_min", "decision_time_max", "label_revision_max",
        F.round("serving_missing_count_avg", 6).alias("serving_missing_count_avg"), "first_sample_id", "last_snapshot_id",
    )


@query("stratified_split", """
select actual_value, count(*) as rows_, cast(round(0.2::double * count(*)) as bigint) as validation_rows from fx_label_volume group by 1""")
def split(spark, sf):
    rows = training.stratified_split(fx.label_volume(spark, sf), "label_event_id")
    return rows.groupBy("actual_value").agg(F.count(F.lit(1)).alias("rows_"), F.count_if("is_validation").alias("validation_rows"))


@query("train_score")
def train_score(spark, sf):
    """Train on the labeled first-complete snapshots and score all complete ones."""
    labels = labels_at(fx.labels(spark, sf), CUTOFF).select("sample_id", "actual_value")
    firsts = widen(first_complete(fx.snapshots(spark, sf)).select("sample_id", "serving_snapshot_id", "missing_count", "features"), KEYS)
    rows = firsts.join(labels, "sample_id").drop("missing_count", "serving_snapshot_id")
    result = training.train(rows, model_columns(len(KEYS)))
    return result.model.score(firsts).select("sample_id", "serving_snapshot_id", "fail_probability", "predicted_value", "predicted_label")
