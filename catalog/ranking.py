"""Queries over ranking, assembly, cohorts and maturity, each next to its SQL twin."""

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.fixtures import CUTOFF, DAY, KEYS, MATURITY, START, WINDOW, listed, oracle
from proofline.functions.features import lengthen
from proofline.operators import latest
from proofline.operators.assemble import assemble_replay, latest_snapshots, reconstruct
from proofline.plans import cohorts, maturity, readiness

CONFIG = cohorts.CohortConfig(
    cohort_start_time=START, cutoff_time=CUTOFF, label_maturity_seconds=MATURITY, min_labeled=100,
    min_label_coverage=0.5, min_fail_samples=20, min_pass_samples=20, min_decisions=100,
)
STRICT = cohorts.CohortConfig(
    cohort_start_time=START, cutoff_time=CUTOFF, label_maturity_seconds=MATURITY, min_labeled=10_000_000,
    min_label_coverage=0.99, min_fail_samples=20, min_pass_samples=10_000_000, min_decisions=10_000_000,
)
LENIENT = cohorts.CohortConfig(
    cohort_start_time=START, cutoff_time=CUTOFF, label_maturity_seconds=MATURITY, min_labeled=5, min_label_coverage=0.1,
    min_fail_samples=1, min_pass_samples=1, min_decisions=10,
)
SNAPSHOT = ["serving_snapshot_id", "sample_id", "snapshot_version", "feature_hash", "available_at", "missing_count"]
LABEL = ["label_event_id", "label_revision", "label_measured_at", "label_available_at", "actual_value", "actual_label"]
MEMBER = ["sample_id", "serving_snapshot_id", "snapshot_version", "feature_hash", "snapshot_available_at",
          "window_start", "window_end", "feature_count", "serving_missing_count"]

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return function
    return register


@query("assemble_replay", """
with observed as (
  select f.*, p.key_, p.present_, p.value_ from fx_folded f,
    lateral (values ('f000', s0, f0), ('f001', s1, f1), ('f002', s2, f2), ('f003', s3, f3), ('f004', s4, f4)) p(key_, present_, value_))
select event_id, feature_group, concat('state:', sample_id, ':', cast(cast(floor(window_end * 1000) as bigint) as varchar), ':',
    cast(snapshot_version as varchar)) as serving_snapshot_id, sample_id, snapshot_version, window_start, window_end,
  cast(sum(present_) over (partition by event_id) as int) as feature_count, key_ as feature_name, value_ as value,
  case when min(present_) over (partition by event_id) = 1 then 'complete' else 'partial' end as snapshot_status,
  cast(sum(case when value_ is null then 1 else 0 end) over (partition by event_id) as int) as missing_count
from observed""")
def assembled(spark, sf):
    patches = fx.patches(spark, sf).select(
        "sample_id", "event_id", F.col("event_id").alias("arrival"), "event_time", "feature_group", "features"
    )
    keep = ["event_id", "feature_group", "serving_snapshot_id", "sample_id", "snapshot_version", "window_start",
            "window_end", "feature_count", "snapshot_status", "missing_count"]
    return lengthen(assemble_replay(patches, KEYS), keep).drop("feature_index")


@query("latest_snapshots", """
select serving_snapshot_id, sample_id, snapshot_version, feature_hash, available_at, missing_count from fx_snapshots s
where not exists (select 1 from fx_snapshots o where o.sample_id = s.sample_id and o.snapshot_version > s.snapshot_version)""")
def newest(spark, sf):
    return latest_snapshots(fx.snapshots(spark, sf)).select(*SNAPSHOT)


@query("reconstruct_as_of", """
with seen as (select *, row_number() over (partition by sample_id, feature_index order by event_time desc, arrived_at desc, event_id desc) as r
  from fx_patches where event_time <= {CUTOFF}),
counted as (select sample_id, count(*) as source_event_count, max(event_time) as max_event_time from fx_patches where event_time <= {CUTOFF} group by 1),
grid as (select c.*, k.i from counted c, (select unnest(range(0, 5)) as i) k)
select concat('offline:', g.sample_id, ':', printf('%.6f', {CUTOFF})) as offline_snapshot_id, g.sample_id, g.source_event_count, g.max_event_time,
  concat('f00', cast(g.i as varchar)) as feature_name, s.feature_value as value,
  cast(count(s.sample_id) over (partition by g.sample_id) as int) as feature_count,
  cast(sum(case when s.feature_value is null then 1 else 0 end) over (partition by g.sample_id) as int) as missing_count,
  count(s.sample_id) over (partition by g.sample_id) = 5 as is_complete
from grid g left join seen s on s.sample_id = g.sample_id and s.feature_index = g.i and s.r = 1""")
def rebuilt(spark, sf):
    events = fx.patches(spark, sf).select("sample_id", "event_id", "event_time", "created_at", "features")
    keep = ["offline_snapshot_id", "sample_id", "source_event_count", "max_event_time", "feature_count",
            "missing_count", "is_complete"]
    return lengthen(reconstruct(events, KEYS, CUTOFF), keep).drop("feature_index")


@query("first_complete_snapshot", """
with ranked as (select *, row_number() over (partition by sample_id order by available_at, snapshot_version, serving_snapshot_id) as r
  from fx_snapshots where is_complete and snapshot_status = 'complete')
select serving_snapshot_id, sample_id, snapshot_version, feature_hash, available_at, missing_count from ranked where r = 1""")
def first_complete(spark, sf):
    return latest.first_complete(fx.snapshots(spark, sf)).select(*SNAPSHOT)


@query("label_at_cutoff", """
select l.* from fx_labels l where available_at <= {CUTOFF} and not exists (
  select 1 from fx_labels o where o.sample_id = l.sample_id and o.available_at <= {CUTOFF} and o.label_revision > l.label_revision)""")
def label_at_cutoff(spark, sf):
    return latest.labels_at(fx.labels(spark, sf), CUTOFF)


@query("first_release_decision", """
with ranked as (select p.*, row_number() over (partition by sample_id, snapshot_version order by predicted_at, prediction_id) as r,
    exists (select 1 from fx_predictions c where c.runtime_slot = 'release' and c.sample_id = p.sample_id
      and c.snapshot_version = p.snapshot_version
      and (c.serving_snapshot_id <> p.serving_snapshot_id or c.feature_hash <> p.feature_hash)) as identity_conflict
  from fx_predictions p where p.runtime_slot = 'release')
select prediction_id, sample_id, snapshot_version, serving_snapshot_id, feature_hash, predicted_at, identity_conflict
from ranked where r = 1""")
def release_decisions(spark, sf):
    return latest.first_release_decisions(fx.predictions(spark, sf)).select(
        "prediction_id", "sample_id", "snapshot_version", "serving_snapshot_id", "feature_hash", "predicted_at",
        "identity_conflict",
    )


@query("conflicting_identity", """
with made as (select * replace (case when ends_with(prediction_id, '-r') and cast(request_id as bigint) % 2 = 0 then 'h:other' else feature_hash end as feature_hash)
  from fx_predictions)
select p.prediction_id, p.sample_id, p.snapshot_version, p.feature_hash from made p where p.runtime_slot = 'release' and exists (
  select 1 from made c where c.runtime_slot = 'release' and c.sample_id = p.sample_id and c.snapshot_version = p.snapshot_version
    and (c.serving_snapshot_id <> p.serving_snapshot_id or c.feature_hash <> p.feature_hash))""")
def conflicts(spark, sf):
    rows = fx.predictions(spark, sf)
    other = F.col("prediction_id").endswith("-r") & (F.col("request_id").cast("bigint") % 2 == 0)
    made = rows.withColumn("feature_hash", F.when(other, "h:other").otherwise(F.col("feature_hash")))
    return latest.conflicting_identities(made).select("prediction_id", "sample_id", "snapshot_version", "feature_hash")


@query("first_model_decision", """
select prediction_id, model_run_id, threshold, sample_id, predicted_at from fx_predictions p where not exists (
  select 1 from fx_predictions e where e.model_run_id = p.model_run_id and e.threshold = p.threshold and e.sample_id = p.sample_id
    and e.serving_snapshot_id = p.serving_snapshot_id and e.snapshot_version = p.snapshot_version
    and (e.predicted_at < p.predicted_at or (e.predicted_at = p.predicted_at and e.prediction_id < p.prediction_id)))""")
def model_decisions(spark, sf):
    return latest.first_decisions(fx.predictions(spark, sf)).select(
        "prediction_id", "model_run_id", "threshold", "sample_id", "predicted_at"
    )


@query("resolved_predictions", """
select p.prediction_id, p.sample_id, p.snapshot_version, p.model_run_id, p.predicted_at from fx_predictions p
join fx_snapshots s on s.serving_snapshot_id = p.serving_snapshot_id and s.sample_id = p.sample_id
  and s.snapshot_version = p.snapshot_version and s.feature_hash = p.feature_hash""")
def resolved(spark, sf):
    snaps = fx.snapshots(spark, sf)
    return latest.resolved_predictions(fx.predictions(spark, sf, snaps), snaps).select(
        "prediction_id", "sample_id", "snapshot_version", "model_run_id", "predicted_at"
    )


# What is known of a sample at the cutoff: among its visible labels the one of the greatest revision.
KNOWN_SQL = """known as (
  select sample_id, arg_max(label_event_id, label_revision) as label_event_id, max(label_revision) as label_revision,
    arg_max(measured_at, label_revision) as label_measured_at, arg_max(available_at, label_revision) as label_available_at,
    arg_max(actual_value, label_revision) as actual_value, arg_max(actual_label, label_revision) as actual_label
  from fx_labels where available_at <= {CUTOFF} group by sample_id)"""
# A sample's entry is the least (time, version, id) of its complete snapshots; it counts if its time lies in the cohort.
COHORT_SQL = f"""
with {KNOWN_SQL},
entries as (
  select min(row(available_at, snapshot_version, serving_snapshot_id)) as entry from fx_snapshots where is_complete group by sample_id),
members as (
  select s.* exclude (available_at, missing_count), s.available_at as snapshot_available_at, s.missing_count as serving_missing_count,
    k.* exclude (sample_id)
  from entries e join fx_snapshots s on (s.available_at, s.snapshot_version, s.serving_snapshot_id) = e.entry
    left join known k using (sample_id)
  where s.available_at between {{START}} and {{CUTOFF}} - {{MATURITY}} and s.available_at <> {{CUTOFF}} - {{MATURITY}})
"""


def training_members(spark, sf, features=False):
    return cohorts.training_cohort(fx.snapshots(spark, sf), fx.labels(spark, sf), CONFIG, features)


@query("training_cohort", COHORT_SQL + f"select {', '.join(MEMBER + LABEL)} from members")
def training(spark, sf):
    return training_members(spark, sf).select(*MEMBER, *LABEL)


@query("training_features", COHORT_SQL + """
select m.sample_id, m.actual_value, s.f0 as feature_000, s.f1 as feature_001, s.f2 as feature_002, s.f3 as feature_003, s.f4 as feature_004
from members m join fx_snapshots s on s.serving_snapshot_id = m.serving_snapshot_id""")
def training_wide(spark, sf):
    from proofline.functions.features import widen

    return widen(training_members(spark, sf, True).select("sample_id", "actual_value", "features"), KEYS)


def missed_sql(**minimums):
    """The figures below their minimum, as ``listed`` writes them."""
    lines = ", ".join(f"('{name}', {least}::double, {name}::double)" for name, least in minimums.items())
    return f"coalesce((select string_agg(printf('%s %.6f %.6f', c, need, got), '; ' order by c) from (values {lines}) g(c, need, got) where got < need), '')"


def readiness_sql(labeled, coverage, fail, passed):
    missed = missed_sql(labeled_sample_count=labeled, label_coverage=coverage, fail_count=fail, pass_count=passed)
    return COHORT_SQL + f"""
, counts as (select count(*) as eligible_sample_count, count(label_event_id) as labeled_sample_count,
    count_if(actual_value = 1) as fail_count, count_if(actual_value = -1) as pass_count, min(snapshot_time) as snapshot_time_min,
    max(snapshot_time) as snapshot_time_max, min(snapshot_available_at) as snapshot_available_at_min,
    max(snapshot_available_at) as snapshot_available_at_max, min(label_available_at) as label_available_at_min,
    max(label_available_at) as label_available_at_max, coalesce(count(label_event_id)::double / nullif(count(*), 0), 0) as label_coverage from members),
judged as (select *, {missed} as reasons from counts)
select * exclude (label_coverage, fail_count, pass_count), fail_count::bigint as fail_count, pass_count::bigint as pass_count,
  eligible_sample_count - labeled_sample_count as unlabeled_sample_count, round(label_coverage, 6) as label_coverage, reasons = '' as ready from judged"""


def flat(df):
    return listed(df).withColumn("label_coverage", F.round("label_coverage", 6))


@query("readiness_training", readiness_sql(100, 0.5, 20, 20))
def ready(spark, sf):
    return flat(readiness.training_readiness(training_members(spark, sf), CONFIG))


@query("readiness_training_refused", readiness_sql(10_000_000, 0.99, 20, 10_000_000))
def refused(spark, sf):
    return flat(readiness.training_readiness(training_members(spark, sf), STRICT))


# All release decisions on a snapshot version are one decision, the earliest; they conflict if they name several snapshots or hashes.
GATE_SQL = f"""
with {KNOWN_SQL},
decided as (
  select min(row(predicted_at, prediction_id)) as entry,
    min(serving_snapshot_id) <> max(serving_snapshot_id) or min(feature_hash) <> max(feature_hash) as identity_conflict
  from fx_predictions where runtime_slot = 'release' group by sample_id, snapshot_version),
members as (
  select p.* exclude (model_run_id, threshold, missing_count), p.model_run_id as source_model_run_id, p.threshold as source_threshold,
    d.identity_conflict, s.serving_snapshot_id as found_snapshot_id, s.feature_hash as found_feature_hash, s.snapshot_status,
    s.is_complete, s.feature_count, s.missing_count as serving_missing_count, s.available_at as snapshot_available_at, k.* exclude (sample_id)
  from decided d join fx_predictions p on (p.predicted_at, p.prediction_id) = d.entry
    left join fx_snapshots s using (serving_snapshot_id, sample_id, snapshot_version)
    left join known k using (sample_id)
  where p.predicted_at between {{START}} and {{CUTOFF}} - {{MATURITY}} and p.predicted_at <> {{CUTOFF}} - {{MATURITY}})
"""
GATE_COLUMNS = ["prediction_id", "request_id", "sample_id", "serving_snapshot_id", "snapshot_version", "feature_hash",
                "source_model_run_id", "runtime_slot", "source_threshold", "predicted_at",
                "identity_conflict", "found_snapshot_id", "found_feature_hash",
                "snapshot_status", "is_complete", "feature_count", "serving_missing_count", "snapshot_available_at", *LABEL]


def gate_members(spark, sf):
    snaps = fx.snapshots(spark, sf)
    return cohorts.gate_cohort(fx.predictions(spark, sf, snaps), snaps, fx.labels(spark, sf), CONFIG)


@query("gate_cohort", GATE_SQL + f"select {', '.join(GATE_COLUMNS)} from members")
def gate(spark, sf):
    return gate_members(spark, sf).select(*GATE_COLUMNS)


@query("val_gate_members", GATE_SQL + """
select prediction_id, concat_ws(',', case when identity_conflict then 'conflicting_identity' end,
  case when found_snapshot_id is null then 'snapshot_missing' end,
  case when found_feature_hash <> feature_hash then 'hash_mismatch' end,
  case when not (snapshot_status = 'complete' and is_complete) then 'not_complete' end,
  case when feature_count <> 5 then 'feature_count' end,
  case when snapshot_available_at > predicted_at then 'available_after_decision' end) as violations from members""")
def gate_rules(spark, sf):
    checked = cohorts.gate_violations(gate_members(spark, sf), len(KEYS))
    return checked.select("prediction_id", F.array_join("violations", ",").alias("violations"))


def gate_readiness_sql(decisions, labeled, coverage, fail, passed):
    missed = missed_sql(decision_count=decisions, labeled_decision_count=labeled, label_coverage=coverage, fail_count=fail, pass_count=passed)
    return GATE_SQL + f"""
, counts as (select count(*) as decision_count, count(label_event_id) as labeled_decision_count,
    count(distinct sample_id) as unique_sample_count, count_if(actual_value = 1)::bigint as fail_count,
    count_if(actual_value = -1)::bigint as pass_count, min(predicted_at) as decision_time_min, max(predicted_at) as decision_time_max,
    array_to_string(list_sort(list_distinct(list(source_model_run_id))), ',') as source_model_run_ids,
    count(label_event_id)::double / count(*) as label_coverage from members),
judged as (select *, {missed} as reasons from counts)
select * replace (round(label_coverage, 6) as label_coverage), decision_count - labeled_decision_count as unlabeled_decision_count,
  reasons = '' as ready from judged"""


def gate_ready(spark, sf, config):
    result = flat(readiness.gate_readiness(gate_members(spark, sf), config))
    return result.withColumn("source_model_run_ids", F.array_join("source_model_run_ids", ",")).select(
        "decision_count", "labeled_decision_count", "unlabeled_decision_count", "unique_sample_count", "fail_count",
        "pass_count", "decision_time_min", "decision_time_max", "source_model_run_ids", "label_coverage", "ready", "reasons",
    )


@query("readiness_gate", gate_readiness_sql(10_000_000, 10_000_000, 0.99, 20, 10_000_000))
def gate_refused(spark, sf):
    return gate_ready(spark, sf, STRICT)


@query("readiness_gate_ready", gate_readiness_sql(10, 5, 0.1, 1, 1))
def gate_accepted(spark, sf):
    return gate_ready(spark, sf, LENIENT)


# A decision is repeated if all its keys are; the earliest of the repeats counts, wherever in time it lies.
LIVE_SQL = f"""
with {KNOWN_SQL},
decided as (select min(row(predicted_at, prediction_id)) as entry from fx_predictions
  group by model_run_id, threshold, sample_id, serving_snapshot_id, snapshot_version),
scored as (
  select p.prediction_id, p.sample_id, p.model_run_id, p.threshold, p.predicted_at, p.fail_probability, p.predicted_value,
    k.label_event_id, k.label_revision, k.actual_value
  from decided d join fx_predictions p on (p.predicted_at, p.prediction_id) = d.entry left join known k using (sample_id)
  where {{CUTOFF}} - p.predicted_at > {{MATURITY}} and {{CUTOFF}} - p.predicted_at <= {{MATURITY}} + {{WINDOW}})
"""


def live_members(spark, sf):
    return cohorts.live_cohort(fx.predictions(spark, sf), fx.labels(spark, sf), CUTOFF, MATURITY, WINDOW)


LIVE = ["prediction_id", "sample_id", "model_run_id", "threshold", "predicted_at", "fail_probability",
        "predicted_value", "label_event_id", "label_revision", "actual_value"]


@query("live_cohort", LIVE_SQL + "select * from scored")
def live(spark, sf):
    return live_members(spark, sf).select(*LIVE)


@query("periodic_cohorts", """
with firsts as (select * from (select *, row_number() over (partition by sample_id order by available_at, snapshot_version, serving_snapshot_id) as r
  from fx_snapshots where is_complete) where r = 1),
intervals as (select distinct cast(floor((available_at + {MATURITY}) / {DAY}) as bigint) as i from firsts),
members as (select f.*, n.i * {DAY} as interval_start, (n.i + 1) * {DAY} as cutoff_time from intervals n join firsts f
  on f.available_at >= n.i * {DAY} - {MATURITY} and f.available_at < (n.i + 1) * {DAY} - {MATURITY})
select m.sample_id, m.serving_snapshot_id, m.interval_start, m.cutoff_time, l.label_event_id, l.label_revision, l.actual_value
from members m left join fx_labels l on l.sample_id = m.sample_id and l.available_at <= m.cutoff_time
  and not exists (select 1 from fx_labels o where o.sample_id = l.sample_id and o.available_at <= m.cutoff_time and o.label_revision > l.label_revision)""")
def periodic(spark, sf):
    return cohorts.periodic_cohorts(fx.snapshots(spark, sf), fx.labels(spark, sf), DAY, MATURITY).select(
        "sample_id", "serving_snapshot_id", "interval_start", "cutoff_time", "label_event_id", "label_revision", "actual_value"
    )


@query("label_maturity", """
with ages as (select unnest(range(0, 11))::int as age),
offline as (select 'offline' as maturity_scope, sample_id, available_at as anchor_at, null::varchar as model_run_id from (
  select *, row_number() over (partition by sample_id order by available_at, snapshot_version, serving_snapshot_id) as r
  from fx_snapshots where is_complete) where r = 1),
serving as (select 'serving' as maturity_scope, sample_id, predicted_at as anchor_at, model_run_id from (
  select *, row_number() over (partition by model_run_id, threshold, sample_id, serving_snapshot_id, snapshot_version order by predicted_at, prediction_id) as r
  from fx_predictions where runtime_slot = 'release') where r = 1),
arrivals as (select sample_id, min(available_at) as first_at from fx_labels where available_at <= {CUTOFF} group by 1),
observed as (select a.*, f.first_at, floor((a.anchor_at - 60.0) / {DAY}) * {DAY} + 60.0 as cohort_start
  from (select * from offline union all select * from serving) a left join arrivals f using (sample_id) where a.anchor_at <= {CUTOFF}),
counted as (select maturity_scope, cohort_start, cohort_start + {DAY} as cohort_end, age, count(*) as size,
    count(*) filter (where first_at <= anchor_at + age * {DAY}) as labeled, nullif(count(distinct model_run_id), 0) as model_run_count,
    {CUTOFF} >= cohort_start + {DAY} + age * {DAY} as is_observable
  from observed cross join ages group by 1, 2, 3, 4)
select maturity_scope, cohort_start, cohort_end, age, cohort_end + age * {DAY} as observable_at, {CUTOFF} >= cohort_end as cohort_closed,
  size as cohort_size_seen_at_refresh, case when {CUTOFF} >= cohort_end then size end as cohort_size,
  case when is_observable then labeled end as labeled_count, case when is_observable then size - labeled end as unlabeled_count,
  case when is_observable then round(labeled::double / size, 6) end as label_coverage, model_run_count, is_observable,
  case when {CUTOFF} < cohort_end then 'open' when {CUTOFF} < cohort_end + 10 * {DAY} then 'observing' else 'complete' end as cohort_status,
  {CUTOFF}::double as computed_at from counted""")
def maturity_curve(spark, sf):
    snaps = fx.snapshots(spark, sf)
    return maturity.label_maturity(
        snaps, fx.predictions(spark, sf, snaps), fx.labels(spark, sf), CUTOFF, DAY, 60.0, DAY, 10
    )


@query("first_label_arrival", """
select sample_id, min(available_at) as first_label_available_at from fx_labels where available_at >= 0 and available_at <= {CUTOFF} group by 1""")
def arrivals(spark, sf):
    return latest.first_label_arrivals(fx.labels(spark, sf), CUTOFF)
