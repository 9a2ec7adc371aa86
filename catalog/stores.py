"""Queries over stored tables: contracts counted while a table is written, order across files, first rows in source order."""

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.fixtures import CUTOFF, KEYS, listed, oracle
from catalog.jobs import DIGEST_COLUMNS
from catalog.ranking import COHORT_SQL, CONFIG, GATE_SQL, LENIENT, missed_sql, training_members
from proofline.constants import GATE_IDENTITY, model_columns
from proofline.functions.features import lengthen, widen
from proofline.operators import quality, stats, validate
from proofline.operators.assemble import latest_snapshots, reconstruct
from proofline.plans import cohorts, datasets, readiness
from proofline.schemas import evidence_schemas
from proofline.session import pinned, scratch
from proofline.sources import readers
from proofline.sources.sinks import Table, as_stored

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return function
    return register


# Each table with some rows broken on purpose: where they come from, what breaks each rule, and the required columns.
_RANGE = "{0} < 0 or {0} > {1}"
STORED = {
    "feature_events": ("""(select event_id::varchar as event_id, sample_id, if(event_id % 40 = 0, -1.0, event_time) as event_time,
        if(event_id % 30 = 0, '', feature_group) as feature_group, if(event_id % 17 = 0, null, 1) as features, arrived_at as created_at from fx_patches)""",
        {"event_time": "event_time < 0", "feature_group": "feature_group = ''"},
        "event_id sample_id event_time feature_group features created_at"),
    "serving_feature_snapshots": ("""(select * replace (if(event_id % 70 = 0, null, serving_snapshot_id) as serving_snapshot_id,
        if(event_id % 60 = 0, 'open', snapshot_status) as snapshot_status, if(event_id % 50 = 0, window_start - 1e9 - 1e9, window_start) as window_start),
        1 as features from fx_snapshots)""",
        {"version": "snapshot_version < 1", "times": "snapshot_time < 0 or window_start < 0 or window_end < window_start", "available_at": "available_at < 0",
         "status": "snapshot_status = 'open'", "counts": f"{_RANGE.format('feature_count', 5)} or {_RANGE.format('missing_count', 5)}",
         "complete": "is_complete and snapshot_status = 'open'"},
        "serving_snapshot_id sample_id snapshot_version feature_hash snapshot_time window_start window_end snapshot_status feature_count "
        "missing_count is_complete features available_at"),
    "offline_feature_snapshots": ("""(select sample_id as offline_snapshot_id, sample_id, {CUTOFF} as build_cutoff_time, least(count(distinct feature_index), 5) as feature_count,
        0 as missing_count, count(distinct feature_index) = 5 as is_complete, 1 as features, count(*) as source_event_count,
        max(event_time) + if(count(*) % 4 = 0, 1e9, 0) as max_event_time, 9.0 as created_at from fx_patches where event_time <= {CUTOFF} group by sample_id)""",
        {"times": "max_event_time > build_cutoff_time", "counts": "false", "complete": "false"},
        "offline_snapshot_id sample_id build_cutoff_time feature_count missing_count is_complete features source_event_count created_at"),
    "label_events": ("""(select * replace (if(label_revision % 2 = 0, 0, actual_value) as actual_value, if(label_revision = 3, null, actual_label) as actual_label)
        from fx_labels)""",
        {"revision": "label_revision < 1", "times": "measured_at < 0 or available_at < 0", "value": "actual_value = 0", "label": "actual_label not in ('pass', 'fail')"},
        "label_event_id sample_id label_revision measured_at available_at actual_value actual_label"),
    "prediction_logs": ("""(select * replace (if(latency_ms > 19, -latency_ms, latency_ms) as latency_ms, if(runtime_slot = 'shadow', null, runtime_slot) as runtime_slot,
        if(latency_ms < 1, 1.5, threshold) as threshold) from fx_predictions)""",
        {"version": "snapshot_version < 1", "time": "predicted_at < 0", "probability": _RANGE.format("fail_probability", 1), "threshold": "threshold > 1",
         "value": "predicted_value not in (-1, 1)", "label": "predicted_label not in ('pass', 'fail')", "missing": _RANGE.format("missing_count", 5),
         "latency": "latency_ms < 0"},
        "prediction_id request_id sample_id serving_snapshot_id snapshot_version feature_hash model_run_id runtime_slot predicted_at "
        "fail_probability predicted_value predicted_label threshold missing_count latency_ms"),
}
# The latest table keeps the newest version of each sample and falls under the contract of the snapshots.
STORED["latest_feature_snapshots"] = (
    STORED["serving_feature_snapshots"][0].replace("from fx_snapshots)", "from fx_snapshots s where snapshot_version = (select max(snapshot_version) from fx_snapshots o where o.sample_id = s.sample_id))"),
    *STORED["serving_feature_snapshots"][1:],
)


def _contract_sql():
    parts = []
    for table, (source, rules, required) in STORED.items():
        broken = rules | {f"null:{c}": f"{c} is null" for c in required.split()}
        names, counts = ", ".join(f"'{r}'" for r in broken), ", ".join(f"count(*) filter (where {b})" for b in broken.values())
        parts.append(
            f"select '{table}' as table_name, unnest([{names}]) as rule, n as rows_, unnest(counts) as violations "
            f"from (select count(*) as n, [{counts}] as counts from {source})"
        )
    return " union all ".join(parts)


def _stored(spark, sf):
    patches, snaps, event = fx.patches(spark, sf), fx.snapshots(spark, sf), F.col("event_id")
    faulty = snaps.withColumns({
        "serving_snapshot_id": F.when(event % 70 != 0, F.col("serving_snapshot_id")),
        "snapshot_status": F.when(event % 60 == 0, "open").otherwise(F.col("snapshot_status")),
        "window_start": F.when(event % 50 == 0, F.col("window_start") - 2e9).otherwise(F.col("window_start")),
    })
    rebuilt = reconstruct(patches.select("sample_id", "event_id", "event_time", "created_at", "features"), KEYS, CUTOFF, 9.0)
    labels, logs = fx.labels(spark, sf), fx.predictions(spark, sf, snaps)
    return {
        "feature_events": patches.withColumns({
            "event_time": F.when(event % 40 == 0, -1.0).otherwise(F.col("event_time")),
            "feature_group": F.when(event % 30 == 0, "").otherwise(F.col("feature_group")),
            "features": F.when(event % 17 != 0, F.col("features")),
        }),
        "serving_feature_snapshots": faulty,
        "latest_feature_snapshots": latest_snapshots(faulty),
        "offline_feature_snapshots": rebuilt.withColumn(
            "max_event_time", F.col("max_event_time") + F.when(F.col("source_event_count") % 4 == 0, 1e9).otherwise(0.0)
        ),
        "label_events": labels.withColumns({
            "actual_value": F.when(F.col("label_revision") % 2 == 0, 0).otherwise(F.col("actual_value")),
            "actual_label": F.when(F.col("label_revision") != 3, F.col("actual_label")),
        }),
        "prediction_logs": logs.withColumns({
            "threshold": F.when(F.col("latency_ms") < 1, 1.5).otherwise(F.col("threshold")),
            "latency_ms": F.when(F.col("latency_ms") > 19, -F.col("latency_ms")).otherwise(F.col("latency_ms")),
            "runtime_slot": F.when(F.col("runtime_slot") != "shadow", F.col("runtime_slot")),
        }),
    }


@query("table_contracts", _contract_sql())
def table_contracts(spark, sf):
    """Every rule of six tables, counted by the jobs that write them."""
    schemas, folder, report = evidence_schemas(), scratch(spark, "stored"), None
    for table, rows in _stored(spark, sf).items():
        contract = "serving_feature_snapshots" if table.startswith("latest") else table
        counted = validate.Counted(rows, table, validate.table_rules(contract, schemas[contract], n=len(KEYS)))
        counted.rows.write.parquet(f"{folder}/{table}")
        report = counted.report() if report is None else report.unionByName(counted.report())
    return report


@query("ordered_cohort", COHORT_SQL + """
select sample_id, serving_snapshot_id, snapshot_available_at, row_number() over (order by snapshot_available_at, sample_id, serving_snapshot_id) - 1 as number from members""")
def ordered_cohort(spark, sf):
    """The training cohort written in its order and read back with the place of each row."""
    folder = scratch(spark, "ordered")
    order = ["snapshot_available_at", "sample_id", "serving_snapshot_id"]
    readers.write_ordered(training_members(spark, sf).select(*order), order, folder)
    return readers.numbered(readers.ordered_rows(spark, folder)).select("sample_id", "serving_snapshot_id", "snapshot_available_at", "number")


@query("first_source_rows", """
with lines as (select l_orderkey, l_linenumber, l_quantity, row_number() over (order by l_orderkey, l_linenumber, l_quantity) as r from lineitem)
select l_orderkey, l_linenumber::int as l_linenumber, l_quantity::double as l_quantity from lines where r <= (select count(*) // 2 from lineitem)""")
def first_source_rows(spark, sf):
    """Text lines in source order: the first half of the order lines, without passing them through one place."""
    folder = scratch(spark, "source")
    rows = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    ordered = rows.orderBy("l_orderkey", "l_linenumber", "l_quantity")
    ordered.select(F.concat_ws(" ", F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_quantity").cast("double")).alias("value")).write.text(folder)
    wanted = rows.count() // 2
    part = F.split("value", " ")
    return readers.first_rows(readers.text_rows(spark, folder), wanted).select(
        part[0].cast("bigint").alias("l_orderkey"), part[1].cast("int").alias("l_linenumber"), part[2].cast("double").alias("l_quantity")
    )


@query("sensor_matrix", """
with cells as (select row_number() over (order by l_orderkey, l_linenumber, l_quantity, l_discount, l_tax) - 1 as number, l_quantity::double as v0, l_discount::double as v1,
  if(l_linenumber = 3, null, l_tax::double) as v2 from lineitem)
select * from cells""")
def sensor_matrix(spark, sf):
    """Numbers in text, NaN for a missing one, read with the place of each line."""
    folder = scratch(spark, "sensors")
    ordered = fx.table(spark, sf, "lineitem").orderBy("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    third = F.when(F.col("l_linenumber") == 3, "NaN").otherwise(F.col("l_tax").cast("double").cast("string"))
    ordered.select(F.concat_ws("  ", F.col("l_quantity").cast("double"), F.col("l_discount").cast("double"), third).alias("value")).write.text(folder)
    rows = readers.numbered(readers.sensor_matrix(spark, folder, 3))
    return rows.select("number", *[F.col("values")[i].alias(f"v{i}") for i in range(3)])


@query("label_lines", """
select row_number() over (order by o_orderkey) - 1 as number, if(o_orderstatus = 'F', 1, -1) as actual_value, if(o_orderstatus = 'F', 'fail', 'pass') as actual_label from orders""")
def label_lines(spark, sf):
    folder = scratch(spark, "label-lines")
    value = F.when(F.col("o_orderstatus") == "F", "1").otherwise("-1")
    fx.table(spark, sf, "orders").orderBy("o_orderkey").select(F.concat_ws(" ", value, F.col("o_orderdate").cast("string")).alias("value")).write.text(folder)
    return readers.numbered(readers.label_lines(spark, folder)).select("number", "actual_value", "actual_label")


@query("offline_at_cutoff", """
with sent as (select distinct sample_id, feature_index, event_time from fx_patches),
built as (select sample_id, count(distinct feature_index) as n from sent where event_time <= {CUTOFF} group by 1)
select sample_id, {CUTOFF} as build_cutoff_time, n::int as feature_count from built where n = 5""")
def offline_at_cutoff(spark, sf):
    """Of the snapshots built for two cutoffs, the complete ones of the second."""
    events = fx.patches(spark, sf).select("sample_id", "event_id", "event_time", "created_at", "features")
    both = reconstruct(events, KEYS, fx.START).unionByName(reconstruct(events, KEYS, CUTOFF))
    return readers.offline_snapshots_at(both, CUTOFF).select("sample_id", "build_cutoff_time", "feature_count")


@query("filtered_cohort", COHORT_SQL.replace("from fx_snapshots where is_complete", "from fx_snapshots where is_complete and event_id % 2 = 1 and event_id % 3 = 0")
       + "select sample_id, serving_snapshot_id, snapshot_version, label_event_id from members")
def filtered_cohort(spark, sf):
    """The cohort of one run and one segment: the first complete snapshot among theirs."""
    from dataclasses import replace

    marked = fx.snapshots(spark, sf).withColumns({
        "simulation_run_id": F.when(F.col("event_id") % 2 == 1, "odd"), "drift_segment": F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")),
    })
    config = replace(CONFIG, simulation_run_id="odd", drift_segment="m0")
    return cohorts.training_cohort(marked, fx.labels(spark, sf), config).select("sample_id", "serving_snapshot_id", "snapshot_version", "label_event_id")


SELECTED_SQL = COHORT_SQL + """
, chosen as (select * from members where label_event_id is not null order by snapshot_available_at desc, sample_id desc, serving_snapshot_id desc limit 12)
"""


def selected(spark, sf):
    cohort = training_members(spark, sf)
    return cohort, quality.latest_labeled(cohort, "snapshot_available_at", ["sample_id", "serving_snapshot_id"], 12)


@query("training_gate", SELECTED_SQL + """
, counts as (select count(*) as sample_count, (select count(label_event_id)::double / count(*) from members) as label_coverage,
  count_if(actual_value = 1) as fail_count, count_if(actual_value = -1) as pass_count from chosen)
select sample_count, fail_count::bigint as fail_count, pass_count::bigint as pass_count, """
       + missed_sql(label_coverage=0.999, sample_count=12, fail_count=100, pass_count=1) + """ as reasons, false as ready from counts""")
def gate_of_training(spark, sf):
    summary = readiness.training_summary(*selected(spark, sf))
    judged = listed(readiness.training_gate(summary, 12, 0.999, 100, 1))
    return judged.select("sample_count", "fail_count", "pass_count", "reasons", "ready")


@query("development_selection", SELECTED_SQL + """
, texts as (select sha256(concat_ws('|', length(sample_id) || ':' || sample_id, length(serving_snapshot_id) || ':' || serving_snapshot_id,
    length(snapshot_version::varchar) || ':' || snapshot_version, length(label_revision::varchar) || ':' || label_revision,
    length(actual_label) || ':' || actual_label)) as h from chosen),
limbs as (select i, sum(('0x' || substr(h, 8 * i + 1, 8))::bigint) as s from texts, (select unnest(range(0, 8)) as i) group by 1)
select (select count(*) from texts) as row_count, sha256(concat((select count(*) from texts), ':', (select string_agg(s::varchar, ':' order by i) from limbs))) as digest""")
def development_selection(spark, sf):
    """The identity of the rows a model is developed on."""
    return datasets.selection_digest(selected(spark, sf)[1], DIGEST_COLUMNS)


@query("metric_store", """
with found as (select model_run_id, threshold, count(*) as n, count_if(predicted_value = 1)::double as fails, avg(latency_ms) as latency from fx_prediction_volume group by 1, 2)
select concat(model_run_id, '@', threshold::varchar) as evaluation_id, model_run_id, threshold, m.name as metric_name, round(m.v, 6) as metric_value, n as n_predictions,
  'all' as window_type, 7.0::double as computed_at from found, lateral (values ('predicted_fail_count', fails), ('latency_ms_mean', latency)) m(name, v)""")
def metric_store(spark, sf):
    """Metrics in the columns and types of their table, stored twice under one key."""
    schema = evidence_schemas()["prediction_window_metrics"]
    found = fx.prediction_volume(spark, sf).groupBy("model_run_id", "threshold").agg(
        F.count(F.lit(1)).alias("n_predictions"), F.count_if(F.col("predicted_value") == 1).alias("predicted_fail_count"),
        F.avg("latency_ms").alias("latency_ms_mean"),
    ).withColumn("evaluation_id", F.concat_ws("@", "model_run_id", "threshold"))
    long = quality.metric_rows(found, ["evaluation_id", "model_run_id", "threshold", "n_predictions"], ["predicted_fail_count", "latency_ms_mean"])
    rows = as_stored(long, schema, window_type="all", computed_at=7.0, created_at=7.0)
    table = Table(f"{scratch(spark, 'metrics')}/store", ("evaluation_id", "metric_name"), 8)
    table.insert_ignore(rows, ["computed_at"])
    table.insert_ignore(rows.withColumn("computed_at", F.lit(8.0)), ["computed_at"])
    return table.read(spark).withColumn("metric_value", F.round("metric_value", 6)).select(
        "evaluation_id", "model_run_id", "threshold", "metric_name", "metric_value", "n_predictions", "window_type", "computed_at"
    )


@query("sparse_feature_stats", """
with cells as (select g.i as feature_index, if(p.feature_index = g.i, p.feature_value, null) as v from fx_patches p, range(0, 5) g(i))
select cells.feature_index::int as feature_index, concat('f00', cells.feature_index) as feature_name, count(*) as samples, count_if(v is null)::bigint as null_count,
  count(v) as non_null, round(avg(v), 6) as mean from cells group by cells.feature_index""")
def sparse_feature_stats(spark, sf):
    """Statistics over patches that name one feature each, under changing spellings: every patch counts for every feature."""
    spelled = F.transform_keys("features", lambda k, _: F.when(F.col("event_id") % 2 == 0, k).otherwise(F.concat(F.lit("feature_"), F.substring(k, 2, 3))))
    rows = fx.patches(spark, sf).withColumn("features", spelled)
    found = stats.feature_stats(lengthen(rows, [], width=len(KEYS)), [])
    return found.select("feature_index", "feature_name", "samples", "null_count", "non_null", F.round("mean", 6).alias("mean"))


SOUND_SQL = GATE_SQL + """
, sound as (select * from members where not identity_conflict and found_snapshot_id is not null and found_feature_hash = feature_hash
  and is_complete and snapshot_available_at <= predicted_at)
"""
GATE_STORED = ["prediction_id", "request_id", "source_model_run_id", "runtime_slot", "source_threshold", "predicted_at", "sample_id",
               "serving_snapshot_id", "snapshot_version", "feature_hash", "snapshot_available_at", "serving_missing_count",
               "label_event_id", "label_revision", "actual_value", "actual_label"]


@query("gate_dataset", SOUND_SQL + f"""
, builds as (select 2 as log_entries)
select {', '.join('m.' + c for c in GATE_STORED)}, s.f0 as feature_000, s.f1 as feature_001, s.f2 as feature_002, s.f3 as feature_003, s.f4 as feature_004,
  log_entries from sound m join fx_snapshots s on s.serving_snapshot_id = m.serving_snapshot_id cross join builds""")
def gate_dataset(spark, sf):
    """The dataset a candidate is judged on: written, asked for again (the stored one is used), loaded through verification."""
    folder = scratch(spark, "gate")
    snaps = fx.snapshots(spark, sf)
    whole = cohorts.gate_cohort(fx.predictions(spark, sf, snaps), snaps, fx.labels(spark, sf), CONFIG, features=True)
    sound = pinned(cohorts.gate_violations(whole, len(KEYS)).where(F.size("violations") == 0).drop("violations"))
    builds = Table(f"{folder}/builds", ("dataset_id",), 0)
    stats_row = readiness.gate_readiness(sound, LENIENT)
    made = [
        datasets.write_dataset(sound, stats_row, LENIENT, GATE_IDENTITY, datasets.GATE_MEMBERS, KEYS, folder, builds, at) for at in (CUTOFF, CUTOFF + 60)
    ]
    if made[0] != made[1]:
        raise RuntimeError("the same members have two identities")
    frame = datasets.verified_dataset(spark, folder, builds, made[0].dataset_id, GATE_IDENTITY, KEYS, ("prediction_id",))
    entries = F.lit(builds.read(spark).count()).cast("int").alias("log_entries")  # BUILDING and READY, once each
    return frame.select(*GATE_STORED, *model_columns(len(KEYS)), entries)


@query("gate_dataset_rules", SOUND_SQL + """
, rules as (select unnest(['missing_count', 'non_finite', 'label_0', 'label_1', 'label_2', 'label_3', 'duplicate_keys']) as rule)
select rule, case rule when 'missing_count' then (select count(*) from sound where snapshot_version % 3 = 0)
  when 'label_0' then (select count(*) from sound where snapshot_version % 4 = 0 and label_event_id is not null)
  when 'duplicate_keys' then (select count(*) from (select request_id from sound group by 1 having count(*) > 1)) else 0 end as violations from rules""")
def gate_dataset_rules(spark, sf):
    """Rules of a stored dataset against rows broken on purpose."""
    snaps = fx.snapshots(spark, sf)
    whole = cohorts.gate_cohort(fx.predictions(spark, sf, snaps), snaps, fx.labels(spark, sf), CONFIG, features=True)
    sound = cohorts.gate_violations(whole, len(KEYS)).where(F.size("violations") == 0)
    wide = widen(sound, KEYS)
    broken = wide.withColumns({
        "serving_missing_count": F.col("serving_missing_count") + F.when(F.col("snapshot_version") % 3 == 0, 1).otherwise(0),
        "label_event_id": F.when(F.col("snapshot_version") % 4 != 0, F.col("label_event_id")),
    })
    return datasets.row_violations(broken, len(KEYS), ["request_id"])
