"""Queries over raw events, tables, scalars, features and roll-ups, each next to its SQL twin."""

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.fixtures import CUTOFF, DAY, KEYS, START, oracle
from proofline.constants import HASH_PATTERN
from proofline.functions import features as feat
from proofline.functions import scalars as sc
from proofline.operators import rollups, validate
from proofline.operators.latest import rows_of_latest
from proofline.operators.stats import median_values
from proofline.sources import sinks

QUERIES, ORACLES = {}, {}
SAMPLE = r"^s-\d+$"


def query(name, sql=None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return function
    return register


# Raw events: the same JSON text in both engines, broken in a different way for every residue of the id.
FEATURE_TEXT = """case event_id % 23
  when 0 then 'oops' when 1 then '[1]' when 4 then concat(h, '{}}') when 12 then concat(h, '[]}')
  when 15 then concat(h, '{"f002":null}}') when 16 then concat('{"event_id":"e', cast(event_id as {STR}), '","sample_id":"s-1","feature_group":"view","features":{"f000":1}}')
  when 5 then concat(h, '{"f9x":1.5}}') when 10 then concat(h, '{"f007":1.5}}') when 6 then concat(h, '{"f001":"x","f002":3}}')
  when 13 then concat(h, '{"f001":1},"created_at":"late"}') when 14 then concat(h, '{"f001":1},"simulation_run_id":7,"drift_segment":""}')
  else concat(h, '{"f000":', cast(event_id % 50 as {STR}), '.25,"f001":', cast(event_id % 9 as {STR}), '}}') end"""
FEATURE_HEAD = """concat('{"event_id":"e', cast(event_id as {STR}), '","sample_id":',
  case event_id % 23 when 2 then '5' when 11 then '"  "' when 17 then '"x-1"' else concat('"s-', cast(user_id as {STR}), '"') end, ',"event_time":',
  case event_id % 23 when 3 then '"12"' when 8 then '-3.5' else concat(cast(event_id as {STR}), '.5') end, ',"feature_group":"',
  case event_id % 23 when 7 then 'unknown' else event_type end, '","features":')"""
EVENT_KEY = "case event_id % 23 when 9 then 'other' when 18 then null else concat('s-', cast(user_id as {STR})) end"


def duck(text):
    return text.replace("{STR}", "varchar")


def spark_text(text):
    return F.expr(text.replace("{STR}", "string"))


PARSED = """, p as (select *, case when json_valid(value) then json(value) end as j from raw),
t as (select *, json_type(j) = 'OBJECT' as ok from p)"""


def blank_text(path, optional=False):
    missing = f"json_type(j, '$.{path}') is null or json_type(j, '$.{path}') = 'NULL'"
    bad = f"json_type(j, '$.{path}') <> 'VARCHAR' or trim(j->>'$.{path}') = ''"
    return f"not ({missing}) and ({bad})" if optional else f"({missing}) or ({bad})"


def number(path, kinds="'BIGINT', 'UBIGINT', 'DOUBLE'"):
    return f"coalesce(json_type(j, '$.{path}') not in ({kinds}), true)"


def integer(path):
    return number(path, "'BIGINT', 'UBIGINT'")


def oracle_reasons(rules):
    lines = [f"case when {'' if name == 'payload' else 'ok and '}({rule}) then '{name}' end" for name, rule in rules]
    return "concat_ws(',', " + ",\n  ".join(lines) + ") as reasons"


FEATURE_RULES = [
    ("payload", "not coalesce(ok, false)"), ("field:event_id", blank_text("event_id")), ("field:sample_id", blank_text("sample_id")),
    ("field:event_time", number("event_time")), ("field:feature_group", blank_text("feature_group")),
    ("field:features", "coalesce(json_type(j, '$.features') <> 'OBJECT', true)"),
    ("field:simulation_run_id", "json_type(j, '$.simulation_run_id') not in ('VARCHAR', 'NULL')"),
    ("field:created_at", "json_type(j, '$.created_at') not in ('BIGINT', 'UBIGINT', 'DOUBLE', 'NULL')"),
    ("pattern:sample_id", "json_type(j, '$.sample_id') = 'VARCHAR' and trim(j->>'$.sample_id') <> '' and not regexp_full_match(j->>'$.sample_id', 's-[0-9]+')"),
    ("key", "key is not null and json_type(j, '$.sample_id') = 'VARCHAR' and trim(j->>'$.sample_id') <> '' and key <> (j->>'$.sample_id')"),
    ("range:event_time", "json_type(j, '$.event_time') in ('BIGINT', 'UBIGINT', 'DOUBLE') and (j->>'$.event_time')::double < 0"),
    ("enum:feature_group", "(j->>'$.feature_group') not in ('view', 'click', 'purchase', 'signup', 'error')"),
    ("features_empty", "json_type(j, '$.features') = 'OBJECT' and len(json_keys(j, '$.features')) = 0"),
    ("feature_key", "len(list_filter(json_keys(j, '$.features'), lambda k: not regexp_full_match(k, 'f00[0-4]'))) > 0"),
    ("feature_value", "len(list_filter(json_keys(j, '$.features'), lambda k: json_type(j, '$.features.' || k) not in ('BIGINT', 'UBIGINT', 'DOUBLE', 'NULL'))) > 0"),
]


@query("val_feature_rules", "with raw as (select event_id, " + duck(EVENT_KEY) + " as key, " + duck(FEATURE_TEXT) + " as value from (select *, "
       + duck(FEATURE_HEAD) + " as h from events))" + PARSED + " select event_id, " + oracle_reasons(FEATURE_RULES) + " from t")
def val_features(spark, sf):
    rows = fx.spread(fx.table(spark, sf, "events")).withColumn("h", spark_text(FEATURE_HEAD))
    raw = rows.select("event_id", spark_text(EVENT_KEY).alias("key"), spark_text(FEATURE_TEXT).alias("value"))
    contract = validate.feature_event_contract(SAMPLE, fx.EVENT_TYPES, len(KEYS), 0.0)
    checked = validate.check(raw.withColumnRenamed("event_id", "place"), contract)
    return checked.select(F.col("place").alias("event_id"), F.array_join("reasons", ",").alias("reasons"))


LABEL_TEXT = """case o_orderkey % 17 when 0 then '' when 1 then '{"label_event_id"' else concat('{"label_event_id":"', cast(o_orderkey as {STR}), '","sample_id":"s-',
  cast(o_custkey as {STR}), '","label_revision":', case o_orderkey % 17 when 2 then '1.5' when 3 then '0' when 4 then '"1"' when 5 then '3000000000' else '2' end,
  ',"measured_at":', case o_orderkey % 17 when 6 then '-1' when 7 then 'null' else '12.5' end, ',"actual_value":',
  case o_orderkey % 17 when 8 then '2' when 9 then '3000000000' when 10 then 'true' when 11 then '-1' else '1' end, ',"actual_label":"',
  case o_orderkey % 17 when 12 then 'pass' when 13 then ' ' when 11 then 'pass' else 'fail' end, '"}') end"""
LABEL_RULES = [
    ("payload", "not coalesce(ok, false)"), ("field:label_revision", integer("label_revision")), ("field:measured_at", number("measured_at")),
    ("field:actual_value", integer("actual_value") + " or (j->>'$.actual_value')::double not between -2147483648 and 2147483647"),
    ("field:actual_label", blank_text("actual_label")),
    ("range:label_revision", "not " + integer("label_revision") + " and (j->>'$.label_revision')::bigint < 1"),
    ("range:measured_at", "not " + number("measured_at") + " and (j->>'$.measured_at')::double < 0"),
    ("enum:actual_value", "not " + integer("actual_value") + " and (j->>'$.actual_value')::bigint in (2, 0)"),
    ("agree:actual_label", "not (" + blank_text("actual_label") + ") and ((j->>'$.actual_value') = '1' and (j->>'$.actual_label') <> 'fail' or (j->>'$.actual_value') = '-1' and (j->>'$.actual_label') <> 'pass')"),
]


@query("val_label_rules", "with raw as (select o_orderkey, " + duck(LABEL_TEXT) + " as value from orders)" + PARSED
       + " select o_orderkey, " + oracle_reasons(LABEL_RULES) + " from t")
def val_labels(spark, sf):
    raw = fx.table(spark, sf, "orders").select(
        "o_orderkey", F.lit(None).cast("string").alias("key"), spark_text(LABEL_TEXT).alias("value")
    )
    checked = validate.check(raw, validate.label_contract(SAMPLE))
    return checked.select("o_orderkey", F.array_join("reasons", ",").alias("reasons"))


PREDICTION_TEXT = """concat('{"prediction_id":"p', cast(event_id as {STR}), '","request_id":"r","sample_id":"s-', cast(user_id as {STR}), '","serving_snapshot_id":"',
  case event_id % 19 when 0 then '' else 'state' end, '","snapshot_version":', case event_id % 19 when 1 then '0' when 2 then '1.0' else '3' end,
  ',"feature_hash":"', case event_id % 19 when 3 then 'sha256:v1:short' else concat('sha256:v1:', repeat('a', 64)) end, '","model_run_id":"run"',
  case event_id % 19 when 4 then ',"model_name":" "' when 5 then ',"runtime_slot":"canary"' when 6 then ',"runtime_slot":null' else '' end,
  ',"predicted_at":', case event_id % 19 when 7 then '-1' else '10.5' end, ',"fail_probability":', case event_id % 19 when 8 then '1.25' when 9 then '"0.5"' else '0.2' end,
  ',"predicted_value":', case event_id % 19 when 10 then '0' when 11 then '1' else '-1' end, ',"predicted_label":"pass","threshold":',
  case event_id % 19 when 12 then '-0.5' else '0.5' end, ',"missing_count":', case event_id % 19 when 13 then '6' when 14 then '2.5' else '5' end,
  ',"latency_ms":', case event_id % 19 when 15 then '-2' when 16 then 'false' else '3' end, '}')"""
PREDICTION_RULES = [
    ("payload", "not coalesce(ok, false)"), ("field:serving_snapshot_id", blank_text("serving_snapshot_id")),
    ("field:snapshot_version", integer("snapshot_version")), ("field:model_name", blank_text("model_name", True)),
    ("field:runtime_slot", blank_text("runtime_slot", True)), ("field:fail_probability", number("fail_probability")),
    ("field:missing_count", integer("missing_count")), ("field:latency_ms", number("latency_ms")),
    ("pattern:feature_hash", "not regexp_full_match(j->>'$.feature_hash', 'sha256:v1:[0-9a-f]{64}')"),
    ("range:snapshot_version", "not " + integer("snapshot_version") + " and (j->>'$.snapshot_version')::bigint < 1"),
    ("range:predicted_at", "(j->>'$.predicted_at')::double < 0"),
    ("range:fail_probability", "not " + number("fail_probability") + " and (j->>'$.fail_probability')::double not between 0 and 1"),
    ("enum:predicted_value", "(j->>'$.predicted_value')::int not in (-1, 1)"),
    ("agree:predicted_label", "(j->>'$.predicted_value') = '1' and (j->>'$.predicted_label') <> 'fail'"),
    ("range:threshold", "(j->>'$.threshold')::double not between 0 and 1"),
    ("range:missing_count", "not " + integer("missing_count") + " and (j->>'$.missing_count')::double not between 0 and 5"),
    ("range:latency_ms", "not " + number("latency_ms") + " and (j->>'$.latency_ms')::double < 0"),
]


@query("val_prediction_rules", "with raw as (select event_id, " + duck(PREDICTION_TEXT) + " as value from events)" + PARSED
       + " select event_id, coalesce(nullif(j->>'$.runtime_slot', ''), 'unknown') as runtime_slot, " + oracle_reasons(PREDICTION_RULES) + " from t")
def val_predictions(spark, sf):
    raw = fx.spread(fx.table(spark, sf, "events")).select(
        "event_id", F.concat(F.lit("s-"), F.col("user_id").cast("string")).alias("key"), spark_text(PREDICTION_TEXT).alias("value")
    )
    checked = validate.check(raw, validate.prediction_contract(SAMPLE, HASH_PATTERN, len(KEYS)))
    return checked.select("event_id", "runtime_slot", F.array_join("reasons", ",").alias("reasons"))


SNAPSHOT_TEXT = """concat('{"serving_snapshot_id":"state","sample_id":"s-', cast(user_id as {STR}), '","source_event_count":4,"snapshot_version":',
  case event_id % 17 when 0 then '3' else '4' end, ',"feature_hash":"sha256:v1:', repeat('b', 64), '","snapshot_time":20.5,"window_start":',
  case event_id % 17 when 1 then '30' when 2 then '-1' else '10' end, ',"window_end":20.5,"snapshot_status":"',
  case event_id % 17 when 3 then 'timed_out' when 4 then 'partial' when 5 then 'partial' else 'complete' end, '","feature_count":',
  case event_id % 17 when 5 then '4' when 6 then '4' when 7 then '9' else '5' end, ',"missing_count":', case event_id % 17 when 8 then '2' else '1' end,
  ',"is_complete":', case event_id % 17 when 5 then 'false' when 9 then '"true"' else 'true' end, ',"features":{"f000":1,"f001":', case event_id % 17 when 10 then '"x"' else '2.5' end,
  ',"f002":null,"f003":3', case event_id % 17 when 11 then '' when 12 then ',"f009":1' else ',"f004":4' end, '}}')"""
SNAPSHOT_RULES = [
    ("payload", "not coalesce(ok, false)"), ("field:is_complete", "json_type(j, '$.is_complete') <> 'BOOLEAN'"),
    ("version_count", "(j->>'$.snapshot_version') <> (j->>'$.source_event_count')"), ("range:window_start", "(j->>'$.window_start')::double < 0"),
    ("window_order", "(j->>'$.window_end')::double < (j->>'$.window_start')::double"),
    ("enum:snapshot_status", "(j->>'$.snapshot_status') not in ('partial', 'complete')"),
    ("range:feature_count", "(j->>'$.feature_count')::int > 5"),
    ("completeness", "json_type(j, '$.is_complete') = 'BOOLEAN' and (j->>'$.is_complete')::boolean <> ((j->>'$.feature_count')::int = 5)"),
    ("status", "json_type(j, '$.is_complete') = 'BOOLEAN' and (j->>'$.snapshot_status') <> case when (j->>'$.is_complete')::boolean then 'complete' else 'partial' end"),
    ("features_canonical", "len(json_keys(j, '$.features')) <> 5"),
    ("feature_key", "len(list_filter(json_keys(j, '$.features'), lambda k: k not in ('f000', 'f001', 'f002', 'f003', 'f004'))) > 0"),
    ("feature_value", "json_type(j, '$.features.f001') = 'VARCHAR'"),
    ("missing_count", "(j->>'$.missing_count')::int <> len(list_filter(json_keys(j, '$.features'), lambda k: json_type(j, '$.features.' || k) = 'NULL'))"),
]


@query("val_snapshot_rules", "with raw as (select event_id, " + duck(SNAPSHOT_TEXT) + " as value from events)" + PARSED
       + " select event_id, " + oracle_reasons(SNAPSHOT_RULES) + " from t")
def val_snapshots(spark, sf):
    raw = fx.spread(fx.table(spark, sf, "events")).select(
        "event_id", F.concat(F.lit("s-"), F.col("user_id").cast("string")).alias("key"), spark_text(SNAPSHOT_TEXT).alias("value")
    )
    checked = validate.check(raw, validate.snapshot_contract(SAMPLE, HASH_PATTERN, len(KEYS)))
    return checked.select("event_id", F.array_join("reasons", ",").alias("reasons"))


@query("val_quarantine_counts", "with raw as (select event_id, " + duck(EVENT_KEY) + " as key, " + duck(FEATURE_TEXT) + " as value from (select *, "
       + duck(FEATURE_HEAD) + " as h from events))" + PARSED + ", r as (select " + oracle_reasons(FEATURE_RULES) + """ from t)
select reason, count(*) as rows_ from (select unnest(string_split(reasons, ',')) as reason from r where reasons <> '') group by 1
union all select 'valid', count(*) from r where reasons = ''""")
def quarantine(spark, sf):
    rows = fx.spread(fx.table(spark, sf, "events")).withColumn("h", spark_text(FEATURE_HEAD))
    raw = rows.select(spark_text(EVENT_KEY).alias("key"), spark_text(FEATURE_TEXT).alias("value"))
    contract = validate.feature_event_contract(SAMPLE, fx.EVENT_TYPES, len(KEYS), 0.0)
    valid, rejected = validate.validate(raw, contract)
    count = F.count(F.lit(1)).alias("rows_")
    return rejected.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(count).unionByName(
        valid.agg(count).select(F.lit("valid").alias("reason"), "rows_")
    )


@query("val_scoring_input", """
select event_id, concat_ws(',', case when event_id % 11 = 0 then 'sample_id' end, case when event_id % 7 = 0 then 'width' end,
  case when event_id % 5 = 0 then 'finite' end) as violations from events""")
def val_scoring(spark, sf):
    event = F.col("event_id")
    sample = F.when(event % 11 == 0, "other").otherwise(F.concat(F.lit("s-"), F.col("user_id").cast("string")))
    value = F.when(event % 5 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    four = F.array(value, F.lit(None).cast("double"), F.lit(1.0), F.lit(2.0))
    values = F.when(event % 7 == 0, four).otherwise(F.array_append(four, F.lit(3.0)))
    rows = fx.table(spark, sf, "events").select("event_id", sample.alias("sample_id"), values.alias("values"))
    checked = validate.scoring_input_violations(rows, 5, SAMPLE)
    return checked.select("event_id", F.array_join("violations", ",").alias("violations"))


@query("val_label_completeness", """
with rows_ as (select o_orderkey, case when o_orderkey % 5 <> 0 then 'l' end as id, case when o_orderkey % 7 <> 0 then 1 end as rev, case o_orderstatus when 'F' then 1 when 'O' then -1 else 3 end as v,
  case when o_orderkey % 11 = 0 then 'pass' else case o_orderstatus when 'F' then 'fail' else 'pass' end end as name from orders)
select o_orderkey, concat_ws(',', case when id is null then 'partial_label' end, case when id is not null and rev is null then 'incomplete_label' end,
  case when id is not null and v = 3 then 'label_value' end, case when id is not null and v in (-1, 1) and name <> case v when 1 then 'fail' else 'pass' end then 'label_name' end) as violations from rows_""")
def val_label_fields(spark, sf):
    from proofline.plans.cohorts import label_violations

    order, status = F.col("o_orderkey"), F.col("o_orderstatus")
    rows = fx.table(spark, sf, "orders").select(
        "o_orderkey", F.when(order % 5 != 0, "l").alias("label_event_id"), F.when(order % 7 != 0, 1).alias("label_revision"),
        F.lit(1.0).alias("label_measured_at"), F.lit(2.0).alias("label_available_at"),
        F.when(status == "F", 1).when(status == "O", -1).otherwise(3).alias("actual_value"),
        F.when(order % 11 == 0, "pass").when(status == "F", "fail").otherwise("pass").alias("actual_label"),
    )
    return rows.select("o_orderkey", F.array_join(sc.reasons(label_violations()), ",").alias("violations"))


@query("table_contract_audit", """
select 'version' as rule, count(*) filter (where not snapshot_version > 3) as violations from fx_snapshots
union all select 'times', count(*) filter (where not (snapshot_time >= 0 and window_start >= 0 and window_end >= window_start)) from fx_snapshots
union all select 'available_at', count(*) filter (where available_at < 0) from fx_snapshots
union all select 'status', count(*) filter (where snapshot_status not in ('partial', 'timed_out', 'complete', 'late_update')) from fx_snapshots
union all select 'counts', count(*) filter (where feature_count not between 0 and 5 or missing_count not between 0 and 5) from fx_snapshots
union all select 'complete', count(*) filter (where is_complete and not (snapshot_status = 'complete' and feature_count = 5)) from fx_snapshots""")
def contract_audit(spark, sf):
    checks = {**validate.TABLE_CHECKS["serving_feature_snapshots"], "version": "snapshot_version > 3"}
    return validate.audit(fx.snapshots(spark, sf), checks, n=len(KEYS))


@query("duplicate_keys", """
select l_orderkey, l_linenumber, count(*) as copies from lineitem group by 1, 2 having count(*) > 1""")
def duplicates(spark, sf):
    return validate.duplicate_keys(fx.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("orphan_rows", """
select prediction_id, sample_id from fx_predictions p where not exists (select 1 from fx_labels l where l.sample_id = p.sample_id)""")
def orphan_rows(spark, sf):
    return validate.orphans(fx.predictions(spark, sf), fx.labels(spark, sf), ["sample_id"]).select("prediction_id", "sample_id")


# Idempotent writes: the first part of the events is stored, all of them arrive again, some twice.
ARRIVALS_SQL = """
with arriving as (select concat('e', cast(floor(event_id / 2.0) as bigint)) as id, event_id as arrival, value, user_id from events),
stored as (select * from arriving where arrival % 3 = 0 and arrival % 2 = 0)
"""


def arriving(spark, sf):
    rows = fx.table(spark, sf, "events").select(
        F.concat(F.lit("e"), F.floor(F.col("event_id") / 2.0).cast("bigint").cast("string")).alias("id"),
        F.col("event_id").alias("arrival"), "value", "user_id",
    )
    return rows, rows.where((F.col("arrival") % 3 == 0) & (F.col("arrival") % 2 == 0))


@query("insert_ignore_rows", ARRIVALS_SQL + """
select * from arriving a where not exists (select 1 from stored s where s.id = a.id)
  and not exists (select 1 from arriving b where b.id = a.id and b.arrival < a.arrival)""")
def insert_ignore(spark, sf):
    incoming, stored = arriving(spark, sf)
    return sinks.new_rows(incoming, stored, ["id"], ["arrival"])


@query("insert_ignore_counts", ARRIVALS_SQL + """
select count(*) as received, count(distinct id) filter (where id not in (select id from stored)) as inserted,
  count(*) - count(distinct id) filter (where id not in (select id from stored)) as duplicates from arriving""")
def insert_counts(spark, sf):
    incoming, stored = arriving(spark, sf)
    return sinks.insert_counts(incoming, stored, ["id"])


@query("insert_ignore_null_keys", """
with metrics as (select user_id as model, case when event_id % 4 = 0 then null else event_type end as feature, event_id as arrival from events),
stored as (select * from metrics where arrival % 7 = 0)
select * from metrics m where not exists (select 1 from stored s where s.model = m.model and coalesce(s.feature, '') = coalesce(m.feature, ''))
  and not exists (select 1 from metrics b where b.model = m.model and coalesce(b.feature, '') = coalesce(m.feature, '') and b.arrival < m.arrival)""")
def insert_null_keys(spark, sf):
    rows = fx.table(spark, sf, "events").select(
        F.col("user_id").alias("model"), F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("feature"),
        F.col("event_id").alias("arrival"),
    )
    return sinks.new_rows(rows, rows.where(F.col("arrival") % 7 == 0), ["model", "feature"], ["arrival"], null_keys=True)


@query("replay_conflicts", ARRIVALS_SQL + """
, first_ as (select a.* from arriving a where not exists (select 1 from arriving b where b.id = a.id and b.arrival < a.arrival)),
agreed as (select f.id, coalesce(s.user_id, f.user_id) as user_id from first_ f left join stored s on s.id = f.id)
select a.* from arriving a join agreed g on g.id = a.id where a.user_id is distinct from g.user_id""")
def conflicts(spark, sf):
    incoming, stored = arriving(spark, sf)
    return sinks.replay_conflicts(incoming, stored, "id", ["user_id"], ["arrival"])


@query("upsert_last_wins", ARRIVALS_SQL + """
, last_ as (select a.* from arriving a where not exists (select 1 from arriving b where b.id = a.id and b.arrival > a.arrival))
select coalesce(l.id, s.id) as id, coalesce(l.arrival, s.arrival) as arrival, case when l.id is null then s.value else l.value end as value,
  case when s.id is null then l.user_id else s.user_id end as user_id from last_ l full join stored s on s.id = l.id""")
def upsert(spark, sf):
    incoming, stored = arriving(spark, sf)
    return sinks.merged(stored, incoming, ["id"], "arrival", keep=["user_id"])


@query("latest_store", """
with again as (select serving_snapshot_id, sample_id, snapshot_version, available_at from fx_snapshots union all
  select serving_snapshot_id, sample_id, snapshot_version, available_at + 500 from fx_snapshots where snapshot_version % 2 = 0)
select serving_snapshot_id, sample_id, snapshot_version, min(available_at) as available_at from again a
where snapshot_version = (select max(snapshot_version) from fx_snapshots s where s.sample_id = a.sample_id) group by 1, 2, 3""")
def latest_store(spark, sf):
    rows = fx.snapshots(spark, sf).select("serving_snapshot_id", "sample_id", "snapshot_version", "available_at")
    replay = rows.where(F.col("snapshot_version") % 2 == 0).withColumn("available_at", F.col("available_at") + 500)
    return sinks.latest_table(rows.unionByName(replay))


@query("message_values", """
select cast(user_id as varchar) as key, concat('{"user_id":', user_id, ',"event_type":"', event_type, '","flag":',
  case when event_id % 2 = 0 then 'null' else 'true' end, '}') as value from events""")
def messages(spark, sf):
    rows = fx.table(spark, sf, "events").select("user_id", "event_type", F.when(F.col("event_id") % 2 != 0, True).alias("flag"))
    return sinks.as_messages(rows, "user_id").withColumn("key", F.col("key").cast("string"))


@query("prediction_evidence", """
select prediction_id, coalesce(case when runtime_slot = 'shadow' then null else runtime_slot end, 'unknown') as runtime_slot, fail_probability from fx_predictions""")
def evidence_rows(spark, sf):
    slot = F.when(F.col("runtime_slot") != "shadow", F.col("runtime_slot"))
    rows = fx.predictions(spark, sf).withColumn("runtime_slot", slot)
    return sinks.prediction_evidence(rows).select("prediction_id", "runtime_slot", "fail_probability")


# Scalars.
@query("safe_arithmetic", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice / nullif(l_linenumber - 3, 0), 6) as ratio_, round(l_tax - case when l_linenumber = 2 then null else l_discount end, 6) as delta_,
  case when l_linenumber = 5 then null else l_quantity end as metric_ from lineitem""")
def arithmetic(spark, sf):
    line = F.col("l_linenumber")
    odd = F.when(line == 5, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    return fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(sc.ratio(F.col("l_extendedprice"), line - 3), 6).alias("ratio_"),
        F.round(sc.delta(F.col("l_tax"), F.when(line != 2, F.col("l_discount"))), 6).alias("delta_"),
        sc.metric_value(odd).alias("metric_"),
    )


@query("time_formats", """
select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') as iso, epoch_us(date_trunc('second', ts)) / 1e6 as parsed,
  epoch_us(date_trunc('second', ts) - interval 9 hour) / 1e6 as parsed_zone, floor((epoch_us(ts) / 1e6 - 60.0) / 600.0) * 600.0 + 60.0 as bucket,
  epoch_us(ts) / 1e6 as epoch from events""")
def times(spark, sf):
    at = sc.epoch_seconds(F.col("ts"))
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    return fx.table(spark, sf, "events").select(
        "event_id", sc.iso_utc(at).alias("iso"), sc.parse_time(F.concat(text, F.lit("Z"))).alias("parsed"),
        sc.parse_time(text, "Asia/Seoul").alias("parsed_zone"), sc.time_bucket(at, 600.0, 60.0).alias("bucket"),
        sc.parse_time(F.format_string("%.6f", at)).alias("epoch"),
    )


@query("first_present", """
select sample_id, arg_min(feature_group, event_id) filter (where feature_group <> 'view') as first_group from fx_patches group by 1""")
def first_present(spark, sf):
    rows = fx.patches(spark, sf).withColumn("g", F.when(F.col("feature_group") == "view", "").otherwise(F.col("feature_group")))
    return rows.groupBy("sample_id").agg(sc.first_present(F.col("g"), F.col("event_id")).alias("first_group"))


OUTCOME_SQL = """
with r as (select event_id, user_id, case event_id % 8 when 0 then null when 1 then 200 when 2 then 404 when 3 then 409 when 4 then 409 when 5 then 502 when 6 then 503 else 500 end as status,
  event_id % 8 = 3 as retryable from events)
"""


def outcomes(spark, sf):
    event = F.col("event_id")
    codes = F.array(*[F.lit(c).cast("int") for c in (None, 200, 404, 409, 409, 502, 503, 500)])
    return fx.table(spark, sf, "events").select(
        "event_id", "user_id", F.get(codes, event % 8).alias("status"), (event % 8 == 3).alias("retryable")
    )


@query("request_outcomes", OUTCOME_SQL + """
select case when status is null then 'request_error' when status = 200 then 'predicted' when status = 404 then 'not_found' when status = 409 and retryable then 'partial'
  when status = 409 then 'not_ready_final' when status = 502 then 'model_gateway_error' when status = 503 then 'feature_store_unavailable' else 'failed' end as outcome, count(*) as row_count
from r group by 1""")
def request_outcomes(spark, sf):
    rows = outcomes(spark, sf).withColumn("outcome", sc.request_outcome(F.col("status"), F.col("retryable")))
    return rollups.inventory(rows, ["outcome"])


@query("success_prefix", """
with r as (select user_id, event_id, event_id % 11 <> 0 as ok from events)
select user_id, (select count(*) from r a where a.user_id = u.user_id and not exists
  (select 1 from r b where b.user_id = a.user_id and not b.ok and b.event_id <= a.event_id)) as ok_rows from (select distinct user_id from events) u""")
def success_prefix(spark, sf):
    # Positions count a user's requests one by one, so the prefix length is a number of requests.
    from proofline.operators.scale import running_sums

    one = F.lit(1).cast("bigint")
    rows = fx.table(spark, sf, "events").select("user_id", "event_id", (F.col("event_id") % 11 != 0).alias("ok"), one.alias("one"))
    placed = running_sums(rows, ["user_id"], "event_id", ["one"]).withColumnRenamed("cum_one", "index")
    return rollups.leading_successes(placed, ["user_id"]).withColumnRenamed("leading_successes", "ok_rows")


@query("serve_disposition", """
select case when is_complete then 'score' else 'not_ready_retry' end as disposition, count(*) as row_count from fx_snapshots where snapshot_version % 4 <> 0 group by 1
union all select 'not_ready_final', count(*) from fx_snapshots where snapshot_version % 4 = 0""")
def disposition(spark, sf):
    late = F.col("snapshot_version") % 4 == 0
    rows = fx.snapshots(spark, sf).withColumns({
        "snapshot_status": F.when(late, "timed_out").otherwise(F.col("snapshot_status")), "is_complete": F.col("is_complete") & ~late,
    })
    return rollups.inventory(rows.withColumn("disposition", sc.serve_disposition(F.col("snapshot_status"), F.col("is_complete"))), ["disposition"])


# Features.
@query("feature_vector_aliases", """
select event_id, cast(i as int) as position, case when i = event_id % 3 then case when event_id % 7 = 0 then null else value end when i = 4 then 1.0::double end as value
from events, (select unnest(range(0, 5)) as i)""")
def aliases(spark, sf):
    event = F.col("event_id")
    value = F.when(event % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    named = F.get(F.array(F.lit("f000"), F.lit("feature_001"), F.lit("2")), event % 3)
    # The first alias present wins, even against a later one with a number.
    features = F.map_concat(F.create_map(named, value), F.create_map(F.lit("feature_004"), F.lit(1.0), F.lit("4"), F.lit(9.0)))
    rows = fx.table(spark, sf, "events").select("event_id", feat.vector_from_map(features, 5).alias("v"))
    return rows.select("event_id", F.posexplode("v").alias("position", "value"))


@query("feature_vector_list", """
select event_id, cast(i as int) as position, case i when 0 then value when 1 then 2.0::double end as value from events, (select unnest(range(0, 5)) as i)""")
def from_list(spark, sf):
    rows = fx.table(spark, sf, "events").select(
        "event_id", feat.vector_from_list(F.array("value", F.lit(2.0), F.lit(float("inf"))), 5).alias("v")
    )
    return rows.select("event_id", F.posexplode("v").alias("position", "value"))


@query("canonical_counts", """
select event_id, cast(4 + case when feature_value is null then 1 else 0 end as int) as null_count, cast(4 as int) as missing_keys from fx_patches""")
def canonical_counts(spark, sf):
    full = feat.canonical(F.col("features"), KEYS)
    return fx.patches(spark, sf).select(
        "event_id", feat.null_count(full).alias("null_count"), F.size(feat.missing_keys(F.col("features"), KEYS)).alias("missing_keys")
    )


def volume_features(spark, sf):
    return fx.prediction_volume(spark, sf).select("prediction_id", "missing_count", "features")


@query("scale_features", """
select prediction_id, feature_name, round(value * 1.1, 6) as up, round(value * 0.9, 6) as down from fx_volume_long""")
def scaled(spark, sf):
    rows = volume_features(spark, sf)
    up = feat.lengthen(rows.withColumn("features", feat.scale_features(F.col("features"), "up", 0.1)), ["prediction_id", "missing_count"])
    return up.select("prediction_id", "feature_name", F.round("value", 6).alias("up"), F.round(F.col("value") / 1.1 * 0.9, 6).alias("down"))


@query("periodic_offset", """
with p as (select event_id, feature_index, feature_value from fx_patches)
select event_id, concat('f00', feature_index) as feature_name, case when event_id % 4 = 0 and feature_index = 2 then feature_value + 7.5::double else feature_value end as value from p""")
def offset(spark, sf):
    changed = feat.offset_feature(F.col("features"), "f002", 7.5, 4, F.col("event_id"))
    rows = fx.patches(spark, sf).select("event_id", changed.alias("features"))
    return feat.lengthen(rows, ["event_id"]).drop("feature_index")


@query("median_reflection", """
with m as (select feature_name, median(value) as mid from fx_volume_long where value is not null group by 1)
select l.prediction_id, l.feature_name, round(2 * m.mid - l.value, 6) as value from fx_volume_long l join m using (feature_name)""")
def reflection(spark, sf):
    rows = volume_features(spark, sf)
    medians = median_values(feat.lengthen(rows, []))
    joined = rows.withColumn("features", feat.reflect(F.col("features"), medians))
    return feat.lengthen(joined, ["prediction_id"]).withColumn("value", F.round("value", 6)).drop("feature_index")


@query("feature_groups", """
select prediction_id, case when feature_index < 1 then 'early' when feature_index < 3 then 'middle' else 'late' end as feature_group, count(*) as keys, count(value) as present
from fx_volume_long group by 1, 2""")
def groups(spark, sf):
    parts = feat.split_groups(F.col("features"), {"early": 0, "middle": 1, "late": 3})
    rows = volume_features(spark, sf).select("prediction_id", F.explode(parts).alias("feature_group", "part"))
    # Duplicate prediction ids are possible in this table, so the parts are summed.
    return rows.groupBy("prediction_id", "feature_group").agg(
        F.sum(F.size("part")).alias("keys"), F.sum(F.size(F.filter(F.map_values("part"), lambda v: v.isNotNull()))).alias("present")
    )


# Roll-ups and audits.
@query("patch_coverage", """
select sample_id, count(*) as patch_count, string_agg(feature_group, ',' order by feature_group) as feature_groups, count(*) as observed_feature_count
from fx_patches group by 1 order by sample_id desc limit 20""")
def coverage(spark, sf):
    found = rollups.patch_coverage(fx.patches(spark, sf))
    return found.withColumns({
        "feature_groups": F.array_join("feature_groups", ","), "observed_feature_count": F.col("observed_feature_count").cast("bigint")
    })


@query("evidence_rollup", """
select count(*) as row_count, count(distinct sample_id) as distinct_sample_id, count(*) filter (where actual_label = 'fail') as fail_count,
  count(*) filter (where actual_label = 'pass') as pass_count, min(label_revision) as min_label_revision, max(label_revision) as max_label_revision,
  min(available_at) as min_available_at, max(available_at) as max_available_at from fx_labels""")
def label_rollup(spark, sf):
    return rollups.rollup(fx.labels(spark, sf), ["sample_id"], ["label_revision", "available_at"], "actual_label")


@query("model_inventory", """
select model_run_id, threshold, case when runtime_slot = 'shadow' then null else runtime_slot end as model_alias, count(*) as row_count from fx_predictions group by 1, 2, 3""")
def model_inventory(spark, sf):
    rows = fx.predictions(spark, sf).withColumn("model_alias", F.when(F.col("runtime_slot") != "shadow", F.col("runtime_slot")))
    return rollups.inventory(rows, ["model_run_id", "threshold", "model_alias"])


@query("status_summary", """
select snapshot_status, count(*) as row_count, min(available_at) as first_available_at, max(available_at) as last_available_at from fx_snapshots group by 1""")
def statuses(spark, sf):
    return rollups.status_summary(fx.snapshots(spark, sf), ["snapshot_status"], "available_at")


@query("latest_evaluation_rows", """
with e as (select concat('ev-', user_id % 50) as evaluation_id, event_id, floor(event_id / 100.0) * 100.0 as computed_at from events)
select event_id, evaluation_id from e where evaluation_id = (select evaluation_id from e order by computed_at desc, evaluation_id desc limit 1)""")
def latest_rows(spark, sf):
    rows = fx.table(spark, sf, "events").select(
        F.concat(F.lit("ev-"), (F.col("user_id") % 50).cast("string")).alias("evaluation_id"), "event_id",
        (F.floor(F.col("event_id") / 100.0) * 100.0).alias("computed_at"),
    )
    return rows_of_latest(rows, "evaluation_id", "computed_at").select("event_id", "evaluation_id")


@query("membership_diff", """
with a as (select event_id, user_id from events where event_id % 10 <> 3), b as (select event_id, case when event_id % 25 = 0 then -1 else user_id end as user_id from events where event_id % 10 <> 4)
select event_id, user_id, 'left' as only_in from (select * from a except all select * from b)
union all select event_id, user_id, 'right' from (select * from b except all select * from a)""")
def membership(spark, sf):
    rows = fx.table(spark, sf, "events").select("event_id", "user_id")
    other = rows.where(F.col("event_id") % 10 != 4).withColumn("user_id", F.when(F.col("event_id") % 25 == 0, -1).otherwise(F.col("user_id")))
    return rollups.membership_difference(rows.where(F.col("event_id") % 10 != 3), other)


REQUESTS_SQL = """
with requests as (select cast(o_orderkey as varchar) as request_id, concat('model-', o_custkey % 40) as model_name, case o_orderkey % 2 when 0 then 'champion' else 'candidate' end as target_alias,
  case when o_orderkey % 7 = 0 then 'failed' when o_orderkey % 97 = 0 then 'odd' else 'passed' end as eval_status,
  case o_orderstatus when 'P' then 'pending' else 'approved' end as approval_status,
  ['not_started', 'promoted', 'canary_reloading', 'canary_ready', 'release_reloading', 'deployed', 'failed', 'rolled_back', 'superseded'][1 + o_orderkey % 9] as rollout_status,
  epoch_us(o_orderdate) / 1e6 as requested_at from orders)
"""


def requests(spark, sf):
    from proofline.constants import ROLLOUT_STATUSES

    order = F.col("o_orderkey")
    return fx.table(spark, sf, "orders").select(
        order.cast("string").alias("request_id"), F.concat(F.lit("model-"), (F.col("o_custkey") % 40).cast("string")).alias("model_name"),
        F.when(order % 2 == 0, "champion").otherwise("candidate").alias("target_alias"),
        F.when(order % 7 == 0, "failed").when(order % 97 == 0, "odd").otherwise("passed").alias("eval_status"),
        F.when(F.col("o_orderstatus") == "P", "pending").otherwise("approved").alias("approval_status"),
        F.get(F.array(*[F.lit(s) for s in ROLLOUT_STATUSES]), order % 9).alias("rollout_status"),
        sc.epoch_seconds(F.col("o_orderdate")).alias("requested_at"),
    )


@query("latest_eligible", REQUESTS_SQL + """
, wanted as (select 'deployable' as purpose, * from requests where eval_status = 'passed' and rollout_status in ('not_started', 'promoted', 'canary_reloading', 'canary_ready')
  union all select 'releasable', * from requests where eval_status = 'passed' and rollout_status in ('canary_ready', 'release_reloading')
  union all select 'rollback', * from requests where rollout_status in ('promoted', 'canary_reloading', 'canary_ready', 'release_reloading', 'failed'))
select purpose, model_name, target_alias, request_id, requested_at from (select *, row_number() over (partition by purpose, model_name, target_alias order by requested_at desc, request_id desc) as r
  from wanted where approval_status = 'approved') where r = 1""")
def eligible(spark, sf):
    rows = requests(spark, sf)
    parts = [rollups.next_eligible(rows, p).withColumn("purpose", F.lit(p)) for p in ("deployable", "releasable", "rollback")]
    found = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return found.select("purpose", "model_name", "target_alias", "request_id", "requested_at")


@query("val_deployment_status", REQUESTS_SQL + """
select 'eval_status' as rule, count(*) filter (where eval_status not in ('passed', 'failed', 'insufficient_data', 'skipped', 'unknown')) as violations from requests
union all select 'approval_status', count(*) filter (where approval_status not in ('pending', 'approved', 'rejected')) from requests
union all select 'rollout_status', 0 from requests group by 1""")
def deployment_audit(spark, sf):
    return validate.audit(requests(spark, sf), validate.TABLE_CHECKS["model_deployment_requests"])


@query("newest_requests", REQUESTS_SQL + """
select request_id, model_name, requested_at from requests order by requested_at desc, request_id desc limit 25""")
def newest_requests(spark, sf):
    return rollups.newest_rows(requests(spark, sf), "requested_at", "request_id", 25).select("request_id", "model_name", "requested_at")


@query("active_baselines", """
select concat('run-', o_custkey) as model_run_id, count(*) as active_count, case when count(*) = 1 then max(cast(o_orderkey as varchar)) end as baseline_id
from orders where o_orderkey % 3 = 0 and o_orderstatus = 'F' group by 1""")
def baselines(spark, sf):
    order = F.col("o_orderkey")
    rows = fx.table(spark, sf, "orders").select(
        order.cast("string").alias("baseline_id"), F.concat(F.lit("run-"), F.col("o_custkey").cast("string")).alias("model_run_id"),
        F.when(order % 3 == 0, "fixed_reference").otherwise("other").alias("baseline_type"),
        F.when(F.col("o_orderstatus") == "F", "active").otherwise("retired").alias("status"),
    )
    return rollups.active_baselines(rows)


@query("appended_notes", """
select o_orderkey, case when o_orderkey % 3 = 0 then case when o_orderkey % 2 = 0 then null else 'old' end when o_orderkey % 2 = 0 then 'new' else concat('old', chr(10), 'new') end as notes from orders""")
def notes(spark, sf):
    order = F.col("o_orderkey")
    old, new = F.when(order % 2 != 0, "old"), F.when(order % 3 != 0, "new").otherwise("")
    return fx.table(spark, sf, "orders").select("o_orderkey", rollups.appended_note(old, new).alias("notes"))


@query("optional_time_filter", """
select count(*) as row_count, min(predicted_at) as min_predicted_at, max(predicted_at) as max_predicted_at from fx_predictions
where predicted_at >= {START} and predicted_at < {CUTOFF} and model_run_id = 'run-a'""")
def filtered(spark, sf):
    rows = fx.predictions(spark, sf).where(sc.half_open(F.col("predicted_at"), START, CUTOFF) & (F.col("model_run_id") == "run-a"))
    return rollups.rollup(rows, [], ["predicted_at"])


@query("age_series", """
select sample_id, i * {DAY} as age_seconds, available_at + i * {DAY} as observable_at from fx_labels, (select unnest(range(0, 3)) as i)""")
def series(spark, sf):
    rows = fx.labels(spark, sf).select("sample_id", "available_at", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    return rows.select("sample_id", (F.col("i") * DAY).alias("age_seconds"), (F.col("available_at") + F.col("i") * DAY).alias("observable_at"))
