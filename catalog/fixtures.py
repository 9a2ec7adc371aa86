"""Evidence tables derived from the given tables, so that every query's work grows with them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.constants import feature_keys
from proofline.functions.scalars import class_name, decide, epoch_seconds
from proofline.operators.assemble import assemble_replay
from proofline.operators.scale import running_sums
from proofline.session import spread

WIDTH = 5
KEYS = feature_keys(WIDTH)
EVENT_TYPES = ("view", "click", "purchase", "signup", "error")

# The point in time the cohort queries look from, and their windows, in seconds.
START = 1704412800.0
CUTOFF = 1706140800.0
MATURITY = 172800.0
WINDOW = 864000.0
DAY = 86400.0


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def patches(spark: SparkSession, sf: str) -> DataFrame:
    return patches_of(table(spark, sf, "events"))


def patches_of(events: DataFrame, *kept: str) -> DataFrame:
    """One feature patch per event, of a table or a stream; every 13th carries an explicit null. ``kept``: of user_id, event_type and value, what stays."""
    at = epoch_seconds(F.col("ts"))
    week = F.floor(F.col("t") / 604800.0).cast("bigint").cast("string")
    index = F.array_position(F.array(*[F.lit(e) for e in EVENT_TYPES]), F.col("event_type")) - 1
    value = F.when(F.col("event_id") % 13 != 0, F.col("value"))
    return (
        events.select("event_id", "user_id", "event_type", "value", at.alias("t"))
        .select(
            "event_id", F.concat(F.lit("s-"), F.col("user_id").cast("string"), F.lit("-"), week).alias("sample_id"),
            F.col("t").alias("arrived_at"), (F.col("t") - (F.col("event_id") % 5) * 3600.0).alias("event_time"),
            F.col("t").alias("created_at"), F.col("event_type").alias("feature_group"),
            index.cast("int").alias("feature_index"), value.alias("feature_value"), *kept,
        )
        .withColumn(
            "features",
            F.create_map(F.concat(F.lit("f00"), F.col("feature_index").cast("string")), F.col("feature_value")),
        )
    )


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    events = patches(spark, sf).select(
        "sample_id", "event_id", F.col("event_id").alias("arrival"), "arrived_at", "event_time", "feature_group",
        "features",
    )
    folded = assemble_replay(events, KEYS)
    suffix = F.concat(F.col("sample_id"), F.lit(":"), F.col("snapshot_version").cast("string"))
    return folded.select(
        F.concat(F.lit("state:"), suffix).alias("serving_snapshot_id"), "sample_id", "snapshot_version",
        F.concat(F.lit("h:"), suffix).alias("feature_hash"), "snapshot_time", "window_start", "window_end",
        "snapshot_status", "feature_count", "missing_count", "is_complete", "features",
        (F.col("arrived_at") + 1.0).alias("available_at"), "event_id", "feature_group", "arrived_at",
    )


def predictions(spark: SparkSession, sf: str, snaps: DataFrame | None = None) -> DataFrame:
    """Decisions on the snapshots of view events; every fifth is repeated, every 97th has a wrong hash."""
    once = F.struct(F.lit("").alias("suffix"), F.lit(0.0).alias("delay"))
    again = F.struct(F.lit("-r").alias("suffix"), F.lit(30.0).alias("delay"))
    event = F.col("event_id")
    runs = F.when(event % 5 == 0, F.array(once, again)).otherwise(F.array(once))
    viewed = (snapshots(spark, sf) if snaps is None else snaps).where(F.col("feature_group") == "view")
    slot = F.when(event % 10 < 6, "release").when(event % 10 < 8, "canary").otherwise("shadow")
    rows = viewed.withColumn("_run", F.explode(runs)).withColumn(
        "fail_probability", F.coalesce(F.col("features")["f000"], F.lit(0.0)) / 500.0
    )
    predicted = decide(F.col("fail_probability"), F.lit(0.2))
    return rows.select(
        F.concat(event.cast("string"), F.col("_run.suffix")).alias("prediction_id"),
        F.floor(event / 3.0).cast("bigint").cast("string").alias("request_id"),
        "sample_id", "serving_snapshot_id", "snapshot_version",
        F.when(event % 97 == 0, "h:mismatch").otherwise(F.col("feature_hash")).alias("feature_hash"),
        F.when(event % 2 == 0, "run-a").otherwise("run-b").alias("model_run_id"),
        slot.alias("runtime_slot"),
        (F.col("arrived_at") + 5.0 + F.col("_run.delay")).alias("predicted_at"), "fail_probability",
        F.lit(0.2).alias("threshold"), predicted.alias("predicted_value"),
        class_name(predicted).alias("predicted_label"), "missing_count",
        ((event % 200).cast("double") / 10.0).alias("latency_ms"),
    )


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """A label revision per purchase event, available up to 12 days later."""
    bought = (
        patches(spark, sf).where(F.col("feature_index") == 2)
        .select("sample_id", "event_id", "arrived_at", F.coalesce("feature_value", F.lit(0.0)).alias("amount"),
                F.lit(1).cast("bigint").alias("one"))
    )
    numbered = running_sums(bought, ["sample_id"], "event_id", ["one"]).withColumnRenamed("cum_one", "label_revision")
    actual = F.when(F.col("amount") > 60.0, 1).otherwise(-1).cast("int")
    return numbered.select(
        F.concat(F.lit("label:"), F.col("sample_id"), F.lit(":r"), F.col("label_revision").cast("string")).alias("label_event_id"),
        "sample_id", "label_revision", F.col("arrived_at").alias("measured_at"),
        (F.col("arrived_at") + 3600.0 * (F.col("event_id") % 300)).alias("available_at"),
        actual.alias("actual_value"), class_name(actual).alias("actual_label"),
    )


def prediction_volume(spark: SparkSession, sf: str) -> DataFrame:
    """One decision per order line: many score ties, six (model, threshold) groups."""
    parts = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    threshold = F.when(F.col("l_linestatus") == "F", 0.5).otherwise(0.6)
    score = F.col("l_discount") * 10.0
    return spread(table(spark, sf, "lineitem")).select(
        F.concat_ws("-", *[F.col(p).cast("string") for p in parts]).alias("prediction_id"),
        F.col("l_orderkey").cast("string").alias("sample_id"), F.col("l_returnflag").alias("model_run_id"),
        threshold.alias("threshold"), epoch_seconds(F.col("l_shipdate")).alias("predicted_at"),
        score.alias("fail_probability"), decide(score, threshold).alias("predicted_value"),
        F.col("l_quantity").cast("int").alias("missing_count"),
        (F.col("l_extendedprice") / 1000.0).alias("latency_ms"),
        F.create_map(
            F.lit("f000"), F.col("l_quantity").cast("double"), F.lit("f001"), F.col("l_extendedprice").cast("double"),
            F.lit("f002"), F.col("l_discount").cast("double"),
            F.lit("f003"), F.when(F.col("l_linenumber") != 7, F.col("l_tax").cast("double")),
        ).alias("features"),
    )


def label_volume(spark: SparkSession, sf: str) -> DataFrame:
    actual = F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1).cast("int")
    key = F.col("o_orderkey").cast("string")
    return table(spark, sf, "orders").select(
        F.concat(F.lit("label:"), key, F.lit(":r1")).alias("label_event_id"), key.alias("sample_id"),
        F.lit(1).cast("bigint").alias("label_revision"),
        epoch_seconds(F.col("o_orderdate")).alias("measured_at"),
        epoch_seconds(F.col("o_orderdate")).alias("available_at"), actual.alias("actual_value"),
        class_name(actual).alias("actual_label"),
    )


def listed(df: DataFrame) -> DataFrame:
    """``reasons`` as one text, by code, for comparison with the SQL twins."""
    line = lambda r: F.format_string("%s %.6f %.6f", r["code"], r["required"], r["actual"])
    return df.withColumn("reasons", F.array_join(F.array_sort(F.transform("reasons", line)), "; "))


# The same tables as common table expressions for the oracle engine.
_SLOTS = ",\n".join(
    f"""max(case when feature_index = {i} then 1 else 0 end) over w as s{i},
  struct_extract(last_value(case when feature_index = {i} then struct_pack(v := feature_value) end ignore nulls) over w, 'v') as f{i}"""
    for i in range(WIDTH)
)
CTES = f"""
fx_patches as (
  select e.event_id, concat('s-', cast(e.user_id as varchar), '-', cast(cast(floor(e.t / 604800.0) as bigint) as varchar)) as sample_id,
    e.t as arrived_at, e.t - (e.event_id % 5) * 3600.0 as event_time, e.event_type as feature_group,
    case e.event_type when 'view' then 0 when 'click' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end as feature_index,
    case when e.event_id % 13 = 0 then null else e.value end as feature_value
  from (select event_id, user_id, event_type, value, epoch_us(ts) / 1e6 as t from events) e),
fx_folded as (
  select p.*, cast(row_number() over w as bigint) as snapshot_version, min(event_time) over w as window_start,
    max(event_time) over w as window_end, {_SLOTS}
  from fx_patches p
  window w as (partition by sample_id order by event_id rows between unbounded preceding and current row)),
fx_snapshots as (
  select concat('state:', sample_id, ':', cast(snapshot_version as varchar)) as serving_snapshot_id, sample_id, snapshot_version,
    concat('h:', sample_id, ':', cast(snapshot_version as varchar)) as feature_hash, window_end as snapshot_time,
    window_start, window_end, case when s0+s1+s2+s3+s4 = 5 then 'complete' else 'partial' end as snapshot_status,
    cast(s0+s1+s2+s3+s4 as int) as feature_count,
    cast((f0 is null)::int + (f1 is null)::int + (f2 is null)::int + (f3 is null)::int + (f4 is null)::int as int) as missing_count,
    s0+s1+s2+s3+s4 = 5 as is_complete, f0, f1, f2, f3, f4, arrived_at + 1.0 as available_at, event_id, feature_group, arrived_at
  from fx_folded),
fx_predictions as (
  select concat(cast(s.event_id as varchar), r.suffix) as prediction_id,
    cast(cast(floor(s.event_id / 3.0) as bigint) as varchar) as request_id,
    s.sample_id, s.serving_snapshot_id, s.snapshot_version,
    case when s.event_id % 97 = 0 then 'h:mismatch' else s.feature_hash end as feature_hash,
    case when s.event_id % 2 = 0 then 'run-a' else 'run-b' end as model_run_id,
    case when s.event_id % 10 < 6 then 'release' when s.event_id % 10 < 8 then 'canary' else 'shadow' end as runtime_slot,
    s.arrived_at + 5.0 + r.delay as predicted_at, coalesce(s.f0, 0.0) / 500.0 as fail_probability,
    cast(0.2 as double) as threshold, case when coalesce(s.f0, 0.0) / 500.0 >= 0.2 then 1 else -1 end as predicted_value,
    case when coalesce(s.f0, 0.0) / 500.0 >= 0.2 then 'fail' else 'pass' end as predicted_label,
    s.missing_count, cast(s.event_id % 200 as double) / 10.0 as latency_ms
  from fx_snapshots s
  join (select '' as suffix, 0.0 as delay, 1 as every union all select '-r', 30.0, 5) r on s.event_id % r.every = 0
  where s.feature_group = 'view'),
fx_labels as (
  select concat('label:', sample_id, ':r', cast(label_revision as varchar)) as label_event_id, sample_id, label_revision,
    arrived_at as measured_at, arrived_at + 3600.0 * (event_id % 300) as available_at,
    case when value_ > 60.0 then 1 else -1 end as actual_value, case when value_ > 60.0 then 'fail' else 'pass' end as actual_label
  from (select sample_id, event_id, arrived_at, coalesce(feature_value, 0.0) as value_,
      cast(row_number() over (partition by sample_id order by event_id) as bigint) as label_revision
    from fx_patches where feature_index = 2)),
fx_prediction_volume as (
  select concat_ws('-', cast(l_orderkey as varchar), cast(l_partkey as varchar), cast(l_suppkey as varchar), cast(l_linenumber as varchar)) as prediction_id,
    cast(l_orderkey as varchar) as sample_id, l_returnflag as model_run_id,
    cast(case l_linestatus when 'F' then 0.5 else 0.6 end as double) as threshold, epoch_us(l_shipdate) / 1e6 as predicted_at,
    l_discount * 10.0 as fail_probability,
    case when l_discount * 10.0 >= (case l_linestatus when 'F' then 0.5 else 0.6 end) then 1 else -1 end as predicted_value,
    cast(l_quantity as int) as missing_count, l_extendedprice / 1000.0 as latency_ms,
    cast(l_quantity as double) as f0, cast(l_extendedprice as double) as f1, cast(l_discount as double) as f2,
    case when l_linenumber = 7 then null else cast(l_tax as double) end as f3
  from lineitem),
fx_label_volume as (
  select concat('label:', cast(o_orderkey as varchar), ':r1') as label_event_id, cast(o_orderkey as varchar) as sample_id,
    cast(1 as bigint) as label_revision, epoch_us(o_orderdate) / 1e6 as available_at,
    case o_orderstatus when 'F' then 1 else -1 end as actual_value,
    case o_orderstatus when 'F' then 'fail' else 'pass' end as actual_label
  from orders),
fx_long as (
  select s.sample_id, s.snapshot_version, s.serving_snapshot_id, s.feature_hash, s.available_at, v.feature_index, v.feature_name, v.value
  from fx_snapshots s, lateral (values (0, 'f000', f0), (1, 'f001', f1), (2, 'f002', f2), (3, 'f003', f3), (4, 'f004', f4))
    v(feature_index, feature_name, value)),
fx_volume_long as (
  select p.prediction_id, p.model_run_id, p.threshold, p.predicted_at, v.feature_index, v.feature_name, v.value
  from fx_prediction_volume p, lateral (values (0, 'f000', f0), (1, 'f001', f1), (2, 'f002', f2), (3, 'f003', f3))
    v(feature_index, feature_name, value))
"""


def oracle(sql: str, **values) -> str:
    """Prefix the derived tables; ``{name}`` placeholders take the parameters above."""
    settings = {"START": START, "CUTOFF": CUTOFF, "MATURITY": MATURITY, "WINDOW": WINDOW, "DAY": DAY, **values}
    text = sql
    for name, value in settings.items():
        text = text.replace("{" + name + "}", f"{value!r}::double" if isinstance(value, float) else str(value))
    text = text.strip()
    if text.lower().startswith("with "):
        return f"with {CTES}, {text[5:]}"
    return f"with {CTES} {text}"
