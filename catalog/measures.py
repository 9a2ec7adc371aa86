"""Queries over quality, statistics and drift, each next to its SQL twin."""

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.fixtures import CUTOFF, DAY, listed, oracle
from catalog.ranking import LIVE_SQL, live_members
from proofline.constants import FAIL
from proofline.functions.features import lengthen
from proofline.functions.scalars import offline_id
from proofline.operators import bins, drift, latest, quality, stats
from proofline.plans import proposal
from proofline.session import scratch
from proofline.sources.days import DayTable

QUERIES, ORACLES = {}, {}
GROUP = ["model_run_id", "threshold"]


def query(name, sql=None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return function
    return register


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


SCORED_SQL = """
with scored as (select p.model_run_id, p.threshold, p.fail_probability, p.predicted_value, l.actual_value
  from fx_prediction_volume p left join fx_label_volume l on l.sample_id = p.sample_id),
confused as (select model_run_id, threshold, count(*) as n_decisions, count(actual_value) as n_samples,
    count(*) filter (where actual_value = 1) as n_fail_samples, count(*) filter (where actual_value = -1) as n_pass_samples,
    count(*) filter (where actual_value = -1 and predicted_value = -1) as true_negative,
    count(*) filter (where actual_value = -1 and predicted_value = 1) as false_positive,
    count(*) filter (where actual_value = 1 and predicted_value = -1) as false_negative,
    count(*) filter (where actual_value = 1 and predicted_value = 1) as true_positive from scored group by 1, 2),
steps as (select model_run_id, threshold, fail_probability, count(*) filter (where actual_value = 1) as pos, count(*) as n
  from scored where actual_value is not null group by 1, 2, 3),
cumulated as (select *, sum(pos) over w as cum_pos, sum(n) over w as cum_n, sum(pos) over (partition by model_run_id, threshold) as all_pos
  from steps window w as (partition by model_run_id, threshold order by fail_probability desc)),
precision_steps as (select model_run_id, threshold, case when max(all_pos) > 0 then
    sum((cum_pos - pos_before) / all_pos * (cum_pos / cum_n)) end as ap from (
    select *, coalesce(lag(cum_pos) over (partition by model_run_id, threshold order by fail_probability desc), 0) as pos_before from cumulated)
  group by 1, 2),
rated as (select c.*, ap, (true_negative + true_positive)::double / nullif(n_samples, 0) as accuracy,
    coalesce(true_positive::double / nullif(true_positive + false_positive, 0), 0) as prec,
    coalesce(true_positive::double / nullif(true_positive + false_negative, 0), 0) as rec,
    (select avg(r) from (values (true_positive::double / nullif(true_positive + false_negative, 0)),
      (true_negative::double / nullif(true_negative + false_positive, 0))) v(r)) as balanced_accuracy
  from confused c join precision_steps using (model_run_id, threshold)),
final as (select *, case when prec + rec = 0 then 0 else 2 * prec * rec / (prec + rec) end as f1 from rated)
"""


def scored_volume(spark, sf):
    labels = fx.label_volume(spark, sf).select("sample_id", "label_event_id", "actual_value")
    return fx.prediction_volume(spark, sf).join(labels, "sample_id", "left")


@query("confusion", SCORED_SQL + "select model_run_id, threshold, true_negative, false_positive, false_negative, true_positive from confused")
def confusion(spark, sf):
    return quality.confusion(scored_volume(spark, sf), GROUP)


@query("quality_rates", SCORED_SQL + """
select model_run_id, threshold, n_decisions, n_samples, n_fail_samples, n_pass_samples, true_negative, false_positive, false_negative, true_positive,
  round(accuracy, 6) as accuracy, round(balanced_accuracy, 6) as balanced_accuracy, round(prec, 6) as fail_precision, round(rec, 6) as fail_recall,
  round(f1, 6) as fail_f1, round(ap, 6) as pr_auc from final""")
def rates(spark, sf):
    found = quality.quality(scored_volume(spark, sf), GROUP)
    return rounded(found, "accuracy", "balanced_accuracy", "fail_precision", "fail_recall", "fail_f1", "pr_auc")


@query("average_precision", SCORED_SQL + """
select model_run_id, threshold, n_samples, n_fail_samples, round(ap, 6) as average_precision from final""")
def average_precision(spark, sf):
    return rounded(quality.average_precision(scored_volume(spark, sf), GROUP), "average_precision")


@query("live_quality", LIVE_SQL + """
, confused as (select model_run_id, threshold, count(*) as n_decisions, count(actual_value) as n_samples,
    count(*) filter (where actual_value = 1) as n_fail_samples, count(*) filter (where actual_value = -1) as n_pass_samples,
    count(*) filter (where actual_value = -1 and predicted_value = -1) as true_negative,
    count(*) filter (where actual_value = -1 and predicted_value = 1) as false_positive,
    count(*) filter (where actual_value = 1 and predicted_value = -1) as false_negative,
    count(*) filter (where actual_value = 1 and predicted_value = 1) as true_positive from scored group by 1, 2),
steps as (select a.model_run_id, a.threshold, a.fail_probability, count(*) filter (where a.actual_value = 1) as pos, count(*) as n
  from scored a where actual_value is not null group by 1, 2, 3),
ranked as (select *, sum(pos) over w as cum_pos, sum(n) over w as cum_n from steps
  window w as (partition by model_run_id, threshold order by fail_probability desc)),
ap as (select model_run_id, threshold, sum(pos * cum_pos / cum_n) / nullif(sum(pos), 0) as ap from ranked group by 1, 2),
judged as (select *, n_samples::double / n_decisions as coverage, case when n_decisions < 30 then 'insufficient_decisions'
    when n_samples::double / n_decisions < 0.5 then 'insufficient_label_coverage' when n_fail_samples < 10 then 'insufficient_fail_labels'
    when n_pass_samples < 10 then 'insufficient_pass_labels' else 'ok' end as evaluation_status
  from confused left join ap using (model_run_id, threshold))
select model_run_id, threshold, n_decisions, n_samples, n_pass_samples, n_fail_samples, round(coverage, 6) as label_coverage, evaluation_status,
  case when evaluation_status = 'ok' then round((true_negative + true_positive)::double / n_samples, 6) end as accuracy,
  case when evaluation_status = 'ok' then round(coalesce(true_positive::double / nullif(true_positive + false_positive, 0), 0), 6) end as fail_precision,
  case when evaluation_status = 'ok' then round(true_positive::double / n_fail_samples, 6) end as fail_recall,
  case when evaluation_status = 'ok' then round(2.0::double * true_positive / (2 * true_positive + false_positive + false_negative), 6) end as fail_f1,
  case when evaluation_status = 'ok' then round(ap, 6) end as fail_average_precision,
  true_negative, false_positive, false_negative, true_positive from judged""")
def live_quality(spark, sf):
    found = quality.live_quality(
        live_members(spark, sf), min_decisions=30, min_label_coverage=0.5, min_fail_samples=10, min_pass_samples=10
    )
    return rounded(found, "label_coverage", "accuracy", "fail_precision", "fail_recall", "fail_f1", "fail_average_precision")


@query("live_quality_refused", LIVE_SQL + """
select model_run_id, threshold, count(*) as n_decisions, 'insufficient_decisions' as evaluation_status, null::double as accuracy,
  count(*) filter (where actual_value = 1 and predicted_value = 1) as true_positive from scored group by 1, 2""")
def live_quality_refused(spark, sf):
    found = quality.live_quality(
        live_members(spark, sf), min_decisions=10_000_000, min_label_coverage=0.5, min_fail_samples=10, min_pass_samples=10
    )
    return found.select("model_run_id", "threshold", "n_decisions", "evaluation_status", "accuracy", "true_positive")


@query("classification_report", SCORED_SQL + """
, lines as (select model_run_id, threshold, '-1' as row_, true_negative as hit, false_negative as wrong, false_positive as missed from confused
  union all select model_run_id, threshold, '1', true_positive, false_positive, false_negative from confused),
scores as (select model_run_id, threshold, row_, coalesce(hit::double / nullif(hit + wrong, 0), 0) as p, coalesce(hit::double / nullif(hit + missed, 0), 0) as r,
  coalesce(2.0::double * hit / nullif(2 * hit + wrong + missed, 0), 0) as f, hit + missed as support from lines),
everything as (select model_run_id, threshold, row_ as "row", p, r, f, support from scores
  union all select model_run_id, threshold, 'macro avg', avg(p), avg(r), avg(f), sum(support) from scores group by 1, 2
  union all select model_run_id, threshold, 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f * support) / sum(support), sum(support)
    from scores group by 1, 2)
select model_run_id, threshold, "row", round(p, 6) as precision, round(r, 6) as recall, round(f, 6) as f1, support::bigint as support from everything""")
def report(spark, sf):
    return rounded(quality.classification_report(scored_volume(spark, sf), GROUP), "precision", "recall", "f1")


@query("threshold_sweep", """
with scored as (select p.model_run_id, p.fail_probability, l.actual_value from fx_prediction_volume p join fx_label_volume l on l.sample_id = p.sample_id),
swept as (select s.model_run_id, t.threshold::double as threshold, count(*) filter (where actual_value = -1 and fail_probability < t.threshold) as true_negative,
    count(*) filter (where actual_value = -1 and fail_probability >= t.threshold) as false_positive,
    count(*) filter (where actual_value = 1 and fail_probability < t.threshold) as false_negative,
    count(*) filter (where actual_value = 1 and fail_probability >= t.threshold) as true_positive
  from scored s cross join (values (0.1::double), (0.2::double), (0.3::double), (0.4::double), (0.5::double)) t(threshold) group by 1, 2)
select *, round((true_positive + true_negative)::double / (true_positive + true_negative + false_positive + false_negative), 6) as accuracy,
  round(coalesce(true_positive::double / nullif(true_positive + false_positive, 0), 0), 6) as fail_precision,
  round(coalesce(true_positive::double / nullif(true_positive + false_negative, 0), 0), 6) as fail_recall,
  round(coalesce(2.0::double * true_positive / nullif(2 * true_positive + false_positive + false_negative, 0), 0), 6) as fail_f1 from swept""")
def sweep(spark, sf):
    scored = scored_volume(spark, sf).drop("threshold")
    found = quality.threshold_sweep(scored, ["model_run_id"], [0.1, 0.2, 0.3, 0.4, 0.5])
    return rounded(found, "accuracy", "fail_precision", "fail_recall", "fail_f1").drop("pr_auc", "balanced_accuracy")


@query("best_threshold", """
with scored as (select p.fail_probability, l.actual_value from fx_prediction_volume p join fx_label_volume l on l.sample_id = p.sample_id),
swept as (select t.threshold, count(*) filter (where actual_value = -1 and fail_probability >= t.threshold) as fp,
    count(*) filter (where actual_value = 1 and fail_probability < t.threshold) as fn,
    count(*) filter (where actual_value = 1 and fail_probability >= t.threshold) as tp
  from scored s cross join (values (0.1::double), (0.2::double), (0.3::double), (0.4::double), (0.5::double)) t(threshold) group by 1)
select threshold, fp as false_positive, fn as false_negative, tp as true_positive from swept
order by 2.0::double * tp / nullif(2 * tp + fp + fn, 0) desc, tp::double / nullif(tp + fn, 0) desc limit 1""")
def best(spark, sf):
    scored = scored_volume(spark, sf).withColumn("all_rows", F.lit(1)).drop("threshold")
    found = quality.threshold_sweep(scored, ["all_rows"], [0.1, 0.2, 0.3, 0.4, 0.5])
    return quality.best_setting(found, ["threshold"]).select("threshold", "false_positive", "false_negative", "true_positive")


@query("rethreshold", """
select model_run_id, case when fail_probability >= 0.3::double then 1 else -1 end as decision, count(*) as rows_ from fx_prediction_volume group by 1, 2""")
def rethreshold(spark, sf):
    from proofline.functions.scalars import decide

    decision = decide(F.col("fail_probability"), F.lit(0.3))
    return fx.prediction_volume(spark, sf).groupBy("model_run_id", decision.alias("decision")).agg(F.count(F.lit(1)).alias("rows_"))


@query("offline_model_metrics", """
with labels as (select * from (select *, row_number() over (partition by sample_id order by label_revision desc) as r from fx_labels where available_at <= {CUTOFF}) where r = 1),
first_ as (select * from (select *, row_number() over (partition by sample_id order by available_at, snapshot_version, serving_snapshot_id) as r
  from fx_snapshots where is_complete) where r = 1),
scored as (select l.actual_value, coalesce(s.f0, 0.0) / 500.0 as score, case when coalesce(s.f0, 0.0) / 500.0 >= 0.2 then 1 else -1 end as predicted
  from first_ s join labels l using (sample_id)),
c as (select count(*) as n, count(*) filter (where actual_value = 1) as n_fail, count(*) filter (where actual_value = -1 and predicted = -1) as tn,
    count(*) filter (where actual_value = -1 and predicted = 1) as fp, count(*) filter (where actual_value = 1 and predicted = -1) as fn,
    count(*) filter (where actual_value = 1 and predicted = 1) as tp from scored),
steps as (select score, count(*) filter (where actual_value = 1) as pos, count(*) as m from scored group by 1),
ap as (select sum(pos * cp / cm) / nullif(sum(pos), 0) as ap from (select *, sum(pos) over (order by score desc) as cp, sum(m) over (order by score desc) as cm from steps)),
wide as (select *, (select ap from ap) as ap from c)
select {CUTOFF} as build_cutoff_time, 'run-a' as model_run_id, 0.2::double as threshold, n as n_samples, n_fail as n_fail_samples, m.metric_name, round(m.v, 6) as metric_value
from wide, lateral (values ('accuracy', (tn + tp)::double / n), ('fail_precision', coalesce(tp::double / nullif(tp + fp, 0), 0)),
  ('fail_recall', coalesce(tp::double / nullif(tp + fn, 0), 0)), ('fail_f1', coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0)),
  ('true_negative', tn::double), ('false_positive', fp::double), ('false_negative', fn::double), ('true_positive', tp::double), ('pr_auc', ap)) m(metric_name, v)""")
def offline_metrics(spark, sf):
    labels = latest.labels_at(fx.labels(spark, sf), CUTOFF).select("sample_id", "actual_value")
    firsts = latest.first_complete(fx.snapshots(spark, sf))
    score = F.coalesce(F.col("features")["f000"], F.lit(0.0)) / 500.0
    scored = firsts.select(
        "sample_id", offline_id(F.col("sample_id"), F.lit(CUTOFF)).alias("offline_snapshot_id"),
        F.lit(CUTOFF).alias("build_cutoff_time"), F.lit("run-a").alias("model_run_id"), F.lit(0.2).alias("threshold"),
        score.alias("fail_probability"), F.when(score >= 0.2, FAIL).otherwise(-1).alias("predicted_value"),
    ).join(labels, "sample_id")
    return rounded(quality.offline_metrics(scored), "metric_value")


@query("gate_compare", """
with labels as (select sample_id, actual_value from fx_label_volume),
scored as (select p.model_run_id, p.predicted_value, l.actual_value from fx_prediction_volume p join labels l using (sample_id)
  where p.model_run_id in ('A', 'R')),
c as (select model_run_id, count(*) filter (where actual_value = -1 and predicted_value = 1) as fp,
    count(*) filter (where actual_value = 1 and predicted_value = -1) as fn, count(*) filter (where actual_value = 1 and predicted_value = 1) as tp from scored group by 1),
m as (select model_run_id, coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0) as f1, coalesce(tp::double / nullif(tp + fn, 0), 0) as rec,
  coalesce(tp::double / nullif(tp + fp, 0), 0) as prec from c),
d as (select a.f1 - r.f1 as df, a.rec - r.rec as dr, a.prec - r.prec as dp from m a, m r where a.model_run_id = 'A' and r.model_run_id = 'R'),
w as (select d.*, (select string_agg(printf('%s %.6f %.6f', c, need, got), '; ' order by c) from (values ('fail_f1', 0.0, df),
    ('fail_recall', -0.02, dr), ('fail_precision', -0.05, dp)) g(c, need, got) where got < need) as missed from d)
select if(missed is null, 'passed', 'failed') as gate_status, coalesce(missed, '') as reasons, round(df, 6) as primary_delta,
  round(dr, 6) as recall_delta, round(dp, 6) as precision_delta from w""")
def gate_compare(spark, sf):
    scored = scored_volume(spark, sf)
    sides = [quality.quality(scored.where(F.col("model_run_id") == run), ["model_run_id"]) for run in ("A", "R")]
    found = quality.compare_gate(quality.metric_deltas(*sides))
    return rounded(listed(found), "primary_delta", "recall_delta", "precision_delta")


@query("latest_labeled", LIVE_SQL + """
select prediction_id, sample_id, predicted_at, actual_value from (select * from scored where label_event_id is not null
  order by predicted_at desc, prediction_id desc limit 15)""")
def newest_labeled(spark, sf):
    found = quality.latest_labeled(live_members(spark, sf), "predicted_at", ["prediction_id"], 15)
    return found.select("prediction_id", "sample_id", "predicted_at", "actual_value")


@query("prediction_window_metrics", """
with newest as (select * from fx_predictions order by predicted_at desc, prediction_id desc limit 200),
wide as (select model_run_id, threshold, min(predicted_at) as window_start, max(predicted_at) as window_end, count(*) as n_predictions,
    count(distinct request_id) as requests, count(*) filter (where predicted_value = 1) as fails, count(*) filter (where predicted_value = -1) as passes,
    avg(fail_probability) as p_avg, quantile_cont(fail_probability, 0.5) as p50, quantile_cont(fail_probability, 0.95) as p95,
    min(fail_probability) as p_min, max(fail_probability) as p_max, avg(missing_count) as m_avg, quantile_cont(missing_count::double, 0.5) as m50,
    quantile_cont(missing_count::double, 0.95) as m95, max(missing_count) as m_max, avg(latency_ms) as l_avg, quantile_cont(latency_ms, 0.95) as l95
  from newest group by 1, 2)
select model_run_id, threshold, window_start, window_end, n_predictions, m.name as metric_name, round(m.v, 6) as metric_value from wide,
  lateral (values ('prediction_count', n_predictions::double), ('request_count', requests::double), ('predicted_fail_count', fails::double),
    ('predicted_pass_count', passes::double), ('predicted_fail_ratio', fails::double / n_predictions), ('fail_probability_mean', p_avg),
    ('fail_probability_p50', p50), ('fail_probability_p95', p95), ('fail_probability_min', p_min), ('fail_probability_max', p_max),
    ('missing_count_mean', m_avg), ('missing_count_p50', m50), ('missing_count_p95', m95), ('missing_count_max', m_max::double),
    ('latency_ms_mean', l_avg), ('latency_ms_p95', l95)) m(name, v)
where (select count(*) from newest) >= 200""")
def window_metrics(spark, sf):
    return rounded(stats.prediction_window_metrics(fx.predictions(spark, sf), 200), "metric_value")


@query("prediction_window_metrics_all", """
select model_run_id, threshold, count(*) as n_predictions, round(quantile_cont(fail_probability, 0.95), 6) as fail_probability_p95,
  round(quantile_cont(missing_count::double, 0.5), 6) as missing_count_p50, round(quantile_cont(latency_ms, 0.95), 6) as latency_ms_p95
from fx_prediction_volume group by 1, 2""")
def window_metrics_all(spark, sf):
    rows = fx.prediction_volume(spark, sf).withColumn("request_id", F.col("sample_id"))
    found = stats.prediction_window_metrics(rows, None)
    wide = found.groupBy("model_run_id", "threshold", "n_predictions").agg(*[
        F.max(F.when(F.col("metric_name") == n, F.col("metric_value"))).alias(n)
        for n in ("fail_probability_p95", "missing_count_p50", "latency_ms_p95")
    ])
    return rounded(wide, "fail_probability_p95", "missing_count_p50", "latency_ms_p95")


def long_volume(spark, sf):
    return lengthen(fx.prediction_volume(spark, sf), [*GROUP, "predicted_at", "prediction_id"])


@query("feature_stats", """
select model_run_id, threshold, feature_index, feature_name, count(*) as samples, count(*) - count(value) as null_count, count(value) as non_null,
  round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std from fx_volume_long group by 1, 2, 3, 4""")
def feature_statistics(spark, sf):
    found = stats.feature_stats(long_volume(spark, sf), GROUP)
    return rounded(found, "mean", "std").drop("sum", "sum_sq")


@query("column_median", """
select feature_name, round(median(value), 6) as median from fx_volume_long where value is not null group by 1""")
def medians(spark, sf):
    return rounded(stats.feature_medians(long_volume(spark, sf)), "median")


@query("linear_percentiles", """
select model_run_id, threshold, round(quantile_cont(latency_ms, 0.5), 6) as p50, round(quantile_cont(latency_ms, 0.95), 6) as p95,
  round(quantile_cont(latency_ms, 0.99), 6) as p99 from fx_prediction_volume group by 1, 2""")
def linear(spark, sf):
    return rounded(stats.percentiles(fx.prediction_volume(spark, sf), GROUP, "latency_ms", [0.5, 0.95, 0.99]), "p50", "p95", "p99")


@query("indexed_percentile", """
with ranked as (select model_run_id, latency_ms, row_number() over (partition by model_run_id order by latency_ms) - 1 as i,
  count(*) over (partition by model_run_id) as n from fx_prediction_volume)
select model_run_id, max(case when i = cast(floor((n - 1) * 0.5::double) as bigint) then latency_ms end) as p50,
  max(case when i = cast(floor((n - 1) * 0.95::double) as bigint) then latency_ms end) as p95 from ranked group by 1""")
def indexed(spark, sf):
    return stats.percentiles(fx.prediction_volume(spark, sf), ["model_run_id"], "latency_ms", [0.5, 0.95], lower=True)


# Recent against previous window.
WIDE_MINUTES = 5 * 24 * 60
SIDES_SQL = """
with resolved as (select p.*, s.f0, s.f1, s.f2, s.f3, s.f4 from fx_predictions p join fx_snapshots s on s.serving_snapshot_id = p.serving_snapshot_id
  and s.sample_id = p.sample_id and s.snapshot_version = p.snapshot_version and s.feature_hash = p.feature_hash),
ends as (select model_run_id, threshold, max(predicted_at) as current_end from resolved group by 1, 2),
sided as (select r.*, e.current_end, case when predicted_at > current_end - 432000 then 'c' else 'b' end as side from resolved r
  join ends e using (model_run_id, threshold) where predicted_at > current_end - 864000 and predicted_at <= current_end),
"""
FAMILY_SQL = SIDES_SQL + """
g as (select model_run_id, threshold, side, count(*) as n, count(*) filter (where predicted_value = 1) as fails, avg(fail_probability) as p_avg,
    quantile_cont(fail_probability, 0.5) as p50, quantile_cont(fail_probability, 0.95) as p95, avg(missing_count) as m_avg,
    quantile_cont(missing_count::double, 0.95) as m95, max(missing_count)::double as m_max from sided group by 1, 2, 3),
long as (select g.model_run_id, g.threshold, g.side, g.n, m.family, m.name, m.v from g, lateral (values ('output', 'prediction_count', n::double),
  ('output', 'predicted_fail_ratio', fails::double / n), ('output', 'fail_probability_avg', p_avg), ('output', 'fail_probability_p50', p50),
  ('output', 'fail_probability_p95', p95), ('input', 'missing_count_avg', m_avg), ('input', 'missing_count_p95', m95), ('input', 'missing_count_max', m_max)) m(family, name, v)),
faced as (select c.model_run_id, c.threshold, c.family as metric_family, c.name as metric_name, c.v as current_value,
    case when b.v is null and c.name = 'prediction_count' then 0.0::double else b.v end as baseline_value,
    coalesce(b.n, 0) as baseline_samples, c.n as current_samples
  from (select * from long where side = 'c') c left join (select * from long where side = 'b') b
    on b.model_run_id = c.model_run_id and b.threshold = c.threshold and b.name = c.name)
select model_run_id, threshold, metric_family, metric_name, round(current_value, 6) as metric_value, round(baseline_value, 6) as baseline_value,
  round(current_value, 6) as current_value, round(current_value - baseline_value, 6) as delta_value, baseline_samples, current_samples from faced
where metric_family = '{family}'"""
METRICS = ["metric_value", "baseline_value", "current_value", "delta_value"]


def recent(spark, sf, family):
    snaps = fx.snapshots(spark, sf)
    found = drift.recent_drift(fx.predictions(spark, sf, snaps), snaps, WIDE_MINUTES, 3, 10, 10)
    return rounded(found.where(F.col("metric_family") == family), *METRICS)


@query("drift_recent_output", FAMILY_SQL.replace("{family}", "output"))
def drift_output(spark, sf):
    return recent(spark, sf, "output").select(*GROUP, "metric_family", "metric_name", *METRICS, "baseline_samples", "current_samples")


@query("drift_recent_input", FAMILY_SQL.replace("{family}", "input"))
def drift_input(spark, sf):
    return recent(spark, sf, "input").select(*GROUP, "metric_family", "metric_name", *METRICS, "baseline_samples", "current_samples")


@query("drift_recent_feature", SIDES_SQL + """
long as (select s.model_run_id, s.threshold, s.side, s.current_end, v.i, v.value from sided s, lateral (values (0, f0), (1, f1), (2, f2), (3, f3), (4, f4)) v(i, value)),
st as (select model_run_id, threshold, side, max(current_end) as current_end, i, count(*) as n, count(value) as nn, avg(value) as mu,
  case when count(value) < 2 then 0.0::double else stddev_samp(value) end as sd from long group by 1, 2, 3, 5),
faced as (select b.model_run_id, b.threshold, b.current_end, b.i, b.n as bn, c.n as cn, b.nn as bnn, c.nn as cnn, b.mu as bmu, c.mu as cmu,
    greatest(b.sd, c.sd, 1e-9::double) as spread, (b.n - b.nn)::double / b.n as bmiss, (c.n - c.nn)::double / c.n as cmiss
  from (select * from st where side = 'b') b join (select * from st where side = 'c') c using (model_run_id, threshold, i)),
scores as (select model_run_id, threshold, current_end, i, 'feature_mean_standardized_delta' as metric_name, abs(cmu - bmu) / spread as score, bmu as b, cmu as c, bnn as bs, cnn as cs
    from faced where bnn >= 10 and cnn >= 10
  union all select model_run_id, threshold, current_end, i, 'feature_missing_ratio_abs_delta', abs(cmiss - bmiss), bmiss, cmiss, bn, cn from faced where bn >= 10 and cn >= 10),
ranked as (select *, row_number() over (partition by model_run_id, threshold, metric_name order by score desc, i) as r from scores)
select model_run_id, threshold, metric_name, concat('f00', i::varchar) as feature_name, round(score, 6) as metric_value, round(b, 6) as baseline_value,
  round(c, 6) as current_value, round(c - b, 6) as delta_value, bs as baseline_samples, cs as current_samples, current_end,
  current_end - 864000.0::double as baseline_start, current_end - 432000.0::double as current_start from ranked where r <= 3""")
def drift_feature(spark, sf):
    return recent(spark, sf, "feature").select(
        *GROUP, "metric_name", "feature_name", *METRICS, "baseline_samples", "current_samples", "current_end",
        "baseline_start", "current_start",
    )


@query("drift_recent_stored")
def drift_stored(spark, sf):
    """The same from predictions stored by day, whose older days are not read."""
    snaps = fx.snapshots(spark, sf)
    resolved = latest.resolved_predictions(fx.predictions(spark, sf, snaps), snaps)
    table = DayTable(scratch(spark, "by-day"), "predicted_at")
    table.append(resolved)
    models = table.read(spark).select(*GROUP).distinct()
    found = drift.stored_recent_drift(
        table, spark, models, WIDE_MINUTES, top_n_features=3, min_feature_non_null=10, min_feature_samples=10
    )
    return rounded(found.where(F.col("metric_family") == "feature"), *METRICS).select(
        *GROUP, "metric_name", "feature_name", *METRICS, "baseline_samples", "current_samples", "current_end",
        "baseline_start", "current_start",
    )


ORACLES["drift_recent_stored"] = ORACLES["drift_recent_feature"]


# Fixed reference: two early years of each model's volume is the baseline.
LOW, HIGH = 820454400.0, 883612800.0
YEAR_MINUTES = 365 * 24 * 60
REFERENCE_SQL = """
with reference as (select * from fx_prediction_volume where predicted_at > {LOW} and predicted_at <= {HIGH}),
reference_long as (select * from fx_volume_long where predicted_at > {LOW} and predicted_at <= {HIGH}),
"""


def with_limits(sql):
    return sql.replace("{LOW}", f"{LOW}::double").replace("{HIGH}", f"{HIGH}::double")


def volume_reference(spark, sf):
    at = F.col("predicted_at")
    rows = fx.prediction_volume(spark, sf).where((at > LOW) & (at <= HIGH))
    return rows.withColumn("baseline_id", F.concat_ws("@", F.col("model_run_id"), F.col("threshold").cast("string")))


@query("baseline_stats", with_limits(REFERENCE_SQL + """
wide as (select model_run_id, threshold, count(*) as n, count(*) filter (where predicted_value = 1) as fails, avg(fail_probability) as p_avg,
    quantile_cont(fail_probability, 0.5) as p50, quantile_cont(fail_probability, 0.95) as p95, avg(missing_count) as m_avg,
    quantile_cont(missing_count::double, 0.95) as m95, max(missing_count)::double as m_max from reference group by 1, 2),
totals as (select model_run_id, threshold, m.family, m.name, null::varchar as feature_name, m.v, n, case when m.plain then null else n end as nn, null::bigint as nulls
  from wide, lateral (values ('output', 'prediction_count', n::double, true), ('output', 'predicted_fail_ratio', fails::double / n, true),
  ('output', 'fail_probability_avg', p_avg, false), ('output', 'fail_probability_p50', p50, false), ('output', 'fail_probability_p95', p95, false),
  ('input', 'missing_count_avg', m_avg, false), ('input', 'missing_count_p95', m95, false), ('input', 'missing_count_max', m_max, false)) m(family, name, v, plain)),
st as (select model_run_id, threshold, feature_name, count(*) as n, count(value) as nn, count(*) - count(value) as nulls, avg(value) as mu, stddev_samp(value) as sd
  from reference_long group by 1, 2, 3),
features as (select model_run_id, threshold, 'feature' as family, m.name, feature_name, m.v, n, nn, nulls from st,
  lateral (values ('feature_missing_ratio', nulls::double / n), ('feature_mean', mu), ('feature_std', sd)) m(name, v) where nn >= 30)
select concat(model_run_id, '@', threshold::varchar) as baseline_id, family as metric_family, name as metric_name, feature_name, round(v, 6) as metric_value,
  n as sample_count, nn as non_null_count, nulls as null_count from (select * from totals union all select * from features)"""))
def baseline_stats(spark, sf):
    found = drift.reference_stats(volume_reference(spark, sf)).where(F.col("metric_name") != "feature_distribution_bins")
    return rounded(found, "metric_value").drop("binning", "bin_edges", "bin_counts", "bin_ratios")


BINS_SQL = REFERENCE_SQL + """
q as (select model_run_id, threshold, feature_name, count(value) as nn, min(value) as lo, max(value) as hi,
  list_distinct(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) as qs from reference_long where value is not null group by 1, 2, 3),
edges as (select *, list_sort(qs) as es from q),
buckets as (select r.model_run_id, r.threshold, r.feature_name, len(list_filter(e.es, lambda x: x < r.value)) as b, count(*) as c
  from reference_long r join edges e using (model_run_id, threshold, feature_name) where r.value is not null group by 1, 2, 3, 4),
grid as (select model_run_id, threshold, feature_name, nn, lo, hi, es, unnest(range(0, len(es) + 1)) as b from edges),
filled as (select g.*, coalesce(c.c, 0) as c from grid g left join buckets c using (model_run_id, threshold, feature_name, b)),
"""


@query("baseline_bins", with_limits(BINS_SQL + """
x as (select 1)
select model_run_id, threshold, feature_name, b::int as bucket, nn as non_null_count, lo as min_value, hi as max_value, c as bucket_count,
  round(c::double / nn, 6) as bucket_ratio, round(case when b < len(es) then es[b + 1] end, 6) as upper_edge from filled"""))
def baseline_bins(spark, sf):
    long = lengthen(volume_reference(spark, sf), GROUP)
    found = bins.reference_bins(long, [*GROUP, "feature_name"])
    rows = found.select(
        *GROUP, "feature_name", "non_null_count", "min_value", "max_value", "bin_edges",
        F.posexplode(F.arrays_zip("bin_counts", "bin_ratios")).alias("bucket", "_b"),
    )
    edge = F.get("bin_edges", F.col("bucket"))
    return rows.select(
        *GROUP, "feature_name", "bucket", "non_null_count", "min_value", "max_value",
        F.col("_b.bin_counts").alias("bucket_count"), F.round("_b.bin_ratios", 6).alias("bucket_ratio"),
        F.round(edge, 6).alias("upper_edge"),
    )


def fixed(spark, sf):
    rows = volume_reference(spark, sf)
    baselines = rows.groupBy("baseline_id", *GROUP).agg(
        F.lit(LOW).alias("source_start"), F.lit(HIGH).alias("source_end")
    )
    return drift.fixed_drift(
        fx.prediction_volume(spark, sf), baselines, drift.reference_stats(rows), None, YEAR_MINUTES, 3
    )


CURRENT_SQL = """
ends as (select model_run_id, threshold, max(predicted_at) as current_end from fx_prediction_volume group by 1, 2),
current_ as (select p.* from fx_prediction_volume p join ends e using (model_run_id, threshold) where predicted_at > current_end - 31536000 and predicted_at <= current_end),
current_long as (select p.* from fx_volume_long p join ends e using (model_run_id, threshold) where predicted_at > current_end - 31536000 and predicted_at <= current_end and value is not null),
"""


@query("drift_fixed_psi", with_limits(BINS_SQL + CURRENT_SQL + """
now_ as (select r.model_run_id, r.threshold, r.feature_name, len(list_filter(e.es, lambda x: x < r.value)) as b, count(*) as c
  from current_long r join edges e using (model_run_id, threshold, feature_name) group by 1, 2, 3, 4),
sizes as (select model_run_id, threshold, feature_name, count(*) as n from current_long group by 1, 2, 3),
terms as (select f.model_run_id, f.threshold, f.feature_name, f.nn, s.n, greatest(f.c::double / f.nn, 1e-6::double) as e, greatest(coalesce(w.c, 0)::double / s.n, 1e-6::double) as a
  from filled f join sizes s using (model_run_id, threshold, feature_name) left join now_ w using (model_run_id, threshold, feature_name, b) where f.nn >= 30 and s.n >= 30),
psi as (select model_run_id, threshold, feature_name, max(nn) as bs, max(n) as cs, sum((a - e) * ln(a / e)) as psi from terms group by 1, 2, 3),
ranked as (select *, row_number() over (partition by model_run_id, threshold order by psi desc, feature_name) as r from psi)
select concat(model_run_id, '@', threshold::varchar) as reference_baseline_id, feature_name, round(psi, 6) as metric_value, 0.0::double as baseline_value,
  bs as baseline_samples, cs as current_samples from ranked where r <= 3"""))
def fixed_psi(spark, sf):
    found = fixed(spark, sf).where(F.col("metric_name") == "feature_psi")
    return rounded(found, "metric_value").select(
        "reference_baseline_id", "feature_name", "metric_value", "baseline_value", "baseline_samples", "current_samples"
    )


@query("drift_fixed_feature", with_limits(REFERENCE_SQL + CURRENT_SQL + """
b as (select model_run_id, threshold, feature_name, count(*) as n, count(value) as nn, avg(value) as mu, stddev_samp(value) as sd from reference_long group by 1, 2, 3),
c as (select p.model_run_id, p.threshold, p.feature_name, count(*) as n, count(value) as nn, avg(value) as mu, stddev_samp(value) as sd from fx_volume_long p
  join ends e using (model_run_id, threshold) where predicted_at > current_end - 31536000 and predicted_at <= current_end group by 1, 2, 3),
scores as (select b.model_run_id, b.threshold, b.feature_name, 'feature_mean_standardized_delta' as metric_name,
    abs(c.mu - b.mu) / greatest(coalesce(b.sd, 0), coalesce(c.sd, 0), 1e-9::double) as score, b.mu as bv, c.mu as cv, b.nn as bs, c.nn as cs
  from b join c using (model_run_id, threshold, feature_name) where b.nn >= 30 and c.nn >= 30
  union all select b.model_run_id, b.threshold, b.feature_name, 'feature_missing_ratio_abs_delta',
    abs((c.n - c.nn)::double / c.n - (b.n - b.nn)::double / b.n), (b.n - b.nn)::double / b.n, (c.n - c.nn)::double / c.n, b.n, c.n
  from b join c using (model_run_id, threshold, feature_name) where b.n >= 30 and c.n >= 30),
ranked as (select *, row_number() over (partition by model_run_id, threshold, metric_name order by score desc, feature_name) as r from scores)
select concat(model_run_id, '@', threshold::varchar) as reference_baseline_id, metric_name, feature_name, round(score, 6) as metric_value,
  round(bv, 6) as baseline_value, round(cv, 6) as current_value, bs as baseline_samples, cs as current_samples from ranked where r <= 3"""))
def fixed_feature(spark, sf):
    found = fixed(spark, sf).where((F.col("metric_family") == "feature") & (F.col("metric_name") != "feature_psi"))
    return rounded(found, "metric_value", "baseline_value", "current_value").select(
        "reference_baseline_id", "metric_name", "feature_name", "metric_value", "baseline_value", "current_value",
        "baseline_samples", "current_samples",
    )


@query("drift_fixed_output", with_limits(REFERENCE_SQL + CURRENT_SQL + """
g as (select 'b' as side, model_run_id, threshold, count(*) as n, count(*) filter (where predicted_value = 1) as fails, avg(fail_probability) as p_avg,
    quantile_cont(fail_probability, 0.5) as p50, quantile_cont(fail_probability, 0.95) as p95, avg(missing_count) as m_avg,
    quantile_cont(missing_count::double, 0.95) as m95, max(missing_count)::double as m_max from reference group by 2, 3
  union all select 'c', model_run_id, threshold, count(*), count(*) filter (where predicted_value = 1), avg(fail_probability), quantile_cont(fail_probability, 0.5),
    quantile_cont(fail_probability, 0.95), avg(missing_count), quantile_cont(missing_count::double, 0.95), max(missing_count)::double from current_ group by 2, 3),
long as (select g.side, g.model_run_id, g.threshold, g.n, m.name, m.v from g, lateral (values ('prediction_count', n::double), ('predicted_fail_ratio', fails::double / n),
  ('fail_probability_avg', p_avg), ('fail_probability_p50', p50), ('fail_probability_p95', p95), ('missing_count_avg', m_avg), ('missing_count_p95', m95), ('missing_count_max', m_max)) m(name, v))
select concat(c.model_run_id, '@', c.threshold::varchar) as reference_baseline_id, c.name as metric_name, round(c.v, 6) as current_value, round(b.v, 6) as baseline_value,
  round(c.v - b.v, 6) as delta_value, b.n as baseline_samples, c.n as current_samples from long c join long b using (model_run_id, threshold, name)
where c.side = 'c' and b.side = 'b'"""))
def fixed_output(spark, sf):
    found = fixed(spark, sf).where(F.col("metric_family").isin("output", "input"))
    return rounded(found, "current_value", "baseline_value", "delta_value").select(
        "reference_baseline_id", "metric_name", "current_value", "baseline_value", "delta_value", "baseline_samples", "current_samples"
    )


@query("baseline_windows", """
with w as (select {START} + i * {DAY} as source_start, {START} + i * {DAY} + 3 * {DAY} as source_end from (select unnest(range(0, 18)) as i)),
kept as (select * from w where not (source_start < {START} + 7 * {DAY} and source_end > {START} + 6 * {DAY})),
g as (select p.model_run_id, p.threshold, k.source_start, k.source_end, count(*) as sample_count, min(predicted_at) as first_predicted_at, max(predicted_at) as last_predicted_at,
    count(*) filter (where predicted_value = 1)::double / count(*) as predicted_fail_ratio, avg(fail_probability) as p_avg, quantile_cont(fail_probability, 0.5) as p50,
    quantile_cont(fail_probability, 0.95) as p95, avg(missing_count) as m_avg, quantile_cont(missing_count::double, 0.5) as m50, quantile_cont(missing_count::double, 0.95) as m95,
    max(missing_count)::double as m_max
  from kept k join fx_predictions p on p.predicted_at > k.source_start and p.predicted_at <= k.source_end group by 1, 2, 3, 4 having count(*) >= 5),
ranked as (select *, row_number() over (partition by model_run_id, threshold order by sample_count desc, source_end desc) as r from g)
select model_run_id, threshold, source_start, source_end, sample_count, first_predicted_at, last_predicted_at, round(predicted_fail_ratio, 6) as predicted_fail_ratio,
  round(p_avg, 6) as fail_probability_avg, round(p50, 6) as fail_probability_p50, round(p95, 6) as fail_probability_p95, round(m_avg, 6) as missing_count_avg,
  round(m50, 6) as missing_count_p50, round(m95, 6) as missing_count_p95, m_max as missing_count_max from ranked where r <= 5""")
def windows(spark, sf):
    from catalog.fixtures import START

    found = proposal.propose_windows(
        fx.predictions(spark, sf), GROUP, START, START + 20 * DAY, 3 * DAY, DAY, 5,
        [(START + 6 * DAY, START + 7 * DAY)], 5,
    )
    return rounded(found, "predicted_fail_ratio", "fail_probability_avg", "fail_probability_p50", "fail_probability_p95",
                   "missing_count_avg", "missing_count_p50", "missing_count_p95").drop("window")
