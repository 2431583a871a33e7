"""Bindings of evaluation and stability reports on formula scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from kohorta.bindings.registry import query
from kohorta.bindings.shared import GAPPED_SQL, SCORES_SQL, gapped_part, scores
from kohorta.operators import evaluate as ev
from kohorta.operators.aggregates import histogram_counts, row_null_count


def r(df, digits=8):
    return df.selectExpr(*[f"round(`{c}`, {digits}) as `{c}`" if k == "double" else f"`{c}`" for c, k in df.dtypes])


RUNS = ["model", "run"]


@query("confusion_at_threshold", f"with {SCORES_SQL} select model, run, predicted, actual, cnt, round(cnt / sum(cnt) over (partition by model, run), 8) as cnt_p from (select model, run, score > 0.3 as predicted, label as actual, count(*) as cnt from scores group by all)")
def confusion(t):
    return r(ev.confusion_at_threshold(scores(t), RUNS, "score", "label"))


@query("classification_metrics", f"""with {SCORES_SQL}, c as (select model, run, count(*) filter (where score > 0.3 and label) as tp, count(*) filter (where score > 0.3 and not label) as fp,
  count(*) filter (where score <= 0.3 and label) as fn, count(*) filter (where score <= 0.3 and not label) as tn from scores group by all),
m as (select model, run, tp / (tp + fn) as recall, fp / (fp + tn) as fallout, tn / (fp + tn) as specificity, tp / (tp + fp) as precision from c)
select model, run, round(recall, 8) as recall, round(fallout, 8) as fallout, round(specificity, 8) as specificity, round(precision, 8) as precision,
  round(2 * precision * recall / (precision + recall), 8) as fmeasure from m""")
def metrics(t):
    return r(ev.classification_metrics(scores(t), RUNS, "score", "label"))


AUC_SQL = f"""{SCORES_SQL},
by_score as (select model, run, score, count(*) filter (where label) as pos, count(*) filter (where not label) as neg from scores group by all),
ranked as (select *, (sum(neg) over u)::bigint as neg_upto, (sum(pos) over u)::bigint as pos_upto,
    (sum(pos) over a)::bigint as p, (sum(neg) over a)::bigint as n from by_score
  window u as (partition by model, run order by score rows unbounded preceding), a as (partition by model, run)),
aucs as (select model, run, round(sum(pos * (neg_upto - neg / 2)) / (max(p)::double * max(n)), 8) as auc from ranked group by 1, 2)
"""


def aucs(t):
    return r(ev.auc(scores(t), RUNS, "score", "label"))


@query("auc", f"with {AUC_SQL} select * from aucs")
def auc(t):
    return aucs(t)


@query("auc_summary", f"with {AUC_SQL} select model, count(*) as cnt, round(avg(auc), 7) as avg_auc, round(stddev_samp(auc), 7) as sd_auc from aucs group by 1")
def auc_summary(t):
    return r(ev.auc_summary(aucs(t), "model"), 7)


@query("auc_ci", f"""with {AUC_SQL},
placed as (select *, (neg_upto - neg / 2) / n as a, (p - pos_upto + pos / 2) / p as b from ranked),
s as (select model, run, sum(pos * a) / max(p) as auc,
  (sum(pos * a * a) - sum(pos * a) * sum(pos * a) / max(p)) / (max(p) - 1) / max(p)
  + (sum(neg * b * b) - sum(neg * b) * sum(neg * b) / max(n)) / (max(n) - 1) / max(n) as variance from placed group by 1, 2)
select model, run, round(auc, 8) as auc, round(variance, 10) as variance,
  round(greatest(auc - 1.959963984540054 * sqrt(variance), 0), 7) as lower, round(least(auc + 1.959963984540054 * sqrt(variance), 1), 7) as upper from s""")
def auc_ci(t):
    out = ev.auc_ci(scores(t), RUNS, "score", "label")
    return out.select(*RUNS, F.round("auc", 8).alias("auc"), F.round("variance", 10).alias("variance"),
                      F.round("lower", 7).alias("lower"), F.round("upper", 7).alias("upper"))


@query("threshold_table", f"""with {SCORES_SQL}, t as (select unnest([0.1, 0.3, 0.9])::double as threshold)
select model, threshold, round(count(*) filter (where score <= threshold and not label) / count(*) filter (where not label), 8) as specificity,
  round(count(*) filter (where score > threshold and label) / count(*) filter (where label), 8) as sensitivity,
  round(count(*) filter (where score >= threshold) / count(distinct run), 8) as cnt_high_risk from scores, t group by 1, 2""")
def threshold_table(t):
    return r(ev.threshold_table(scores(t), ["model"], "score", "label", "run"))


def _sweep_sql(shares):
    return f"""{SCORES_SQL},
moved as (select model, run, label, score + ('0x' || substr(md5(concat_ws('|', model, run, patient, row_id, 7)), 1, 13))::bigint::double / 4503599627370496.0 * 1e-5 as v from scores),
sized as (select model, run, v, label, row_number() over (partition by model, run order by v) - 1 as place, count(*) over (partition by model, run) as size from moved),
grid as ({shares}),
wanted as (select model, run, share, max(size) as size, round((max(size) - 1) * (1 - share), 9) as h from sized, grid group by 1, 2, 3),
cut as (select w.*, a.v + (h - floor(h)) * (b.v - a.v) as threshold from wanted w
  join sized a on a.model = w.model and a.run = w.run and a.place = floor(h) join sized b on b.model = w.model and b.run = w.run and b.place = ceil(h)),
counted as (select c.model, c.run, share, threshold, count(*) filter (where v >= threshold and label) as tp, count(*) filter (where v >= threshold and not label) as fp,
  count(*) filter (where v < threshold and label) as fn, count(*) filter (where v < threshold and not label) as tn from cut c join sized s on c.model = s.model and c.run = s.run group by 1, 2, 3, 4),
sweep as (select model, run, round(share, 8) as share, round(threshold, 8) as threshold, tp, fp, fn, tn, round(tp / (tp + fn), 8) as recall, round(tp / (tp + fp), 8) as precision,
  round(tp / (tp + fn) / share, 8) as lift, round(tn / (fp + tn), 8) as specificity from counted)
"""


def _idents(t):
    return scores(t).withColumn("ident", F.concat_ws("|", F.col("patient").cast("string"), F.col("row_id").cast("string")))


@query("selection_metrics", f"with {_sweep_sql('select 0.05::double as share')} select * from sweep")
def selection_metrics(t):
    return r(ev.selection_metrics(_idents(t), RUNS, "score", "label", "ident", share=0.05, seed=7))


SHARES_SQL = ("select distinct share from (select 0.05::double + i * ((1.0::double - 0.05::double) / 49) as share from range(50) g(i) "
              "union all select unnest([0.05, 0.3, 0.5, 0.7, 0.95])::double)")


@query("sweep_selection", f"""with {_sweep_sql(SHARES_SQL)}, long as (select model, run, share, m.metric, m.value from (select *,
  [{{'metric': 'precision', 'value': precision}}, {{'metric': 'recall', 'value': recall}}, {{'metric': 'specificity', 'value': specificity}}, {{'metric': 'threshold', 'value': threshold}}] as ms from sweep), unnest(ms) u(m))
select * from long""")
def sweep_selection(t):
    out = r(ev.sweep_selection(_idents(t), RUNS, "score", "label", "ident", steps=50, marks=ev.SWEEP_MARKS, seed=7))
    return out.unpivot([*RUNS, "share"], ["precision", "recall", "specificity", "threshold"], "metric", "value")


ROC_SQL = f"""{SCORES_SQL},
by_score as (select model, run, score, count(*) filter (where label) as pos, count(*) filter (where not label) as neg from scores group by all),
points as (select model, run, sum(neg) over u / sum(neg) over a as fpr, sum(pos) over u / sum(pos) over a as tpr, score as cutoff from by_score
  window u as (partition by model, run order by score desc rows unbounded preceding), a as (partition by model, run)
  union all select distinct model, run, 0.0::double, 0.0::double, 'inf'::double from scores)
"""


def _curve_sql(size, points="points"):
    return f"""ends as (select min(fpr) as lo, max(fpr) as hi, (max(fpr) - min(fpr)) / ({size} - 1) as step from {points}),
tied as (select model, run, fpr as x, avg(tpr) as tpr, avg(cutoff) as cutoff from {points} group by 1, 2, 3),
grid as (select model, run, k::int as grid_no, lo + k * step as fpr from (select distinct model, run from {points}), ends, range({size}) g(k)),
lower_pt as (select g.model, g.run, grid_no, arg_max(struct_pack(x := x, tpr := tpr, cutoff := cutoff), x) as a from grid g join tied t on g.model = t.model and g.run = t.run and x <= fpr group by 1, 2, 3),
upper_pt as (select g.model, g.run, grid_no, arg_min(struct_pack(x := x, tpr := tpr, cutoff := cutoff), x) as b from grid g join tied t on g.model = t.model and g.run = t.run and x >= fpr group by 1, 2, 3),
curves as (select g.model, g.run, g.grid_no, fpr,
  case when a is null or b.x = fpr then b.tpr when b is null or a.x = fpr then a.tpr else a.tpr + (fpr - a.x) / (b.x - a.x) * (b.tpr - a.tpr) end as tpr,
  case when a is null or b.x = fpr then b.cutoff when b is null or a.x = fpr then a.cutoff else a.cutoff + (fpr - a.x) / (b.x - a.x) * (b.cutoff - a.cutoff) end as cutoff
  from grid g left join lower_pt l on g.model = l.model and g.run = l.run and g.grid_no = l.grid_no
  left join upper_pt u on g.model = u.model and g.run = u.run and g.grid_no = u.grid_no)
"""


def points(t):
    return ev.finite_points(ev.roc_points(scores(t), RUNS, "score", "label"))


@query("roc_points", f"with {ROC_SQL} select model, run, round(fpr, 8) as fpr, round(tpr, 8) as tpr, case when isfinite(cutoff) then round(cutoff, 8) end as cutoff from points")
def roc_points(t):
    out = r(ev.roc_points(scores(t), RUNS, "score", "label"))
    return out.withColumn("cutoff", F.when(F.col("cutoff") < float("inf"), F.col("cutoff")))


@query("finite_points", f"with {ROC_SQL}, p as (select model, run, fpr, tpr, round(tpr / nullif(fpr, 0), 7) as ratio from points) select model, run, round(fpr, 7) as fpr, round(tpr, 7) as tpr, ratio from p where ratio is not null")
def finite_points(t):
    out = ev.roc_points(scores(t), RUNS, "score", "label").drop("cutoff")
    ratio = F.when(F.col("fpr") == 0, F.lit(float("inf"))).otherwise(F.col("tpr") / F.when(F.col("fpr") != 0, F.col("fpr")))
    return r(ev.finite_points(out.withColumn("ratio", ratio), ["fpr", "tpr", "ratio"]), 7)


@query("curve_interpolate", f"with {ROC_SQL}, {_curve_sql(101)} select model, run, grid_no, round(fpr, 11) as fpr, round(tpr, 11) as tpr, case when isfinite(cutoff) then round(cutoff, 11) end as cutoff from curves")
def curve_interpolate(t):
    out = ev.curve_interpolate(points(t), RUNS, "fpr", ["tpr", "cutoff"], 101)
    return r(out.withColumn("cutoff", ev.finite_or_null(F.col("cutoff"))), 11)


@query("roc_vertical_average", f"""with {ROC_SQL}, {_curve_sql('(select max(c) from (select count(*) as c from points group by model, run))')},
averaged as (select model, grid_no, fpr, avg(tpr) as tpr, avg(cutoff) as cutoff from curves group by 1, 2, 3)
select model, grid_no, round(fpr, 7) as fpr, round(tpr, 7) as tpr, case when isfinite(cutoff) then round(cutoff, 7) end as cutoff from averaged""")
def roc_vertical_average(t):
    return r(ev.roc_vertical_average(points(t), ["model"], "run"), 7)


SPREAD_SQL = f"""{ROC_SQL}, {_curve_sql(40)},
spread as (select model, grid_no, fpr, avg(tpr) as tpr, stddev_samp(tpr) as sd, case when isfinite(avg(cutoff)) then avg(cutoff) end as cutoff,
  quantile_cont(case when isfinite(cutoff) then cutoff end, 0.025) as cutoff_low, quantile_cont(case when isfinite(cutoff) then cutoff end, 0.975) as cutoff_high from curves group by 1, 2, 3)
"""


@query("roc_spread", f"""with {SPREAD_SQL} select model, grid_no, round(fpr, 7) as fpr, round(tpr, 7) as tpr, round(sd, 7) as sd, round(cutoff, 7) as cutoff, round(cutoff_low, 7) as cutoff_low,
  round(cutoff_high, 7) as cutoff_high, round(tpr - sd, 7) as tpr_low1, round(tpr + sd, 7) as tpr_high1, round(tpr - 2 * sd, 7) as tpr_low2, round(tpr + 2 * sd, 7) as tpr_high2 from spread""")
def roc_spread(t):
    return r(ev.roc_spread(points(t), ["model"], "run"), 7)


@query("roc_cutoff_labels", f"""with {SPREAD_SQL}, s as (select *, round_even(cutoff * 20, 0) / 20 as step from spread where cutoff is not null),
f as (select * from s where step <> 0 qualify row_number() over (partition by model, step order by fpr) = 1)
select model, round(fpr, 7) as fpr, round(tpr, 7) as tpr, step as cutoff, format('TH:{{:.2f}} CI:[{{:.2f}},{{:.2f}}]', step, round_even(cutoff_low, 2), round_even(cutoff_high, 2)) as label from f""")
def roc_cutoff_labels(t):
    return r(ev.roc_cutoff_labels(ev.roc_spread(points(t), ["model"], "run"), ["model"]), 7)


@query("sensitivity_interval", f"""with {ROC_SQL}, {_curve_sql(25)}
select model, grid_no, round(1 - fpr, 7) as specificity, round(quantile_cont(tpr, 0.025), 7) as lower, round(quantile_cont(tpr, 0.5), 7) as median, round(quantile_cont(tpr, 0.975), 7) as upper from curves group by model, grid_no, fpr""")
def sensitivity_interval(t):
    return r(ev.sensitivity_interval(points(t), ["model"], "run"), 7)


@query("order_statistic_rows", f"with {AUC_SQL}, o as (select *, row_number() over (order by auc, run) as place from aucs where model = 'glm') select * from o where place in (1, 4, 7)")
def order_statistic_rows(t):
    return ev.order_statistic_rows(aucs(t).where("model = 'glm'"), "run", places=(1, 4, 7))


@query("run_stability", f"""with {SCORES_SQL}, c as (select model, patient, label, count(*) filter (where score >= 0.6) as above, count(*) filter (where score < 0.6) as below, round(avg(score), 8) as mean_value from scores group by 1, 2, 3)
select model, patient, case when label then 'above threshold with crisis' else 'above threshold no crisis' end as state, above as runs, mean_value from c
union all select model, patient, 'below the threshold', below, mean_value from c""")
def run_stability(t):
    return r(ev.run_stability(scores(t), ["model", "patient"], "score", "label", threshold=0.6))


@query("imputation_impact", f"""with {SCORES_SQL}, {GAPPED_SQL}, missing as (select p_partkey as row_id, (p_size is null)::int + (p_type is null)::int + (p_retailprice is null)::int as nas from gapped),
c as (select row_id, label, count(*) filter (where score >= 0.1) as cnt_above_th, count(*) filter (where score < 0.1) as cnt_below_th, stddev_samp(score) as sd_value from scores group by 1, 2)
select row_id, label, cnt_above_th, cnt_below_th, round(sd_value, 8) as sd_value, round(case when label then cnt_above_th else cnt_below_th end / (cnt_above_th + cnt_below_th), 8) as correct_share,
  floor(case when label then cnt_above_th else cnt_below_th end / (cnt_above_th + cnt_below_th) * 10) / 10 as correct_step, nas from c join missing using (row_id)""")
def imputation_impact(t):
    missing = gapped_part(t).select(F.col("p_partkey").alias("row_id"),
                                    row_null_count(["p_size", "p_type", "p_retailprice"]).alias("nas"))
    return r(ev.imputation_impact(scores(t), "row_id", "score", "label", missing))


@query("feature_usage", """with coefs as (select p_brand || ':' || p_type as term, p_size % 10 as run, p_retailprice / 1000 as coefficient from part),
base as (select unnest(string_split(term, ':')) as feature, run, coefficient from coefs),
completeness as (select p_type as key, count(*) filter (where p_size <= 10) as value from part group by 1),
used as (select feature, count(distinct run) as nr_runs, count(*) as cnt_occ, round(avg(coefficient), 8) as avg_value, round(stddev_samp(coefficient), 8) as sd_value from base group by 1 having count(*) > 3)
select used.*, value as nr_nas from used join completeness on feature = key""")
def feature_usage(t):
    coefs = t.part.select(F.concat_ws(":", "p_brand", "p_type").alias("term"), (F.col("p_size") % 10).alias("run"),
                          (F.col("p_retailprice") / 1000).alias("coefficient"))
    completeness = t.part.groupBy(F.col("p_type").alias("key")).agg(F.count_if(F.col("p_size") <= 10).alias("value"))
    return r(ev.feature_usage(coefs, completeness))


@query("patient_score_summary", f"""with {SCORES_SQL}, s as (select model, patient, avg(score) as a, stddev_samp(score) as d from scores group by 1, 2)
select model, patient, round(a, 8) as avg_predicted, round(d, 8) as sd_predicted, a >= 0.1 as threshold_01, a >= 0.3 as threshold_03, a >= 0.8 as threshold_08 from s""")
def patient_score_summary(t):
    return r(ev.patient_score_summary(scores(t), ["model", "patient"], "score"))


DRILL_PATIENT = 42


@query("patient_drilldown", f"""
select 'customer' as source, c_custkey as id, null::double as value from customer where c_custkey = {DRILL_PATIENT} union all
select 'orders', o_orderkey, o_totalprice from orders where o_custkey = {DRILL_PATIENT} union all
select 'lineitem', l_orderkey, l_extendedprice from lineitem join orders on l_orderkey = o_orderkey where o_custkey = {DRILL_PATIENT} union all
select 'events', event_id, value from events where user_id = {DRILL_PATIENT}""")
def patient_drilldown(t):
    items = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return ev.drilldown({
        "customer": (t.customer, F.col("c_custkey"), F.col("c_custkey"), F.lit(None)),
        "orders": (t.orders, F.col("o_custkey"), F.col("o_orderkey"), F.col("o_totalprice")),
        "lineitem": (items, F.col("o_custkey"), F.col("l_orderkey"), F.col("l_extendedprice")),
        "events": (t.events, F.col("user_id"), F.col("event_id"), F.col("value"))}, DRILL_PATIENT)


@query("score_histogram", f"with {SCORES_SQL}, ends as (select min(score) as lo, (max(score) - min(score)) / 30 as w from scores) select model, label, least(floor((score - lo) / w) + 1, 30)::int as bin, count(*) as cnt from scores, ends group by 1, 2, 3")
def score_histogram(t):
    return histogram_counts(scores(t), "score", 30, ["model", "label"]).drop("bin_low")
