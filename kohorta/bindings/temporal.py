"""Bindings of window-like operators over patient histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from kohorta.bindings.registry import query
from kohorta.bindings.shared import MEASUREMENTS_SQL, TERMS_SQL, measurements, order_days, term_table
from kohorta.operators import ordered, temporal
from kohorta.operators.aggregates import count_by, ratio_to_total


@query("ratio_to_total", "select l_returnflag, l_linenumber, cnt, round(cnt / sum(cnt) over (partition by l_returnflag), 8) as cnt_p, (sum(cnt) over (partition by l_returnflag))::bigint as s, round(cnt / sum(cnt) over (), 8) as overall from (select l_returnflag, l_linenumber, count(*) as cnt from lineitem group by all)")
def ratio(t):
    counted = count_by(t.lineitem, ["l_returnflag", "l_linenumber"])
    within = ratio_to_total(counted, "cnt", ["l_returnflag"], "cnt_p", "s")
    return ratio_to_total(within, "cnt", [], "overall").withColumns(
        {c: F.round(c, 8) for c in ("cnt_p", "overall")})


@query("running_count", """select o_custkey, o_orderkey,
  (sum((o_orderstatus = 'F')::int) over w)::bigint as cnt_stat, (sum((o_orderstatus = 'O')::int) over w)::bigint as cnt_amb
  from orders window w as (partition by o_custkey order by o_orderdate::date, o_orderkey rows unbounded preceding)""")
def running_count(t):
    flags = {f"cnt_{n}": (F.col("o_orderstatus") == s).cast("bigint") for n, s in (("stat", "F"), ("amb", "O"))}
    return ordered.running_sums(order_days(t), ["o_custkey"], ["o_orderdate", "o_orderkey"], flags).select(
        "o_custkey", "o_orderkey", "cnt_stat", "cnt_amb")


@query("active_in_window", """
with days as (select distinct o_custkey, o_orderdate::date as day from orders),
changes as (select o_custkey, day, 1 as d from days union all select o_custkey, (day + interval 6 month)::date, -1 from days),
daily as (select o_custkey, day, sum(d) as d from changes group by 1, 2)
select o_custkey, day, round(sum(d) over (partition by o_custkey order by day) / 365, 8) as active from daily""")
def active_in_window(t):
    days = t.orders.select("o_custkey", F.to_date("o_orderdate").alias("day"))
    return temporal.active_in_window(days, "o_custkey", "day", "active").withColumn("active", F.round("active", 8))


@query("encounter_day_count", "select o_custkey, round(count(distinct o_orderdate::date) / 365, 8) as days from orders group by 1")
def encounter_day_count(t):
    days = t.orders.select("o_custkey", F.to_date("o_orderdate").alias("day"))
    return temporal.encounter_day_count(days, "o_custkey", "day", "days").withColumn("days", F.round("days", 8))


@query("locf_marker", """
with opened as (select event_id, user_id, event_type, sum((event_type = 'signup')::int) over (partition by user_id order by ts, event_id rows unbounded preceding) as n from events)
select event_id, user_id, event_type, case when n > 0 then user_id || '_' || n end as lab_id from opened""")
def locf_marker(t):
    return temporal.locf_marker(t.events, ["user_id"], ["ts", "event_id"], "event_type", "signup", "user_id").select(
        "event_id", "user_id", "event_type", "lab_id")


@query("locf", """
select event_id, user_id, last_value(case when event_type = 'click' then value end ignore nulls) over w as click,
  last_value(case when event_type = 'error' then value end ignore nulls) over w as error
from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)""")
def locf(t):
    wide = t.events.select("event_id", "user_id", "ts", *[
        F.when(F.col("event_type") == k, F.col("value")).alias(k) for k in ("click", "error")])
    return temporal.locf(wide, ["user_id"], ["ts", "event_id"], ["click", "error"]).drop("ts")


TRENDS_SQL = f"""{MEASUREMENTS_SQL},
lagged as (select *, value - lag(value) over w as diff, day - lag(day) over w as days from measurements
  window w as (partition by user_id, event_type order by day, event_id)),
trends as (select event_id, user_id, day, event_type, value, coalesce(diff, 0) as trend_abs,
    coalesce(diff / nullif(days, 0), 0) as trend from lagged
  where not (coalesce(days, 1) = 0 and coalesce(diff, 0) <> 0))
"""


def trends(t):
    return temporal.lag_trend(measurements(t), ["user_id", "event_type"], ["day", "event_id"], "day", "value")


@query("lag_trend", f"with {TRENDS_SQL} select event_id, user_id, day, event_type, round(trend_abs, 8) as trend_abs, round(trend, 8) as trend from trends")
def lag_trend(t):
    return trends(t).drop("value").withColumns({c: F.round(c, 8) for c in ("trend_abs", "trend")})


@query("row_id_global", "select event_id, ts::date as day, row_number() over (order by ts, event_id) as row_id from events")
def row_id_global(t):
    return ordered.number_rows(t.events, [], ["ts", "event_id"], "row_id").select(
        "event_id", F.to_date("ts").alias("day"), "row_id")


@query("row_number_by", "select event_id, user_id, row_number() over (partition by user_id, event_type order by ts, event_id) as row_no from events")
def row_number_by(t):
    return ordered.number_rows(t.events, ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "row_no")


@query("first_per_group", "select user_id, ts::date as day, min(value) as value from events group by 1, 2")
def first_per_group(t):
    return t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("value").alias("value"))


@query("top_k_by_group", f"with {TERMS_SQL} select contains(term, ':') as interaction, term, p_value from terms qualify row_number() over (partition by contains(term, ':') order by p_value, term) < 30")
def top_k_by_group(t):
    terms = term_table(t).withColumn("interaction", F.col("term").contains(":"))
    return ordered.top_rows(terms, ["interaction"], [F.col("p_value"), F.col("term")], 29).select(
        "interaction", "term", "p_value")


@query("anonymize_ids", "select c_mktsegment as model, c_custkey, 'Patient #' || row_number() over (partition by c_mktsegment order by c_custkey) || ' ' || (c_acctbal < 0) || ', ' || c_mktsegment as alias from customer")
def anonymize_ids(t):
    numbered = ordered.number_rows(t.customer.withColumnRenamed("c_mktsegment", "model"), ["model"], ["c_custkey"], "n")
    alias = F.concat(F.lit("Patient #"), F.col("n").cast("string"), F.lit(" "), (F.col("c_acctbal") < 0).cast("string"),
                     F.lit(", "), "model")
    return numbered.select("model", "c_custkey", alias.alias("alias"))
