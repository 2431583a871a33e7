"""Bindings of counts, profiles, summaries and bins."""

from __future__ import annotations

from pyspark.sql import functions as F

from kohorta.bindings.registry import query
from kohorta.bindings.shared import (EVENT_DATES, GAPPED_SQL, MEASUREMENTS_SQL, URGENT_SQL, USER_EVENTS_SQL,
                                     gapped_part, measurements, order_days, urgent_dates, user_events)
from kohorta.bindings.sources import TABLES
from kohorta.functions.dates import add_months
from kohorta.operators import aggregates as ag
from kohorta.operators.ordered import first_rows, quantiles
from kohorta.operators.reshape import eav_to_record, pivot_mean, unpivot
from kohorta.operators.aggregates import six_stat_summary


@query("count_by", "select l_returnflag, l_linestatus, l_linenumber, count(*) as cnt from lineitem group by all")
def count_by(t):
    return ag.count_by(t.lineitem, ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("count_distinct_by", "select o_orderpriority, count(distinct coalesce(o_custkey::varchar, 'missing')) as patients, count(distinct coalesce(nullif(o_orderstatus, 'P'), 'missing')) as states from orders group by 1")
def count_distinct_by(t):
    df = t.orders.withColumn("state", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    return df.groupBy("o_orderpriority").agg(ag.distinct_with_missing("o_custkey").alias("patients"),
                                             ag.distinct_with_missing("state").alias("states"))


@query("median_min_max", "select c_mktsegment, o_orderstatus, median(o_totalprice) as median_value, min(o_totalprice) as min_value, max(o_totalprice) as max_value from orders join customer on o_custkey = c_custkey group by all")
def median_min_max(t):
    priced = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    keys = ["c_mktsegment", "o_orderstatus"]
    middle = quantiles(priced, keys, "o_totalprice", {"median_value": 0.5})
    ends = priced.groupBy(*keys).agg(F.min("o_totalprice").alias("min_value"), F.max("o_totalprice").alias("max_value"))
    return ends.join(middle, keys)


def _profile_sql(tables):
    parts = []
    for table, cols in tables.items():
        for c, blank in cols.items():
            test = f"({c} is null or {c} = '')" if blank else f"{c} is null"
            parts.append(f"select '{table}' as table_name, '{c}' as column_name, count(*) filter (where not {test}) as filled_values, "
                         f"count(*) filter (where {test}) as unfilled_values, "
                         f"round_even(count(*) filter (where not {test}) / count(*), 2)::double as filled_percent from {table}")
    return " union all ".join(parts)


PROFILE = {
    "gapped": {"p_partkey": False, "p_size": False, "p_brand": True, "p_type": True, "p_retailprice": False},
    "orders": {"o_orderkey": False, "o_custkey": False, "o_orderstatus": True, "o_totalprice": False,
               "o_orderdate": False, "o_orderpriority": True},
    "documents": {"doc_id": False, "text": True, "lang": True, "source": True, "n_chars": False},
    "events": {"event_id": False, "ts": False, "user_id": False, "event_type": True, "value": False, "props": True},
}


@query("fill_profile", f"with {GAPPED_SQL} {_profile_sql(PROFILE)}")
def fill_profile(t):
    tables = {name: gapped_part(t) if name == "gapped" else getattr(t, name) for name in PROFILE}
    return ag.fill_profile(tables)


#: Every column of every given table; True where an empty text counts as unfilled.
CATALOG = {
    "region": {"r_regionkey": False, "r_name": True},
    "nation": {"n_nationkey": False, "n_name": True, "n_regionkey": False},
    "customer": {"c_custkey": False, "c_name": True, "c_nationkey": False, "c_acctbal": False, "c_mktsegment": True},
    "supplier": {"s_suppkey": False, "s_name": True, "s_nationkey": False, "s_acctbal": False},
    "part": {"p_partkey": False, "p_name": True, "p_brand": True, "p_type": True, "p_size": False, "p_retailprice": False},
    "lineitem": {"l_orderkey": False, "l_partkey": False, "l_suppkey": False, "l_linenumber": False, "l_quantity": False,
                 "l_extendedprice": False, "l_discount": False, "l_tax": False, "l_returnflag": True, "l_linestatus": True,
                 "l_shipdate": False},
    "embeddings": {"vec_id": False, "embedding": False, "label": False},
    "pages": {"page_id": False, "url": True, "html": True}, "benchmark": {"item_id": False, "text": True},
    "labels": {"doc_id": False, "quality": False, "toxic": False},
    "conversations": {"conv_id": False, "turn": False, "role": True, "text": True},
    **{name: columns for name, columns in PROFILE.items() if name != "gapped"},
}


@query("fill_profile_catalog", _profile_sql(CATALOG))
def fill_profile_catalog(t):
    return ag.fill_profile({n: getattr(t, n) for n in TABLES})


NULL_SQL = " union all ".join(f"select '{c}' as key, count(*) filter (where {c} is null) as value from gapped"
                              for c in ("p_size", "p_brand", "p_type", "p_retailprice"))


@query("null_profile", f"with {GAPPED_SQL}, profile as ({NULL_SQL}) select * from profile where value < 400")
def null_profile(t):
    return ag.null_profile(gapped_part(t), exclude=["p_partkey"], below=400)


@query("null_profile_gate", f"with {GAPPED_SQL}, profile as ({NULL_SQL}) select value < 400 as complete, count(*) as cnt from profile group by 1")
def null_profile_gate(t):
    profile = ag.null_profile(gapped_part(t), exclude=["p_partkey"])
    return ag.count_by(profile.withColumn("complete", F.col("value") < 400), ["complete"])


@query("row_null_count", f"with {GAPPED_SQL} select p_partkey, (p_size is null)::int + (p_brand is null)::int + (p_type is null)::int + (p_retailprice is null)::int as missing from gapped")
def row_null_count(t):
    return gapped_part(t).select("p_partkey", ag.row_null_count(["p_size", "p_brand", "p_type", "p_retailprice"]).alias("missing"))


@query("eav_to_record", "select event_id, event_type as kind, value::varchar as amount from events")
def eav_to_record_query(t):
    eav = t.events.select("event_id", F.inline(F.array(
        F.struct(F.lit("Kat").alias("attr"), F.col("event_type").alias("value")),
        F.struct(F.lit("Value").alias("attr"), F.col("value").cast("string").alias("value")))))
    return eav_to_record(eav, ["event_id"], "attr", "value", {"Kat": "kind", "Value": "amount"})


def daily_matrix(t):
    return pivot_mean(measurements(t), ["user_id", "day"], "event_type", "value", ["click", "error", "purchase"])


DAILY_SQL = f"""{MEASUREMENTS_SQL},
daily as (select user_id, day, avg(case when event_type = 'click' then value end) as click,
  avg(case when event_type = 'error' then value end) as error,
  avg(case when event_type = 'purchase' then value end) as purchase
  from measurements group by user_id, day)
"""


def six_sql(columns, clip, source, keys="user_id", order="day"):
    out = []
    for c in columns:
        low, high = (f"case when min({c}) is not null then least(0.0, min({c})) end", f"case when max({c}) is not null then greatest(0.0, max({c})) end") if clip else (f"min({c})", f"max({c})")
        out.append(f"{low} as {c}_min, {high} as {c}_max, avg({c}) as {c}_mean, median({c}) as {c}_median, "
                   f"arg_max({c}, {order}) filter (where {c} is not null) as {c}_lastKnown, stddev_samp({c}) as {c}_stdev")
    return f"select {keys}, {', '.join(out)} from {source} group by {keys}"


def rounded(df, keep, suffixes=("_mean", "_median", "_stdev"), digits=8):
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if c.endswith(suffixes) and c not in keep else F.col(f"`{c}`")
                       for c in df.columns])


def _exact(df):
    """Daily means are compared rounded where they surface unchanged."""
    return df.select(*[F.round(F.col(c), 8).alias(c) if c.endswith(("_min", "_max", "_lastKnown")) else F.col(c)
                       for c in df.columns])


def _round_all(sql, columns, keys="user_id"):
    names = [f"{c}_{s}" for c in columns for s in ("min", "max", "mean", "median", "lastKnown", "stdev")]
    return f"select {keys}, {', '.join(f'round({n}, 8) as {n}' for n in names)} from ({sql})"


@query("six_stat_summary", f"with {DAILY_SQL} " + _round_all(
    six_sql(["click", "error", "purchase"], False, "daily"), ["click", "error", "purchase"]))
def six_stat(t):
    out = six_stat_summary(daily_matrix(t), ["user_id"], ["click", "error", "purchase"], ["day"])
    return _exact(rounded(out, ["user_id"]))


@query("six_stat_clipped", f"with {DAILY_SQL}, centred as (select user_id, day, click - 15 as click, purchase - 30 as purchase from daily) "
       + _round_all(six_sql(["click", "purchase"], True, "centred"), ["click", "purchase"]))
def six_stat_clipped(t):
    centred = daily_matrix(t).select("user_id", "day", (F.col("click") - 15).alias("click"),
                                     (F.col("purchase") - 30).alias("purchase"))
    out = six_stat_summary(centred, ["user_id"], ["click", "purchase"], ["day"], clip=True)
    return _exact(rounded(out, ["user_id"]))


@query("merge_summaries", f"""with {DAILY_SQL}, {USER_EVENTS_SQL},
constant as (select d.*, n from daily d join (select user_id, count(*)::double as n from daily group by 1) using (user_id))
select a.user_id, mk, round(click_min, 8) as click_min, round(click_max, 8) as click_max, round(click_mean, 8) as click_mean, round(click_median, 8) as click_median,
  round(click_lastKnown, 8) as click_lastKnown, round(click_stdev, 8) as click_stdev, n
from ({six_sql(['click'], True, 'constant')}) a join (select user_id, min(n) as n from constant group by 1) using (user_id) join user_events using (user_id)""")
def merge_summaries(t):
    daily = daily_matrix(t)
    days = daily.groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    labelled = daily.join(days, "user_id").join(user_events(t).select("user_id", "mk"), "user_id")
    clipped = six_stat_summary(labelled, ["user_id", "mk"], ["click"], ["day"], clip=True)
    plain = six_stat_summary(labelled, ["user_id", "mk"], ["n"], ["day"])
    return _exact(rounded(ag.merge_summaries(clipped, plain, ["user_id", "mk"], "mk", constants=["n"]), ["user_id", "mk"]))


@query("distinct_rows", "select distinct o_custkey, o_orderdate::date as day from orders")
def distinct_rows(t):
    return t.orders.select("o_custkey", F.to_date("o_orderdate").alias("day")).distinct()


@query("distinct_keep_first", "select o_custkey, o_orderkey, o_orderdate::date as o_orderdate, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderdate::date, o_orderkey) = 1")
def distinct_keep_first(t):
    return first_rows(order_days(t), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(
        "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


@query("collapse_unique", "select user_id, string_agg(event_type, ', ' order by first_at) as kinds from (select user_id, event_type, min(event_id) as first_at from events group by all) group by user_id")
def collapse_unique(t):
    return ag.collapse_unique(t.events, ["user_id"], "event_type", "event_id", "kinds")


@query("mean_sd_by", "select event_type, count(*) as cnt, round(avg(value), 8) as avg_value, round(stddev_samp(value), 8) as sd_value from events group by 1")
def mean_sd_by(t):
    out = ag.mean_sd_by(t.events, ["event_type"], "value")
    return out.withColumns({c: F.round(c, 8) for c in ("avg_value", "sd_value")})


@query("count_conditional", "select user_id, count(*) filter (where value >= 20) as cnt_above_th, count(*) filter (where value < 20) as cnt_below_th, round(avg(value), 8) as mean_value, round(stddev_samp(value), 8) as sd_value from events group by 1")
def count_conditional(t):
    out = ag.count_conditional(t.events, ["user_id"], "value", 20.0)
    return out.withColumns({c: F.round(c, 8) for c in ("mean_value", "sd_value")})


@query("quantile_agg", """
select l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.025), 6) as q025,
  round(quantile_cont(l_extendedprice, 0.5), 6) as q50, round(quantile_cont(l_extendedprice, 0.975), 6) as q975
from lineitem group by all""")
def quantile_agg(t):
    out = quantiles(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice",
                    {"q025": 0.025, "q50": 0.5, "q975": 0.975})
    return out.withColumns({c: F.round(c, 6) for c in ("q025", "q50", "q975")})


def _bins_sql(table, column, n, digits=2):
    edges = f"select list_sort(list_distinct(quantile_cont({column}::double, [{', '.join(str(i / n) for i in range(n + 1))}]))) as e from {table}"
    label = f"regexp_replace(round(e[b], {digits})::varchar, '\\.0$', '') || ' - ' || regexp_replace(round(e[b + 1], {digits})::varchar, '\\.0$', '')"
    return f"""edges as ({edges}),
binned as (select s.*, greatest(len(list_filter(e, lambda x: x < {column})), 1)::int as b, e from {table} s, edges),
cut as (select * exclude (b, e), b as bin, {label} as bin_label from binned)"""


@query("quantile_cut", f"with {_bins_sql('orders', 'o_totalprice', 5)} select o_orderkey, bin, bin_label from cut")
def quantile_cut(t):
    return ag.quantile_cut(t.orders, "o_totalprice", 5).select("o_orderkey", "bin", "bin_label")


@query("bin_rate", f"with {_bins_sql('lineitem', 'l_quantity', 4)} select bin, bin_label, count(*) as cnt, round(avg((l_returnflag = 'R')::int), 8) as event_rate, round(avg((l_quantity >= 5 and l_quantity <= case when l_linestatus = 'F' then 30 else 40 end)::int), 8) as in_range_share from cut group by all")
def bin_rate(t):
    df = t.lineitem.withColumn("mk", F.col("l_returnflag") == "R")
    out = ag.bin_rate(df, "l_quantity", "mk", 4, low=F.lit(5.0),
                      high=F.when(F.col("l_linestatus") == "F", 30.0).otherwise(40.0))
    return out.withColumns({c: F.round(c, 8) for c in ("event_rate", "in_range_share")})


@query("histogram_counts", """
with ends as (select min(value) as lo, (max(value) - min(value)) / 30 as w from events)
select event_type, least(floor((value - lo) / w) + 1, 30)::int as bin, count(*) as cnt, round(min(lo + (least(floor((value - lo) / w) + 1, 30) - 1) * w), 6) as bin_low from events, ends group by 1, 2""")
def histogram_counts(t):
    return ag.histogram_counts(t.events, "value", 30, ["event_type"]).withColumn("bin_low", F.round("bin_low", 6))


@query("timeline_band", f"with {MEASUREMENTS_SQL} select user_id, day, event_type, min(value) as min_value, max(value) as max_value from measurements group by all")
def timeline_band(t):
    return ag.timeline_band(measurements(t), "user_id", "day", "event_type", "value")


@query("timeline_envelope", f"with {MEASUREMENTS_SQL}, {USER_EVENTS_SQL} select user_id, event_type, least(min(value / 40), 0.0) as ymin, greatest(max(value / 40), 1.0) as ymax, event_day, (event_day + interval 6 month)::date as event_end from measurements join user_events using (user_id) group by user_id, event_type, event_day")
def timeline_envelope(t):
    df = measurements(t).withColumn("scaled", F.col("value") / 40)
    spans = user_events(t).select("user_id", "event_day", add_months(F.col("event_day"), 6).alias("event_end"))
    out = df.groupBy("user_id", "event_type").agg(F.least(F.min("scaled"), F.lit(0.0)).alias("ymin"),
                                                  F.greatest(F.max("scaled"), F.lit(1.0)).alias("ymax"))
    return out.join(spans, "user_id")


@query("crisis_count_by_group", f"""with {URGENT_SQL}, counted as (select c_custkey, c_mktsegment as grp,
  case when d3 is not null then 3 when d2 is not null then 2 when d1 is not null then 1 else 0 end as nr_mks from customer left join urgent on c_custkey = o_custkey)
select nr_mks, grp, count(*) as cnt from counted group by all""")
def crisis_count_by_group(t):
    cohort = t.customer.join(urgent_dates(t).withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")
    return ag.count_by(cohort.select(ag.event_count(EVENT_DATES).alias("nr_mks"), F.col("c_mktsegment").alias("grp")),
                       ["nr_mks", "grp"])
