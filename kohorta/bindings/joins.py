"""Bindings of the joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from kohorta.bindings.registry import query
from kohorta.bindings.shared import EVENT_DATES, TERMS_SQL, URGENT_SQL, order_days, term_table, urgent_dates
from kohorta.functions.columns import shared_columns
from kohorta.operators.joins import (join_list_column, join_lookup, join_natural, join_star, ordered_pairs,
                                     within_after)
from kohorta.operators.ordered import join_null_safe
from kohorta.operators.reshape import pivot_onehot


@query("join_left", "select c_custkey, c_name, o_orderkey, o_totalprice from customer left join (select * from orders where o_orderstatus = 'P') on c_custkey = o_custkey")
def join_left(t):
    open_orders = t.orders.where("o_orderstatus = 'P'")
    return t.customer.join(open_orders, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", "c_name", "o_orderkey", "o_totalprice")


@query("join_inner", "select o_orderkey, c_mktsegment, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey")
def join_inner(t):
    return (t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select("o_orderkey", "c_mktsegment", "n_name"))


@query("join_right", "select o_orderkey, l_linenumber, l_quantity from (select * from lineitem where l_discount > 0.08) right join orders on l_orderkey = o_orderkey")
def join_right(t):
    records = t.lineitem.where("l_discount > 0.08")
    return records.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"), "right").select(
        "o_orderkey", "l_linenumber", "l_quantity")


@query("join_full", "select c_custkey, c_name, e.user_id, n from customer full join (select user_id, count(*) as n from events group by user_id) e on c_custkey = user_id where c_custkey is not null")
def join_full(t):
    users = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return t.customer.join(users, F.col("c_custkey") == F.col("user_id"), "full").where(
        "c_custkey is not null").select("c_custkey", "c_name", "user_id", "n")


@query("join_natural", "select doc_id, lang, source, quality, toxic from documents natural join labels")
def join_natural_query(t):
    return join_natural(t.documents.select("doc_id", "lang", "source"), t.labels)


@query("join_anti", f"""with {URGENT_SQL}
select o_orderkey, o_custkey from orders where o_orderkey not in (
  select o_orderkey from orders o join urgent u on o.o_custkey = u.o_custkey where o_orderdate::date = d1)""")
def join_anti(t):
    first = order_days(t).join(urgent_dates(t), "o_custkey").where("o_orderdate = d1").select("o_orderkey")
    return t.orders.join(first, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


@query("join_semi", f"with {TERMS_SQL} select term, p_value from terms where contains(term, ':') and term in (select term from terms where p_value < 0.5)")
def join_semi(t):
    terms = term_table(t)
    chosen = terms.where("p_value < 0.5").select("term")
    return terms.where(F.col("term").contains(":")).join(chosen, "term", "left_semi").select("term", "p_value")


@query("join_null_safe", """
with a as (select p_partkey, case when p_size > 10 then p_size end as size from part),
b as (select case when p_size > 10 then p_size end as size, count(*) as n from part group by 1)
select p_partkey, a.size, n from a join b on a.size is not distinct from b.size""")
def join_null_safe_query(t):
    sized = t.part.select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_size")).alias("size"))
    return join_null_safe(sized, sized.groupBy("size").agg(F.count(F.lit(1)).alias("n")), ["size"])


@query("join_broadcast_lookup", "select s_suppkey, s_name, n_name, r_name from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def join_broadcast_lookup(t):
    nations = t.nation.withColumnRenamed("n_nationkey", "s_nationkey")
    named = join_lookup(t.supplier, nations, ["s_nationkey"])
    return join_lookup(named, t.region.withColumnRenamed("r_regionkey", "n_regionkey"), ["n_regionkey"]).select(
        "s_suppkey", "s_name", "n_name", "r_name")


AFTER_SQL = f"""{URGENT_SQL},
after_event as (select distinct o_orderkey from orders o join urgent u on o.o_custkey = u.o_custkey where
  (o_orderdate::date >= d1 and o_orderdate::date < (d1 + interval 6 month)::date) or
  (o_orderdate::date >= d2 and o_orderdate::date < (d2 + interval 6 month)::date) or
  (o_orderdate::date >= d3 and o_orderdate::date < (d3 + interval 6 month)::date))
"""


def encounters_after_event(t):
    return within_after(order_days(t), urgent_dates(t), "o_custkey", "o_orderdate", EVENT_DATES, 6, ["o_orderkey"])


@query("join_interval_after_event", f"with {AFTER_SQL} select o_orderkey from after_event")
def join_interval_after_event(t):
    return encounters_after_event(t)


@query("join_theta_pairs", f"with {TERMS_SQL}, gate as (select term from terms where p_value < 0.6) select a.term as a, b.term as b from terms a join gate b on a.term < b.term")
def join_theta_pairs(t):
    terms = term_table(t)
    return ordered_pairs(terms, "term", terms.where("p_value < 0.6"))


@query("join_star_features", """
with per_order as (select l_orderkey, count(*) as lines, round(sum(l_quantity), 2) as qty from lineitem group by 1),
per_customer as (select o_custkey, count(*) as encounters from orders group by 1),
per_day as (select o_custkey, o_orderdate::date as day, count(*) as same_day from orders group by all),
flags as (select o_custkey, max((o_orderstatus = 'F')::int) as "F", max((o_orderstatus = 'O')::int) as "O", max((o_orderstatus = 'P')::int) as "P" from orders group by 1)
select o_orderkey, o.o_custkey, o.o_orderdate::date as day, lines, qty, encounters, same_day, "F", "O", "P", c_mktsegment
from orders o left join per_order on o_orderkey = l_orderkey left join per_customer using (o_custkey)
left join per_day d on o.o_custkey = d.o_custkey and o.o_orderdate::date = d.day left join flags f on f.o_custkey = o.o_custkey
join customer on o.o_custkey = c_custkey""")
def join_star_features(t):
    base = t.orders.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderstatus")
    per_order = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_quantity"), 2).alias("qty"))
    per_customer = base.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("encounters"))
    per_day = base.groupBy("o_custkey", "day").agg(F.count(F.lit(1)).alias("same_day"))
    flags = pivot_onehot(base, ["o_custkey"], "o_orderstatus", ["F", "O", "P"])
    star = join_star(base.drop("o_orderstatus"), [(per_order, ["o_orderkey"]), (per_customer, ["o_custkey"]),
                                                  (per_day, ["o_custkey", "day"]), (flags, ["o_custkey"])])
    cohort = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return star.join(cohort, shared_columns(star, cohort))


@query("join_list_column", """
with lists as (select p_brand, list(distinct p_type) as types from part group by 1)
select p_partkey, p_type, b.p_brand as other_brand from part join (select p_brand, unnest(types) as p_type from lists) b using (p_type)""")
def join_list_column_query(t):
    lists = t.part.groupBy(F.col("p_brand").alias("other_brand")).agg(F.collect_set("p_type").alias("types"))
    return join_list_column(t.part.select("p_partkey", "p_type"), lists, "types", "p_type").select(
        "p_partkey", "p_type", "other_brand")
