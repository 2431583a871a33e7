"""Bindings of sorts, set operations and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from kohorta.bindings.registry import query
from kohorta.bindings.shared import EVENT_TYPES, GAPPED_SQL, MEASUREMENTS_SQL, TERMS_SQL, gapped_part, measurements, term_table
from kohorta.operators import reshape as rs
from kohorta.operators.aggregates import count_by, ratio_to_total


@query("sort_desc_ties", f"with {TERMS_SQL} select term, p_value, row_number() over (order by p_value desc, length(term), term) as place from terms")
def sort_desc_ties(t):
    from kohorta.operators.ordered import number_rows
    ordered = term_table(t).select("term", "p_value", (-F.col("p_value")).alias("d"), F.length("term").alias("n"))
    return number_rows(ordered, [], ["d", "n", "term"], "place").select("term", "p_value", "place")


@query("top_n", f"with {TERMS_SQL} select term, p_value from terms where contains(term, ':') order by p_value, term limit 20")
def top_n(t):
    return term_table(t).where(F.col("term").contains(":")).orderBy("p_value", "term").limit(20).select("term", "p_value")


@query("reorder_levels", "with l as (select p_brand, row_number() over (order by round(avg(p_retailprice), 6), p_brand) as level from part group by 1) select p_partkey, p_brand, level from part join l using (p_brand)")
def reorder_levels(t):
    return rs.reorder_levels(t.part, "p_brand", "p_retailprice", "level").select("p_partkey", "p_brand", "level")


@query("union_all_by_name", "select doc_id as id, lang, null::bigint as conv_id from documents union all by name select turn as id, null as lang, conv_id from conversations")
def union_all_by_name(t):
    docs = t.documents.select(F.col("doc_id").alias("id"), "lang")
    return docs.unionByName(t.conversations.select(F.col("turn").alias("id"), "conv_id"), allowMissingColumns=True)


@query("set_difference", "select p_name as name from part union select p_type from part except select p_type from part where p_size > 25 except select 'red widget'")
def set_difference(t):
    names = t.part.select(F.col("p_name").alias("name")).union(t.part.select("p_type"))
    fixed = t.part.where("p_size > 25").select("p_type").union(t.part.where("p_name = 'red widget'").select("p_name"))
    return rs.set_difference(names, fixed)


@query("unpivot", "select l_orderkey, l_linenumber, l_partkey, key, value from (select l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax from lineitem) unpivot (value for key in (l_quantity, l_discount, l_tax))")
def unpivot(t):
    return rs.unpivot(t.lineitem, ["l_orderkey", "l_linenumber", "l_partkey"], ["l_quantity", "l_discount", "l_tax"])


@query("unpivot_drop_blank", f"with {GAPPED_SQL} select p_partkey, 'p_brand' as key, p_brand as value from gapped where p_brand <> '' union all select p_partkey, 'p_type', p_type from gapped where p_type is not null")
def unpivot_drop_blank(t):
    return rs.unpivot(gapped_part(t), ["p_partkey"], ["p_brand", "p_type"], drop_blank=True)


@query("unpivot_groups", """select l_orderkey, l_linenumber, l_partkey, 1 as slot, l_returnflag as "Drug", l_discount as "Dose" from lineitem
union all select l_orderkey, l_linenumber, l_partkey, 2, l_linestatus, l_tax from lineitem""")
def unpivot_groups(t):
    wide = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("Drug1"), F.col("l_discount").alias("Dose1"),
        F.col("l_linestatus").alias("Drug2"), F.col("l_tax").alias("Dose2"))
    return rs.unpivot_groups(wide, ["l_orderkey", "l_linenumber", "l_partkey"], ["Drug", "Dose"], [1, 2])


def _case(agg, kinds=EVENT_TYPES, value="value", name="{k}", default=None):
    cells = [f"{agg}(case when event_type = '{k}' then {value} end)" for k in kinds]
    if default is not None:
        cells = [f"coalesce({c}, {default})" for c in cells]
    return ", ".join(f"{c} as \"{name.format(k=k)}\"" for c, k in zip(cells, kinds))


@query("pivot_attr", "select o_orderkey, o_orderstatus as admission, o_orderpriority as discharge from orders")
def pivot_attr(t):
    eav = t.orders.select("o_orderkey", F.inline(F.array(
        F.struct(F.lit("admission").alias("attr"), F.col("o_orderstatus").alias("value")),
        F.struct(F.lit("discharge").alias("attr"), F.col("o_orderpriority").alias("value")))))
    return rs.pivot_attr(eav, ["o_orderkey"], "attr", "value", ["admission", "discharge"])


@query("pivot_onehot", f"select user_id, {_case('max', value='1', default=0)} from events group by 1")
def pivot_onehot(t):
    return rs.pivot_onehot(t.events, ["user_id"], "event_type", EVENT_TYPES)


@query("pivot_share", "with c as (select user_id, event_type, count(*) as cnt from events group by all), s as (select user_id, event_type, round(cnt / sum(cnt) over (partition by user_id), 8) as share from c) "
       f"select user_id, {_case('max', value='share', default='0.0').replace('0.0)', '0.0::double)')} from s group by 1")
def pivot_share(t):
    shares = ratio_to_total(count_by(t.events, ["user_id", "event_type"]), "cnt", ["user_id"], "share")
    return rs.pivot_share(shares.withColumn("share", F.round("share", 8)), ["user_id"], "event_type", "share", EVENT_TYPES)


@query("pivot_mean", f"with {MEASUREMENTS_SQL} select user_id, day, {', '.join(f'''round(avg(case when event_type = '{k}' then value end), 8) as {k}''' for k in EVENT_TYPES)} from measurements group by 1, 2")
def pivot_mean(t):
    out = rs.pivot_mean(measurements(t), ["user_id", "day"], "event_type", "value", EVENT_TYPES)
    return out.withColumns({k: F.round(k, 8) for k in EVENT_TYPES})


@query("pivot_multi", "select user_id, " + ", ".join(
    f"round(coalesce(avg(case when event_type = '{k}' then {e} end), 0), 8) as {m}_{k}" for m, e in (("value", "value"), ("hour", "hour(ts)")) for k in EVENT_TYPES) + " from events group by 1")
def pivot_multi(t):
    df = t.events.withColumn("hour", F.hour("ts"))
    out = rs.pivot_multi(df, ["user_id"], "event_type", ["value", "hour"], EVENT_TYPES)
    return out.select("user_id", *[F.round(c, 8).alias(c) for c in out.columns[1:]])


@query("split_rows", f"with {TERMS_SQL} select unnest(string_split(term, ':')) as term, p_value from terms")
def split_rows(t):
    return rs.split_rows(term_table(t).select("term", "p_value"), "term")
