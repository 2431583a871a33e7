"""Bindings of the cleaning, date and predicate operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from kohorta.bindings.registry import query
from kohorta.bindings.shared import (GAPPED_SQL, TERMS_SQL, URGENT_SQL, gapped_part, order_days, term_table,
                                     urgent_dates)
from kohorta.functions import columns, dates, numeric, terms, text
from kohorta.plans.measurements import default_ranges, nonneg_numeric, unit_rescale

AS_OF = dt.date(2021, 11, 23)


@query("filter_not_null", f"with {GAPPED_SQL} select p_partkey, p_brand from gapped where p_brand is not null and p_brand <> '' and p_size is not null")
def filter_not_null(t):
    kept = gapped_part(t).where(~text.is_blank(F.col("p_brand")) & F.col("p_size").isNotNull())
    return kept.select("p_partkey", "p_brand")


@query("trim_names", "select c_custkey, trim('  ' || c_name || ' ') as c_name from customer")
def trim_names(t):
    padded = t.customer.select("c_custkey", F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("c_name"))
    return padded.withColumn("c_name", F.trim("c_name"))


@query("pad_id", "select o_orderkey, case when length(o_custkey::varchar) < 4 then lpad(o_custkey::varchar, 4, '0') else o_custkey::varchar end as patient, case when length(o_orderkey::varchar) < 3 then lpad(o_orderkey::varchar, 3, '0') else o_orderkey::varchar end as encounter from orders")
def pad_id(t):
    return t.orders.select("o_orderkey", text.pad_left(F.col("o_custkey").cast("string"), 4).alias("patient"),
                           text.pad_left(F.col("o_orderkey").cast("string"), 3).alias("encounter"))


@query("strip_title", "select c_custkey, case when c_nationkey < 12 then 'Dr. ' else '' end || c_name as titled, c_name as name from customer")
def strip_title(t):
    titled = F.concat(F.when(F.col("c_nationkey") < 12, "Dr. ").otherwise(""), "c_name")
    return t.customer.select("c_custkey", titled.alias("titled"), text.strip_title(titled).alias("name"))


@query("repair_encoding", "select doc_id, replace(replace(text, 'ü', 'ü'), 'ä', 'ä') as repaired, length(text) as n from documents")
def repair_encoding(t):
    damaged = F.translate("text", text.STRAY_LETTERS, text.STRAY_CHARACTERS)
    return t.documents.select("doc_id", text.repair_encoding(damaged).alias("repaired"),
                              F.length("text").cast("bigint").alias("n"))


@query("date_parts_by_schema", """
select o_orderkey, strftime(o_orderdate, '%Y') as y1, strftime(o_orderdate, '%m') as m1, strftime(o_orderdate, '%d') as d1,
  strftime(o_orderdate, '%Y') as y2, strftime(o_orderdate, '%m') as m2, strftime(o_orderdate, '%d') as d2 from orders""")
def date_parts_by_schema(t):
    dotted = t.orders.select("o_orderkey", F.date_format("o_orderdate", "dd.MM.yyyy").alias("Gebdat"),
                             F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"))
    a = dates.date_parts_by_schema(dotted).select(
        "o_orderkey", F.col("iso").alias("Geburtsdatum"), F.col("year").alias("y1"), F.col("month").alias("m1"),
        F.col("day").alias("d1"))
    return dates.date_parts_by_schema(a).select("o_orderkey", "y1", "m1", "d1", F.col("year").alias("y2"),
                                                F.col("month").alias("m2"), F.col("day").alias("d2"))


@query("split_ddmmyyyy", """
with raw as (select o_orderkey, o_orderpriority as attr0, case when o_orderpriority = '2-HIGH' then 'Unit' else 'Date' end as attr,
  case when length(v) = 8 and v[1] = '0' then v[2:] else v end as value
  from (select *, strftime(o_orderdate, '%d%m%Y') as v from orders)),
parts as (select *, case when attr = 'Date' then right(value, 4) else '' end as year,
  lpad(value[:-5], 4, '0') as rest from raw)
select o_orderkey, value, year, case when year <> '' then rest[3:4] else '' end as month,
  case when year <> '' then rest[1:2] else '' end as day from parts""")
def split_ddmmyyyy(t):
    value = F.regexp_replace(F.date_format("o_orderdate", "ddMMyyyy"), "^0", "")
    raw = t.orders.select("o_orderkey", value.alias("value"),
                          F.when(F.col("o_orderpriority") == "2-HIGH", "Unit").otherwise("Date").alias("attr"))
    return raw.withColumns(dates.split_ddmmyyyy(F.col("attr"), F.col("value"))).drop("attr")


@query("parse_date_lenient", """
select o_orderkey, case when o_orderpriority = '5-LOW' then null else o_orderdate::date end as dmy,
  case when o_orderstatus = 'P' then null else o_orderdate::date end as ymd from orders""")
def parse_date_lenient(t):
    raw = t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderpriority") == "5-LOW", "31022020").otherwise(
            F.regexp_replace(F.date_format("o_orderdate", "ddMMyyyy"), "^0", "")).alias("dmy"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("ymd"))
    return dates.parse_columns(raw.withColumn("dmy", dates.parse_dmy(F.col("dmy"))), ["ymd"])


@query("decade_bucket", """
select o_orderkey, substr(strftime(o_orderdate, '%Y-%m-%d'), 1, 3) || '0' as decade,
  (floor(o_totalprice / 10) * 10)::bigint as price_decade from orders""")
def decade_bucket(t):
    return t.orders.select("o_orderkey", dates.decade_text(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("decade"),
                           dates.decade_floor(F.col("o_totalprice")).cast("bigint").alias("price_decade"))


@query("age_features", """
select o_orderkey, round(floor(datediff('day', o_orderdate::date, date '2021-11-23') / 365.0) / 100, 6) as age,
  round((2005 - year(o_orderdate)) / 100.0, 6)::double as onset from orders""")
def age_features(t):
    born = F.to_date("o_orderdate")
    return t.orders.select(
        "o_orderkey", F.round(dates.age_in_centuries(born, F.lit(AS_OF)), 6).alias("age"),
        F.round(dates.onset_age(F.lit("2005"), born) / 100, 6).alias("onset"))


@query("late_onset_flag", "select p_size >= 25 as late_onset, count(*) as cnt from part group by 1")
def late_onset_flag(t):
    return t.part.groupBy((F.col("p_size") >= 25).alias("late_onset")).agg(F.count(F.lit(1)).alias("cnt"))


@query("regex_flag", f"with {GAPPED_SQL} select p_partkey, case when regexp_matches(p_type, 'ECO|PROMO') then 1 else 0 end as flag from gapped")
def regex_flag(t):
    return gapped_part(t).select("p_partkey", text.regex_flag(F.col("p_type"), "ECO|PROMO").alias("flag"))


@query("any_regex_ci", "select doc_id, regexp_matches(text, '(?i)(DER)|(l[ae] )|(und?)') as hit, false as none from documents")
def any_regex_ci(t):
    body = F.col("text")
    return t.documents.select("doc_id", text.any_regex(body, ["DER", "l[ae] ", "und?"]).alias("hit"),
                              text.any_regex(body, []).alias("none"))


@query("normalize_key", """
select p_partkey, replace(regexp_replace(regexp_replace(replace(p_name || ' 37°C_absolut ö', ' ', '_'),
  '_.37°.|_absolut', '', 'g'), '°', '', 'g'), 'ö', '?') as key from part""")
def normalize_key(t):
    raw = F.concat("p_name", F.lit(" 37°C_absolut ö"))
    return t.part.select("p_partkey", text.normalize_key(raw).alias("key"))


@query("decimal_comma", "select o_orderkey, case when o_orderstatus = 'P' then null else round(o_totalprice, 2) end as price from orders")
def decimal_comma(t):
    raw = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(
        F.regexp_replace(F.format_string("%.2f", "o_totalprice"), r"\.", ","))
    return t.orders.select("o_orderkey", text.decimal_comma(raw).alias("price"))


@query("ordinal_code", """
select o_orderkey, case when o_orderpriority = '1-URGENT' then
  case o_orderstatus when 'O' then '0' when 'F' then '1' else '' end else o_orderstatus end as value from orders""")
def ordinal_code(t):
    key = F.when(F.col("o_orderpriority") == "1-URGENT", "Titin_Ak").otherwise("Natrium")
    raw = F.when(key == "Natrium", F.col("o_orderstatus")).when(F.col("o_orderstatus") == "O", "negativ").when(
        F.col("o_orderstatus") == "F", "positiv").otherwise("unklar")
    return t.orders.select("o_orderkey", text.ordinal_code(key, raw).alias("value"))


@query("nonneg_numeric", "select c_custkey, c_acctbal as value from customer where c_acctbal >= 0 and c_mktsegment <> 'MACHINERY'")
def nonneg(t):
    raw = t.customer.select("c_custkey", F.when(F.col("c_mktsegment") == "MACHINERY", "unlesbar").otherwise(
        F.col("c_acctbal").cast("string")).alias("value"))
    return nonneg_numeric(raw, "value")


LIMITED_SQL = """
limits as (select p_type as key, min(p_size)::double as women_low, max(p_size)::double as women_high,
  min(p_size)::double - 1 as men_low, max(p_size)::double + 1 as men_high, 0.0::double as child_low, 99.0::double as child_high
  from part group by p_type),
raw as (select l_orderkey, l_linenumber, l_suppkey, l_quantity as value, p_type as key,
  case l_returnflag when 'A' then 'w' when 'R' then 'm' else 'x' end as sex,
  case when l_discount = 0.05 then '' when l_discount = 0.03 then '7' else (l_discount * 100)::bigint::varchar end as low,
  case when l_tax = 0.02 then null when l_discount = 0.03 then '7' else (l_quantity::bigint + 1)::varchar end as high
  from lineitem join part on l_partkey = p_partkey),
blanked as (select * exclude (low, high), case when low = high or low = '' or high is null then null else low end as low,
  case when high = '' then null else high end as high from raw),
ranged as (select l_orderkey, l_linenumber, l_suppkey, b.value, b.key, sex,
  case when b.key = 'PROMO' then 0.005 else coalesce(low::double, case sex when 'w' then women_low when 'm' then men_low else child_low end) end as low,
  coalesce(high::double, case sex when 'w' then women_high when 'm' then men_high else child_high end) as high
  from blanked b join limits using (key))
"""


def limited(t):
    """Line items as measurements with text limits, some blank, some equal, some missing."""
    limits = t.part.groupBy(F.col("p_type").alias("key")).agg(
        F.min("p_size").cast("double").alias("women_low"), F.max("p_size").cast("double").alias("women_high"),
        (F.min("p_size").cast("double") - 1).alias("men_low"), (F.max("p_size").cast("double") + 1).alias("men_high"),
        F.lit(0.0).alias("child_low"), F.lit(99.0).alias("child_high"))
    d = F.col("l_discount")
    raw = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("key")), "l_partkey").select(
        "l_orderkey", "l_linenumber", "l_suppkey", F.col("l_quantity").alias("value"), "key",
        F.when(F.col("l_returnflag") == "A", "w").when(F.col("l_returnflag") == "R", "m").otherwise("x").alias("sex"),
        F.when(d == 0.05, "").when(d == 0.03, "7").otherwise(F.round(d * 100).cast("bigint").cast("string")).alias("low"),
        F.when(F.col("l_tax") == 0.02, F.lit(None)).when(d == 0.03, "7").otherwise(
            (F.col("l_quantity").cast("bigint") + 1).cast("string")).alias("high"))
    return default_ranges(raw, limits, overrides={"PROMO": {"low": 0.005}})


@query("default_ranges", f"with {LIMITED_SQL} select * from ranged")
def default_ranges_query(t):
    return limited(t).select("l_orderkey", "l_linenumber", "l_suppkey", "value", "key", "sex", "low", "high")


@query("unit_rescale", f"""with {LIMITED_SQL} select l_orderkey, l_linenumber, l_suppkey, key,
  case when key = 'SMALL' and high <= 20 then value * 100 else value end as value,
  case when key = 'SMALL' and high <= 20 then low * 100 else low end as low,
  case when key = 'SMALL' and high <= 20 then high * 100 else high end as high from ranged""")
def unit_rescale_query(t):
    return unit_rescale(limited(t), key="SMALL", up_to=20.0).select(
        "l_orderkey", "l_linenumber", "l_suppkey", "key", "value", "low", "high")


@query("range_normalize", f"with {LIMITED_SQL} select l_orderkey, l_linenumber, l_suppkey, round((value - low) / nullif(high - low, 0), 8) as value from ranged")
def range_normalize(t):
    return limited(t).select("l_orderkey", "l_linenumber", "l_suppkey", F.round(numeric.range_normalize(
        F.col("value"), F.col("low"), F.col("high")), 8).alias("value"))


@query("calendar_quarter", "select o_orderkey, quarter(o_orderdate)::varchar as quarter from orders")
def calendar_quarter(t):
    return t.orders.select("o_orderkey", dates.quarter_text(F.col("o_orderdate")).alias("quarter"))


@query("sentinel_coalesce", f"""with {URGENT_SQL}
select o_custkey, coalesce(d1, date '9999-12-31') as d1, coalesce(d2, date '9999-12-31') as d2,
  coalesce(d3, date '9999-12-31') as d3, coalesce(year(d3), 2021)::int as y3 from urgent""")
def sentinel_coalesce(t):
    raw = urgent_dates(t).select("o_custkey", *[F.coalesce(F.col(d).cast("string"), F.lit("")).alias(d)
                                                for d in ("d1", "d2", "d3")])
    y3 = F.coalesce(F.substring("d3", 1, 4).try_cast("int"), F.lit(dates.NO_EVENT_YEAR))
    return raw.withColumn("y3", y3).withColumns({d: dates.date_or_sentinel(F.col(d)) for d in ("d1", "d2", "d3")})


@query("drop_non_finite", "select l_orderkey, l_linenumber, l_suppkey, l_partkey, round(l_tax / nullif(l_discount, 0), 8) as ratio from lineitem")
def drop_non_finite(t):
    d = F.col("l_discount")
    stored = F.when(d == 0, F.lit(float("inf"))).otherwise(F.col("l_tax") / F.when(d != 0, d))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey",
                             F.round(numeric.finite_or_null(stored), 8).alias("ratio"))


@query("clip_zero", "select c_custkey, case when v is not null then least(0.0, v) end as low, case when v is not null then greatest(0.0, v) end as high from (select c_custkey, case when c_mktsegment <> 'MACHINERY' then c_acctbal end as v from customer)")
def clip_zero(t):
    v = F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_acctbal"))
    return t.customer.select("c_custkey", numeric.at_most_zero(v).alias("low"), numeric.at_least_zero(v).alias("high"))


@query("round_to_step", "select o_orderkey, round_even(o_totalprice / 1e6 * 20, 0) / 20 as step, floor(o_totalprice / 1e6 * 10) / 10 as low from orders")
def round_to_step(t):
    x = F.col("o_totalprice") / 1e6
    return t.orders.select("o_orderkey", numeric.round_to_step(x).alias("step"), numeric.floor_to_step(x).alias("low"))


@query("split_term", f"""with {TERMS_SQL}
select term, string_split(term, '_')[1] as i1, string_split(term, '_')[2] as i2, string_split(term, '_')[3] as i3,
  string_split(term, '_')[4] as i4, string_split(term, ':')[1] as key1, string_split(term, ':')[2] as key2 from terms""")
def split_term(t):
    return term_table(t).select("term", *text.split_term(F.col("term"), "_", 4, "i"),
                                *text.split_term(F.col("term"), ":", 2, "key"))


@query("interpret_term", f"""with {TERMS_SQL},
p as (select term, estimate >= 0 as up, string_split(term, '_') as s from terms)
select term, case when s[1] = 'trend' then
    case when s[2] = 'abs' then 'The absolute ' || coalesce(s[4], 'NA') || ' trend of ' || coalesce(s[3], 'NA') || ' shows a '
         else 'The time relative ' || coalesce(s[3], 'NA') || ' trend of ' || coalesce(s[2], 'NA') || ' shows a ' end
    || ' ' || case when up then 'positive' else 'negative' end || ' Estimate.  ' ||
    case when up then 'this suggests, the abrupt rise in comparison to last value during the entire disease progression'
         else 'this suggests, the abrupt decrease in comparison to the last value during the entire disease progression' end
    || ' is predictive of a myasthenic crisis'
  when s[1] = 'cnt' then 'The Count of  ' || coalesce(s[2], 'NA') || ' shows a ' ||
    case when up then 'positive Estimate. This suggests correlation with myasthenic crisis.'
         else 'negative Estimate.  This suggests anti-correlation with myasthenic crisis' end
  else 'The ' || coalesce(s[2], 'NA') || ' value of ' || coalesce(s[1], 'NA') || ' shows a ' ||
    case when up then 'positive Estimate.  This suggests a correlation with myasthenic crisis'
         else 'negative Estimate.  This suggests no correlation with myasthenic crisis' end end as interpretation
from p""")
def interpret_term(t):
    return term_table(t).select("term", terms.interpret_term(F.col("term"), F.col("estimate")).alias("interpretation"))


@query("term_groups", f"""with {TERMS_SQL}
select distinct regexp_replace(regexp_replace(term, 'trend_abs_|trend_', '', 'g'), '_(min|max|mean|median|lastKnown|stdev)$', '') as term,
  case when regexp_matches(term, 'Age') then '' else regexp_extract(term, '_(min|max|mean|median|lastKnown|stdev)$', 1) end
    || ' ' || case when contains(term, 'trend_abs') then 'Trend' when contains(term, 'trend') then 'Change Rate' else '' end as "Value",
  round_even(p_value, 2) as pvalue, round_even(estimate, 2) as estimate
from terms where regexp_matches(term, 'D[0-9]+') and round_even(p_value, 2) <= 0.5""")
def term_groups(t):
    return terms.term_groups(term_table(t), families="D[0-9]+", max_p=0.5)


@query("sanitize_columns", 'select p_partkey as "X1.part.key", p_brand as "Brand.Name", p_type as "X_type.p" from part')
def sanitize_columns(t):
    raw = t.part.select(F.col("p_partkey").alias("1.part key"), F.col("p_brand").alias("Brand-Name"),
                        F.col("p_type").alias("_type%p"))
    return columns.sanitize_columns(raw)


@query("select_by_pattern", "select l_orderkey, l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_discount from lineitem")
def select_by_pattern(t):
    chosen = columns.select_by_pattern(t.lineitem, contains="key", drop=True, always=["l_orderkey"])
    return columns.select_by_pattern(chosen, regex="flag$|status$|price|quantity|discount", prefix="l_", always=["l_orderkey"])


@query("term_exclusion", f"with {TERMS_SQL} select term, p_value from terms where not regexp_matches(term, 'cnt_D1.*|Age_of_onset') and not contains(term, ':')")
def term_exclusion(t):
    return term_table(t).where(~F.col("term").rlike("cnt_D1.*|Age_of_onset") & ~F.col("term").contains(":")).select(
        "term", "p_value")


@query("cast_columns", "select try_cast(o_orderkey as int) as o_orderkey, o_custkey::varchar as o_custkey, try_cast(o_orderpriority as int) as o_orderpriority from orders")
def cast_columns(t):
    return columns.cast_columns(t.orders.select("o_orderkey", "o_custkey", "o_orderpriority"),
                                {"o_orderkey": "int", "o_custkey": "string", "o_orderpriority": "int"})


@query("filter_in_list", "select o_orderkey, o_orderstatus, o_orderpriority from orders where o_orderstatus in ('O', 'P') and regexp_matches(o_orderpriority, 'URG|HIGH')")
def filter_in_list(t):
    return t.orders.where(F.col("o_orderstatus").isin("O", "P") & F.col("o_orderpriority").rlike("URG|HIGH")).select(
        "o_orderkey", "o_orderstatus", "o_orderpriority")


@query("filter_pre_event", f"""with {URGENT_SQL}
select o_orderkey, o.o_custkey, o_orderdate::date as o_orderdate from orders o left join urgent u on o.o_custkey = u.o_custkey
where d2 is null or o_orderdate::date < d2""")
def filter_pre_event(t):
    joined = order_days(t).join(urgent_dates(t), "o_custkey", "left")
    return joined.where(dates.before_event(F.col("o_orderdate"), F.col("d2"))).select("o_orderkey", "o_custkey", "o_orderdate")


@query("filter_labeled", "select doc_id, lang, quality from documents left join labels using (doc_id) where quality is not null")
def filter_labeled(t):
    return t.documents.join(t.labels, "doc_id", "left").where(F.col("quality").isNotNull()).select("doc_id", "lang", "quality")


@query("concat_path", "select o_orderkey, o_orderstatus || ', ' || o_orderpriority as path from orders")
def concat_path(t):
    return t.orders.select("o_orderkey", text.concat_path(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("path"))
