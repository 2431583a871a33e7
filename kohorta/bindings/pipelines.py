"""Bindings of the composed pipelines."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from kohorta.bindings.aggregates import six_sql
from kohorta.bindings.evaluation import r
from kohorta.bindings.registry import query
from kohorta.bindings.shared import (EVENT_DATES, EVENT_TYPES, MEASUREMENTS_SQL, URGENT_SQL, USER_EVENTS_SQL,
                                     measurements, order_days, urgent_dates, user_events)
from kohorta.bindings.temporal import TRENDS_SQL
from kohorta.functions.columns import clean_name, sanitize_columns
from kohorta.plans import cohort as co
from kohorta.plans import features as fe
from kohorta.plans import medication as me
from kohorta.plans.measurements import measurement_table
from kohorta.operators.aggregates import STAT_NAMES
from kohorta.operators.ordered import splits_for
from kohorta.operators.temporal import active_in_window, encounter_day_count
from kohorta.session import materialize


# ---- cohort -------------------------------------------------------------------------------------

def cohort(t):
    c = t.customer
    return c.select(
        F.col("c_mktsegment").alias("Vorname"), F.col("c_name").alias("Nachname"), F.col("c_custkey").alias("Patient_ID"),
        F.when(F.col("c_acctbal") < 0, "test").otherwise("control").alias("grp"),
        F.when(F.col("c_nationkey") % 2 == 0, "w").otherwise("m").alias("Gender"), (F.col("c_acctbal") < 0).alias("mk"))


def patients(t, title=True):
    """Patient records: the customers with an urgent order, born on the day of their first order."""
    born = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min("o_orderdate").alias("born"), F.max(F.col("o_orderpriority") == "1-URGENT").alias("known")).where("known")
    name = F.concat(F.when(F.col("c_nationkey") < 12, "Dr. ").otherwise(""), "c_name") if title else F.col("c_name")
    return t.customer.join(born, "c_custkey").select(
        F.col("c_custkey").alias("Pat_Nr"), name.alias("Name"), F.col("c_mktsegment").alias("Vorname"),
        F.date_format("born", "yyyy-MM-dd").alias("Geburtsdatum"))


COHORT_SQL = """
cohort as (select c_mktsegment as Vorname, c_name as Nachname, c_custkey as Patient_ID, case when c_acctbal < 0 then 'test' else 'control' end as grp,
  case when c_nationkey % 2 = 0 then 'w' else 'm' end as Gender, c_acctbal < 0 as mk from customer),
patients as (select c_custkey as Pat_Nr, c_name as Name, c_mktsegment as Vorname, strftime(born, '%Y-%m-%d') as Geburtsdatum
  from customer join (select o_custkey, min(o_orderdate) as born from orders group by 1 having max((o_orderpriority = '1-URGENT')::int) = 1) on c_custkey = o_custkey)
"""


@query("cohort_table", f"""with {COHORT_SQL}, m as (select substr(Geburtsdatum, 1, 3) || '0' as decade, Gender, grp from cohort c left join patients p on c.Nachname = p.Name and c.Vorname = p.Vorname),
g as (select decade, Gender, grp, count(*) as cnt from m group by all)
select decade, Gender as "Gender", grp, cnt, round(cnt / sum(cnt) over (partition by decade), 8) as cnt_p, (sum(cnt) over (partition by decade))::bigint as s from g""")
def cohort_table(t):
    return r(co.cohort_table(cohort(t), patients(t)))


@query("encounter_cohort", f"""with {COHORT_SQL}, lab as (select distinct l_orderkey from lineitem where l_discount > 0.07)
select c_mktsegment as "Vorname", c_name as "Nachname", o_orderkey as "Encounter", o_custkey as "Patient_ID", l_orderkey is not null as has_lab, o_orderpriority as "ICD",
  k.mk, coalesce(k.grp, 'pop') as grp, p.Pat_Nr as "Pat_Nr", p.Geburtsdatum as "Geburtsdatum"
from orders join customer on o_custkey = c_custkey left join lab on l_orderkey = o_orderkey
left join (select * from cohort where grp = 'test') k on k.Patient_ID = o_custkey left join patients p on p.Name = c_name and p.Vorname = c_mktsegment""")
def encounter_cohort(t):
    lab = t.lineitem.where("l_discount > 0.07").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("Patient_ID"), F.col("o_orderkey").alias("Encounter"))
    wards = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderpriority").alias("ICD"), F.col("o_orderkey").alias("Fallnr"), F.col("o_custkey").alias("Patnr"),
        F.col("c_name").alias("Nachname"), F.col("c_mktsegment").alias("Vorname"))
    chosen = cohort(t).where("grp = 'test'")
    out = co.encounter_cohort(lab, wards, chosen, patients(t, title=False))
    return out.withColumn("has_lab", F.coalesce("has_lab", F.lit(False)))


ONSET_SQL = f"""{COHORT_SQL}, {URGENT_SQL},
members as (select grp, Gender, 2000.0 + c_nationkey - substr(Geburtsdatum, 1, 4)::double as onset_age,
  coalesce(year(d2), 2021) - (2000.0 + c_nationkey) as years_to_event
  from patients p join cohort c on c.Nachname = p.Name and c.Vorname = p.Vorname join customer on c_custkey = Patient_ID left join urgent on o_custkey = Patient_ID where c_mktsegment <> 'MACHINERY')
"""


def onset_members(t):
    known = co.date_parts_by_schema(patients(t, title=False))
    diagnoses = t.customer.select(F.col("c_custkey").alias("Pat_Nr"), F.when(
        F.col("c_mktsegment") != "MACHINERY", (2000 + F.col("c_nationkey")).cast("string")).alias("Diagnose_Jahr"))
    dated = cohort(t).join(urgent_dates(t).select(F.col("o_custkey").alias("Patient_ID"), F.coalesce(
        F.col("d2").cast("string"), F.lit("")).alias("mk1_date")), "Patient_ID", "left")
    return co.onset_members(known, diagnoses, dated)


@query("onset_table", f"""with {ONSET_SQL} select grp, Gender as "Gender", median(onset_age) as median_onset_age, min(onset_age) as min_onset_age, max(onset_age) as max_onset_age,
  median(years_to_event)::double as median_years_to_event, min(years_to_event)::double as min_years_to_event, max(years_to_event)::double as max_years_to_event from members group by 1, 2""")
def onset_table(t):
    return co.onset_table(onset_members(t))


@query("age_table", f"""with {COHORT_SQL}, raw as (select Pat_Nr, Vorname = 'BUILDING' as fixed, (Vorname = 'FURNITURE')::int::double as sex,
  floor(datediff('day', Geburtsdatum::date, date '2021-11-23') / 365) / 100 as age, (2000.0 + length(Vorname) - year(Geburtsdatum::date)) / 100 as onset from patients)
select Pat_Nr as "Patient_ID", case when fixed then 1.0 else sex end as "Geschlecht", round(case when fixed then 0.5 else age end, 8) as "Age",
  round(case when fixed then 0.25 else onset end, 8) as "Age_of_onset" from raw""")
def age_table(t):
    return r(ages(t))


def ages(t):
    records = patients(t)
    members = records.select(
        F.col("Pat_Nr").alias("Patient_ID"), F.when(F.col("Vorname") == "FURNITURE", "weiblich").otherwise("männlich").alias("Geschlecht"),
        "Geburtsdatum", (2000 + F.length("Vorname")).cast("string").alias("Diagnose_Jahr"))
    corrected = records.where("Vorname = 'BUILDING'").select(
        F.col("Pat_Nr").alias("Patient_ID"), F.lit(1.0).alias("Geschlecht"), F.lit(0.5).alias("Age"), F.lit(0.25).alias("Age_of_onset"))
    return co.age_table(members, dt.date(2021, 11, 23), corrected)


@query("onset_decades", f"""with {ONSET_SQL}, g as (select (floor(onset_age / 10) * 10)::bigint as onset_decade, Gender, grp, count(*) as cnt from members group by 1, 2, 3)
select onset_decade, Gender as "Gender", grp, cnt, round(cnt / sum(cnt) over (partition by onset_decade), 8) as cnt_p from g""")
def onset_decades(t):
    return r(co.onset_decades(onset_members(t)))


@query("clinical_status", f"""with {COHORT_SQL}, history as (select o_custkey as Pat_Nr, max((o_orderstatus = 'P')::int) as Thymektomie, min(o_orderpriority) as AChR from orders group by 1)
select grp, Thymektomie as "Thymektomie", AChR as "AChR", count(*) as cnt from cohort c left join patients p on c.Nachname = p.Name and c.Vorname = p.Vorname left join history using (Pat_Nr) group by all""")
def clinical_status(t):
    history = t.orders.groupBy(F.col("o_custkey").alias("Pat_Nr")).agg(
        F.max((F.col("o_orderstatus") == "P").cast("int")).alias("Thymektomie"), F.min("o_orderpriority").alias("AChR"))
    return co.clinical_status(cohort(t), patients(t, title=False), history, ["Thymektomie", "AChR"])


def lab_rows(t):
    """Three attribute rows per line item, in a stated order within the order."""
    from kohorta.bindings.sources import LINE_ORDER
    from kohorta.operators.ordered import number_rows
    lines = number_rows(t.lineitem, ["l_orderkey"], LINE_ORDER, "n").join(
        t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(F.col("o_custkey").alias("Patient_ID"), F.col("l_orderkey").alias("Encounter"), F.inline(F.array(*[
        F.struct((F.col("n") * 3 + i).alias("seq"), F.lit(a).alias("attr"), v.alias("value")) for i, (a, v) in enumerate((
            ("LeistID", F.col("l_partkey").cast("string")), ("Value", F.col("l_quantity").cast("int").cast("string")),
            ("Date", F.date_format("l_shipdate", "ddMMyyyy"))))])))


@query("pre_event_records", f"""with {COHORT_SQL}, {URGENT_SQL},
after_event as (select distinct o_orderkey from orders o join urgent u on o.o_custkey = u.o_custkey where
  (o_orderdate::date >= d1 and o_orderdate::date < (d1 + interval 6 month)::date) or (o_orderdate::date >= d2 and o_orderdate::date < (d2 + interval 6 month)::date) or
  (o_orderdate::date >= d3 and o_orderdate::date < (d3 + interval 6 month)::date)),
n as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as n from lineitem),
e as (select o_custkey as Patient_ID, l_orderkey as Encounter, n, unnest([n * 3, n * 3 + 1, n * 3 + 2]) as seq, unnest(['LeistID', 'Value', 'Date']) as attr,
  unnest([l_partkey::varchar, l_quantity::int::varchar, strftime(l_shipdate, '%d%m%Y')]) as value from n join orders on l_orderkey = o_orderkey)
select e.Patient_ID as "Patient_ID", Encounter as "Encounter", seq, attr, value, Encounter || '_' || n as "lab_ID", mk, Gender as "Gender"
from e join cohort using (Patient_ID) where Encounter not in (select o_orderkey from after_event)""")
def pre_event_records(t):
    members = cohort(t).join(urgent_dates(t).withColumnRenamed("o_custkey", "Patient_ID"), "Patient_ID", "left")
    encounters = order_days(t).select(F.col("o_custkey").alias("Patient_ID"), F.col("o_orderkey").alias("Encounter"),
                                      F.col("o_orderdate").alias("date"))
    return co.pre_event_records(lab_rows(t), encounters, members, EVENT_DATES)


@query("cohort_summary", f"""with {COHORT_SQL} select grp, mk, Gender as "Gender", count(*) as cnt from cohort where Patient_ID in (select o_custkey from orders where o_orderstatus = 'F') group by all""")
def cohort_summary(t):
    scored = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("Patient_ID"))
    return co.cohort_summary(cohort(t), scored, ["grp", "mk", "Gender"])


# ---- medication ---------------------------------------------------------------------------------

NOUN_CLASSES = {"widget": "CE_Hemmer", "bolt": "Corticoid", "ring": "Immunsupressivum"}


def medication_wide(t):
    """One row per line item as a prescription with two slots: the part, and a shouted variant of it
    whose class is missing or blank."""
    noun = F.element_at(F.split("p_name", " "), -1)
    klass = F.lit("Andere")
    for n, c in NOUN_CLASSES.items():
        klass = F.when(noun == n, c).otherwise(klass)
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(
        t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(
        F.col("o_custkey").alias("Pat_Nr"), F.to_date("l_shipdate").alias("Datum"),
        F.col("p_name").alias("Drug1"), F.when(F.col("p_size") > 20, klass).otherwise("").alias("Klasse1"),
        F.concat(F.upper("p_name"), F.lit(" forte")).alias("Drug2"),
        F.when(F.col("l_linestatus") == "F", F.lit("")).alias("Klasse2"))


MEDICATION_SQL = f"""{URGENT_SQL},
wide as (select o_custkey as Pat_Nr, l_shipdate::date as Datum, p_name as Drug1,
  case when p_size > 20 then case string_split(p_name, ' ')[-1] when 'widget' then 'CE_Hemmer' when 'bolt' then 'Corticoid' when 'ring' then 'Immunsupressivum' else 'Andere' end else '' end as Klasse1,
  upper(p_name) || ' forte' as Drug2, case when l_linestatus = 'F' then '' end as Klasse2
  from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey),
meds as (select Pat_Nr, Datum, 1 as slot, Drug1 as Drug, Klasse1 as Klasse from wide union all select Pat_Nr, Datum, 2, Drug2, Klasse2 from wide),
dictionary as (select distinct Klasse as k, Drug as d from meds where Klasse in ('CE_Hemmer', 'Corticoid', 'Immunsupressivum') and Drug <> ''),
guess as (select Drug, min(k) as g from (select distinct Drug from meds where Klasse is null or Klasse = '') join dictionary on regexp_matches(Drug, '(?i)' || d) group by 1),
filled as (select Pat_Nr, Datum, slot, m.Drug, coalesce(nullif(Klasse, ''), g, '') as Klasse from meds m left join guess using (Drug))
"""


@query("medication_fill", f"""with {MEDICATION_SQL} select Drug as "Drug", Klasse as "Klasse", slot, count(*) as cnt from filled group by all""")
def medication_fill(t):
    rows = me.medication_rows(medication_wide(t), ["Pat_Nr", "Datum"], [1, 2], ["Drug", "Klasse"])
    return me.fill_classes(rows).groupBy("Drug", "Klasse", "slot").agg(F.count(F.lit(1)).alias("cnt"))


@query("medication_classes", f"""with {MEDICATION_SQL},
kept as (select Pat_Nr, Klasse, min(strftime(Datum, '%Y%m%d') || slot || Klasse) as first_at from filled join urgent on Pat_Nr = o_custkey where Klasse <> '' and (d3 is null or Datum < d3) group by 1, 2)
select Pat_Nr as "Pat_Nr", string_agg(Klasse, ', ' order by first_at) as "Wirkstoffe", max((Klasse = 'CE_Hemmer')::int) as "CE_Hemmer", max((Klasse = 'Corticoid')::int) as "Corticoid", max((Klasse = 'Immunsupressivum')::int) as "Immunsupressivum" from kept group by 1""")
def medication_classes(t):
    rows = me.medication_rows(medication_wide(t), ["Pat_Nr", "Datum"], [1, 2], ["Drug", "Klasse"])
    ordered = rows.withColumn("seen", F.concat(F.date_format("Datum", "yyyyMMdd"), F.col("slot").cast("string")))
    events = urgent_dates(t).withColumnRenamed("o_custkey", "Pat_Nr")
    return me.medication_classes(ordered, events, "Pat_Nr", "Datum", "d3", "seen")


@query("medication_distribution", """
with long as (select o_custkey, o_orderstatus as k from orders union all select o_custkey, nullif(o_orderpriority, '5-LOW') from orders),
g as (select k as "Klasse", count(distinct o_custkey) as cnt_patients from long where k is not null and k <> '' group by 1)
select "Klasse", cnt_patients, round(cnt_patients / sum(cnt_patients) over (), 8) as cnt_p from g""")
def medication_distribution(t):
    wide = t.orders.select("o_custkey", F.col("o_orderstatus").alias("Klasse1"),
                           F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("Klasse2"))
    return r(me.medication_distribution(wide, "o_custkey", ["Klasse1", "Klasse2"]))


# ---- measurements and encounters ----------------------------------------------------------------

@query("measurement_table", """
with n as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as n from lineitem),
limits as (select p_type as key, min(p_size)::double as wl, max(p_size)::double as wh, min(p_size)::double - 1 as ml, max(p_size)::double + 1 as mh from part group by 1),
base as (select l_orderkey as "Encounter", n as rec, case l_returnflag when 'A' then 'w' when 'R' then 'm' else 'x' end as sex, p_type as key, l_quantity + l_discount as value,
  case when l_tax = 0.02 then null else l_discount * 100 end as low0, l_quantity + 1 as high0, l_shipdate::date as day, l_suppkey
  from n join part on l_partkey = p_partkey where not (l_linestatus = 'F' and l_tax = 0)),
ranged as (select b.*, case when b.key = 'PROMO' then 0.005 else coalesce(round(low0), case sex when 'w' then wl when 'm' then ml else 0.0 end) end as low1, high0 as high1 from base b join limits l using (key)),
scaled as (select "Encounter", rec, sex, key, day, case when key = 'SMALL' and high1 <= 20 then value * 100 else value end as value,
  case when key = 'SMALL' and high1 <= 20 then low1 * 100 else low1 end as low, case when key = 'SMALL' and high1 <= 20 then high1 * 100 else high1 end as high from ranged)
select "Encounter", rec, sex, key, round(value, 6) as value, low, high, round((value - low) / nullif(high - low, 0), 6) as normalized, day, quarter(day)::varchar as quarter from scaled""")
def measurement(t):
    from kohorta.bindings.sources import LINE_ORDER
    from kohorta.operators.ordered import number_rows
    lines = number_rows(t.lineitem, ["l_orderkey"], LINE_ORDER, "rec").join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    value = F.when((F.col("l_linestatus") == "F") & (F.col("l_tax") == 0), "-1").otherwise(
        F.replace(F.format_string("%.2f", F.col("l_quantity") + F.col("l_discount")), F.lit("."), F.lit(",")))
    attrs = {"Kat": F.concat("p_type", F.lit("_absolut")), "Value": value, "Date": F.date_format("l_shipdate", "dMMyyyy"),
             "range_low": F.when(F.col("l_tax") != 0.02, F.format_string("%.0f,0", F.col("l_discount") * 100)),
             "range_high": F.format_string("%.1f", F.col("l_quantity") + 1)}
    eav = lines.select(
        F.col("l_orderkey").alias("Encounter"), "rec",
        F.when(F.col("l_returnflag") == "A", "w").when(F.col("l_returnflag") == "R", "m").otherwise("x").alias("sex"),
        F.inline(F.array(*[F.struct(F.lit(a).alias("attr"), v.alias("value")) for a, v in attrs.items()])))
    limits = t.part.groupBy(F.col("p_type").alias("key")).agg(
        F.min("p_size").cast("double").alias("women_low"), F.max("p_size").cast("double").alias("women_high"),
        (F.min("p_size").cast("double") - 1).alias("men_low"), (F.max("p_size").cast("double") + 1).alias("men_high"),
        F.lit(0.0).alias("child_low"), F.lit(99.0).alias("child_high"))
    out = measurement_table(eav, ["Encounter", "rec", "sex"], limits, {"PROMO": {"low": 0.005}}, ("SMALL", 20.0))
    return out.withColumns({"value": F.round("value", 6), "normalized": F.round("normalized", 6)})


@query("treatment_flags", """
with lookup as (select distinct p_type as value, case when p_type in ('ECONOMY', 'SMALL') then 'basic' when p_type = 'PROMO' then 'special' end as value_clean from part)
select l_orderkey as "Encounter", o_custkey as "Patient_ID", max((value_clean = 'basic')::int) as basic, max((value_clean = 'special')::int) as special
from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey join lookup on p_type = value where value_clean is not null group by 1, 2""")
def treatment_flags(t):
    records = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(
        t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("Encounter"), F.col("o_custkey").alias("Patient_ID"), F.inline(F.array(
            F.struct(F.lit("Type").alias("attr"), F.lit("OPS").alias("value")),
            F.struct(F.lit("Descr").alias("attr"), F.col("p_type").alias("value")))))
    lookup = t.part.select(F.col("p_type").alias("value")).distinct().withColumn("value_clean", F.when(
        F.col("value").isin("ECONOMY", "SMALL"), "basic").when(F.col("value") == "PROMO", "special"))
    return fe.treatment_flags(records, lookup, ["basic", "special"])


def encounter_attributes(t):
    return t.orders.select(F.col("o_custkey").alias("Patient_ID"), F.col("o_orderkey").alias("Encounter"), F.inline(F.array(*[
        F.struct(F.lit(a).alias("attr"), v.alias("value")) for a, v in (
            ("admission", F.date_format("o_orderdate", "ddMMyyyy")),
            ("discharge", F.when(F.col("o_orderpriority") != "5-LOW", F.date_format(F.date_add("o_orderdate", 2), "ddMMyyyy"))),
            ("oe_admission", F.col("o_orderstatus")), ("oe_discharge", F.substring("o_orderpriority", 1, 1)),
            ("encounter_type", F.when(F.col("o_orderstatus") == "F", "stat").otherwise("amb")))])))


PATH_NAMES = [f"{a}, {b}" for a in "FOP" for b in "12345"]


@query("care_paths", "with c as (select o_custkey, o_orderstatus || ', ' || o_orderpriority[1] as path, count(*) as cnt from orders group by 1, 2), s as (select o_custkey, path, round(cnt / sum(cnt) over (partition by o_custkey), 8) as share from c) "
       "select o_custkey as \"Patient_ID\", " + ", ".join(f"coalesce(max(case when path = '{p}' then share end), 0.0::double) as \"{p}\"" for p in PATH_NAMES) + " from s group by 1")
def care_paths(t):
    return r(fe.care_paths(encounter_attributes(t), PATH_NAMES).toDF("Patient_ID", *PATH_NAMES))


@query("stay_counts", """
select o_custkey as "Patient_ID", o_orderkey as "Encounter", (sum((o_orderstatus = 'F')::int) over w)::bigint as cnt_stat, (sum((o_orderstatus <> 'F')::int) over w)::bigint as cnt_amb
from orders where o_orderpriority <> '5-LOW' window w as (partition by o_custkey order by o_orderdate::date, o_orderkey rows unbounded preceding)""")
def stay_counts(t):
    return fe.stay_counts(encounter_attributes(t))


# ---- features -----------------------------------------------------------------------------------

TREND_COLUMNS = [f"{m}_{k}" for m in ("trend_abs", "trend") for k in EVENT_TYPES]
TREND_PIVOT = ", ".join(f"coalesce(avg(case when event_type = '{k}' then {m} end), 0) as {m}_{k}"
                        for m in ("trend_abs", "trend") for k in EVENT_TYPES)


def trend_table(t):
    return fe.value_trends(measurements(t), ["user_id"], "event_type", ["day", "event_id"], "day", "value",
                           ["user_id", "day"], EVENT_TYPES)


@query("value_trends", f"with {TRENDS_SQL}, p as (select user_id, day, {TREND_PIVOT} from trends group by 1, 2) select user_id, day, "
       + ", ".join(f"round({c}, 8) as {c}" for c in TREND_COLUMNS) + " from p")
def value_trends(t):
    return r(trend_table(t))


STATUS_SHARES = ["F", "O", "P"]
PLAIN = [*EVENT_TYPES, "active", "share_F", "share_O", "share_P"]
CONSTANTS = ["encounter_days", "balance"]


def dated(t):
    """The dated feature matrix of the event users: values carried forward, trends, activity, shares.

    The raw events are read once for the user-day matrix, which is materialized: everything after it
    works at user-day grain. A user's history is then bounded by the calendar and never split.
    """
    matrix = materialize(fe.values_and_trends(measurements(t), ["user_id"], "event_type", ["day", "event_id"], "day",
                                              "value", ["user_id", "day"], EVENT_TYPES))
    days = matrix.select("user_id", "day")
    shares = t.orders.groupBy(F.col("o_custkey").alias("user_id")).agg(*[
        F.expr(f"avg(if(o_orderstatus = '{s}', 1, 0)) as share_{s}") for s in STATUS_SHARES])
    accounts = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("balance"))
    parts = [(active_in_window(days, "user_id", "day", "active"), ["user_id", "day"]),
             (encounter_day_count(days, "user_id", "day", "encounter_days"), ["user_id"]), (shares, ["user_id"]),
             (accounts, ["user_id"]), (user_events(t), ["user_id"])]
    return fe.dated_features(matrix, ["user_id"], ["day"], EVENT_TYPES, parts, splits=1)


DATED_SQL = f"""{TRENDS_SQL}, {USER_EVENTS_SQL},
trend_table as (select user_id, day, {TREND_PIVOT} from trends group by 1, 2),
daily as (select user_id, day, {', '.join(f"avg(case when event_type = '{k}' then value end) as {k}" for k in EVENT_TYPES)} from measurements group by 1, 2),
filled as (select user_id, day, {', '.join(f"last_value({k} ignore nulls) over w as {k}" for k in EVENT_TYPES)} from daily
  window w as (partition by user_id order by day rows between unbounded preceding and current row)),
active_days as (select user_id, day from daily),
changes as (select user_id, day, 1 as d from active_days union all select user_id, (day + interval 6 month)::date, -1 from active_days),
active as (select user_id, day, sum(d) over (partition by user_id order by day) / 365 as active from (select user_id, day, sum(d) as d from changes group by 1, 2)),
shares as (select o_custkey as user_id, avg((o_orderstatus = 'F')::int) as share_F, avg((o_orderstatus = 'O')::int) as share_O, avg((o_orderstatus = 'P')::int) as share_P from orders group by 1),
counts as (select user_id, count(*) / 365 as encounter_days from active_days group by 1),
dated as (select f.*, {', '.join(TREND_COLUMNS)}, active, encounter_days, share_F, share_O, share_P, c_acctbal as balance, event_day, mk
  from filled f left join trend_table t on f.user_id = t.user_id and f.day = t.day left join active a on f.user_id = a.user_id and f.day = a.day
  left join counts n on n.user_id = f.user_id left join shares s on s.user_id = f.user_id left join customer on c_custkey = f.user_id left join user_events u on u.user_id = f.user_id)
"""


@query("dated_features", f"with {DATED_SQL} select user_id, day, event_day, mk, " + ", ".join(
    f"round({c}, 8) as \"{c}\"" for c in [*EVENT_TYPES, *TREND_COLUMNS, "active", "encounter_days", "share_F", "share_O", "share_P", "balance"]) + " from dated")
def dated_features(t):
    return r(dated(t))


def feature_matrix(t):
    return fe.patient_features(dated(t), ["user_id", "mk"], "day", "event_day", TREND_COLUMNS, PLAIN, CONSTANTS, splits=1)


FEATURES = [f"{c}_{s}" for c in [*TREND_COLUMNS, *PLAIN] for s in STAT_NAMES]
FEATURES_SQL = (f"with {DATED_SQL}, early as (select * from dated where event_day is null or day < event_day), "
                f"clipped as ({six_sql(TREND_COLUMNS, True, 'early', keys='user_id, mk')}), "
                f"plain as ({six_sql([*PLAIN, *CONSTANTS], False, 'early', keys='user_id, mk')}) "
                "select clipped.user_id, clipped.mk, " + ", ".join(f"round({c}, 7) as \"{c}\"" for c in FEATURES)
                + ", " + ", ".join(f"round({c}_min, 7) as {c}" for c in CONSTANTS)
                + " from clipped join plain on clipped.user_id = plain.user_id")


@query("patient_features", FEATURES_SQL)
def patient_features(t):
    return r(feature_matrix(t), 7)


# ---- features by encounter: the line items as measurements, all parts at their own grain ------------

KEYS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
KEY_TRENDS = [f"{m}_{k}" for m in ("trend_abs", "trend") for k in KEYS]
TREATMENTS = ["basic", "special"]
BY_DAY = [*KEYS, "active", *TREATMENTS, "cnt_stat"]
BY_PATIENT = ["Geschlecht", "Age", "Age_of_onset", "cnt_Encounters_days", *PATH_NAMES, *me.CLASSES]


def encounter_values(t):
    """Measurements of an encounter: its line items, by type of part, on the day shipped."""
    from kohorta.bindings.sources import LINE_ORDER
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(
        t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(F.col("o_custkey").alias("Patient_ID"), F.col("l_orderkey").alias("Encounter"),
                        F.to_date("l_shipdate").alias("Date"), F.col("p_type").alias("key"), *LINE_ORDER)


def cohort_events(t):
    events = urgent_dates(t).select(F.col("o_custkey").alias("Patient_ID"), *EVENT_DATES)
    return cohort(t).select("Patient_ID", "mk").join(events, "Patient_ID", "left")


def patient_parts(t):
    """Age, days with an encounter, care paths and medication classes: one row per patient each."""
    days = t.orders.select(F.col("o_custkey").alias("Patient_ID"), F.to_date("o_orderdate").alias("day"))
    classes = medication_classes(t).withColumnRenamed("Pat_Nr", "Patient_ID").drop("Wirkstoffe")
    paths = fe.care_paths(encounter_attributes(t), PATH_NAMES).toDF("Patient_ID", *PATH_NAMES)
    return [(part, ["Patient_ID"]) for part in (
        ages(t), encounter_day_count(days, "Patient_ID", "day", "cnt_Encounters_days"), paths, classes)]


def encounter_matrix(t):
    from kohorta.bindings.sources import LINE_ORDER
    return fe.encounter_matrix(encounter_values(t), cohort_events(t), "key", ["Date", "Encounter", *LINE_ORDER], "Date", "l_quantity", KEYS)


def encounter_dated(t, matrix, parts=(), splits=None):
    by_encounter = [(treatment_flags(t), ["Patient_ID", "Encounter"]), (fe.stay_counts(encounter_attributes(t)), ["Patient_ID", "Encounter"])]
    return fe.encounter_days(matrix, cohort_events(t), [*by_encounter, *parts], "Date", KEYS, splits=splits)


ENCOUNTER_SQL = f"""{COHORT_SQL}, {MEDICATION_SQL},
vals as (select o_custkey as "Patient_ID", l_orderkey as "Encounter", l_shipdate::date as "Date", p_type as key, l.*
  from lineitem l join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey),
lagged as (select *, l_quantity - lag(l_quantity) over w as diff, "Date" - lag("Date") over w as days from vals
  window w as (partition by "Patient_ID", key order by "Date", "Encounter", l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)),
daily as (select "Patient_ID", "Encounter", "Date", {', '.join(f"avg(case when key = '{k}' then l_quantity end) as {k}" for k in KEYS)} from vals group by 1, 2, 3),
trend_rows as (select "Patient_ID", "Encounter", "Date", {', '.join(f"coalesce(avg(case when key = '{k}' then {e} end), 0) as {m}_{k}" for m, e in (("trend_abs", "coalesce(diff, 0)"), ("trend", "coalesce(diff / nullif(days, 0), 0)")) for k in KEYS)}
  from lagged where not (coalesce(days, 1) = 0 and coalesce(diff, 0) <> 0) group by 1, 2, 3),
filled_days as (select "Patient_ID", "Encounter", "Date", {', '.join(f"last_value({k} ignore nulls) over w as {k}" for k in KEYS)} from daily
  window w as (partition by "Patient_ID" order by "Date", "Encounter" rows between unbounded preceding and current row)),
value_days as (select distinct "Patient_ID", "Date" from daily),
steps as (select "Patient_ID", "Date", 1 as d from value_days union all select "Patient_ID", ("Date" + interval 6 month)::date, -1 from value_days),
active as (select "Patient_ID", "Date", sum(d) over (partition by "Patient_ID" order by "Date") / 365 as active from (select "Patient_ID", "Date", sum(d) as d from steps group by 1, 2)),
treated as (select l_orderkey as "Encounter", max((p_type in ('ECONOMY', 'SMALL'))::int) as basic, max((p_type = 'PROMO')::int) as special
  from lineitem join part on l_partkey = p_partkey where p_type in ('ECONOMY', 'SMALL', 'PROMO') group by 1),
stays as (select o_orderkey as "Encounter", (sum((o_orderstatus = 'F')::int) over w)::bigint as cnt_stat, (sum((o_orderstatus <> 'F')::int) over w)::bigint as cnt_amb
  from orders where o_orderpriority <> '5-LOW' window w as (partition by o_custkey order by o_orderdate::date, o_orderkey rows unbounded preceding)),
raw_ages as (select Pat_Nr, Vorname = 'BUILDING' as fixed, (Vorname = 'FURNITURE')::int::double as sex,
  floor(datediff('day', Geburtsdatum::date, date '2021-11-23') / 365) / 100 as age, (2000.0 + length(Vorname) - year(Geburtsdatum::date)) / 100 as onset from patients),
ages as (select Pat_Nr, case when fixed then 1.0 else sex end as "Geschlecht", case when fixed then 0.5 else age end as "Age", case when fixed then 0.25 else onset end as "Age_of_onset" from raw_ages),
visits as (select o_custkey, count(distinct o_orderdate::date) / 365 as "cnt_Encounters_days" from orders group by 1),
path_counts as (select o_custkey, o_orderstatus || ', ' || o_orderpriority[1] as path, count(*) as cnt from orders group by 1, 2),
path_shares as (select o_custkey, path, cnt / sum(cnt) over (partition by o_custkey) as share from path_counts),
paths as (select o_custkey, {', '.join(f"coalesce(max(case when path = '{p}' then share end), 0.0::double) as " + chr(34) + p + chr(34) for p in PATH_NAMES)} from path_shares group by 1),
taken as (select Pat_Nr, {', '.join(f'max((Klasse = {chr(39)}{c}{chr(39)})::int) as "{c}"' for c in me.CLASSES)} from filled join urgent on Pat_Nr = o_custkey where Klasse <> '' and (d3 is null or Datum < d3) group by 1),
mk_info as (select c.Patient_ID as id, c.mk, d1, d2, d3 from cohort c left join urgent on o_custkey = c.Patient_ID),
by_day as (select f.*, {', '.join(KEY_TRENDS)}, active, basic, special, cnt_stat, cnt_amb, mk, d1, d2, d3
  from filled_days f join mk_info on f."Patient_ID" = id left join trend_rows v on v."Patient_ID" = f."Patient_ID" and v."Encounter" = f."Encounter" and v."Date" = f."Date"
  left join active a on a."Patient_ID" = f."Patient_ID" and a."Date" = f."Date" left join treated e on e."Encounter" = f."Encounter" left join stays s on s."Encounter" = f."Encounter")
"""
PATIENT_JOINS = "left join ages on ages.Pat_Nr = b.\"Patient_ID\" left join visits on visits.o_custkey = b.\"Patient_ID\" left join paths on paths.o_custkey = b.\"Patient_ID\" left join taken on taken.Pat_Nr = b.\"Patient_ID\""


def _listed(names, digits=7, places=("Geschlecht", "Age", "Age_of_onset", "cnt_Encounters_days", *PATH_NAMES)):
    """Select list of the result; fractions are compared rounded."""
    return ", ".join(f'round("{c}"::double, {digits}) as "{clean_name(c)}"' if c in places or c not in BY_PATIENT
                     else f'"{c}" as "{clean_name(c)}"' for c in names)


@query("encounter_features", f"with {ENCOUNTER_SQL} select b.\"Patient_ID\", \"Encounter\", \"Date\", mk, d1, d2, d3, basic, special, cnt_stat, cnt_amb, "
       + _listed([*KEYS, *KEY_TRENDS, "active", *BY_PATIENT]) + f" from by_day b {PATIENT_JOINS}")
def encounter_features(t):
    return r(sanitize_columns(encounter_dated(t, encounter_matrix(t), patient_parts(t))), 7)


ENCOUNTER_STATS = [f"{c}_{s}" for c in [*KEY_TRENDS, *BY_DAY] for s in STAT_NAMES]


@query("encounter_patient_features", f"with {ENCOUNTER_SQL}, early as (select * from by_day where d1 is null or \"Date\" < d1), "
       + f"clipped as ({six_sql(KEY_TRENDS, True, 'early', keys=chr(34) + 'Patient_ID' + chr(34), order='row(' + chr(34) + 'Date' + chr(34) + ', ' + chr(34) + 'Encounter' + chr(34) + ')')}), "
       + f"plain as ({six_sql([*BY_DAY, 'cnt_amb'], False, 'early', keys=chr(34) + 'Patient_ID' + chr(34) + ', mk, d1, d2, d3', order='row(' + chr(34) + 'Date' + chr(34) + ', ' + chr(34) + 'Encounter' + chr(34) + ')')}) "
       + "select b.\"Patient_ID\", b.mk, b.d1, b.d2, b.d3, round(cnt_amb_min::double, 7) as cnt_amb, " + _listed([*ENCOUNTER_STATS, *BY_PATIENT])
       + f" from plain b join clipped c on c.\"Patient_ID\" = b.\"Patient_ID\" {PATIENT_JOINS}")
def encounter_patient_features(t):
    matrix = encounter_matrix(t)
    splits = splits_for(matrix.select("Patient_ID"), ["Patient_ID"])  # counted on the written matrix, not on all that is joined to it
    dated = encounter_dated(t, matrix, splits=1 if splits == 1 else None)
    out = fe.encounter_patient_features(dated, ["Patient_ID", "mk", *EVENT_DATES], "Date", "d1", KEY_TRENDS, BY_DAY, ["cnt_amb"],
                                        patient_parts(t), splits=splits)
    return r(out, 7)
