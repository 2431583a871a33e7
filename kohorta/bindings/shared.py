"""Roles of the given tables, stated once for Spark and once for SQL.

patient = customer or events.user_id, encounter = order, measurement = event, dictionary = part,
nation or region. The event dates of a patient are its first three urgent order dates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
EVENT_DATES = ["d1", "d2", "d3"]


def order_days(t) -> DataFrame:
    return t.orders.withColumn("o_orderdate", F.to_date("o_orderdate"))


def urgent_dates(t) -> DataFrame:
    """One row per customer: its first three distinct urgent order dates. The distinct dates of a
    customer are bounded by the calendar."""
    days = order_days(t).where("o_orderpriority = '1-URGENT'")
    dates = days.groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderdate")).alias("ds"))
    return dates.select("o_custkey", *[F.get("ds", F.lit(i)).alias(d) for i, d in enumerate(EVENT_DATES)])


URGENT_SQL = """
urgent as (
  select o_custkey, ds[1] as d1, ds[2] as d2, ds[3] as d3
  from (select o_custkey, list_sort(list(distinct o_orderdate::date)) as ds
        from orders where o_orderpriority = '1-URGENT' group by o_custkey))
"""


def measurements(t) -> DataFrame:
    return t.events.select("event_id", "user_id", F.to_date("ts").alias("day"), "event_type", "value")


MEASUREMENTS_SQL = """
measurements as (select event_id, user_id, ts::date as day, event_type, value from events)
"""

# A patient of the event stream has the event when a purchase is worth more than this.
EVENT_VALUE = 150.0


def user_events(t) -> DataFrame:
    """Per user: event day (the first large purchase) and label."""
    big = (F.col("event_type") == "purchase") & (F.col("value") > EVENT_VALUE)
    return (t.events.groupBy("user_id").agg(F.min(F.when(big, F.to_date("ts"))).alias("event_day"))
            .withColumn("mk", F.col("event_day").isNotNull()))


USER_EVENTS_SQL = """
user_events as (
  select user_id, event_day, event_day is not null as mk
  from (select user_id, min(case when event_type = 'purchase' and value > 150.0 then ts::date end) as event_day
        from events group by user_id))
"""


def gapped_part(t) -> DataFrame:
    """The part table with holes: missing and blank cells by stated rules."""
    return t.part.select(
        "p_partkey",
        F.when(F.col("p_size") > 10, F.col("p_size")).alias("p_size"),
        F.when(F.col("p_brand") != "Brand#7", F.col("p_brand")).otherwise("").alias("p_brand"),
        F.when(F.col("p_type") != "SMALL", F.col("p_type")).alias("p_type"),
        F.when(F.col("p_retailprice") > 1000, F.col("p_retailprice")).alias("p_retailprice"))


GAPPED_SQL = """
gapped as (
  select p_partkey, case when p_size > 10 then p_size end as p_size,
    case when p_brand <> 'Brand#7' then p_brand else '' end as p_brand,
    case when p_type <> 'SMALL' then p_type end as p_type,
    case when p_retailprice > 1000 then p_retailprice end as p_retailprice from part)
"""


def term_table(t) -> DataFrame:
    """A term table over the embedding dimensions: contrast of the two label halves per dimension."""
    long = t.embeddings.select((F.col("label") < 5).alias("hit"), F.posexplode("embedding").alias("dim", "x"))
    x, hit = F.col("x").cast("double"), F.col("hit")
    stats = long.groupBy("dim").agg(
        (F.avg(F.when(hit, x)) - F.avg(F.when(~hit, x))).alias("estimate"),
        (2 * F.stddev_samp(x) / F.sqrt(F.count(x))).alias("std_error"))
    stats = stats.withColumns({"estimate": F.round("estimate", 9), "std_error": F.round("std_error", 9)})
    kinds = F.array(*[F.lit(k) for k in ("trend_abs_D%s_mean", "trend_D%s_max", "cnt_D%s_median", "D%s_lastKnown",
                                         "D%s_stdev:D0_mean", "Age_of_onset_D%s_min")])
    name = F.element_at(kinds, (F.col("dim") % 6 + 1).cast("int"))
    return stats.select(
        F.replace(name, F.lit("%s"), F.col("dim").cast("string")).alias("term"), "estimate", "std_error",
        F.round(F.exp(-F.abs(F.col("estimate")) / F.col("std_error")), 7).alias("p_value"))


TERMS_SQL = """
long_dims as (
  select label < 5 as hit, unnest(range(64)) as dim, unnest(embedding)::double as x from embeddings),
dim_stats as (
  select dim, round(avg(case when hit then x end) - avg(case when not hit then x end), 9) as estimate,
    round(2 * stddev_samp(x) / sqrt(count(x)), 9) as std_error from long_dims group by dim),
terms as (
  select replace(['trend_abs_D%s_mean', 'trend_D%s_max', 'cnt_D%s_median', 'D%s_lastKnown',
      'D%s_stdev:D0_mean', 'Age_of_onset_D%s_min'][dim % 6 + 1], '%s', dim::varchar) as term,
    estimate, std_error, round(exp(-abs(estimate) / std_error), 7) as p_value from dim_stats)
"""


def scores(t) -> DataFrame:
    """Scored runs: run = line number, patient = order customer, score from the line's own values.

    Discounts give many ties; late ship dates tend to score higher.
    """
    line = t.lineitem.select("l_linenumber", "l_returnflag", "l_orderkey", "l_partkey", "l_quantity", "l_discount",
                             "l_tax")
    return line.select(
        F.col("l_linenumber").alias("run"),
        F.when(F.col("l_returnflag") == "A", "glm").otherwise("rF").alias("model"),
        F.col("l_orderkey").alias("patient"), F.col("l_partkey").alias("row_id"),
        ((F.col("l_quantity") + F.round(F.col("l_discount") * 100)) / 67).alias("score"),
        (F.col("l_quantity") * 0.5 + F.col("l_tax") * 300 > 20).alias("label"))


SCORES_SQL = """
scores as (
  select l_linenumber as run, case when l_returnflag = 'A' then 'glm' else 'rF' end as model,
    l_orderkey as patient, l_partkey as row_id,
    (l_quantity + round(l_discount * 100)) / 67 as score,
    l_quantity * 0.5 + l_tax * 300 > 20 as label
  from lineitem)
"""
