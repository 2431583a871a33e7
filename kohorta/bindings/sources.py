"""Bindings of readers, writers, stages and record segmentation.

The raw files are written by Spark from the given tables into the shared folder and read back.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from kohorta.bindings.registry import query
from kohorta.operators.ordered import number_rows
from kohorta.operators.reshape import eav_to_record
from kohorta.operators.segment import TREATMENT_ATTRIBUTES, leading_attributes, segment_records, with_positions
from kohorta.session import drop_scratch, passing_shuffles, scratch_path
from kohorta.sources.readers import scan_catalog, scan_csv_typed, scan_fixed_width, scan_ragged_csv, union_extracts
from kohorta.sources.sinks import sink_csv, stage

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


@query("scan_catalog", " union all ".join(
    f"select '{name}' as table_name, count(*) as n_rows from {name}" for name in TABLES))
def scan_catalog_query(t):
    found = scan_catalog(t.spark, t.location)
    return union_extracts([df.groupBy().agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("table_name"), "n_rows") for name, df in found.items()])


FIXED_WIDTH = ("%-5s %-10s %-10s %-22s %-14s %-10s")
FIXED_NAMES = ["ICD", "Fallnr", "Patnr", "Nachname", "Vorname", "Gebdat"]


def _with_head(batches):
    """Three header lines before the lines of each file."""
    yield pd.DataFrame({"line": ["extract of all cases", "all wards", "ICD   Fallnr     Patnr"]})
    yield from batches


@query("scan_fixed_width", """
select 'G70.0' as "ICD", o_orderkey::varchar as "Fallnr", o_custkey::varchar as "Patnr",
  case when o_orderstatus = 'P' then null else c_name end as "Nachname", replace(c_mktsegment, 'U', 'Ü') as "Vorname",
  strftime(o_orderdate, '%d.%m.%Y') as "Gebdat" from orders join customer on o_custkey = c_custkey""")
def scan_fixed_width_query(t):
    cases = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.format_string(
        FIXED_WIDTH, F.lit("G70.0"), F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("c_name")),
        F.replace("c_mktsegment", F.lit("U"), F.lit("Ü")), F.date_format("o_orderdate", "dd.MM.yyyy")).alias("line"))
    path = scratch_path(t.spark, "fixed-width")
    (cases.mapInPandas(_with_head, "line string").write.option("encoding", "ISO-8859-1").option("sep", "\u0001")
     .option("quote", "").option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False)
     .option("emptyValue", "").csv(path))
    return scan_fixed_width(t.spark, path, FIXED_NAMES, skip=3, encoding="ISO-8859-1")


@query("scan_ragged_csv", """
select o_custkey::varchar as patient, o_orderkey::varchar as encounter, (unnest(range(len(cells))))::int as col_pos, unnest(cells) as value
from (select *, [o_orderstatus, strftime(o_orderdate, '%d%m%Y')] || string_split(o_orderpriority, ' ') as cells from orders)""")
def scan_ragged_csv_query(t):
    line = F.concat_ws(",", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"), "o_orderstatus",
                       F.date_format("o_orderdate", "ddMMyyyy"), F.replace("o_orderpriority", F.lit(" "), F.lit(",")))
    path = scratch_path(t.spark, "ragged")
    lines = t.orders.select(line.alias("line")).mapInPandas(
        lambda batches: _first_line("V1,V2", batches), "line string")
    lines.write.text(path)
    cells = scan_ragged_csv(t.spark, path, skip=1, keys=["patient", "encounter"], fill=False)
    return cells.drop("row_pos")


@query("scan_ragged_quoted", """
select o_custkey::varchar as patient, o_orderkey::varchar as encounter, (unnest(range(len(cells))))::int as col_pos, unnest(cells) as value
from (select *, [o_orderkey || ',' || o_custkey, 'a "quoted" ' || o_orderstatus] || string_split(o_orderpriority, ' ') as cells from orders)""")
def scan_ragged_quoted(t):
    """Quoted cells with the separator and with quotes inside, lines of different width, filled to the widest."""
    number = F.concat(F.lit('"'), F.col("o_orderkey").cast("string"), F.lit(","), F.col("o_custkey").cast("string"), F.lit('"'))
    said = F.concat(F.lit('"a ""quoted"" '), "o_orderstatus", F.lit('"'))
    line = F.concat_ws(",", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"), number, said,
                       F.replace("o_orderpriority", F.lit(" "), F.lit(",")))
    path = scratch_path(t.spark, "ragged")
    t.orders.select(line.alias("line")).mapInPandas(lambda batches: _first_line("V1,V2", batches), "line string").write.text(path)
    cells = scan_ragged_csv(t.spark, path, skip=1, keys=["patient", "encounter"], fill=True)
    return cells.where("value is not null").drop("row_pos")  # without the cells that only fill


def _first_line(head, batches):
    yield pd.DataFrame({"line": [head]})
    yield from batches


@query("scan_csv_typed", "select p_partkey, replace(p_name, 'e', 'é') as p_name, p_size, p_retailprice from part")
def scan_csv_typed_query(t):
    path = scratch_path(t.spark, "typed-csv")
    sink_csv(t.part.withColumn("p_name", F.replace("p_name", F.lit("e"), F.lit("é"))), path, encoding="ISO-8859-1")
    return scan_csv_typed(
        t.spark, path, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
        drop=("p_brand", "p_type"), encoding="ISO-8859-1")


@query("union_extracts", "select o_orderkey, o_custkey, o_orderstatus, case when o_orderstatus <> 'P' then o_totalprice end as o_totalprice from orders")
def union_extracts_query(t):
    wards = [t.orders.where(F.col("o_orderstatus") == s).select("o_orderkey", "o_custkey", "o_orderstatus", *(
        [] if s == "P" else ["o_totalprice"])) for s in ("O", "F", "P")]
    return union_extracts(wards)


@query("sink_csv", "select l_returnflag, l_linestatus, count(*) as cnt, round(sum(l_quantity), 2) as qty from lineitem group by all")
def sink_csv_query(t):
    path = scratch_path(t.spark, "result-csv")
    result = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("cnt"), F.round(F.sum("l_quantity"), 2).alias("qty"))
    sink_csv(result, path)
    return t.spark.read.schema("l_returnflag string, l_linestatus string, cnt bigint, qty double").option(
        "header", True).csv(path)


@query("stage_checkpoint", "select user_id, event_type, count(*) as cnt, round(sum(value), 4) as total from events group by all")
def stage_query(t):
    path = scratch_path(t.spark, "stage")

    def build():
        return t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("cnt"),
                                                             F.round(F.sum("value"), 4).alias("total"))
    stage(t.spark, path, build)
    return stage(t.spark, path, build)


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
              "l_returnflag", "l_linestatus", "l_shipdate"]


def token_pieces(t):
    """Tokens of every order in reading order, a piece a row: six header values, then per line item a lab record, a
    junk token, a treatment record and another junk token."""
    head = t.orders.select(
        F.col("o_custkey").alias("patient"), F.col("o_orderkey").alias("encounter"), F.lit(0).cast("bigint").alias("piece"),
        F.array(
            F.date_format("o_orderdate", "ddMMyyyy"), F.date_format(F.date_add("o_orderdate", 3), "ddMMyyyy"),
            F.lit("MNEURO"), F.lit("WARD"), F.when(F.col("o_orderstatus") == "F", "stat").otherwise("amb"),
            F.col("o_orderpriority")).alias("value"))
    lines = number_rows(t.lineitem, ["l_orderkey"], LINE_ORDER, "piece").withColumnRenamed("l_orderkey", "o_orderkey")
    shipped = F.date_format("l_shipdate", "dMMyyyy")
    body = lines.join(t.orders.select("o_custkey", "o_orderkey"), "o_orderkey").select(
        F.col("o_custkey").alias("patient"), F.col("o_orderkey").alias("encounter"), "piece",
        F.array(
            F.concat(F.lit("L_"), F.col("l_partkey").cast("string")), F.concat(F.lit("K"), (F.col("l_suppkey") % 7).cast("string")),
            F.col("l_quantity").cast("int").cast("string"), F.lit("mmol"), shipped, F.lit("000000"), F.lit("2951-2"),
            F.lit("1"), F.lit("40"), F.lit("x"), F.lit("OPS"), F.concat(F.lit("8-"), F.col("l_suppkey").cast("string")),
            F.concat(F.lit("Treatment "), F.col("l_returnflag")), shipped, F.lit("0"), F.lit("y")).alias("value"))
    return head.unionByName(body)


PIECE_TOKENS, HEAD_TOKENS = 16, 6


def numbered_tokens(t):
    """Pieces with the dense position of their first token, staged like any raw extract before it is cut into records. Every
    piece of the stream has a fixed number of tokens, so the position is arithmetic."""
    pos = F.when(F.col("piece") == 0, 0).otherwise(HEAD_TOKENS + (F.col("piece") - 1) * PIECE_TOKENS)
    path = scratch_path(t.spark, "tokens")
    return stage(t.spark, path, lambda: token_pieces(t).select("patient", "encounter", pos.alias("pos"), "value"))


RECORDS_SQL = """
with numbered as (select o_custkey as patient, l_orderkey as encounter, l_partkey, l_suppkey, l_quantity, l_returnflag, l_shipdate,
  row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount,
    l_tax, l_returnflag, l_linestatus, l_shipdate) as n from lineitem join orders on l_orderkey = o_orderkey),
pieces as (
  select patient, encounter, 2 * n - 1 as rec_no, 'lab' as rec_type,
    ['LeistID', 'Kat', 'Value', 'Unit', 'Date', 'Time', 'LOINC', 'range_low', 'range_high'] as attrs,
    ['L_' || l_partkey, 'K' || l_suppkey % 7, l_quantity::int::varchar, 'mmol', strftime(l_shipdate, '%-d%m%Y'), '000000', '2951-2', '1', '40'] as vals
  from numbered union all
  select patient, encounter, 2 * n, 'treatment', ['Type', 'Code', 'Descr', 'Date', 'Time'],
    ['OPS', '8-' || l_suppkey, 'Treatment ' || l_returnflag, strftime(l_shipdate, '%-d%m%Y'), '0'] from numbered)
select patient, encounter, rec_no, rec_type, unnest(attrs) as attr, (unnest(range(len(attrs))))::int as seq, unnest(vals) as value from pieces"""


@query("segment_records", RECORDS_SQL)
def segment_records_query(t):
    return segment_records(numbered_tokens(t), ["patient", "encounter"])


@query("raw_extract_records", RECORDS_SQL.replace("l_quantity::int::varchar", "l_quantity::int::varchar || ',5'"))
def raw_extract_records(t):
    """From raw files to records: quoted lines of uneven width with decimal commas are written, read with filling,
    ordered by (column, row), and cut into records."""
    keys = ["patient", "encounter"]
    pieces = token_pieces(t).withColumn("value", F.transform("value", lambda v, i: F.when(
        (F.col("piece") > 0) & (i == 2), F.concat(v, F.lit(",5"))).otherwise(v)))
    runs = F.collect_list(F.struct("piece", "value"))
    tokens = F.sort_array(F.flatten(F.transform(runs, lambda r: F.transform(r["value"], lambda v, i: F.struct(
        r["piece"].alias("piece"), i.alias("at"), v.alias("value"))))))
    cells = F.transform(tokens, lambda x: F.concat(
        F.lit('"'), F.replace(x["value"], F.lit('"'), F.lit('""')), F.lit('"')))
    lines = pieces.groupBy(*keys).agg(F.array_join(cells, ",").alias("cells")).select(
        F.concat_ws(",", *[F.col(k).cast("string") for k in keys], "cells").alias("line"))
    path = scratch_path(t.spark, "raw")
    with passing_shuffles(t.spark):
        lines.mapInPandas(lambda batches: _first_line("V1,V2", batches), "line string").write.text(path, compression="gzip")
    read = scan_ragged_csv(t.spark, path, skip=1, keys=keys, fill=True, runs=True)  # cells that only fill get no position
    placed = stage(t.spark, scratch_path(t.spark, "raw-tokens"), lambda: with_positions(read, keys, ["col_pos", "row_pos"]).select(
        *[F.col(k).cast("bigint").alias(k) for k in keys], "pos", "value"))
    drop_scratch(t.spark, path)
    return segment_records(placed, keys)


@query("header_attributes", """
select o_custkey as patient, o_orderkey as encounter,
  unnest(['admission', 'discharge', 'oe_admission', 'oe_discharge', 'encounter_type', 'DRG_Code_Aufn']) as attr,
  unnest([strftime(o_orderdate, '%d%m%Y'), strftime(o_orderdate + interval 3 day, '%d%m%Y'), 'MNEURO', 'WARD',
    case when o_orderstatus = 'F' then 'stat' else 'amb' end, o_orderpriority]) as value
from orders""")
def header_attributes_query(t):
    return leading_attributes(token_pieces(t), ["patient", "encounter"], ["piece"])


@query("treatment_records", """
select o_custkey as patient, l_orderkey as encounter, 'OPS' as "Type", '8-' || l_suppkey as "Code", 'Treatment ' || l_returnflag as "Descr",
  strftime(l_shipdate, '%-d%m%Y') as "Date", '0' as "Time" from lineitem join orders on l_orderkey = o_orderkey""")
def treatment_records(t):
    records = segment_records(numbered_tokens(t), ["patient", "encounter"]).where("rec_type = 'treatment'")
    return eav_to_record(records, ["patient", "encounter", "rec_no"], "attr", "value",
                         {a: a for a in TREATMENT_ATTRIBUTES}).drop("rec_no")
