"""What the measurement table does per row: patterns are the dear part, and the optimizer repeats what filters and joins use."""

from kohorta.functions import text
from kohorta.plans.measurements import measurement_table
from pyspark.sql import functions as F

ROWS = [(1, "w", "Kat", "Pro B_absolut"), (1, "w", "Value", "3,5"), (1, "w", "Date", "1022020"), (1, "w", "range_low", "1,0"),
        (1, "w", "range_high", "6,0"), (2, "m", "Kat", "Größe°"), (2, "m", "Value", "-1"), (3, "x", "Kat", "Pro B"),
        (3, "x", "Value", "abc")]
LIMITS = "key string, women_low double, women_high double, men_low double, men_high double, child_low double, child_high double"


def test_measurements_replace_by_pattern_once_a_key(spark):
    eav = spark.createDataFrame(ROWS, "rec long, sex string, attr string, value string")
    limits = spark.createDataFrame([("Pro_B", 0.0, 9.0, 0.0, 9.0, 0.0, 9.0)], LIMITS)
    out = measurement_table(eav, ["rec", "sex"], limits)
    row, = out.collect()
    assert (row.key, row.value, row.low, row.high, row.normalized, str(row.day)) == ("Pro_B", 3.5, 1.0, 6.0, 0.5, "2020-02-01")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 2  # the key, and the filter on it


def test_keys_and_commas_as_before(spark):
    rows = [("a b_37°C_absolut ö°", "1,5"), ("_x37°y", "1,,5"), (None, None), ("ö ö", ",5"), ("", "5,")]
    df = spark.createDataFrame(rows, "k string, v string")
    got = [tuple(r) for r in df.select(text.normalize_key(F.col("k")), text.decimal_comma(F.col("v"))).collect()]
    old = F.col("k")
    for pattern, replacement in ((" ", "_"), ("_.37°.|_absolut", ""), ("°", ""), ("ö", "?")):
        old = F.regexp_replace(old, pattern, replacement)
    assert [g[0] for g in got] == [r[0] for r in df.select(old).collect()]
    assert [g[1] for g in got] == [r[0] for r in df.select(text.to_number(F.regexp_replace("v", ",", "."))).collect()]
