import datetime as dt

from pyspark.sql import functions as F

from kohorta.functions import columns, dates, numeric, terms, text
from kohorta.plans.measurements import default_ranges, nonneg_numeric


def values(spark, rows, schema, column):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(column.alias("o")).collect()]


def test_pad_left_never_cuts(spark):
    assert values(spark, [("7",), ("123456",), (None,)], "x string", text.pad_left(F.col("x"), 4)) == [
        "0007", "123456", None]


def test_regex_on_missing_and_empty_dictionary(spark):
    rows = [("Prednisolon 5",), (None,), ("x",)]
    assert values(spark, rows, "x string", text.any_regex(F.col("x"), ["PREDNI"])) == [True, False, False]
    assert values(spark, rows, "x string", text.any_regex(F.col("x"), [])) == [False, False, False]
    assert values(spark, [("a+b",)], "x string", text.any_regex(F.col("x"), ["A+B"], literal=True)) == [True]


def test_dates_with_lost_zero_and_bad_days(spark):
    rows = [("1022020",), ("31022020",), ("",), (None,), ("29022020",)]
    assert values(spark, rows, "x string", dates.parse_dmy(F.col("x"))) == [
        dt.date(2020, 2, 1), None, None, None, dt.date(2020, 2, 29)]


def test_month_arithmetic_clamps_or_is_missing(spark):
    rows = [(dt.date(2021, 8, 31),), (dt.date(2021, 1, 15),)]
    assert values(spark, rows, "x date", dates.add_months(F.col("x"), 6)) == [dt.date(2022, 2, 28), dt.date(2021, 7, 15)]
    assert values(spark, rows, "x date", dates.add_months(F.col("x"), 6, strict=True)) == [None, dt.date(2021, 7, 15)]


def test_if_else_keeps_missing(spark):
    assert values(spark, [(None,), (True,), (False,)], "x boolean", numeric.if_else(F.col("x"), F.lit(1), F.lit(2))) == [
        None, 1, 2]


def test_clip_keeps_missing(spark):
    assert values(spark, [(None,), (2.0,), (-3.0,)], "x double", numeric.at_most_zero(F.col("x"))) == [None, 0.0, -3.0]
    assert values(spark, [(None,), (2.0,), (-3.0,)], "x double", numeric.at_least_zero(F.col("x"))) == [None, 2.0, 0.0]


def test_half_even_steps_and_zero_width_range(spark):
    assert values(spark, [(0.125,), (0.375,)], "x double", numeric.round_to_step(F.col("x"), 4)) == [0.0, 0.5]
    assert values(spark, [(1.0,)], "x double", numeric.range_normalize(F.col("x"), F.lit(2.0), F.lit(2.0))) == [None]


def test_non_finite(spark):
    rows = [(float("inf"),), (float("-inf"),), (float("nan"),), (1.5,), (None,)]
    assert values(spark, rows, "x double", numeric.finite_or_null(F.col("x"))) == [None, None, None, 1.5, None]


def test_numbers_in_text(spark):
    rows = [("000000",), ("0.0",), ("1d",), ("1e3",), ("",), (None,), ("0x0",), ("-.5",)]
    assert values(spark, rows, "x string", text.is_zero(F.col("x"))) == [True, True, False, False, False, False, False, False]
    assert values(spark, rows, "x string", text.to_number(F.col("x"))) == [0.0, 0.0, None, 1000.0, None, None, None, -0.5]
    assert values(spark, [("3,5",), ("<1",)], "x string", text.decimal_comma(F.col("x"))) == [3.5, None]


def test_nonneg_numeric_with_and_without_comma(spark):
    df = spark.createDataFrame([("3,5",), ("-1",), ("2",), ("neg",)], "v string")
    assert sorted(r.v for r in nonneg_numeric(df, "v").collect()) == [2.0, 3.5]
    assert [r.v for r in nonneg_numeric(df, "v", comma=False).collect()] == [2.0]


def test_ordinal_code(spark):
    rows = [("Titin", "stark positiv"), ("Titin", "grenzwertig"), ("Na", "positiv"), (None, "7")]
    assert values(spark, rows, "k string, v string", text.ordinal_code(F.col("k"), F.col("v"))) == ["2", "", "positiv", "7"]


def test_default_ranges(spark):
    limits = spark.createDataFrame([("Na", 1.0, 9.0, 2.0, 8.0, 0.0, 5.0), ("Titin_Ak", 1., 1., 1., 1., 1., 1.)],
                                   "key string, women_low double, women_high double, men_low double, men_high double, "
                                   "child_low double, child_high double")
    rows = spark.createDataFrame([
        (1, "Na", "w", "3", "4,5"), (2, "Na", "m", "7", "7"), (3, "Na", "x", "", None), (4, "Na", "w", "3", None),
        (5, "Titin_Ak", "w", "8", "9")], "id int, key string, sex string, low string, high string")
    got = {r.id: (r.low, r.high) for r in default_ranges(rows, limits).collect()}
    # equal limits, blank limits and a test against a missing limit all fall back to the lookup
    assert got == {1: (3.0, 4.5), 2: (2.0, 7.0), 3: (0.0, 5.0), 4: (1.0, 9.0), 5: (0.0, 2.0)}


def test_split_ddmmyyyy(spark):
    df = spark.createDataFrame([("Date", "3102019"), ("Unit", "mmol"), ("Date", "13102019")], "a string, v string")
    got = df.select(*[c.alias(n) for n, c in dates.split_ddmmyyyy(F.col("a"), F.col("v")).items()]).collect()
    assert [tuple(r) for r in got] == [("2019", "10", "03"), ("", "", ""), ("2019", "10", "13")]


def test_sanitize_and_pattern(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`1 a` int, `b-c` int, trend_x int")
    assert columns.sanitize_columns(df).columns == ["X1.a", "b.c", "trend_x"]
    assert columns.select_by_pattern(df, contains="trend", drop=True).columns == ["1 a", "b-c"]


def test_interpretation_uses_the_sign(spark):
    df = spark.createDataFrame([("cnt_amb", -1.0), ("Na_mean", 2.0), ("trend_abs_Na_max", 1.0)], "t string, e double")
    got = [r[0] for r in df.select(terms.interpret_term(F.col("t"), F.col("e"))).collect()]
    assert "anti-correlation" in got[0] and "amb shows a negative" in got[0]
    assert got[1].startswith("The mean value of Na shows a positive")
    assert got[2].startswith("The absolute max trend of Na shows a")


def test_unit_hash_ignores_partitioning(spark):
    df = spark.range(1000)
    a = df.repartition(7).select("id", numeric.unit_hash(F.col("id"), seed=3).alias("u"))
    b = df.coalesce(1).select("id", numeric.unit_hash(F.col("id"), seed=3).alias("u"))
    assert a.exceptAll(b).isEmpty()
    low, high, mean = a.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= low and high < 1 and abs(mean - 0.5) < 0.05
