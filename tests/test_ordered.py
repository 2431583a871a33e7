"""The split form of every ordered operator must equal the plain one, hot keys and ties included."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kohorta.operators import ordered as od
from kohorta.operators.temporal import active_in_window, lag_trend, locf_marker


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    n = 1200
    key = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 40, n))
    df = pd.DataFrame({"key": key, "at": rng.integers(0, 300, n), "id": np.arange(n),
                       "v": np.round(rng.normal(size=n), 3)})
    df["at"] = df["at"].astype("Int64").mask(rng.random(n) < 0.02)
    df["v"] = df["v"].mask(rng.random(n) < 0.4)
    rows = [(None if k == 3 else int(k), None if pd.isna(a) else int(a), int(i), None if pd.isna(v) else float(v))
            for k, a, i, v in df.itertuples(index=False)]
    return spark.createDataFrame(rows, "key int, at int, id int, v double").cache()


def same(a, b):
    a = a.select(*sorted(a.columns))
    b = b.select(*sorted(b.columns))
    left = sorted(map(str, (tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in a.collect())))
    right = sorted(map(str, (tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in b.collect())))
    assert left == right and left


@pytest.mark.parametrize("splits", [2, 7])
@pytest.mark.parametrize("keys", [["key"], []])
def test_running_sums(skewed, splits, keys):
    for descending in (False, True):
        sums = {"s": F.col("v"), "n": F.lit(1)}
        same(od.running_sums(skewed, keys, ["at", "id"], sums, descending, splits=splits),
             od.running_sums(skewed, keys, ["at", "id"], sums, descending, splits=1))


def test_previous_values(skewed):
    cols = {"v": "pv", "at": "pa"}
    same(od.previous_values(skewed, ["key"], ["at", "id"], cols, splits=6),
         od.previous_values(skewed, ["key"], ["at", "id"], cols, splits=1))


@pytest.mark.parametrize("descending", [False, True])
def test_fill_forward(skewed, descending):
    same(od.fill_forward(skewed, ["key"], ["at", "id"], ["v"], descending, splits=9),
         od.fill_forward(skewed, ["key"], ["at", "id"], ["v"], descending, splits=1))


def test_quantiles(skewed):
    probs = {"a": 0.0, "b": 0.025, "m": 0.5, "c": 0.9, "d": 1.0}
    for keys in (["key"], []):
        same(od.quantiles(skewed, keys, "v", probs, splits=5), od.quantiles(skewed, keys, "v", probs, splits=1))


def test_first_rows_and_top_rows(spark, skewed):
    got = {r.key: r.id for r in od.first_rows(skewed, ["key"], ["at", "id"]).collect()}
    for key, rows in skewed.toPandas().groupby("key", dropna=False):
        rows = rows.sort_values(["at", "id"], na_position="first")
        assert got[None if pd.isna(key) else key] == rows["id"].iloc[0]
    top = od.top_rows(skewed, ["key"], [F.col("id")], 3).groupBy("key").count()
    assert top.where("count > 3").isEmpty()


def test_a_hot_key_is_split(skewed, monkeypatch):
    monkeypatch.setattr(od, "ROWS_PER_TASK", 100)
    assert [r.key for r in od.heavy_keys(skewed, ["key"]).collect()] == [0]
    assert od.splits_for(skewed, ["key"]) == 2 and od.splits_for(skewed, ["key"], 10_000) == 1
    sums = {"s": F.col("v"), "n": F.lit(1)}
    same(od.running_sums(skewed, ["key"], ["at", "id"], sums), od.running_sums(skewed, ["key"], ["at", "id"], sums, splits=1))
    same(od.previous_values(skewed, ["key"], ["at", "id"], {"v": "pv"}),
         od.previous_values(skewed, ["key"], ["at", "id"], {"v": "pv"}, splits=1))
    same(od.fill_forward(skewed, ["key"], ["at", "id"], ["v"]), od.fill_forward(skewed, ["key"], ["at", "id"], ["v"], splits=1))
    parts = od.add_ranges(skewed.where("key = 0"), ["key"], ["at", "id"], 12).groupBy("key", od.RANGE).count()
    assert parts.count() > 6 and parts.agg(F.max("count")).first()[0] < 130


def test_no_single_task_without_a_key(skewed):
    """Ordering a whole table never brings it to one task."""
    for df in (od.running_sums(skewed, [], ["at", "id"], {"s": F.col("v")}), od.number_rows(skewed, [], ["v", "id"]),
               od.previous_values(skewed, [], ["at", "id"], {"v": "pv"}), od.fill_forward(skewed, [], ["at", "id"], ["v"])):
        assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("order", [["e"], ["t", "e"], ["s"], ["t", "u", "e"]])
@pytest.mark.parametrize("keys", [["p"], []])
def test_any_order_type_is_split(spark, order, keys):
    """Text, struct and date orders, and ties of two columns that only the third decides."""
    rows = [("hot" if i % 4 else f"q{i % 5}", f"e{(i * 7919) % 1000:04d}", i % 2, 7, (i % 3, f"x{(i * 31) % 1000}"), float(i % 13))
            for i in range(1000)]
    df = spark.createDataFrame(rows, "p string, e string, t int, u int, s struct<a: int, b: string>, v double")
    same(od.number_rows(df, keys, order, splits=2), od.number_rows(df, keys, order, splits=1))
    same(od.running_sums(df, keys, order, {"c": F.col("v")}, True, splits=9),
         od.running_sums(df, keys, order, {"c": F.col("v")}, True, splits=1))


def test_lag_trend_first_row_and_same_day(spark):
    rows = [("p", "2020-01-01", 1, 5.0), ("p", "2020-01-01", 2, 5.0), ("p", "2020-01-01", 3, 9.0),
            ("p", "2020-01-03", 4, 5.0), ("q", "2020-01-01", 5, None), ("q", "2020-01-02", 6, 2.0)]
    df = spark.createDataFrame(rows, "p string, d string, id int, v double").withColumn("d", F.to_date("d"))
    for splits in (1, 3):
        got = {r.id: (r.trend_abs, r.trend) for r in lag_trend(df, ["p"], ["d", "id"], "d", "v", splits).collect()}
        assert got == {1: (0.0, 0.0), 2: (0.0, 0.0), 4: (-4.0, -2.0), 5: (0.0, 0.0), 6: (0.0, 0.0)}


def test_locf_marker_numbers_records(spark):
    rows = [("e", 0, "junk"), ("e", 1, "LeistID"), ("e", 2, "Value"), ("e", 3, "LeistID"), ("e", 4, "Date")]
    df = spark.createDataFrame(rows, "enc string, seq int, attr string")
    for splits in (1, 2):
        got = {r.seq: r.lab_id for r in locf_marker(df, ["enc"], ["seq"], "attr", "LeistID", "enc", splits=splits).collect()}
        assert got == {0: None, 1: "e_1", 2: "e_1", 3: "e_2", 4: "e_2"}


def test_active_in_window(spark):
    df = spark.createDataFrame([("p", "2020-01-01"), ("p", "2020-01-01"), ("p", "2020-03-01"), ("p", "2020-07-01")],
                               "p string, d string").withColumn("d", F.to_date("d"))
    got = [(str(r.d), r.n) for r in active_in_window(df, "p", "d", "n", scale=1.0).orderBy("d").collect()]
    assert got == [("2020-01-01", 1.0), ("2020-03-01", 2.0), ("2020-07-01", 2.0), ("2020-09-01", 1.0), ("2021-01-01", 0.0)]


def test_a_hot_day_of_a_hot_key_is_split_too(spark):
    rows = [("hot" if i % 3 else f"k{i % 50}", 7 if i % 5 else i % 40, i, float(i % 11)) for i in range(1500)]
    df = spark.createDataFrame(rows, "key string, at int, id int, v double")
    parts = od.add_ranges(df, ["key"], ["at", "id"], 10).groupBy("key", od.RANGE).count()
    assert parts.agg(F.max("count")).first()[0] < 250
    sums = {"s": F.col("v")}
    for descending in (False, True):
        same(od.running_sums(df, ["key"], ["at", "id"], sums, descending, splits=10),
             od.running_sums(df, ["key"], ["at", "id"], sums, descending, splits=1))
    same(od.previous_values(df, ["key"], ["at", "id"], {"v": "pv"}, splits=10),
         od.previous_values(df, ["key"], ["at", "id"], {"v": "pv"}, splits=1))


def test_folds_are_even_at_every_size(spark):
    from kohorta.operators.models import with_folds
    for n in (7, 1001, 30_000):
        sizes = [r["count"] for r in with_folds(spark.range(n).withColumnRenamed("id", "p"), "p", 10, 3).groupBy("fold").count().collect()]
        assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
