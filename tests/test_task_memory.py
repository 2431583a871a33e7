"""Memory of one task: windows are dealt by rows, a pivot keeps one row per id."""

import re

from kohorta.operators import ordered as od
from kohorta.operators.reshape import pivot_onehot
from pyspark.sql import functions as F


def test_many_rows_are_dealt_into_more_tasks_than_cores(spark, monkeypatch):
    rows = spark.range(400).select((F.col("id") % 50).alias("key"), F.col("id").alias("at"))
    rows = rows.unionByName(spark.createDataFrame([(None, 1), (None, 2)], "key long, at long"))
    plain = sorted(map(tuple, od.number_rows(rows, ["key"], ["at"]).collect()), key=str)
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(od, "ROWS_PER_SORT", 402 // (2 * cores))
    dealt = od.number_rows(rows, ["key"], ["at"])
    assert dealt.rdd.getNumPartitions() >= 2 * cores
    assert sorted(map(tuple, dealt.collect()), key=str) == plain


def test_one_hot_groups_by_ids_alone(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "z"), (2, None), (None, "b")], "id long, c string")
    out = pivot_onehot(rows, ["id"], "c", ["a", "b"])
    assert sorted(map(tuple, out.collect()), key=str) == [(1, 1, 1), (2, 0, 0), (None, 0, 1)]
    assert out.dtypes == [("id", "bigint"), ("a", "int"), ("b", "int")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Aggregate \[", plan)) == 1
