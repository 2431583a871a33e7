import pytest
from pyspark.sql import functions as F

from kohorta.operators.joins import join_star, ordered_pairs


def test_star_refuses_a_doubled_key(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    part = spark.createDataFrame([(1, 10), (3, 30)], "k int, w int")
    assert sorted((r.k, r.w) for r in join_star(base, [(part, ["k"])]).collect()) == [(1, 10), (2, None)]
    doubled = part.union(part.where("k = 3"))
    with pytest.raises(ValueError):
        join_star(base, [(part, ["k"]), (doubled.withColumnRenamed("w", "x"), ["k"])])


@pytest.mark.parametrize("tile", [1, 7, 1000])
def test_pairs_meet_in_tiles(spark, tile):
    names = spark.range(40).select(F.format_string("n%02d", "id").alias("name"))
    got = [tuple(r) for r in ordered_pairs(names, "name", tile=tile).collect()]
    every = [f"n{i:02d}" for i in range(40)]
    assert sorted(got) == [(a, b) for a in every for b in every if a < b]
    some = names.where("name < 'n05'")
    assert ordered_pairs(names, "name", some, tile).count() == 10
    assert ordered_pairs(names.limit(0), "name").collect() == []


def test_star_checks_keys_while_joining(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    part = spark.createDataFrame([(1, 10), (3, 30), (None, 5), (None, 6)], "k int, w int")
    got = join_star(base, [(part, ["k"])], "plan")
    assert sorted((r.v, r.w) for r in got.collect()) == [("a", 10), ("b", None), ("c", None)]
    two = spark.createDataFrame([(1, 1, 7), (1, 2, 8)], "k int, n int, x int")
    assert join_star(base.withColumn("n", F.lit(2)), [(two, ["k", "n"])], "plan").where("x = 8").count() == 1
    with pytest.raises(Exception, match=r'not unique in .*"k":1'):
        join_star(base, [(two, ["k"])], "plan").collect()
    assert join_star(base, [(part.limit(0), ["k"])], "plan").count() == 3
