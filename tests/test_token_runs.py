"""Tokens that travel in arrays are cut into the same records as tokens one a row."""

from pyspark.sql import functions as F

from kohorta.operators.segment import leading_attributes, segment_records


def test_runs_of_tokens_give_the_same_records(spark):
    body = ["L_1", "K", "3", "mmol", "1012020", "000000", "2951-2", "1", "40", "x", "OPS", "8-12", "Treatment A", "1012020", "0", "y"]
    value = F.element_at(F.array(*[F.lit(v) for v in body]), (F.col("pos") % 16 + 1).cast("int"))
    tokens = spark.range(16 * 9).select((F.lit(1)).alias("key"), F.col("id").alias("pos"), F.lit(None).cast("string").alias("value"))
    tokens = tokens.withColumn("value", value)
    tokens = tokens.unionByName(tokens.where("pos < 40 and pos % 16 <> 3").withColumn("key", F.lit(2)).unionByName(
        tokens.where("pos < 32").withColumn("key", F.lit(2))))  # some positions come twice
    runs = tokens.withColumn("no", F.expr("row_number() over (partition by key, pos order by value)")).groupBy(
        "key", "no", F.expr("pos div 16").alias("p")).agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("t"))
    runs = runs.where("size(t) = t[size(t) - 1].pos - t[0].pos + 1").select(
        "key", F.expr("t[0].pos").alias("pos"), F.col("t.value").alias("value"))
    same = runs.select("key", F.posexplode("value").alias("i", "v"), "pos").select("key", (F.col("pos") + F.col("i")).alias("pos"), F.col("v").alias("value"))
    for size in (9, 16, 50, 1024):
        got = sorted(map(tuple, segment_records(runs, ["key"], chunk_size=size).collect()))
        assert got and got == sorted(map(tuple, segment_records(same, ["key"], chunk_size=size).collect()))


def test_leading_tokens_of_runs(spark):
    rows = [(1, 1, ["c", "d"]), (1, 0, ["a", "b"]), (1, 2, ["e"] * 20), (2, 0, ["x"]), (2, 0, ["x"]), (3, 5, ["q", None])]
    got = {tuple(r) for r in leading_attributes(spark.createDataFrame(rows, "k int, piece int, value array<string>"), ["k"], ["piece"],
                                                ["n0", "n1", "n2", "n3", "n4"]).collect()}
    assert got == {(1, f"n{i}", v) for i, v in enumerate("abcde")} | {(2, "n0", "x"), (2, "n1", "x"), (3, "n0", "q"), (3, "n1", None)}
