"""Flags of mean scores do not depend on the order of the rows."""

import itertools

from kohorta.operators import evaluate as ev


def test_a_mean_on_the_threshold_reaches_it_in_every_order(spark):
    orders = set(itertools.permutations([60, 57, 58, 45, 48]))  # 268 of 5 * 67 is 0.8
    rows = [(no, k / 67) for no, order in enumerate(orders) for k in order] + [(-1, 0.8 - 1e-9)]
    one = spark.createDataFrame(rows, "patient long, score double").coalesce(1)  # keeps the order
    got = {r.patient: r for r in ev.patient_score_summary(one, ["patient"], "score").collect()}
    assert not got.pop(-1).threshold_08
    assert all(r.threshold_08 for r in got.values())
