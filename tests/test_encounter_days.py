"""The features by encounter from their written matrix: the same rows, and the patients' rows can be counted on the matrix."""

import datetime as dt
import re

from kohorta.operators import aggregates
from kohorta.plans import features as fe

DAY = dt.date(2020, 1, 1)


def test_summary_counts_on_the_matrix_and_not_on_the_joined_days(spark, monkeypatch):
    rows = [(p, e, DAY + dt.timedelta(days=d), k, n, float(p + d + n)) for p in (1, 2, 3) for e in (10 * p, 10 * p + 1)
            for d in (0, 3) for n, k in enumerate("ab")]
    values = spark.createDataFrame(rows, "Patient_ID long, Encounter long, Date date, key string, n int, value double")
    members = spark.createDataFrame([(1, True, DAY + dt.timedelta(days=2)), (2, False, None), (9, True, None)], "Patient_ID long, mk boolean, d1 date")
    treated = spark.createDataFrame([(1, 10, 1)], "Patient_ID long, Encounter long, op int")
    parts, order = [(treated, ["Patient_ID", "Encounter"])], ["Date", "Encounter", "n"]
    matrix = fe.encounter_matrix(values, members, "key", order, "Date", "value", ["a", "b"])
    days = fe.encounter_days(matrix, members, parts, "Date", ["a", "b"], splits=1)
    whole = fe.encounter_features(values, members, parts, "key", order, "Date", "value", ["a", "b"])
    assert days.columns == whole.columns
    assert sorted(map(str, days.collect())) == sorted(map(str, whole.collect())) and days.count() == 8
    ids = ["Patient_ID", "mk", "d1"]
    counted = fe.encounter_patient_features(whole, ids, "Date", "d1", ["trend_a"], ["a", "op"], [], []).collect()

    def never(*_):
        raise AssertionError("the joined days were counted")
    monkeypatch.setattr(aggregates, "splits_for", never)
    given = fe.encounter_patient_features(days, ids, "Date", "d1", ["trend_a"], ["a", "op"], [], [], splits=1).collect()
    assert sorted(map(str, given)) == sorted(map(str, counted)) and len(given) == 2


def test_wide_rows_are_dealt_by_patient_only(spark):
    """Tables by encounter and by day are put beside the matrix in a written step; the plan after it deals its rows by patient alone."""
    rows = [(p, e, dt.date(2020, 1, 1 + e), "a", float(p + e)) for p in range(3) for e in range(4)] + [(1, None, dt.date(2020, 2, 1), "a", 7.0)]
    values = spark.createDataFrame(rows, "Patient_ID int, Encounter int, Date date, key string, value double")
    members = spark.createDataFrame([(p, True) for p in range(3)], "Patient_ID int, mk boolean")
    treated = spark.createDataFrame([(p, 2, 1) for p in range(3)], "Patient_ID int, Encounter int, basic int")
    ages = spark.createDataFrame([(p, 0.5) for p in range(3)], "Patient_ID int, Age double")
    days = fe.encounter_features(values, members, [(treated, ["Patient_ID", "Encounter"]), (ages, ["Patient_ID"])], "key",
                                 ["Date"], "Date", "value", ["a"], splits=1)
    plan = days._jdf.queryExecution().sparkPlan().toString() + days._jdf.queryExecution().executedPlan().toString()
    assert "basic" in plan and not re.search(r"hashpartitioning\(Patient_ID#\d+, (Encounter|Date)", plan)
    found = {(r.Patient_ID, r.Encounter): r for r in days.collect()}
    assert len(found) == 13 and all(r.Age == 0.5 and r.mk for r in found.values())
    assert {k for k, r in found.items() if r.basic == 1} == {(p, 2) for p in range(3)}
    assert found[1, None].a == 7.0 and found[1, None].active is not None
