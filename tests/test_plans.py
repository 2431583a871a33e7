import random
import re

import pytest
from pyspark.sql import functions as F

from kohorta.operators.joins import within_after
from kohorta.plans import features as fe
from kohorta.plans import medication as me
from kohorta.plans.measurements import measurement_table


def test_interval_after_any_event(spark):
    events = spark.createDataFrame([("p", "e1", "2020-02-29"), ("p", "e2", "2020-08-31"), ("p", "e3", "2021-01-01"),
                                    ("q", "e4", "2020-03-01")], "p string, e string, d string").withColumn("d", F.to_date("d"))
    anchors = spark.createDataFrame([("p", "2020-02-29", None, "2021-01-02"), ("q", None, None, None)],
                                    "p string, a string, b string, c string")
    anchors = anchors.select("p", *[F.to_date(c).alias(c) for c in "abc"])
    got = {r.e for r in within_after(events, anchors, "p", "d", ["a", "b", "c"], 6, ["e"]).collect()}
    assert got == {"e1"}


def test_classes_are_filled_from_known_drugs(spark):
    rows = [("p", 1, "Predni", "Corticoid"), ("p", 2, "PREDNI 5 mg", None), ("p", 3, "Azathioprin", "Immunsupressivum"),
            ("p", 4, "unknown", ""), ("q", 5, "azathioprin forte", ""), ("q", 6, None, None)]
    df = spark.createDataFrame(rows, "p string, at int, Drug string, Klasse string")
    for options in ({}, {"dictionary_rows": 1}, {"literal": True}, {"literal": True, "dictionary_rows": 1}):
        got = {r.at: r.Klasse for r in me.fill_classes(df, **options).collect()}
        assert got == {1: "Corticoid", 2: "Corticoid", 3: "Immunsupressivum", 4: "", 5: "Immunsupressivum", 6: ""}
    events = spark.createDataFrame([("p", 3), ("q", None)], "p string, event int")
    out = {r.p: r for r in me.medication_classes(df, events, "p", "at", "event", "at").collect()}
    assert out["p"].Wirkstoffe == "Corticoid" and out["p"].Immunsupressivum == 0
    assert out["q"].Immunsupressivum == 1


def test_stays_and_paths(spark):
    rows = [("p", "e1", "01012020", "03012020", "stat"), ("p", "e2", "05012020", None, "amb"), ("p", "e3", "1022020", "02022020", "stat")]
    eav = [(p, e, a, v) for p, e, adm, dis, kind in rows for a, v in
           (("admission", adm), ("discharge", dis), ("encounter_type", kind), ("oe_admission", "A"), ("oe_discharge", kind))]
    df = spark.createDataFrame(eav, "Patient_ID string, Encounter string, attr string, value string")
    got = {r.Encounter: (r.cnt_stat, r.cnt_amb) for r in fe.stay_counts(df).collect()}
    assert got == {"e1": (1, 0), "e3": (2, 0)}
    paths = fe.care_paths(df, ["A, stat", "A, amb"]).first()
    assert round(paths["A, stat"], 6) == 0.666667 and round(paths["A, amb"], 6) == 0.333333


def test_measurements_from_attribute_rows(spark):
    rec = [("Kat", "Haematokrit"), ("Value", "0,42"), ("Date", "3102019"), ("range_low", "0,4"), ("range_high", "0,5")]
    bad = [("Kat", "Natrium"), ("Value", "hämolytisch"), ("Date", "3102019"), ("range_low", "1"), ("range_high", "2")]
    eav = spark.createDataFrame([("e", i, "w", a, v) for i, r in enumerate((rec, bad)) for a, v in r],
                                "Encounter string, rec int, sex string, attr string, value string")
    limits = spark.createDataFrame([(k, 1., 2., 1., 2., 1., 2.) for k in ("Haematokrit", "Natrium")],
                                   "key string, women_low double, women_high double, men_low double, men_high double, child_low double, child_high double")
    got = measurement_table(eav, ["Encounter", "rec", "sex"], limits).collect()
    assert len(got) == 1 and got[0].value == 42.0 and got[0].low == 40.0 and round(got[0].normalized, 9) == 0.2
    assert str(got[0].day) == "2019-10-03" and got[0].quarter == "4"


def test_features_by_encounter_and_patient(spark):
    values = spark.createDataFrame(
        [("p", 1, "2020-01-01", "a", 1.0, 1), ("p", 1, "2020-01-01", "a", 3.0, 2), ("p", 2, "2020-01-03", "b", 5.0, 3),
         ("p", 3, "2020-01-03", "a", 7.0, 4), ("p", 4, "2020-02-01", "a", 99.0, 5), ("x", 9, "2020-01-01", "a", 1.0, 6)],
        "Patient_ID string, Encounter int, Date string, key string, value double, n int").withColumn("Date", F.to_date("Date"))
    members = spark.createDataFrame([("p", True, "2020-02-01"), ("q", False, None)], "Patient_ID string, mk boolean, d1 string").withColumn("d1", F.to_date("d1"))
    treated = spark.createDataFrame([("p", 2, 1), ("p", 8, 1)], "Patient_ID string, Encounter int, op int")
    ages = spark.createDataFrame([("p", 0.4), ("q", 0.5)], "Patient_ID string, Age double")
    dated = fe.encounter_features(values, members, [(treated, ["Patient_ID", "Encounter"])], "key", ["Date", "n"], "Date", "value", ["a", "b"])
    got = {r.Encounter: r for r in dated.collect()}
    assert sorted(got) == [1, 2, 3, 4]  # a patient outside of the cohort has no row
    assert (got[1].a, got[1].b, got[1].op) == (2.0, None, None)
    assert (got[2].a, got[2].b, got[2].op, got[2].trend_abs_b) == (2.0, 5.0, 1, 0.0)
    assert (got[3].a, got[3].b, got[3].trend_abs_a, got[3].trend_a) == (7.0, 5.0, 4.0, 2.0)
    assert [round(got[e].active * 365) for e in (1, 2, 3, 4)] == [1, 2, 2, 3]
    one = fe.encounter_patient_features(dated, ["Patient_ID", "mk", "d1"], "Date", "d1", ["trend_abs_a"], ["a", "op"], [], [(ages, ["Patient_ID"])]).collect()
    assert len(one) == 1 and one[0].a_max == 7.0 and one[0].a_lastKnown == 7.0 and one[0].op_max == 1 and one[0].Age == 0.4
    assert one[0].trend_abs_a_min == 0.0 and one[0].trend_abs_a_max == 4.0
    doubled = treated.union(treated)
    with pytest.raises(Exception, match="not unique"):
        fe.encounter_features(values, members, [(doubled, ["Patient_ID", "Encounter"])], "key", ["Date", "n"], "Date", "value", ["a"]).collect()


@pytest.mark.parametrize("literal", [False, True])
def test_names_meet_the_dictionary_as_all_pairs_do(spark, literal):
    draw = random.Random(5)
    parts = ["Predni", "solon", "AZA", "thio", "prin", "mg", " 5", "ret", "Ä", "x", "İ", "Σ"]
    names = sorted({"".join(draw.choices(parts, k=draw.randint(1, 5))) for _ in range(150)}) + ["", "a.b", "a+b", "(ret"]
    known = sorted({"".join(draw.choices(parts, k=draw.randint(1, 3))) for _ in range(60)})
    known += ["m", "5 ", "Ä"] + (["a.b", "(ret", "+"] if literal else
                                 ["Pre.*lon", "predx?n", "(aza|thio)x", "[ps]o", "mg+", "so.?lo", r"a\+b", "^Σ", "x*", ".", "solonx?"])
    known = [(i % 3, k) for i, k in enumerate(known)] + [(2, "Predni"), (None, "Predni"), (1, "")]

    def hit(name, pattern):
        return pattern.lower() in name.lower() if literal else re.search(pattern, name, re.IGNORECASE | re.ASCII | re.DOTALL) is not None
    want = {n: min(r for r, k in known if r is not None and k and hit(n, k)) for n in names
            if any(r is not None and k and hit(n, k) for r, k in known)}
    left = spark.createDataFrame([(n,) for n in [*names, None]], "Drug string")
    right = spark.createDataFrame(known, "rank int, known string")
    for tile in (1, 1000):
        out = me.mentioned_ranks(left, right, literal=literal, tile=tile)
        assert {r.Drug: r["rank"] for r in out.collect()} == want
        plan = out._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert me.mentioned_ranks(left.limit(0), right, literal=literal).collect() == []
    assert me.mentioned_ranks(left, right.limit(0), literal=literal).collect() == []
