import numpy as np
import pytest
from pyspark.sql import functions as F

from kohorta.operators import aggregates as ag
from kohorta.operators import evaluate as ev


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(2)
    rows = [(run, i, float(np.round(rng.random() * (1.3 if y else 1.0), 2)), bool(y))
            for run in (1, 2, 3) for i, y in enumerate(rng.random(90) < 0.3)]
    return spark.createDataFrame(rows, "run int, id int, score double, label boolean").cache()


def by_run(scored):
    pdf = scored.toPandas()
    return {run: (g.score.to_numpy(), g.label.to_numpy()) for run, g in pdf.groupby("run")}


@pytest.mark.parametrize("splits", [1, 5])
def test_auc_counts_pairs(scored, splits):
    got = {r.run: r.auc for r in ev.auc(scored, ["run"], "score", "label", splits).collect()}
    for run, (s, y) in by_run(scored).items():
        d = s[y][:, None] - s[~y][None, :]
        assert got[run] == pytest.approx(((d > 0) + 0.5 * (d == 0)).mean())


def test_auc_invariants(spark, scored):
    perfect = scored.withColumn("score", F.col("label").cast("double"))
    assert all(r.auc == 1.0 for r in ev.auc(perfect, ["run"], "score", "label").collect())
    one_class = scored.where("label")
    assert all(r.auc is None for r in ev.auc(one_class, ["run"], "score", "label").collect())


def test_delong_variance(scored):
    got = {r.run: r for r in ev.auc_ci(scored, ["run"], "score", "label").collect()}
    for run, (s, y) in by_run(scored).items():
        d = s[y][:, None] - s[~y][None, :]
        v = (d > 0) + 0.5 * (d == 0)
        want = v.mean(1).var(ddof=1) / y.sum() + v.mean(0).var(ddof=1) / (~y).sum()
        assert got[run].variance == pytest.approx(want)
        assert got[run].lower < got[run].auc < got[run].upper


@pytest.mark.parametrize("splits", [1, 4])
def test_roc_is_monotone_and_ends_at_one(scored, splits):
    points = ev.roc_points(scored, ["run"], "score", "label", splits).orderBy("run", "fpr", "tpr").toPandas()
    for run, g in points.groupby("run"):
        assert (g.fpr.diff().dropna() >= 0).all() and (g.tpr.diff().dropna() >= 0).all()
        assert (g.fpr.iloc[0], g.tpr.iloc[0], g.fpr.iloc[-1], g.tpr.iloc[-1]) == (0, 0, 1, 1)


@pytest.mark.parametrize("jitter", [0.0, 1e-5])
@pytest.mark.parametrize("splits", [1, 3])
def test_sweep_equals_selection_by_quantile(scored, jitter, splits):
    shares = [0.05, 0.3, 0.77, 1.0]
    out = ev.sweep_selection(scored, ["run"], "score", "label", "id", 0.05, 0.05, 1, marks=shares[1:], jitter=jitter, splits=splits)
    got = {(r.run, r.share): r for r in out.collect()}
    assert len(got) == 12
    for run, (s, y) in by_run(scored).items():
        for share in shares:
            r = got[run, share]
            if jitter == 0.0:
                t = np.quantile(s, 1 - share)
                assert r.threshold == pytest.approx(t)
                assert (r.tp, r.fp) == ((y & (s >= t)).sum(), (~y & (s >= t)).sum())
            assert r.tp + r.fp + r.fn + r.tn == len(s)
            assert r.recall == pytest.approx(r.tp / y.sum()) and r.lift == pytest.approx(r.recall / share)


@pytest.mark.parametrize("splits", [1, 3])
def test_interpolation_equals_numpy(spark, splits):
    rng = np.random.default_rng(3)
    curves = {run: np.sort(np.round(rng.random(12), 1)) for run in (1, 2)}
    rows = [(run, float(x), float(i)) for run, xs in curves.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "run int, x double, y double")
    out = ev.curve_interpolate(df, ["run"], "x", ["y"], 23, splits).toPandas()
    for run, g in out.groupby("run"):
        xs = curves[run]
        ux = np.unique(xs)
        uy = [np.mean([i for i, v in enumerate(xs) if v == u]) for u in ux]
        g = g.sort_values("grid_no")
        assert len(g) == 23
        np.testing.assert_allclose(g.y, np.interp(g.x, ux, uy), atol=1e-9)


def test_threshold_edges(spark):
    rows = [(1, 0.1, True), (1, 0.1, False), (1, 0.3, True), (2, 0.9, True), (2, 0.05, False)]
    df = spark.createDataFrame(rows, "run int, score double, label boolean")
    got = {r.threshold: (r.specificity, r.sensitivity, r.cnt_high_risk)
           for r in ev.threshold_table(df, [], "score", "label", "run").collect()}
    assert got[0.1] == (1.0, pytest.approx(2 / 3), 2.0) and got[0.9] == (1.0, 0.0, 0.5)


def test_shares_sum_to_one(scored):
    shares = ev.confusion_at_threshold(scored, ["run"], "score", "label").groupBy("run").agg(F.sum("cnt_p").alias("s"))
    assert all(r.s == pytest.approx(1.0) for r in shares.collect())


def test_stability_rows_are_complements(scored):
    out = ev.run_stability(scored, ["id"], "score", "label", 0.5).groupBy("id").agg(F.sum("runs").alias("n"))
    assert all(r.n in (3, 6) for r in out.collect())


def test_six_statistics_split_equals_plain(spark):
    rng = np.random.default_rng(5)
    rows = [("hot" if i % 2 else f"p{i % 7}", i, None if rng.random() < 0.3 else float(np.round(rng.normal(), 2)), None)
            for i in range(300)]
    df = spark.createDataFrame(rows, "p string, at int, x double, y double")
    a = ag.six_stat_summary(df, ["p"], ["x", "y"], ["at"], clip=["x"], splits=1).orderBy("p").collect()
    b = ag.six_stat_summary(df, ["p"], ["x", "y"], ["at"], clip=["x"], splits=4).orderBy("p").collect()
    for left, right in zip(a, b, strict=True):
        assert left.asDict().keys() == right.asDict().keys()
        for k, v in left.asDict().items():
            assert right[k] == (pytest.approx(v) if isinstance(v, float) else v)
        assert left.x_min <= 0 <= left.x_max and left.y_min is None and left.y_stdev is None


def test_quantile_cut_shares_bins_among_ties(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 1, 2, 3, 4, 10]], "x double")
    got = {r.x: (r.bin, r.bin_label) for r in ag.quantile_cut(df, "x", 4).collect()}
    assert got[1.0] == (1, "1 - 1.5") and got[2.0] == (2, "1.5 - 3.25") and got[10.0] == (3, "3.25 - 10")


def test_collapse_and_distinct_with_missing(spark):
    df = spark.createDataFrame([("p", "b", 2), ("p", "a", 3), ("p", "b", 1), ("p", None, 0)], "p string, v string, at int")
    assert ag.collapse_unique(df.where("v is not null"), ["p"], "v", "at", "o").first().o == "b, a"
    assert df.agg(ag.distinct_with_missing("v")).first()[0] == 3


def test_empty_inputs_give_empty_results(spark):
    from kohorta.operators.aggregates import histogram_counts
    from kohorta.operators.evaluate import curve_interpolate, roc_vertical_average
    points = spark.createDataFrame([], "model string, run int, fpr double, tpr double, cutoff double")
    assert histogram_counts(points, "fpr").collect() == []
    assert curve_interpolate(points, ["model", "run"], "fpr", ["tpr", "cutoff"], 5).collect() == []
    assert roc_vertical_average(points, ["model"], "run").collect() == []
