import numpy as np

from kohorta.plans import modeling


def test_every_report_on_its_own_scores(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 120))
    rows = [(i, bool(a[i] + 0.5 * rng.normal() > 0), float(a[i]) if i % 9 else None, float(b[i]) if i % 7 else None) for i in range(120)]
    rows.append((500, None, 0.5, 0.5))
    matrix = spark.createDataFrame(rows, "id int, mk boolean, a double, b double")
    done = modeling.model_evaluation(matrix, "id", "mk", ["a", "b", "a:b"], runs=2, folds=2, sweeps=1, share_steps=5, null_runs=2,
                                     inner_folds=2, path=3, trees=8)
    reports = {name: df.collect() for name, df in done.reports.items()}
    assert set(reports) == {"metrics", "auc_summary", "curve", "thresholds", "selection", "stability", "patients", "feature_usage",
                            "imputation_impact", "importance", "null_metrics"}
    assert done.scores.count() == 2 * 2 * 120 and done.scores.where("patient = 500").isEmpty()
    assert {(r.model, r.run) for r in reports["metrics"]} == {(m, r) for m in ("lasso", "forest") for r in (1, 2)}
    assert all(r.auc > 0.75 for r in reports["metrics"]) and len(reports["null_metrics"]) == 2
    assert len(reports["patients"]) == 240 and len(reports["imputation_impact"]) == 240
    assert {r.feature: r.nr_nas for r in reports["feature_usage"]}.get("a", 14) == 14
    assert {r.term for r in reports["importance"]} == {"a", "b"}
