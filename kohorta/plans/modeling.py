"""From the patient matrix to chosen terms, scored runs and reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohorta.functions.terms import interpret_term
from kohorta.operators import evaluate as ev
from kohorta.operators.aggregates import null_profile, row_null_count
from kohorta.operators.impute import impute_mean, impute_runs
from kohorta.operators.models import importance_summary, label_permutation_null, repeated_oof
from kohorta.operators.screen import rank_terms, screen_interactions, screen_univariate, select_features
from kohorta.session import materialize

# Gates on missing cells, significance, and how many terms of each kind are kept.
MAX_MISSING, MAX_MISSING_PARTNER, SIGNIFICANT, KEEP = 10, 7, 0.05, 29


@dataclass
class Screening:
    completeness: DataFrame
    main: DataFrame
    interactions: DataFrame
    ranked: DataFrame
    features: DataFrame


def screen_and_select(matrix: DataFrame, ident: str, label: str, max_missing: int = MAX_MISSING,
                      max_missing_partner: int = MAX_MISSING_PARTNER, keep: int = KEEP,
                      excluded: Sequence[str] = ()) -> Screening:
    """Gate by completeness, regress on every feature and product, explain, rank, choose."""
    profile = null_profile(matrix, exclude=[ident, label], below=max_missing)
    missing = {r["key"]: r["value"] for r in profile.collect()}
    names = sorted(missing)
    partners = [n for n in names if missing[n] < max_missing_partner]

    def explained(table: DataFrame) -> DataFrame:
        return table.withColumns({"stat_sign": F.col("p_value") < SIGNIFICANT,
                                  "interpretation": interpret_term(F.col("term"), F.col("estimate"))})
    main = explained(screen_univariate(matrix, label, names))
    both = explained(screen_interactions(matrix, label, names, partners))
    ranked = rank_terms(main.where("converged"), both.where("converged"), keep)
    return Screening(profile, main, both, ranked, select_features(ranked, excluded))


@dataclass
class Evaluation:
    """Scores of all runs and every report on them; ``reports`` maps a report's name to its table."""
    scores: DataFrame
    coefficients: DataFrame
    reports: dict[str, DataFrame]


def model_evaluation(matrix: DataFrame, ident: str, label: str, terms: Sequence[str], runs: int = 100, folds: int = 10,
                     sweeps: int = 5, seed: int = 0, share_steps: int = 200, null_runs: int | None = None, **options) -> Evaluation:
    """Impute once per run, score out of fold, and report on the scores: metrics, AUC and its spread, averaged curves, thresholds,
    selection by share, stability, patients, use and importance of terms, imputed cells against right runs, and the
    metrics of ``null_runs`` label permutations (as many as runs by default; 0 leaves them out)."""
    columns = sorted({p for t in terms for p in t.split(":")})
    base = materialize(matrix.select(ident, label, *[F.col(f"`{c}`") for c in columns]))
    filled = impute_mean(impute_runs(base, ident, columns, runs, sweeps, seed=seed), columns, label)
    done = repeated_oof(filled, ident, label, terms, runs, folds, seed=seed, importance=True, **options)
    scores, by_run = done.scores, ["model", "run"]
    metrics = ev.classification_metrics(scores, by_run, "predicted", "label").join(
        ev.auc(scores, by_run, "predicted", "label"), by_run)
    points = ev.finite_points(ev.roc_points(scores, by_run, "predicted", "label"))
    missing = base.select(F.col(ident).alias("patient"), row_null_count(columns).alias("nr_nas"))
    impact = [ev.imputation_impact(scores.where(F.col("model") == m), "patient", "predicted", "label", missing).withColumn("model", F.lit(m))
              for m in sorted({"lasso", "forest"} & set(options.get("models", ("lasso", "forest"))))]
    reports = {
        "metrics": metrics, "auc_summary": ev.auc_summary(metrics, "model"), "curve": ev.roc_spread(points, ["model"], "run"),
        "thresholds": ev.threshold_table(scores, ["model"], "predicted", "label", "run"),
        "selection": ev.sweep_selection(scores, by_run, "predicted", "label", "patient", steps=share_steps, seed=seed),
        "stability": ev.run_stability(scores, ["model", "patient"], "predicted", "label"),
        "patients": ev.patient_score_summary(scores, ["model", "patient", "label"], "predicted"),
        "feature_usage": ev.feature_usage(done.used, null_profile(base, exclude=[ident, label])),
        "imputation_impact": reduce(DataFrame.unionByName, impact)}
    if done.importance is not None:
        reports["importance"] = importance_summary(done.importance)
    if null_runs != 0:
        first = filled.where("run = 1").drop("run")  # the labels move, the cells stay
        null = label_permutation_null(first, ident, label, terms, null_runs or runs, folds, seed=seed, **{
            k: v for k, v in options.items() if k in ("inner_folds", "path")})
        reports["null_metrics"] = null.metrics
    return Evaluation(scores, done.used, reports)
