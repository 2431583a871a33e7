"""Evaluation of scored runs: ranks, AUC, ROC curves, thresholds, stability.

Scores are first counted per distinct value, so the shuffles carry counts, and the running
counts go through ``running_sums``, which splits a run too large for one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kohorta.functions.numeric import finite_or_null, floor_to_step, round_to_step, unit_hash
from kohorta.operators.aggregates import count_conditional, mean_sd_by, ratio_to_total
from kohorta.operators.ordered import (fill_forward, first_rows, join_null_safe, number_rows, running_sums)
from kohorta.operators.reshape import split_rows

# The decision thresholds of the reports.
METRIC_THRESHOLD = 0.3
STABILITY_THRESHOLD = 0.096
IMPACT_THRESHOLD = 0.1
REPORT_THRESHOLDS = (0.1, 0.3, 0.9)
FLAG_THRESHOLDS = {"threshold_01": 0.1, "threshold_03": 0.3, "threshold_08": 0.8}
SWEEP_MARKS = (0.05, 0.3, 0.5, 0.7, 0.95)

GRID_BLOCK = 4096  # a grid is unfolded in two steps, so no row holds all of a long grid
RANK_BLOCKS = 1000  # ranks of a run are looked up by thousandths


def score_ranks(df: DataFrame, runs: Sequence[str], score: str, label: str, descending: bool = False,
                splits: int | None = None, totals: bool = False) -> DataFrame:
    """Per run and distinct score: pos, neg and the counts up to here; on demand the run's P and N,
    which come from the same per-score counts."""
    hit = F.col(label).cast("boolean")
    counted = df.groupBy(*runs, score).agg(F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg"))
    upto = running_sums(counted, runs, [score], {"pos_upto": F.col("pos"), "neg_upto": F.col("neg")},
                        descending, splits)
    if not totals:
        return upto
    sizes = counted.groupBy(*runs).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    if runs:
        return join_null_safe(upto, sizes, runs)
    return upto.withColumns({"P": sizes.select("P").scalar(), "N": sizes.select("N").scalar()})


def auc(df: DataFrame, runs: Sequence[str], score: str, label: str, splits: int | None = None) -> DataFrame:
    """Exact rank AUC with ties, per run. Missing where a run has one class only."""
    ranks = score_ranks(df, runs, score, label, splits=splits)
    below = F.col("neg_upto") - F.col("neg") / 2
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return ranks.groupBy(*runs).agg(F.try_divide(F.sum(F.col("pos") * below), pairs).alias("auc"))


def auc_summary(aucs: DataFrame, model: str) -> DataFrame:
    return mean_sd_by(aucs, [model], "auc", ("cnt", "avg_auc", "sd_auc"))


def auc_ci(df: DataFrame, runs: Sequence[str], score: str, label: str, z: float = 1.959963984540054,
           splits: int | None = None) -> DataFrame:
    """AUC with the DeLong variance from placement values, in one aggregate of the ranks."""
    # Placements are kept as counts, so the totals of a run are needed only in the aggregate itself:
    # a positive beats `under` negatives, a negative is beaten by P - `over` positives.
    ranks = score_ranks(df, runs, score, label, splits=splits)
    under = F.col("neg_upto") - F.col("neg") / 2
    over = F.col("pos_upto") - F.col("pos") / 2
    p, n = F.sum("pos").cast("double"), F.sum("neg").cast("double")

    def variance(weight: str, place: Column, size: Column, scale: Column) -> Column:
        w = F.col(weight)
        centred = F.sum(w * place * place) - F.sum(w * place) * F.sum(w * place) / size
        return F.try_divide(centred / (scale * scale), (size - 1) * size)
    summed = ranks.groupBy(*runs).agg(
        p.alias("P"), n.alias("N"), F.try_divide(F.sum(F.col("pos") * under), p * n).alias("auc"),
        F.when((p > 1) & (n > 1), variance("pos", under, p, n) + variance("neg", over, n, p)).alias("variance"))
    summed = summed.where("P > 0 and N > 0").drop("P", "N")
    width = F.lit(z) * F.sqrt(F.greatest(F.col("variance"), F.lit(0.0)))
    return summed.withColumns({"lower": F.greatest(F.col("auc") - width, F.lit(0.0)),
                               "upper": F.least(F.col("auc") + width, F.lit(1.0))})


def confusion_at_threshold(df: DataFrame, runs: Sequence[str], score: str, label: str,
                           threshold: float = METRIC_THRESHOLD) -> DataFrame:
    counted = df.groupBy(*runs, (F.col(score) > threshold).alias("predicted"),
                         F.col(label).cast("boolean").alias("actual")).agg(F.count(F.lit(1)).alias("cnt"))
    return ratio_to_total(counted, "cnt", runs)


def classification_metrics(df: DataFrame, runs: Sequence[str], score: str, label: str,
                           threshold: float = METRIC_THRESHOLD) -> DataFrame:
    chosen, hit = F.col(score) > threshold, F.col(label).cast("boolean")
    counts = df.groupBy(*runs).agg(
        F.count_if(chosen & hit).alias("tp"), F.count_if(chosen & ~hit).alias("fp"),
        F.count_if(~chosen & hit).alias("fn"), F.count_if(~chosen & ~hit).alias("tn"))
    rates = counts.select(
        *runs, F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"),
        F.try_divide("fp", F.col("fp") + F.col("tn")).alias("fallout"),
        F.try_divide("tn", F.col("fp") + F.col("tn")).alias("specificity"),
        F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"))
    return rates.withColumn("fmeasure", F.try_divide(2 * F.col("precision") * F.col("recall"),
                                                     F.col("precision") + F.col("recall")))


def threshold_table(df: DataFrame, models: Sequence[str], score: str, label: str, run: str,
                    thresholds: Sequence[float] = REPORT_THRESHOLDS) -> DataFrame:
    """Specificity, sensitivity and mean high-risk count per threshold, from one pass."""
    s, hit = F.col(score), F.col(label).cast("boolean")
    rows = [F.struct(
        F.lit(float(t)).alias("threshold"),
        F.try_divide(F.count_if((s <= t) & ~hit), F.count_if(~hit)).alias("specificity"),
        F.try_divide(F.count_if((s > t) & hit), F.count_if(hit)).alias("sensitivity"),
        F.count_if(s >= t).alias("high")) for t in thresholds]
    table = df.groupBy(*models).agg(F.array(*rows).alias("rows"))
    runs = df.groupBy(*models).agg(F.countDistinct(run).alias("runs"))
    joined = join_null_safe(table, runs, models) if models else table.withColumn("runs", runs.scalar())
    return joined.select(*models, "runs", F.inline("rows")).withColumn(
        "cnt_high_risk", F.col("high") / F.col("runs")).drop("high", "runs")


def sweep_selection(df: DataFrame, runs: Sequence[str], score: str, label: str, ident: str,
                    min_share: float = 0.05, max_share: float = 1.0, steps: int = 200,
                    marks: Sequence[float] = (), seed: int = 0, jitter: float = 1e-5,
                    splits: int | None = None) -> DataFrame:
    """Recall, precision, lift and specificity when the top share of each run is selected.

    One running count per run serves all shares: each share asks for two ranks. Ranks meet by an
    equi join on the thousandth of the run they lie in, so a value tied over much of a run stays one
    row in a bounded number of blocks.
    """
    width = (max_share - min_share) / (steps - 1) if steps > 1 else 0.0
    shares = list(dict.fromkeys([min_share + i * width for i in range(steps)] + [float(m) for m in marks]))
    moved = df.select(*runs, (F.col(score) + unit_hash(*[F.col(r) for r in runs], F.col(ident), seed=seed)
                              * jitter).alias("v"), F.col(label).cast("boolean").alias("hit"))
    counted = moved.groupBy(*runs, "v").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("p"))
    ranked = running_sums(counted, runs, ["v"], {"n_upto": F.col("n"), "p_upto": F.col("p")}, splits=splits)
    sizes = counted.groupBy(*runs).agg(F.sum("n").alias("size"), F.sum("p").alias("P"))
    wanted = sizes.select(*runs, "size", "P", F.explode(F.array(*[F.lit(s) for s in shares])).alias("share"))
    wanted = wanted.withColumn("h", F.round((F.col("size") - 1) * (1 - F.col("share")), 9))
    sides = F.array(F.struct(F.lit("lo").alias("side"), F.floor("h").cast("bigint").alias("place")),
                    F.struct(F.lit("hi").alias("side"), F.ceil("h").cast("bigint").alias("place")))
    wanted = wanted.select("*", F.inline(sides)).withColumn("block", F.expr(f"place * {RANK_BLOCKS} div size"))
    held = join_null_safe(ranked, sizes.select(*runs, "size"), runs) if runs else ranked.withColumn(
        "size", sizes.select("size").scalar())
    first, last = f"(n_upto - n) * {RANK_BLOCKS} div size", f"(n_upto - 1) * {RANK_BLOCKS} div size"
    blocks = held.select(*runs, "v", (F.col("n_upto") - F.col("n")).alias("n_before"), "n_upto",
                         (F.col("p_upto") - F.col("p")).alias("p_before"),
                         F.explode(F.expr(f"sequence({first}, {last})")).alias("block"))
    asked = join_null_safe(wanted, blocks, [*runs, "block"]).where("n_before <= place and place < n_upto")
    found = asked.groupBy(*runs, "size", "P", "share", "h").agg(*[
        F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{n}_{side}")
        for side in ("lo", "hi") for n, c in (("v", "v"), ("n", "n_before"), ("p", "p_before"))])
    found = found.withColumn("threshold", F.col("v_lo") + (F.col("h") - F.floor("h")) * (F.col("v_hi") - F.col("v_lo")))
    at_low = F.col("threshold") <= F.col("v_lo")
    chosen = F.col("size") - F.when(at_low, F.col("n_lo")).otherwise(F.col("n_hi"))
    caught = F.col("P") - F.when(at_low, F.col("p_lo")).otherwise(F.col("p_hi"))
    found = found.withColumns({"tp": caught, "fp": chosen - caught})
    recall = F.try_divide("tp", "P")
    return found.select(
        *runs, "share", "threshold", "tp", "fp", (F.col("P") - F.col("tp")).alias("fn"),
        (F.col("size") - F.col("P") - F.col("fp")).alias("tn"), recall.alias("recall"),
        F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"),
        F.try_divide(recall, F.col("share")).alias("lift"),
        F.try_divide(F.col("size") - F.col("P") - F.col("fp"), F.col("size") - F.col("P")).alias("specificity"))


def selection_metrics(df: DataFrame, runs: Sequence[str], score: str, label: str, ident: str,
                      share: float = 0.05, seed: int = 0, splits: int | None = None) -> DataFrame:
    return sweep_selection(df, runs, score, label, ident, share, share, 1, seed=seed, splits=splits)


def roc_points(df: DataFrame, runs: Sequence[str], score: str, label: str, splits: int | None = None) -> DataFrame:
    """(fpr, tpr, cutoff) at each distinct score of a run, and the origin."""
    ranks = score_ranks(df, runs, score, label, descending=True, splits=splits, totals=True)
    points = ranks.select(*runs, F.try_divide("neg_upto", "N").alias("fpr"), F.try_divide("pos_upto", "P").alias("tpr"),
                          F.col(score).cast("double").alias("cutoff"))
    origin = df.select(*runs).distinct().select(
        *runs, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("cutoff"))
    return points.unionByName(origin)


def finite_points(points: DataFrame, columns: Sequence[str] = ("fpr", "tpr")) -> DataFrame:
    for c in columns:
        points = points.where(finite_or_null(F.col(c)).isNotNull())
    return points


def curve_interpolate(points: DataFrame, runs: Sequence[str], x: str, ys: Sequence[str], size: int,
                      splits: int | None = None) -> DataFrame:
    """Every run's curve at ``size`` common positions: linear between points, tied x averaged, ends held.

    A run's points are first reduced to the first and last point of each grid cell, so what is
    ordered per run is the grid and not the points.
    """
    low, high = points.agg(F.min(x), F.max(x)).first()
    low, high = (0.0, 0.0) if low is None else (low, high)  # no points give an empty result
    step = (high - low) / max(size - 1, 1) or 1.0
    tied = points.groupBy(*runs, F.col(x).alias("x")).agg(*[F.avg(y).alias(y) for y in ys])
    point = F.struct("x", *ys)
    cell = F.least(F.floor((F.col("x") - low) / step), F.lit(size - 1)).cast("bigint")
    cells = tied.groupBy(*runs, cell.alias("k")).agg(F.min_by(point, "x").alias("b"), F.max_by(point, "x").alias("a"))
    blocks = F.sequence(F.lit(0).cast("bigint"), F.lit((size - 1) // GRID_BLOCK).cast("bigint"))
    inside = F.sequence(F.lit(0).cast("bigint"), F.lit(min(size, GRID_BLOCK) - 1).cast("bigint"))
    grid = points.select(*runs).distinct().select(*runs, F.explode(blocks).alias("block")).select(
        *runs, "block", F.explode(inside).alias("k")).withColumn("k", F.col("block") * GRID_BLOCK + F.col("k")).drop(
        "block").where(F.col("k") < size)
    grid = join_null_safe(grid, cells.select(*runs, "k", "b"), [*runs, "k"], "left")
    grid = join_null_safe(grid, cells.select(*runs, (F.col("k") + 1).alias("k"), "a"), [*runs, "k"], "left")
    if splits is None:
        splits = 1 if size <= 1_000_000 else None
    grid = fill_forward(grid, runs, ["k"], ["a"], splits=splits)
    grid = fill_forward(grid, runs, ["k"], ["b"], descending=True, splits=splits)
    at = F.lit(low) + F.col("k") * F.lit(step)
    share = (F.col("at") - F.col("a.x")) / (F.col("b.x") - F.col("a.x"))
    held = [F.when(F.col("a").isNull() | (F.col("b.x") <= F.col("at")), F.col(f"b.{y}"))
            .when(F.col("b").isNull() | (F.col("a.x") >= F.col("at")), F.col(f"a.{y}"))
            .otherwise(F.col(f"a.{y}") + share * (F.col(f"b.{y}") - F.col(f"a.{y}"))).alias(y) for y in ys]
    return grid.withColumn("at", at).select(*runs, F.col("k").cast("int").alias("grid_no"), F.col("at").alias(x), *held)


def roc_vertical_average(points: DataFrame, models: Sequence[str], run: str, size: int | None = None) -> DataFrame:
    """Mean tpr and cutoff over runs at each grid position; the grid defaults to the longest run."""
    if size is None:
        size = points.groupBy(*models, run).count().agg(F.max("count")).first()[0] or 1
    curves = curve_interpolate(points, [*models, run], "fpr", ["tpr", "cutoff"], size)
    return curves.groupBy(*models, "grid_no", "fpr").agg(
        F.avg("tpr").alias("tpr"), finite_or_null(F.avg("cutoff")).alias("cutoff"))


def roc_spread(points: DataFrame, models: Sequence[str], run: str, size: int = 40) -> DataFrame:
    """Mean, 1 and 2 sd bands of tpr and the central 95 percent of the cutoff over runs. A group
    here holds one row per run."""
    curves = curve_interpolate(points, [*models, run], "fpr", ["tpr", "cutoff"], size)
    cutoff = finite_or_null(F.col("cutoff"))
    sd = F.col("sd")
    return curves.groupBy(*models, "grid_no", "fpr").agg(
        F.avg("tpr").alias("tpr"), F.stddev_samp("tpr").alias("sd"),
        finite_or_null(F.avg("cutoff")).alias("cutoff"),
        F.percentile(cutoff, 0.025).alias("cutoff_low"), F.percentile(cutoff, 0.975).alias("cutoff_high"),
    ).withColumns({"tpr_low1": F.col("tpr") - sd, "tpr_high1": F.col("tpr") + sd,
                   "tpr_low2": F.col("tpr") - 2 * sd, "tpr_high2": F.col("tpr") + 2 * sd})


def roc_cutoff_labels(spread: DataFrame, models: Sequence[str]) -> DataFrame:
    """First grid position of each rounded cutoff, with its label."""
    rounded = spread.withColumn("step", round_to_step(F.col("cutoff"))).where("step is not null and step <> 0")
    kept = first_rows(rounded, [*models, "step"], ["fpr"])
    return kept.select(*models, "fpr", "tpr", F.col("step").alias("cutoff"), F.format_string(
        "TH:%.2f CI:[%.2f,%.2f]", "step", F.bround("cutoff_low", 2), F.bround("cutoff_high", 2)).alias("label"))


def sensitivity_interval(points: DataFrame, models: Sequence[str], run: str, size: int = 25) -> DataFrame:
    """Sensitivity at evenly spaced specificities: 2.5, 50 and 97.5 percent over runs."""
    curves = curve_interpolate(points, [*models, run], "fpr", ["tpr"], size)
    return curves.groupBy(*models, "grid_no", (1 - F.col("fpr")).alias("specificity")).agg(
        F.percentile("tpr", 0.025).alias("lower"), F.percentile("tpr", 0.5).alias("median"),
        F.percentile("tpr", 0.975).alias("upper"))


def order_statistic_rows(aucs: DataFrame, run: str, value: str = "auc",
                         places: Sequence[int] = (5, 50, 95)) -> DataFrame:
    """The runs at the given places when ordered by value."""
    return number_rows(aucs, [], [value, run], "place").where(F.col("place").isin(*places))


def run_stability(df: DataFrame, keys: Sequence[str], score: str, label: str,
                  threshold: float = STABILITY_THRESHOLD) -> DataFrame:
    """Runs above and below the threshold per patient, stacked with the complement rows."""
    counts = count_conditional(df, [*keys, label], score, threshold)
    shown = counts.select(*keys, F.when(F.col(label), "above threshold with crisis").otherwise(
        "above threshold no crisis").alias("state"), F.col("cnt_above_th").alias("runs"), F.col("mean_value"))
    rest = counts.select(*keys, F.lit("below the threshold").alias("state"), F.col("cnt_below_th").alias("runs"),
                         F.col("mean_value"))
    return shown.unionByName(rest)


def imputation_impact(df: DataFrame, patient: str, score: str, label: str, missing: DataFrame,
                      threshold: float = IMPACT_THRESHOLD) -> DataFrame:
    """Missing cells of a patient against the share of its runs that were right, in steps of 0.1."""
    counts = count_conditional(df, [patient, label], score, threshold)
    runs = F.col("cnt_above_th") + F.col("cnt_below_th")
    right = F.when(F.col(label), F.col("cnt_above_th")).otherwise(F.col("cnt_below_th"))
    out = counts.withColumn("correct_share", right / runs)
    return out.withColumn("correct_step", floor_to_step(F.col("correct_share"))).join(missing, patient).drop("mean_value")


def feature_usage(coefficients: DataFrame, completeness: DataFrame, term: str = "term", run: str = "run",
                  value: str = "coefficient", more_than: int = 3) -> DataFrame:
    """How often each base feature was used over the runs, its coefficient, and its missing cells."""
    base = split_rows(coefficients, term).groupBy(F.col(term).alias("feature")).agg(
        F.countDistinct(run).alias("nr_runs"), F.count(F.lit(1)).alias("cnt_occ"), F.avg(value).alias("avg_value"),
        F.stddev_samp(value).alias("sd_value"))
    return base.where(F.col("cnt_occ") > more_than).join(
        completeness.select(F.col("key").alias("feature"), F.col("value").alias("nr_nas")), "feature")


def patient_score_summary(df: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Mean and spread of the scores, and whether the mean reaches each threshold. The last digits of a mean depend on the order of its
    rows, so it is compared without them: a mean of exactly 0.8 reaches 0.8."""
    summed = df.groupBy(*keys).agg(F.avg(score).alias("avg_predicted"), F.stddev_samp(score).alias("sd_predicted"))
    return summed.withColumns({n: F.round("avg_predicted", 12) >= t for n, t in FLAG_THRESHOLDS.items()})


def drilldown(facts: dict[str, tuple[DataFrame, Column, Column, Column]], patient) -> DataFrame:
    """Every fact of one patient in long form (source, id, value). ``facts`` maps a source to its table and the columns of
    patient, identity and value; the filter reaches each scan."""
    parts = [df.where(key == F.lit(patient)).select(F.lit(name).alias("source"), ident.cast("bigint").alias("id"),
                                                    value.cast("double").alias("value"))
             for name, (df, key, ident, value) in facts.items()]
    return reduce(DataFrame.unionByName, parts)
