"""Bindings of screening, imputation and classification. Iterative fits have no SQL beside them
unless their optimum is unique and cheap to reach."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohorta.bindings.evaluation import r
from kohorta.bindings.pipelines import feature_matrix
from kohorta.bindings.registry import query
from kohorta.bindings.shared import GAPPED_SQL, TERMS_SQL, gapped_part, term_table
from kohorta.operators import forest, impute, models, paths, screen
from kohorta.plans import modeling
from kohorta.session import materialize

DIMS = [f"d{i}" for i in range(64)]
_staged: dict = {}


def staged(build):
    """A result that several queries read is made once per session and location; it is a checkpoint in the shared folder."""
    def run(t):
        key = build.__name__, t.spark.sparkContext.applicationId, t.location
        if key not in _staged:
            _staged[key] = build(t)
        return _staged[key]
    return run


def vectors(t):
    """Embeddings as a labelled feature matrix."""
    return t.embeddings.select("vec_id", (F.col("label") < 5).alias("mk"), *[
        F.get("embedding", F.lit(i)).cast("double").alias(d) for i, d in enumerate(DIMS)])


def _newton_sql(steps, start="term, 0.0::double as b0, 0.0::double as b1"):
    """Newton steps of a one-feature logistic regression per term, unrolled."""
    parts = [f"fit0 as materialized (select distinct {start} from data)"]
    for i in range(1, steps + 1):
        parts.append(f"""fit{i} as materialized (select term, b0 + (s2 * g0 - s1 * g1) / (s0 * s2 - s1 * s1) as b0, b1 + (s0 * g1 - s1 * g0) / (s0 * s2 - s1 * s1) as b1,
  sqrt(s0 / (s0 * s2 - s1 * s1)) as error, n from (select term, b0, b1, sum(w) as s0, sum(w * x) as s1, sum(w * x * x) as s2, sum(y - p) as g0, sum((y - p) * x) as g1, count(*) as n
  from (select *, p * (1 - p) as w from (select term, x, y, b0, b1, 1 / (1 + exp(-(b0 + b1 * x))) as p from data join fit{i - 1} using (term))) group by term, b0, b1))""")
    return ", ".join(parts) + f" select term, round(b1, 6) as estimate, round(error, 6) as std_error, n from fit{steps}"


LONG_SQL = "dims as (select vec_id, (label < 5)::int as y, unnest(range(64)) as i, unnest(embedding)::double as v from embeddings)"


@query("screen_univariate", f"with {LONG_SQL}, data as (select 'd' || i as term, v as x, y from dims), {_newton_sql(9)}")
def screen_univariate(t):
    out = screen.screen_univariate(vectors(t), "mk", DIMS)
    return out.select("term", F.round("estimate", 6).alias("estimate"), F.round("std_error", 6).alias("std_error"), "n")


@query("screen_interactions", f"""with {LONG_SQL}, data as (select 'd' || a.i || ':d' || b.i as term, 10 * a.v * b.v as x, a.y from dims a join dims b on a.vec_id = b.vec_id and ('d' || a.i) < ('d' || b.i)),
{_newton_sql(9).replace('round(b1, 6)', 'round(b1 * 10, 5)').replace('round(error, 6)', 'round(error * 10, 5)')}""")
def screen_interactions(t):
    out = screen.screen_interactions(vectors(t), "mk", DIMS)
    return out.select("term", F.round("estimate", 5).alias("estimate"), F.round("std_error", 5).alias("std_error"), "n")


@query("glm_multi")
def glm_multi(t):
    return models.glm_multi(vectors(t), "mk", DIMS)


@query("rank_terms", f"with {TERMS_SQL} select term, estimate, p_value, contains(term, ':') as interaction from terms qualify row_number() over (partition by contains(term, ':') order by p_value, term) <= 29")
def rank_terms(t):
    terms = term_table(t)
    return screen.rank_terms(terms.where("not term like '%:%'"), terms.where("term like '%:%'")).select(
        "term", "estimate", "p_value", "interaction")


@query("select_features", f"""with {TERMS_SQL}, ranked as (select term from terms qualify row_number() over (partition by contains(term, ':') order by p_value, term) <= 29),
names as (select distinct unnest(string_split(term, ':')) as feature from ranked)
select feature from names where not regexp_matches(feature, 'cnt_D1.*') and not regexp_matches(feature, 'Age_of_onset_D2')""")
def select_features(t):
    terms = term_table(t)
    ranked = screen.rank_terms(terms.where("not term like '%:%'"), terms.where("term like '%:%'"))
    return screen.select_features(ranked, ["cnt_D1.*", "Age_of_onset_D2"])


@query("impute_mean", f"""with {GAPPED_SQL}, means as (select avg(p_size) as s, avg(p_retailprice) as p from gapped)
select p_partkey, round(coalesce(p_size, s), 8) as p_size, round(coalesce(p_retailprice, p), 8) as p_retailprice from gapped, means where p_type is not null""")
def impute_mean(t):
    df = gapped_part(t).select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice", "p_type")
    return r(impute.impute_mean(df, ["p_size", "p_retailprice"], "p_type").drop("p_type"))


def holed_vectors(t):
    """Vectors with a hole where a value is far out, so holes depend on the data; every column has some."""
    return vectors(t).withColumns({c: F.when(F.col(c) < 0.15, F.col(c)) for c in DIMS})


@query("impute_pmm")
def impute_pmm(t):
    return impute.impute_pmm(holed_vectors(t), "vec_id", DIMS)


@query("impute_pmm_audit", """
with cells as (select unnest(range(64)) as i, unnest(embedding)::double as v from embeddings)
select 'd' || i as feature, count(*) filter (where v >= 0.15) as filled, 0::bigint as still_missing, 0::bigint as foreign_values,
  0::bigint as changed from cells group by i""")
def impute_pmm_audit(t):
    """Per feature: how many holes were filled, that donors are observed values, and that observed values stay."""
    tables = (holed_vectors(t).drop("mk"), "was"), (impute_pmm(t).drop("mk"), "now")
    long = [df.unpivot(["vec_id"], DIMS, "feature", name) for df, name in tables]
    seen = long[0].where("was is not null").select("feature", F.col("was").alias("now")).distinct().withColumn("seen", F.lit(1))
    both = long[0].join(long[1], ["vec_id", "feature"]).join(seen, ["feature", "now"], "left")
    return both.groupBy("feature").agg(
        F.count_if(F.col("was").isNull() & F.col("now").isNotNull()).alias("filled"),
        F.count_if(F.col("now").isNull()).alias("still_missing"),
        F.count_if(F.col("now").isNotNull() & F.col("seen").isNull()).alias("foreign_values"),
        F.count_if(F.col("was") != F.col("now")).alias("changed"))


@query("nearest_donors", """
with cases as (select label as grp, vec_id, round(embedding[1]::double, 3) as prediction, case when embedding[2] < 0.05 then embedding[2]::double end as value from embeddings),
placed as (select *, count(value) over (partition by grp order by prediction, (value is null)::int, vec_id rows unbounded preceding) as place from cases),
pairs as (select a.grp, a.vec_id, b.value, row_number() over (partition by a.grp, a.vec_id order by abs(b.prediction - a.prediction), b.place) - 1 as rank,
  count(*) over (partition by a.grp, a.vec_id) as found from placed a join placed b on a.grp = b.grp and a.value is null and b.value is not null
    and b.place between a.place - 4 and a.place + 5)
select grp, vec_id, value from pairs
where rank = floor(('0x' || substr(md5(concat_ws('|', vec_id, grp, 11)), 1, 13))::bigint / 4503599627370496.0 * least(found, 5))""")
def nearest_donors(t):
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    cases = t.embeddings.select(F.col("label").alias("grp"), "vec_id", F.round(e(0), 3).alias("prediction"),
                                F.when(e(1) < 0.05, e(1)).alias("value"))
    return impute.nearest_donors(cases, "vec_id", 5, 11, keys=["grp"])


@query("design_matrix", "select vec_id, label < 5 as mk, embedding[1]::double as d0, embedding[2]::double as d1, round(embedding[1]::double * embedding[2]::double, 12) as \"d0:d1\" from embeddings")
def design_matrix(t):
    out = models.design_matrix(vectors(t), ["d0", "d1", "d0:d1"], ["vec_id", "mk"])
    return out.withColumn("d0:d1", F.round("d0:d1", 12))


TERMS = [*DIMS, "d0:d1", "d2:d5"]
NOISE = "2 * embedding[{0}]::double - embedding[{1}]::double + embedding[{2}]::double + (label - 4.5) / 15 > 0"
SIGNAL_SQL = f"signal as (select vec_id, ({NOISE.format(1, 2, 3)})::int as y, embedding from embeddings)"


def signal(t):
    """Vectors under a label that some of their dimensions tell, with noise from the given label."""
    mk = 2 * F.col("d0") - F.col("d1") + F.col("d2") + (F.col("label") - 4.5) / 15 > 0
    return vectors(t).join(t.embeddings.select("vec_id", "label"), "vec_id").withColumn("mk", mk).drop("label")


RUNS, FOLDS = 100, 10
#: Queries over many runs, which take minutes however small the table is.
LONG = ["impute_pmm", "impute_pmm_audit", "repeated_oof", "repeated_oof_audit", "lasso_audit", "permutation_importance", "label_permutation_null",
        "model_evaluation"]


# One evaluation: both classifiers at their defaults on all dimensions, 100 runs, 10 folds, 10 inner folds, 20 penalties, 100 trees. Its
# halves are made apart, so that a query waits for the half it reads.

@staged
def out_of_fold_lasso(t):
    return models.repeated_oof(signal(t), "vec_id", "mk", TERMS, RUNS, FOLDS, models=("lasso",))


@staged
def out_of_fold_forest(t):
    return models.repeated_oof(signal(t), "vec_id", "mk", TERMS, RUNS, FOLDS, models=("forest",))


@staged
def out_of_fold_importance(t):
    done = out_of_fold_forest(t)
    return materialize(forest.forest_importance(done.sheets, done.forests))


def out_of_fold_scores(t):
    return out_of_fold_lasso(t).scores.unionByName(out_of_fold_forest(t).scores)


@query("lasso_cv")
def lasso_cv(t):
    fit = models.lasso_cv(signal(t), "vec_id", "mk", TERMS)
    names = F.array(F.lit("(Intercept)"), *[F.lit(x) for x in TERMS]).alias("term")
    values = F.concat(F.array("intercept"), F.col("coefficients")).alias("coefficient")
    return fit.select("penalty", F.explode(F.arrays_zip(names, values)).alias("c")).select("c.term", "c.coefficient", "penalty")


DEALT_SQL = """
dealt as (select vec_id, y, run, (no - 1) % 10 as fold from (select vec_id, y, run, row_number() over (
  partition by run order by substr(md5(concat_ws('|', vec_id, run, 'fold', 0)), 1, 13), vec_id) as no from signal, range(1, 101) r(run)))"""


@query("lasso_audit", f"""
with {SIGNAL_SQL}, {DEALT_SQL},
cells as (select vec_id, unnest(range(66)) as j, unnest(list_concat(embedding::double[], [embedding[1]::double * embedding[2]::double, embedding[3]::double * embedding[6]::double])) as x from embeddings),
parts as (select run, fold, j, count(*) as n, sum(y) as s, sum(x) as sx, sum(x * x) as sxx, sum(x * y) as sxy from dealt join cells using (vec_id) group by all),
whole as (select run, j, sum(n) as n, sum(s) as s, sum(sx) as sx, sum(sxx) as sxx, sum(sxy) as sxy from parts group by all),
train as (select p.run, p.fold, w.n - p.n as n, w.s - p.s as s, w.sx - p.sx as sx, w.sxx - p.sxx as sxx, w.sxy - p.sxy as sxy from parts p join whole w on p.run = w.run and p.j = w.j)
select run::int as run, fold::int as fold, max(n)::bigint as rows, max(s)::bigint as events, round(max(abs(sxy / n - sx / n * s / n) / sqrt(sxx / n - sx / n * sx / n)), 7) as top,
  true as optimal from train group by run, fold""")
def lasso_audit(t):
    """Per run and fold: rows and events fitted on, the first penalty of the path, and whether the returned model meets the optimality
    conditions of its own penalty, recomputed from the rows."""
    done, rows = out_of_fold_lasso(t), signal(t)
    dealt = paths.deal_runs(rows.select("vec_id", "mk"), "vec_id", "mk", list(range(1, RUNS + 1)), FOLDS, 10)
    design = models.design_matrix(rows, TERMS, ["vec_id"])
    checked = paths.optimality(design, dealt, done.fitted, "vec_id", TERMS)
    return checked.join(done.fitted.select("run", "fold", "top"), ["run", "fold"]).select(
        "run", "fold", "rows", "events", F.round("top", 7).alias("top"), (F.col("gap") <= 1e-3).alias("optimal"))


@query("rf_balanced")
def rf_balanced(t):
    return models.rf_balanced(signal(t), "vec_id", "mk", DIMS)


@query("forest_draws", f"""
with {SIGNAL_SQL}, {DEALT_SQL.replace("range(1, 101)", "range(1, 2)")},
placed as (select *, row_number() over (partition by y order by fold, substr(md5(concat_ws('|', vec_id, run, 'place', 0)), 1, 13), vec_id) as place from dealt),
sizes as (select y, fold, count(*) as n, min(place) - 1 as start from placed group by all),
wanted as (select f.fold, t.y, tree, draw, t.total, coalesce(n, 0) as n, coalesce(start, 0) as start from (select distinct fold from placed) f
  cross join (select y, count(*) as total from placed group by y) t cross join range(100) a(tree) cross join range(10) b(draw) left join sizes s on s.y = t.y and s.fold = f.fold),
hits as (select *, floor(('0x' || substr(md5(concat_ws('|', 1, fold, tree, y, draw, 0)), 1, 13))::bigint / 4503599627370496.0 * (total - n)) as hit from wanted)
select fold::int as fold, tree::int as tree, h.y, draw::int as draw, vec_id from (select *, (case when hit < start then hit + 1 else hit + 1 + n end)::bigint as place from hits) h
join placed p on p.y = h.y and p.place = h.place""".replace("p.y = h.y", "p.y = h.y").replace("select fold::int", "select h.fold::int"))
def forest_draws(t):
    """The draws of one run: 10 rows of either class outside the fold, for each of 100 trees of 10 folds."""
    dealt = paths.deal_runs(signal(t).select("vec_id", "mk"), "vec_id", "mk", [1], FOLDS, 10)
    return forest.draws(forest.place_rows(dealt, "vec_id"), "vec_id").select("fold", "tree", "y", "draw", "vec_id")


@query("permutation_importance")
def permutation_importance(t):
    return models.importance_summary(out_of_fold_importance(t))


@query("repeated_oof")
def repeated_oof(t):
    return out_of_fold_scores(t)


@query("repeated_oof_audit", f"""
with {SIGNAL_SQL}, {DEALT_SQL}
select run::int as run, fold::int as fold, model, count(*) as scored, count(distinct vec_id) as patients, sum(y)::bigint as events, 0::bigint as outside
from dealt, (select unnest(['lasso', 'forest']) as model) group by run, fold, model""")
def repeated_oof_audit(t):
    """Every patient is scored once per run and model, in its own fold, under its own label, with a probability."""
    return out_of_fold_scores(t).groupBy("run", "fold", "model").agg(
        F.count(F.lit(1)).alias("scored"), F.countDistinct("patient").alias("patients"),
        F.count_if("label").alias("events"), F.count_if(~F.col("predicted").between(0.0, 1.0)).alias("outside"))


@query("label_permutation_null")
def label_permutation_null(t):
    return models.label_permutation_null(signal(t), "vec_id", "mk", TERMS, RUNS, FOLDS).metrics


@query("permute_labels", """
with hashed as (select vec_id, label < 5 as mk, row_number() over (order by substr(md5(concat_ws('|', vec_id, 5)), 1, 13), vec_id) as mine,
  row_number() over (order by substr(md5(concat_ws('|', vec_id, 6)), 1, 13), vec_id) as theirs from embeddings)
select a.vec_id, b.mk from hashed a join hashed b on a.mine = b.theirs""")
def permute_labels(t):
    return models.permute_labels(vectors(t).select("vec_id", "mk"), "vec_id", "mk", seed=5).select("vec_id", "mk")


@query("with_folds", """
select vec_id, ((row_number() over (order by substr(md5(concat_ws('|', vec_id, 'fold', 3)), 1, 13), vec_id) - 1) % 10)::int as fold from embeddings""")
def with_folds(t):
    return models.with_folds(t.embeddings.select("vec_id"), "vec_id", 10, seed=3)


def matrix(t):
    return materialize(feature_matrix(t))


@query("screen_and_select")
def screen_and_select(t):
    done = modeling.screen_and_select(matrix(t), "user_id", "mk")
    return done.ranked


@query("model_evaluation")
def model_evaluation(t):
    """Chosen terms of the flagship's matrix, 100 imputed runs, every report in long form: report, item, value."""
    rows = matrix(t)
    chosen = modeling.screen_and_select(rows, "user_id", "mk").ranked.select("term").collect()  # at most 58
    done = modeling.model_evaluation(rows, "user_id", "mk", sorted(r[0] for r in chosen), RUNS)
    parts = []
    for name, df in done.reports.items():
        numbers = [c for c, k in df.dtypes if k in ("double", "float", "bigint", "int") and c not in ("run", "grid_no", "patient")]
        item = F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns if c not in numbers])
        parts.append(df.select(F.lit(name).alias("report"), item.alias("item"), *[F.col(c).cast("double").alias(c) for c in numbers]).unpivot(
            ["report", "item"], numbers, "measure", "value"))
    return reduce(DataFrame.unionByName, parts)
