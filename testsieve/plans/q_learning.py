"""Queries: learning and evaluation and agreement_nb (§2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement as AG
from ..operators import learn as L
from ..operators import metrics as M
from ..operators import selection as S
from ..session import run_path, stored
from ..sources import adapters as A
from .q_tokens import FEAT_RAW_SQL, features
from .q_windows import N, SEL_SQL, T
from .registry import query, r6
from .views import with_views

FEATS = [f"{s}_{t}" for s in ("input", "output") for t in ("mean", "max", "min", "sum", "total", "variance")]
FOLD_SQL = "CAST(CAST(('0x' || substr(md5(CAST({k} AS VARCHAR)), 1, 8)) AS BIGINT) % 5 AS INTEGER)"
LEARN_SQL = FEAT_RAW_SQL + f", fd AS (SELECT *, {FOLD_SQL.format(k='function_id')} AS fold FROM feat)\n"


def learn_frame(spark, sf):
    """Entropy features with group folds (a function never spans two folds)."""
    return S.group_kfold(features(spark, sf), 5)


def nb_sql(src: str, feats, label: str) -> str:
    """Out-of-fold Gaussian NB in SQL (oracle of ``gaussian_nb_oof``): means and population
    variances over the rows outside each fold; rows without label are scored only."""
    stat = ", ".join(f"avg(x.{c}) AS {c}__mu, var_pop(x.{c}) AS {c}__v" for c in feats)
    eps = f"greatest({', '.join(f'var_pop(x.{c})' for c in feats)})" if len(feats) > 1 else f"var_pop(x.{feats[0]})"
    ll = lambda p: p + ".lp" + "".join(f" - 0.5 * ln(2 * pi() * ({p}.{c}__v + {p}.eps)) - (x.{c} - {p}.{c}__mu) * (x.{c} - {p}.{c}__mu) / (2 * ({p}.{c}__v + {p}.eps))"
                                       for c in feats)
    return f"""
, nb_f AS (SELECT DISTINCT fold FROM {src}),
nb_a AS (SELECT f.fold, count(x.fold) AS total, {eps} * 1e-9 AS eps FROM nb_f f LEFT JOIN {src} x ON x.fold <> f.fold AND x.{label} IN (0, 1) GROUP BY f.fold),
nb_p AS (SELECT f.fold, c.cls, CASE WHEN count(x.fold) > 0 THEN ln(count(x.fold) / any_value(a.total)) END AS lp, any_value(a.eps) AS eps, {stat}
         FROM nb_f f CROSS JOIN (VALUES (0), (1)) c(cls) JOIN nb_a a ON a.fold = f.fold
         LEFT JOIN {src} x ON x.fold <> f.fold AND x.{label} = c.cls GROUP BY f.fold, c.cls),
nb_s AS (SELECT x.*, {ll('p0')} AS l0, {ll('p1')} AS l1 FROM {src} x
         LEFT JOIN nb_p p0 ON p0.fold = x.fold AND p0.cls = 0 LEFT JOIN nb_p p1 ON p1.fold = x.fold AND p1.cls = 1),
nb AS (SELECT *, CASE WHEN l1 IS NULL THEN 0.0 WHEN l0 IS NULL THEN 1.0
                      ELSE exp(l1 - greatest(l0, l1)) / (exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1))) END AS y_prob
       FROM nb_s)
"""


def _prf_sql(src: str, truth: str, pred: str, by: str = "") -> str:
    g = f"{by}, " if by else ""
    gb = f"GROUP BY {by}" if by else ""
    return f"""
, cf AS (SELECT {g}CAST(sum(CASE WHEN {truth} = 1 AND {pred} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
                CAST(sum(CASE WHEN {truth} = 0 AND {pred} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
                CAST(sum(CASE WHEN {truth} = 1 AND {pred} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
                CAST(sum(CASE WHEN {truth} = 0 AND {pred} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn FROM {src} {gb}),
pr AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS p,
                 CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS r FROM cf)
SELECT {g}tp, fp, fn, tn, round(CASE WHEN tp + fp + fn + tn = 0 THEN 0.0 ELSE (tp + tn) / (tp + fp + fn + tn) END, 6) AS accuracy,
       round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1
FROM pr"""


# ------------------------------------------------------------------ SQL-checked
_SCALE_STATS = ", ".join(
    f"avg(x.{c}) AS {c}__mean, CASE WHEN sqrt(var_pop(x.{c})) = 0 THEN 1.0 ELSE sqrt(var_pop(x.{c})) END AS {c}__std"
    for c in FEATS)


@query("impute_scale", LEARN_SQL + f"""
, st AS (SELECT f.fold, {_SCALE_STATS} FROM (SELECT DISTINCT fold FROM fd) f JOIN fd x ON x.fold <> f.fold GROUP BY f.fold)
SELECT fd.function_id, fd.test_idx, fd.fold, {", ".join(f"round((coalesce(fd.{c}, st.{c}__mean) - st.{c}__mean) / st.{c}__std, 6) AS {c}" for c in FEATS)}
FROM fd JOIN st ON fd.fold = st.fold""")
def q_impute_scale(spark, sf):
    return r6(L.impute_scale_oof(learn_frame(spark, sf), FEATS).select("function_id", "test_idx", "fold", *FEATS))


@query("score_to_probability", LEARN_SQL + """
SELECT function_id, test_idx, round(1.0 / (1.0 + exp(-(output_mean - input_mean))), 6) AS y_prob FROM fd""")
def q_score_to_probability(spark, sf):
    f = features(spark, sf)
    return r6(f.select("function_id", "test_idx",
                       L.score_to_probability(F.col("output_mean") - F.col("input_mean")).alias("y_prob")))


SCORES_FOLD_SQL = with_views("scores_v") + f", sf5 AS (SELECT *, {FOLD_SQL.format(k='function_id')} AS fold, " \
                                           "CASE WHEN y_prob >= 0.5 THEN 1 ELSE 0 END AS y_pred FROM scores_v)"


@query("fold_metrics", SCORES_FOLD_SQL + _prf_sql("sf5", "y_true", "y_pred", "fold"))
def q_fold_metrics(spark, sf):
    return r6(M.fold_metrics(S.group_kfold(A.scores_v(spark, sf), 5), 0.5))


@query("selection_prf", with_views("scores_v") + f", {SEL_SQL}" + """
, fl AS (SELECT s.y_true, CASE WHEN sel.test_idx IS NULL THEN 0 ELSE 1 END AS selected FROM scores_v s
         LEFT JOIN sel ON s.function_id = sel.function_id AND s.test_idx = sel.test_idx),
cf AS (SELECT CAST(sum(CASE WHEN y_true = 1 AND selected = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
              CAST(sum(CASE WHEN y_true <> 1 AND selected = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
              CAST(sum(CASE WHEN y_true = 1 AND selected = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
              CAST(sum(CASE WHEN y_true <> 1 AND selected = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn FROM fl),
pr AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS r,
              CAST(round_even((tp + fp) * round_even(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 3), 0) AS BIGINT) AS tpr
       FROM cf),
rr AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tpr / (tp + fp) END AS rp, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tpr / (tp + fn) END AS rr
       FROM pr)
SELECT tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall,
       round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1, tpr AS tp_rounded,
       round(CASE WHEN rp + rr = 0 THEN 0.0 ELSE 2 * rp * rr / (rp + rr) END, 6) AS f1_rounded FROM rr""")
def q_selection_prf(spark, sf):
    return r6(M.selection_prf(S.flag_selected(A.scores_v(spark, sf), T, N)))


THRESHOLDS = (0.5, 0.6, 0.7, 0.8, 0.9)
TOP_NS = (0, 1, 2, 3, 5, 7)


@query("threshold_sweep", with_views("scores_v") + f"""
, rk AS (SELECT *, row_number() OVER (PARTITION BY function_id ORDER BY y_prob DESC, test_idx) AS rn FROM scores_v),
g AS (SELECT t.t AS threshold, n.n AS top_n FROM (VALUES {", ".join(f"({t})" for t in THRESHOLDS)}) t(t),
      (VALUES {", ".join(f"({n})" for n in TOP_NS)}) n(n)),
c AS (SELECT g.threshold, g.top_n,
             CAST(sum(CASE WHEN rk.y_prob >= g.threshold OR rk.rn <= g.top_n THEN 1 ELSE 0 END) AS BIGINT) AS selected,
             CAST(sum(CASE WHEN (rk.y_prob >= g.threshold OR rk.rn <= g.top_n) AND rk.y_true = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
             CAST(sum(CASE WHEN rk.y_true = 1 THEN 1 ELSE 0 END) AS BIGINT) AS valid_all, count(*) AS n_all
      FROM g, rk GROUP BY g.threshold, g.top_n),
d AS (SELECT *, selected - tp AS fp, valid_all - tp AS fn FROM c),
e AS (SELECT *, CASE WHEN selected = 0 THEN 0.0 ELSE tp / selected END AS p,
                CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS r FROM d)
SELECT CAST(threshold AS DOUBLE) AS threshold, CAST(top_n AS INTEGER) AS top_n, selected, tp, fp, fn,
       n_all - valid_all - fp AS tn, round(round(p, 3), 6) AS valid_ratio, round(p, 6) AS precision, round(r, 6) AS recall,
       round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM e""")
def q_threshold_sweep(spark, sf):
    return r6(M.threshold_sweep(A.scores_v(spark, sf), THRESHOLDS, TOP_NS))


MW_FEATS = ("input_mean", "output_mean")


# erfc(x), x = z / sqrt(2): the series of erf below 3, the continued fraction above
_NORMAL_P = """CASE WHEN z <= 0 THEN 1.0 WHEN z / sqrt(2) < 3 THEN 1 - 2 / sqrt(pi()) * exp(-z * z / 2) * list_sum(list_transform(range(100),
    lambda i: exp((2 * i + 1) * ln(z / sqrt(2)) + 2 * i * ln(2) + lgamma(i + 1) - lgamma(2 * i + 2))))
  ELSE exp(-z * z / 2) / sqrt(pi()) / (z / sqrt(2)) / list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(80, 0, -1), lambda i: i::DOUBLE)),
    lambda f, i: 1 + i / (z * z) / f) END"""


def _mw_sql(by: str) -> str:
    same = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in [*by.split(", "), "feature"])
    return FEAT_RAW_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + f"""
, lg AS (SELECT {by}, is_valid, 'input_mean' AS feature, input_mean AS value FROM feat
         UNION ALL SELECT {by}, is_valid, 'output_mean', output_mean FROM feat),
rk AS (SELECT *, rank() OVER (PARTITION BY {by}, feature ORDER BY value) AS rmin,
              count(*) OVER (PARTITION BY {by}, feature, value) AS t FROM lg),
mid AS (SELECT *, rmin + (t - 1) / 2.0 AS m FROM rk),
ag AS (SELECT {by}, feature, sum(CASE WHEN is_valid = 1 THEN m ELSE 0 END) AS r1,
              CAST(sum(CASE WHEN is_valid = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n1,
              CAST(sum(CASE WHEN is_valid <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS n2 FROM mid GROUP BY {by}, feature),
ti AS (SELECT {by}, feature, sum(t * t * t - t) AS tie FROM (SELECT DISTINCT {by}, feature, value, t FROM rk)
       GROUP BY {by}, feature),
u AS (SELECT a.*, ti.tie, a.r1 - a.n1 * (a.n1 + 1) / 2.0 AS u1, (a.n1 + a.n2) AS n FROM ag a JOIN ti ON {same('a', 'ti')}),
s AS (SELECT *, sqrt(n1 * n2 / 12.0 * ((n + 1) - tie / (n * greatest(n - 1, 1)))) AS sigma FROM u),
z AS (SELECT *, CASE WHEN sigma > 0 THEN (greatest(u1, n1 * n2 - u1) - n1 * n2 / 2.0 - 0.5) / sigma END AS z,
             tie = 0 AND least(n1, n2) BETWEEN 1 AND 8 AND greatest(n1, n2) <= 1000 AS exact FROM s),
most AS (SELECT coalesce(max(n), 0) AS n FROM z WHERE exact),
-- rank orders by (sizes, U): a value of one sample is put after all of the other, or the other way round
c AS (SELECT 0 AS a, 0 AS b, 0 AS u, 1.0::DOUBLE AS k
      UNION ALL
      SELECT a, b, u, sum(k) FROM (SELECT a + 1 AS a, b, u + b AS u, k FROM c UNION ALL SELECT a, b + 1, u, k FROM c), most
      WHERE a <= 8 AND a + b <= most.n GROUP BY a, b, u),
w AS (SELECT {", ".join("z." + x for x in by.split(", "))}, z.feature, least(1.0, 2 * sum(k) FILTER (WHERE c.u <= least(z.u1, z.n1 * z.n2 - z.u1)) / sum(k)) AS tail
      FROM z JOIN c ON z.exact AND c.a = least(z.n1, z.n2) AND c.b = greatest(z.n1, z.n2) GROUP BY ALL)
SELECT {", ".join("z." + x for x in by.split(", "))}, z.feature, n1, n2, round(u1, 6) AS u, round(z, 6) AS z,
       round(CASE WHEN exact THEN w.tail WHEN z IS NOT NULL THEN {_NORMAL_P} END, 6) AS p
FROM z LEFT JOIN w ON {same('z', 'w')}"""


def _mann_whitney(spark, sf, *by):
    mw = L.mann_whitney_u(features(spark, sf), MW_FEATS, by=by)
    return r6(mw.withColumn("n1", F.col("n1").cast("bigint")).withColumn("n2", F.col("n2").cast("bigint")))


@query("mann_whitney_u", _mw_sql("dataset, llm"))
def q_mann_whitney_u(spark, sf):
    return _mann_whitney(spark, sf, "dataset", "llm")


@query("mann_whitney_u_by_function", _mw_sql("function_id"))
def q_mann_whitney_u_by_function(spark, sf):
    return _mann_whitney(spark, sf, "function_id")


# agreement_nb: features (agreement, token score), label = the first sample's result
NB_FEATS = ["agreement", "score"]


def agreement_frame(spark, sf):
    ex, tests = A.exec_v(spark, sf), A.tests_v(spark, sf)
    t = tests.groupBy("task_id", "test_id").agg(F.avg("score").alias("score"))
    agr = AG.test_agreement(ex, t).join(t, ["task_id", "test_id"])
    lab = ex.filter(F.col("solution_id") == 0).select("task_id", "test_id",
                                                      F.when(F.col("passed"), 1).otherwise(0).alias("is_valid"))
    # a test that the first sample was not run on has no label: it is scored, not counted
    return S.stratified_kfold(agr.join(lab, ["task_id", "test_id"], "left"), 5, "is_valid", ("task_id", "test_id"))


@query("agreement_nb", with_views("exec_v", "tests_v") + """
, pp AS (SELECT DISTINCT task_id, solution_id, test_id FROM exec_v WHERE passed),
nsol AS (SELECT task_id, count(DISTINCT solution_id) AS n FROM pp GROUP BY task_id),
tp AS (SELECT task_id, test_id, count(*) AS c FROM pp GROUP BY task_id, test_id),
tt AS (SELECT task_id, test_id, avg(score) AS score FROM tests_v GROUP BY task_id, test_id),
ag AS (SELECT tt.task_id, tt.test_id, tt.score, CASE WHEN nsol.n IS NULL THEN tt.score ELSE coalesce(tp.c, 0) / nsol.n END AS agreement
       FROM tt LEFT JOIN nsol ON tt.task_id = nsol.task_id LEFT JOIN tp ON tt.task_id = tp.task_id AND tt.test_id = tp.test_id),
lb AS (SELECT ag.*, CASE WHEN e.passed THEN 1 WHEN NOT e.passed THEN 0 END AS is_valid FROM ag
       LEFT JOIN exec_v e ON e.task_id = ag.task_id AND e.test_id = ag.test_id AND e.solution_id = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY is_valid ORDER BY task_id, test_id) - 1 AS r,
             count(*) OVER (PARTITION BY is_valid) AS n FROM lb),
q AS (SELECT *, n // 5 AS q, n - (n // 5) * 5 AS rem FROM r),
src AS (SELECT task_id, test_id, agreement, score, is_valid,
               CAST(CASE WHEN r < rem * (q + 1) THEN r // (q + 1) ELSE rem + (r - rem * (q + 1)) // greatest(q, 1) END AS INTEGER) AS fold
        FROM q)""" + nb_sql("src", NB_FEATS, "is_valid") + """
, pd AS (SELECT is_valid, CASE WHEN y_prob >= 0.5 THEN 1 ELSE 0 END AS pred FROM nb)""" + _prf_sql("pd", "is_valid", "pred"))
def q_agreement_nb(spark, sf):
    nb = L.gaussian_nb_oof(agreement_frame(spark, sf), NB_FEATS, "is_valid")
    return r6(M.confusion(nb.withColumn("pred", F.when(F.col("y_prob") >= 0.5, 1).otherwise(0)), "is_valid", "pred")
              .select("tp", "fp", "fn", "tn", "accuracy", "precision", "recall", "f1"))


@query("gaussian_nb_oof", LEARN_SQL + nb_sql("fd", FEATS, "is_valid") +
       "SELECT function_id, test_idx, fold, round(y_prob, 6) AS y_prob FROM nb")
def q_gaussian_nb_oof(spark, sf):
    return r6(L.gaussian_nb_oof(learn_frame(spark, sf), FEATS, "is_valid").select("function_id", "test_idx", "fold", "y_prob"))


# ------------------------------------------------------------------ linear members
# Newton's method for one scaled feature and an intercept, all folds in one recursion.
@query("logistic_oof", LEARN_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """
, st AS (SELECT f.fold, avg(x.output_mean) AS m, CASE WHEN var_pop(x.output_mean) > 0 THEN sqrt(var_pop(x.output_mean)) ELSE 1.0 END AS d
         FROM (SELECT DISTINCT fold FROM fd) f JOIN fd x ON x.fold <> f.fold GROUP BY f.fold),
z AS (SELECT st.fold AS held, (fd.output_mean - st.m) / st.d AS z, fd.is_valid AS y FROM st JOIN fd ON fd.fold <> st.fold),
w AS (SELECT fold AS held, 0 AS i, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM st
      UNION ALL
      SELECT held, i + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM (
        SELECT w.held, w.i, w.a, w.b, sum(p - y) AS ga, sum((p - y) * z) + w.b AS gb, sum(p * (1 - p)) AS haa, sum(p * (1 - p) * z) AS hab, sum(p * (1 - p) * z * z) + 1 AS hbb
        FROM (SELECT w.held, w.i, w.a, w.b, z.z, z.y, 1 / (1 + exp(-(w.a + w.b * z.z))) AS p FROM w JOIN z ON z.held = w.held WHERE w.i < 20) w
        GROUP BY w.held, w.i, w.a, w.b))
SELECT function_id, test_idx, fd.fold, round(1 / (1 + exp(-(w.a + w.b * (output_mean - st.m) / st.d))), 6) AS y_prob
FROM fd JOIN st ON st.fold = fd.fold JOIN w ON w.held = fd.fold AND w.i = 20""")
def q_logistic_oof(spark, sf):
    df = stored(learn_frame(spark, sf), "learn")
    return r6(L.linear_oof(df, ["output_mean"], "is_valid", members=("logistic_regression",))
              .select("function_id", "test_idx", "fold", F.col("p_logistic_regression").alias("y_prob")))


# ------------------------------------------------------------------ rows only (fitted models)
@query("train_classifiers")
def q_train_classifiers(spark, sf):
    p = L.member_scores(learn_frame(spark, sf), FEATS, "is_valid", folds=[0], members=L.MEMBERS)
    return p.select("function_id", "test_idx", F.inline(F.array(*(
        F.struct(F.lit(m).alias("model"), F.col(f"p_{m}").alias("y_prob")) for m in L.MEMBERS)))).select("model", "function_id", "test_idx", "y_prob")


@query("soft_vote")
def q_soft_vote(spark, sf):
    df = stored(learn_frame(spark, sf), "learn")
    v = L.soft_vote(df.filter(F.col("fold") != 0), df.filter(F.col("fold") == 0), FEATS, "is_valid")
    return v.select("function_id", "test_idx", "is_valid", "y_prob")


@query("oof_scores")
def q_oof_scores(spark, sf):
    return L.oof_scores(learn_frame(spark, sf), FEATS, "is_valid").select("function_id", "test_idx", "fold", "is_valid", "y_prob")


@query("voted_path")
def q_voted_path(spark, sf):
    """Features, balanced folds, out-of-fold vote, selection, and its counts and scores."""
    df = S.group_kfold(features(spark, sf), 5, mode="balanced")
    sel = L.voted_selection(df, FEATS, "is_valid", T, 5, by=("dataset", "llm", "function_id"))
    kept = sel.groupBy("dataset", "llm").agg(F.count(F.lit(1)).alias("tests"), F.sum("selected").alias("kept"),
                                             F.sum(F.col("selected") * F.col("y_true")).alias("kept_valid"))
    return kept.crossJoin(F.broadcast(M.selection_prf(sel)))  # one row


@query("fit_full_pipeline")
def q_fit_full_pipeline(spark, sf):
    df = stored(features(spark, sf).filter(F.col("llm") == "gpt-4o"), "train")
    path = run_path(spark, "models/gpt-4o")
    L.fit_full_pipeline(df, FEATS, "is_valid", path)
    return L.holdout_eval(path, df).groupBy("dataset", "llm").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.avg("y_prob"), 6).alias("mean_y_prob"))


@query("holdout_eval")
def q_holdout_eval(spark, sf):
    df = stored(features(spark, sf).filter(F.col("llm") == "gpt-4o"), "features")
    path = run_path(spark, "models/humaneval-gpt-4o")
    L.fit_full_pipeline(df.filter(F.col("dataset") == "HumanEval"), FEATS, "is_valid", path)
    scored = L.holdout_eval(path, df.filter(F.col("dataset") == "MBPP"))
    sel = S.flag_selected(scored.withColumnRenamed("is_valid", "y_true"), T, 3)
    return sel.select("function_id", "test_idx", "y_true", "y_prob", "selected")
