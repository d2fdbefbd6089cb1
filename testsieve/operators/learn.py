"""Learning and evaluation.

* ``impute_scale_oof`` / ``gaussian_nb_oof``: closed forms over per-fold
  partial aggregates.  Statistics of "all folds but f" are the totals minus
  fold f, so one aggregation pass serves every fold; the per-fold table has
  k x classes rows (a proven bound) and is broadcast back to the rows.
* ``fit_linear``: logistic regression and linear SVM of all folds together, one
  pass over the rows a Newton step.
* Other members by Spark ML (seeded) on shared scaling; soft vote, out-of-fold
  scores, the voted path, full fit + save, hold-out evaluation.
* ``mann_whitney_u``: mid-ranks with ties without sorting a whole group in
  one task (range-partitioned running sums), exact p of small samples.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier)
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .small import bounded_rows

MAX_FOLDS = 100

SEED = 42
VAR_SMOOTHING = 1e-9


# ---------------------------------------------------------------- fold stats
def _fold_moments(df: DataFrame, features: Sequence[str], fold: str, by: Sequence[str] = ()) -> DataFrame:
    """Per (fold, *by): count, and per feature non-null count, mean, population variance."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in features:
        aggs += [F.count(c).alias(f"{c}__n"), F.avg(c).alias(f"{c}__m"), F.var_pop(c).alias(f"{c}__v")]
    return df.groupBy(fold, *by).agg(*aggs)


def _collect_moments(df: DataFrame, features: Sequence[str], fold: str, by: Sequence[str], bound: int) -> list[dict]:
    """The moments as a bounded list of dicts (k folds x classes rows)."""
    rows = bounded_rows(_fold_moments(df, features, fold, by), bound, "fold moments")
    return [r.asDict() for r in rows]


def _merged_moments(rows: list[dict], features: Sequence[str]) -> dict:
    """The moments of several row sets together: deviations are taken from the
    common mean, so values far from 0 lose no digits."""
    out = {"_n": sum(r["_n"] for r in rows)}
    for c in features:
        parts = [(r[f"{c}__n"], r[f"{c}__m"], r[f"{c}__v"]) for r in rows if r[f"{c}__n"]]
        n = sum(k for k, _, _ in parts)
        shift = parts[0][1] if parts else 0.0
        mean = shift + sum(k * (m - shift) for k, m, _ in parts) / n if n else None
        out |= {f"{c}__n": n, f"{c}__m": mean,
                f"{c}__v": sum(k * (v + (m - mean) ** 2) for k, m, v in parts) / n if n else None}
    return out


def _mean_var(m: dict, c: str, n_all: int | None = None) -> tuple[float | None, float | None]:
    n, mean, var = m[f"{c}__n"], m[f"{c}__m"], m[f"{c}__v"]
    if not n:
        return None, None
    return mean, var * n / (n_all if n_all else n)


def impute_scale_oof(df: DataFrame, features: Sequence[str], fold: str = "fold") -> DataFrame:
    """Mean imputation then standardisation (population deviation, scale 1
    when the deviation is 0), both fitted on the training folds only (a feature
    without known training values: mean 0, scale 1).
    Fit = one aggregation to per-fold moments; the k-row parameter table is
    broadcast back."""
    df = stored(df, "scaled")  # read twice: for the moments, then for the rows
    spark = df.sparkSession
    params = [(f, *(v for both in zip(s.mean, s.std, strict=True) for v in both)) for f, s in fold_scaling(df, features, fold).items()]
    schema = f"{fold} int, " + ", ".join(f"`{c}__mean` double, `{c}__std` double" for c in features)
    st = spark.createDataFrame(params, schema)
    out = df.join(F.broadcast(st), fold)  # k rows
    for c in features:
        out = out.withColumn(c, (F.coalesce(F.col(c), F.col(f"{c}__mean")) - F.col(f"{c}__mean")) / F.col(f"{c}__std"))
    return out.drop(*[f"{c}__{t}" for c in features for t in ("mean", "std")])


def gaussian_nb_oof(df: DataFrame, features: Sequence[str], label: str, fold: str = "fold",
                    out: str = "y_prob", classes: Sequence[int] = (0, 1)) -> DataFrame:
    """Out-of-fold Gaussian naive Bayes, closed form: for held-out fold f the
    class priors, means and population variances come from the other folds;
    variances are smoothed by 1e-9 x the largest feature variance of the
    training rows.  ``out`` = P(label = 1 | x).

    Fit: one pass over ``df`` to (fold, class) moments (k x classes rows);
    the per-fold parameters follow from those moments, as Spark ML's own naive
    Bayes does from its aggregated sums.  Transform: one broadcast join."""
    df = stored(df, "nb")  # read twice: for the moments, then for the scores
    rows = _collect_moments(df, features, fold, [label], MAX_FOLDS * len(classes))
    spark = df.sparkSession
    folds = sorted({r[fold] for r in rows})
    params = []
    for f in folds:
        train = [r for r in rows if r[fold] != f and r[label] in classes]
        total = _merged_moments(train, features)
        variances = [_mean_var(total, c)[1] for c in features]
        eps = VAR_SMOOTHING * max(v for v in variances if v is not None) if any(v is not None for v in variances) else 0.0
        vals = [f]
        for cls in classes:
            cm = _merged_moments([r for r in train if r[label] == cls], features)
            vals.append(math.log(cm["_n"] / total["_n"]) if cm["_n"] else None)
            for c in features:
                mu, var = _mean_var(cm, c)
                vals += [mu, var + eps if var is not None else None]
        params.append(tuple(vals))
    schema = f"{fold} int, " + ", ".join(
        f"`{cls}__logprior` double, " + ", ".join(f"`{cls}_{c}__mu` double, `{cls}_{c}__var` double" for c in features)
        for cls in classes)
    wide = spark.createDataFrame(params, schema)
    j = df.join(F.broadcast(wide), fold, "left")

    def loglik(cls: int) -> Column:
        ll = F.col(f"{cls}__logprior")
        for c in features:
            mu, var = F.col(f"{cls}_{c}__mu"), F.col(f"{cls}_{c}__var")
            ll = ll - 0.5 * F.log(2 * math.pi * var) - (F.col(c) - mu) * (F.col(c) - mu) / (2 * var)
        return ll

    l0, l1 = loglik(classes[0]), loglik(classes[1])
    mx = F.greatest(l0, l1)
    p1 = F.exp(l1 - mx) / (F.exp(l0 - mx) + F.exp(l1 - mx))
    # a class absent from the training folds has no parameters: its probability is 0
    p1 = (F.when(F.col(f"{classes[1]}__logprior").isNull(), F.lit(0.0))
          .when(F.col(f"{classes[0]}__logprior").isNull(), F.lit(1.0)).otherwise(p1))
    return j.select(*df.columns, p1.alias(out))


# ---------------------------------------------------------------- linear members, all folds at once
class Scaling(NamedTuple):
    """Of the rows outside a fold: means of the known values and population deviations after
    imputation (1 where it is 0), by feature, and the number of rows."""
    mean: list[float]
    std: list[float]
    n: int


def fold_scaling(df: DataFrame, features: Sequence[str], fold: str = "fold") -> dict[int, Scaling]:
    """The scaling of every fold's training rows from one aggregation to per-fold moments."""
    rows = _collect_moments(df, features, fold, (), MAX_FOLDS)
    out = {}
    for r in rows:
        train = _merged_moments([o for o in rows if o[fold] != r[fold]], features)
        both = [_mean_var(train, c, train["_n"]) for c in features]
        out[r[fold]] = Scaling([m if m is not None else 0.0 for m, _ in both],
                               [math.sqrt(v) if v is not None and v > 0 else 1.0 for _, v in both], train["_n"])
    return out


LINEAR = ("logistic_regression", "linear_svm")
STEPS = 100  # most passes over the rows


def _logistic(f: np.ndarray, s: np.ndarray):
    """Loss, its derivative and second derivative by the margin f; s is -1 or 1."""
    p = 1.0 / (1.0 + np.exp(-np.clip(f, -700, 700)))
    return np.logaddexp(0.0, -s * f), p - (s > 0), p * (1.0 - p)


def _squared_hinge(f: np.ndarray, s: np.ndarray):
    short = np.maximum(0.0, 1.0 - s * f)
    return short**2, -2.0 * s * short, np.where(short > 0, 2.0, 0.0)


_LOSS = {"logistic_regression": _logistic, "linear_svm": _squared_hinge}


def _linear_sums(df: DataFrame, features: Sequence[str], label: str, fold: str,
                 models: list[tuple[str, int, Scaling, list[float]]]) -> list[tuple[float, np.ndarray, np.ndarray, int, int]]:
    """(loss, gradient, Hessian, rows, rows of label 1) of every model (member, held-out fold,
    scaling, weights with the intercept first) over the rows outside its fold: one pass
    over ``df`` for all, a row of sums for each model and task, added up by Spark."""
    d = len(features) + 1
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(models), 3 + d + len(upper[0])))
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns[2:]], 1) if len(features) else np.empty((b.num_rows, 0))
            y, folds = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for k, (name, held, scaling, w) in enumerate(models):
                rows = folds != held
                z = (np.where(np.isnan(x[rows]), scaling.mean, x[rows]) - scaling.mean) / scaling.std
                z = np.concatenate([np.ones((len(z), 1)), z], 1)
                s = np.where(y[rows] == 1, 1.0, -1.0)
                loss, first, second = _LOSS[name](z @ np.array(w), s)
                sums[k] += np.concatenate([[len(s), (s > 0).sum(), loss.sum()], z.T @ first, ((z * second[:, None]).T @ z)[upper]])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(models)), sums.shape[1])), pa.array(np.tile(np.arange(sums.shape[1]), len(models))),
                                          pa.array(sums.ravel())], names=["model", "at", "part"])

    rows = df.where(F.col(label).isNotNull()).select(F.col(label).cast("int"), F.col(fold).cast("int"), *(F.col(c).cast("double") for c in features))
    found = rows.mapInArrow(run, "model long, at long, part double").groupBy("model", "at").agg(F.sum("part").alias("sum"))
    sums = np.zeros((len(models), 3 + d + len(upper[0])))
    for r in found.collect():  # as many rows as the models have parameters and pairs of them
        sums[r["model"], r["at"]] = r["sum"]
    out = []
    for row in sums:
        h = np.zeros((d, d))
        h[upper] = row[3 + d:]
        out.append((row[2], row[3:3 + d], h + np.triu(h, 1).T, int(row[0]), int(row[1])))
    return out


def fit_linear(df: DataFrame, features: Sequence[str], label: str, fold: str, scaling: dict[int, Scaling],
               members: Sequence[str] = LINEAR, tolerance: float = 1e-10) -> dict[tuple[str, int], list[float]]:
    """Weights (intercept first) of the linear members for every fold in ``scaling``, fitted on the
    rows outside it with an L2 penalty of C = 1 on the summed loss (logistic, or squared
    hinge for the support vector machine), the intercept free.

    Newton's method with halved steps where the objective rises; each pass over ``df``
    serves all members and folds.  Training rows of one class alone give an infinite
    intercept (probability 0 or 1)."""
    d = len(features) + 1
    penalty = np.r_[0.0, np.ones(d - 1)]
    keys = [(m, f) for m in members for f in scaling]
    weight, best = {k: np.zeros(d) for k in keys}, dict.fromkeys(keys, math.inf)
    step, trial, done = {}, {k: np.zeros(d) for k in keys}, {}
    for _ in range(STEPS):
        left = [k for k in keys if k not in done]
        if not left:
            break
        got = _linear_sums(df, features, label, fold, [(m, f, scaling[f], trial[m, f].tolist()) for m, f in left])
        for k, (loss, gradient, hessian, n, ones) in zip(left, got, strict=True):
            if ones in (0, n):
                done[k] = [math.inf if n and ones else -math.inf, *[0.0] * (d - 1)]
                continue
            objective = loss + 0.5 * (penalty * trial[k] ** 2).sum()
            if objective > best[k] + 1e-12 * abs(best[k]) and np.abs(step[k]).max() > tolerance:
                step[k] = step[k] / 2
            else:
                weight[k], best[k] = trial[k], objective
                step[k] = -np.linalg.solve(hessian + np.diag(penalty + 1e-9), gradient + penalty * trial[k])
                if np.abs(step[k]).max() <= tolerance * (1 + np.abs(weight[k]).max()):
                    done[k] = (weight[k] + step[k]).tolist()
            trial[k] = weight[k] + step[k]
    return done | {k: weight[k].tolist() for k in keys if k not in done}


def linear_oof(df: DataFrame, features: Sequence[str], label: str, fold: str = "fold", members: Sequence[str] = LINEAR,
               scaling: dict[int, Scaling] | None = None) -> DataFrame:
    """``df`` with a column ``p_<member>``: the probability of label 1 by the member fitted on the
    other folds (the sigmoid of the margin).  ``df`` is read once for the scaling and
    once a step; pass a stored table."""
    scaling = fold_scaling(df, features, fold) if scaling is None else scaling
    fitted = fit_linear(df, features, label, fold, scaling, members)
    names = [f"_w_{m}" for m in members]
    rows = [(f, s.mean, s.std, *(fitted[m, f] for m in members)) for f, s in scaling.items()]
    table = df.sparkSession.createDataFrame(rows, f"_fold int, _mean array<double>, _std array<double>, {', '.join(f'{n} array<double>' for n in names)}")
    out = df.join(F.broadcast(table), F.col(fold) == F.col("_fold"), "left")  # k rows
    for m, n in zip(members, names, strict=True):
        margin = F.get(n, 0)
        for i, c in enumerate(features):
            mean = F.get("_mean", i)
            margin = margin + F.get(n, i + 1) * (F.coalesce(F.col(c).cast("double"), mean) - mean) / F.get("_std", i)
        out = out.withColumn(f"p_{m}", score_to_probability(margin))
    return out.drop("_fold", "_mean", "_std", *names)


# ---------------------------------------------------------------- Spark ML
def member(name: str, n_train: int | None = None):
    """Model registry: the reference's model names that Spark ML provides.
    An L2 penalty of C = 1 on summed losses is regParam = 1 / n on Spark's
    mean loss."""
    reg = 1.0 / n_train if n_train else 0.0
    if name == "logistic_regression":
        return LogisticRegression(maxIter=100, regParam=reg)
    if name == "decision_tree":
        return DecisionTreeClassifier(seed=SEED, maxDepth=12)
    if name == "random_forest":
        return RandomForestClassifier(numTrees=100, maxDepth=12, seed=SEED)
    if name == "gradient_boosting":
        return GBTClassifier(maxIter=50, maxDepth=3, stepSize=0.1, seed=SEED)
    if name == "gaussian_nb":
        return NaiveBayes(modelType="gaussian")
    if name == "mlp":
        return MultilayerPerceptronClassifier(seed=SEED, maxIter=200)
    if name == "linear_svm":
        return LinearSVC(maxIter=100, regParam=reg)
    raise ValueError(name)


# every factory model with a Spark ML estimator
MEMBERS = ("logistic_regression", "decision_tree", "random_forest", "gradient_boosting", "gaussian_nb", "mlp", "linear_svm")
# the soft-vote ensemble: its linear, kernel-machine, forest and boosting members
# (the boosted-tree variants collapse onto one GBT; the kernel SVM onto a linear one)
ENSEMBLE = ("logistic_regression", "linear_svm", "random_forest", "gradient_boosting")


def score_to_probability(raw: Column) -> Column:
    """Sigmoid of a decision margin for models without probabilities."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-raw))


def fit_member(train: DataFrame, features: Sequence[str], label: str, name: str, n_train: int | None = None) -> PipelineModel:
    """One member with its own imputer and scaler, as a pipeline that can be saved."""
    t = train.withColumn(label, F.col(label).cast("double"))
    if n_train is None and name in LINEAR:
        n_train = t.count()
    est = member(name, n_train)
    if name == "mlp":
        est = est.setLayers([len(features), 16, 2])
    est = est.setLabelCol(label).setFeaturesCol("_features")
    stages = [Imputer(inputCols=list(features), outputCols=[f"_imp_{c}" for c in features], strategy="mean"),
              VectorAssembler(inputCols=[f"_imp_{c}" for c in features], outputCol="_raw"),
              StandardScaler(inputCol="_raw", outputCol="_features", withMean=True, withStd=True), est]
    return Pipeline(stages=stages).fit(t)


def predict_proba(model, df: DataFrame, name: str, out: str = "y_prob") -> DataFrame:
    p = model.transform(df)
    if name == "linear_svm":
        prob = score_to_probability(vector_to_array("rawPrediction")[1])
    else:
        # a model that has seen label 0 alone has a probability for that one only
        prob = F.coalesce(F.get(vector_to_array("probability"), 1), F.lit(0.0))
    return p.select(*df.columns, prob.alias(out))


def scaled(df: DataFrame, features: Sequence[str], s: Scaling) -> DataFrame:
    """``df`` with the imputed and scaled features as a vector, by parameters at hand."""
    columns = [((F.coalesce(F.col(c).cast("double"), F.lit(m)) - m) / d) for c, m, d in zip(features, s.mean, s.std, strict=True)]
    return df.withColumn("_features", array_to_vector(F.array(*columns)))


def _fit_scaled(job):
    train, features, label, name = job
    est = member(name)
    if name == "mlp":
        est = est.setLayers([len(features), 16, 2])
    return est.setLabelCol(label).setFeaturesCol("_features").fit(train.withColumn(label, F.col(label).cast("double")))


def fit_all(jobs: list[tuple], parallelism: int) -> list:
    """Fit (scaled train, features, label, name) jobs; like CrossValidator's
    ``parallelism``, several fits are submitted at once from driver threads so
    small fits do not leave the cluster idle."""
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        return list(pool.map(_fit_scaled, jobs))


def member_scores(df: DataFrame, features: Sequence[str], label: str, fold: str = "fold", folds: Sequence[int] | None = None,
                  members: Sequence[str] = ENSEMBLE, parallelism: int = 8) -> DataFrame:
    """The rows of the held-out ``folds`` (default: all) with ``p_<member>``, the probability by
    each member fitted on the other folds.

    The rows are stored once; one aggregation gives every fold's imputation and scaling,
    shared by all members; the linear members of all folds are fitted together, one
    pass a step; the others by Spark ML on the scaled rows, several at once."""
    base = stored(df, "members")
    scaling = fold_scaling(base, features, fold)
    scaling = {f: s for f, s in scaling.items() if folds is None or f in folds}
    linear = [m for m in members if m in LINEAR]
    others = [m for m in members if m not in LINEAR]
    scored = linear_oof(base, features, label, fold, linear, scaling) if linear else base
    known = base.where(F.col(label).isNotNull())
    jobs = [(scaled(known.where(F.col(fold) != f), features, s), features, label, m) for f, s in scaling.items() for m in others]
    models = dict(zip(((f, m) for f in scaling for m in others), fit_all(jobs, parallelism), strict=True))
    if not others:
        return scored.where(F.col(fold).isin(list(scaling)))
    out = scored.where("false").withColumns({f"p_{m}": F.lit(None).cast("double") for m in others})
    for f, s in scaling.items():
        part = scaled(scored.where(F.col(fold) == f), features, s)
        for m in others:
            part = predict_proba(models[f, m], part, m, f"p_{m}")
        out = out.unionByName(part.drop("_features"))
    return out


def _vote(members: Sequence[str]) -> Column:
    cols = [F.col(f"p_{m}") for m in members]
    return sum(cols[1:], cols[0]) / len(cols)


def soft_vote(train: DataFrame, test: DataFrame, features: Sequence[str], label: str,
              members: Sequence[str] = ENSEMBLE, out: str = "y_prob", parallelism: int = 8) -> DataFrame:
    """Mean of the members' class-1 probabilities (members fitted on ``train``)."""
    both = test.withColumn("_part", F.lit(0)).unionByName(train.withColumn("_part", F.lit(1)))
    scored = member_scores(both, features, label, "_part", [0], members, parallelism)
    return scored.select(*test.columns, _vote(members).alias(out))


def oof_scores(df: DataFrame, features: Sequence[str], label: str, fold: str = "fold", k: int | None = None,
               members: Sequence[str] = ENSEMBLE, parallelism: int = 8) -> DataFrame:
    """Out-of-fold y_prob for every row: the vote of the members fitted on the other folds
    (``member_scores``); ``k``: folds 0 .. k - 1 alone."""
    scored = member_scores(df, features, label, fold, None if k is None else range(k), members, parallelism)
    return scored.select(*df.columns, _vote(members).alias("y_prob"))


def voted_selection(df: DataFrame, features: Sequence[str], label: str, threshold: float, top_n: int, fold: str = "fold",
                    by: Sequence[str] = ("function_id",), members: Sequence[str] = ENSEMBLE) -> DataFrame:
    """The path from features to kept tests: out-of-fold vote, then every test at or above the
    threshold and at least ``top_n`` of each function.  All rows, with ``y_prob``, ``y_true``
    and ``selected``; scores are stored, since cutoffs and flags both read them."""
    from . import selection
    scored = stored(oof_scores(df, features, label, fold, members=members).withColumnRenamed(label, "y_true"), "voted")
    return selection.flag_selected(scored, threshold, top_n, by=by)


def fit_full_pipeline(train: DataFrame, features: Sequence[str], label: str, path: str,
                      name: str = "logistic_regression") -> PipelineModel:
    """Fit one member on the union of several datasets and save it."""
    model = fit_member(train, features, label, name)
    model.write().overwrite().save(path)
    return model


def holdout_eval(path: str, holdout: DataFrame, name: str = "logistic_regression") -> DataFrame:
    """Apply a saved pipeline to a left-out dataset: y_prob per test."""
    return predict_proba(PipelineModel.load(path), holdout, name)


# ---------------------------------------------------------------- Mann-Whitney
EXACT_SMALL, EXACT_LARGE = 8, 1000  # sizes of the smaller and larger sample up to which untied samples get the exact p


def mann_whitney_u(df: DataFrame, features: Sequence[str], label: str = "is_valid",
                   by: Sequence[str] = ("dataset", "llm")) -> DataFrame:
    """Two-sided Mann-Whitney U of valid (label 1) vs invalid per group and
    feature: U of the valid sample, tie-corrected z (with continuity
    correction on the larger U, as the usual asymptotic test) and p.

    Mid-ranks depend only on per-value counts: rows collapse to (group,
    value) counts first (ties merge in the partial aggregation), a weighted
    running count over the distinct values gives each value's first rank,
    and U sums n_valid(v) x midrank(v) — no per-row ranks, no join back.

    p is exact where no values tie and the smaller sample has at most ``EXACT_SMALL``
    and the larger at most ``EXACT_LARGE`` values, else the normal tail of z; null where a
    sample is empty or all values are equal."""
    from .ranking import weight_before
    long = df.select(*by, label, F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                                                     for c in features]))).filter(F.col("value").isNotNull())
    long = long.withColumn("_g", F.concat_ws("\u0001", *[F.col(b).cast("string") for b in by], F.col("feature")))
    counts = long.groupBy("_g", *by, "feature", "value").agg(
        F.count(F.lit(1)).alias("_t"), F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("_t1"))
    ranked = weight_before(counts, "_g", ["value"], "_t", out="_before")
    mid = F.col("_before") + (F.col("_t") + 1) / 2.0
    per = ranked.groupBy("_g", *by, "feature").agg(
        F.sum(F.col("_t1") * mid).alias("_r1"),
        F.sum("_t1").alias("n1"), F.sum(F.col("_t") - F.col("_t1")).alias("n2"),
        F.sum(F.pow(F.col("_t"), 3) - F.col("_t")).alias("_tie"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u1 = F.col("_r1") - n1 * (n1 + 1) / 2
    mu = n1 * n2 / 2
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("_tie") / (n * F.greatest(n - 1, F.lit(1.0)))))
    u = F.greatest(u1, n1 * n2 - u1)
    z = F.when(sigma > 0, (u - mu - 0.5) / sigma)
    per = per.select(*by, "feature", "n1", "n2", u1.alias("u"), z.alias("z"), F.col("_tie"))
    small, large = F.least("n1", "n2"), F.greatest("n1", "n2")
    per = per.withColumn("_exact", (F.col("_tie") == 0) & (small > 0) & (small <= EXACT_SMALL) & (large <= EXACT_LARGE))
    return with_exact_tail(per, "_exact").withColumn("p", F.coalesce("_tail", normal_two_sided(F.col("z")))).drop("_tie", "_exact", "_tail")


def normal_two_sided(z: Column) -> Column:
    """min(1, 2 * (1 - Phi(z))) = erfc(z / sqrt 2): the series of erf below 3, the
    continued fraction of erfc from there on."""
    x = z / math.sqrt(2.0)
    series = F.aggregate(F.sequence(F.lit(0), F.lit(90)), F.struct(x.alias("term"), F.lit(0.0).alias("sum")),
                         lambda s, i: F.struct((s["term"] * 2 * x * x / (2 * i + 3)).alias("term"), (s["sum"] + s["term"]).alias("sum")),
                         lambda s: s["sum"])
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), F.lit(1.0), lambda f, i: F.lit(1.0) + i / (2 * x * x) / f)
    tail = F.exp(-x * x) / math.sqrt(math.pi)
    return F.when(x <= 0, F.lit(1.0)).when(x < 3, 1 - 2 * tail * series).when(x.isNotNull(), tail / (x * fraction))


def with_exact_tail(per: DataFrame, where: str) -> DataFrame:
    """Add ``_tail`` where ``where``: twice the chance (at most 1) that the U of samples of ``n1`` and
    ``n2`` untied values is as far from its mean as ``u``, by counting.

    The number of rank orders of each U is a coefficient of the Gaussian binomial
    prod (1 - q^(large+i)) / (1 - q^i), i = 1 .. small, which is multiplied out up to the
    smaller U: each factor is one pass over an array."""
    small, large = F.least("n1", "n2").cast("int"), F.greatest("n1", "n2").cast("int")
    u = F.least(F.col("u"), F.col("n1") * F.col("n2") - F.col("u")).cast("int")
    c = F.when(F.col(where), F.transform(F.sequence(F.lit(0), u), lambda j: F.when(j == 0, F.lit(1.0)).otherwise(0.0)))
    df = per.withColumn("_c", c)
    for i in range(1, EXACT_SMALL + 1):
        less = F.transform("_c", lambda x, j: x - F.when(j >= large + i, F.get("_c", j - large - i)).otherwise(0.0))
        df = df.withColumn("_d", F.when(small >= i, less))
        sums = F.aggregate("_d", F.array().cast("array<double>"), lambda acc, x: F.concat(acc, F.array(
            x + F.coalesce(F.get(acc, F.size(acc) - i), F.lit(0.0)))))
        df = df.withColumn("_c", F.when(small >= i, sums).otherwise(F.col("_c")))
    orders = F.aggregate(F.sequence(F.lit(1), F.greatest(small, F.lit(1))), F.lit(1.0), lambda a, i: a * (large + i) / i)
    tail = F.least(F.lit(1.0), 2 * F.aggregate("_c", F.lit(0.0), lambda a, x: a + x) / orders)
    return df.withColumn("_tail", F.when(F.col(where), tail)).drop("_c", "_d")
