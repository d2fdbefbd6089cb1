"""Linear members of all folds in one pass a step: values against a plain solver, one scan a
step, the vote and the voted path."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from testsieve.operators import learn as L
from testsieve.operators import metrics as M
from testsieve.operators import selection as S

FEATS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    n = 600
    x = rng.normal([0, 50, -3], [1, 20, 0.1], (n, 3))
    y = (x[:, 0] + (x[:, 1] - 50) / 20 + rng.normal(0, 1, n) > 0).astype(float)
    pdf = pd.DataFrame(x, columns=FEATS)
    pdf.loc[rng.random(n) < 0.1, "b"] = np.nan
    pdf["y"] = np.where(rng.random(n) < 0.05, np.nan, y)
    pdf["fold"], pdf["id"], pdf["function_id"] = rng.integers(0, 4, n), range(n), rng.integers(0, 30, n)
    return pdf


@pytest.fixture(scope="module")
def df(spark, data):
    rows = [tuple(None if v != v else float(v) for v in r[:3]) + (None if r.y != r.y else int(r.y), int(r.fold), int(r.id), int(r.function_id))
            for r in data[[*FEATS, "y", "fold", "id", "function_id"]].itertuples(index=False)]
    return spark.createDataFrame(rows, "a double, b double, c double, y int, fold int, id int, function_id int").repartition(5)


def plain(train, test, loss):
    """Plain descent on the penalised loss of one split, to a small gradient."""
    mean = train[FEATS].mean()
    z = train[FEATS].fillna(mean)
    std = z.std(ddof=0)
    scale = lambda p: np.c_[np.ones(len(p)), ((p[FEATS].fillna(mean) - mean) / std).to_numpy()]
    known = train.y.notna()
    a, s = scale(train)[known], np.where(train.y[known] == 1, 1.0, -1.0)
    w, eye = np.zeros(4), np.diag([0.0, 1, 1, 1])
    for _ in range(5000):
        f = a @ w
        if loss == "logistic_regression":
            p = 1 / (1 + np.exp(-f))
            g, top = a.T @ (p - (s > 0)), 0.25
        else:
            g, top = a.T @ (-2 * s * np.maximum(0, 1 - s * f)), 2.0
        g += eye @ w
        w -= g / (top * np.linalg.norm(a, 2) ** 2 + 1)
        if np.abs(g).max() < 1e-10:
            break
    return 1 / (1 + np.exp(-scale(test) @ w))


def test_linear_members_equal_a_plain_solver(df, data):
    got = {r.id: r for r in L.linear_oof(df, FEATS, "y").collect()}
    assert len(got) == len(data)
    for f in range(4):
        test = data[data.fold == f]
        for m in L.LINEAR:
            want = plain(data[data.fold != f], test, m)
            assert [got[i][f"p_{m}"] for i in test.id] == pytest.approx(want.tolist(), abs=1e-6), m


def test_one_pass_a_step_for_all_folds(df, monkeypatch):
    passes, sums = [], L._linear_sums
    monkeypatch.setattr(L, "_linear_sums", lambda *a: passes.append(len(a[-1])) or sums(*a))
    scaling = L.fold_scaling(df, FEATS)
    L.fit_linear(df, FEATS, "y", "fold", scaling)
    assert passes[0] == 8 and len(passes) < 25  # two members, four folds; Newton's steps


def test_one_class_and_no_rows(spark, df):
    only = df.where("y = 1")
    got = L.linear_oof(only, FEATS, "y").collect()
    assert got and all(r.p_logistic_regression == 1.0 and r.p_linear_svm == 1.0 for r in got)
    assert L.oof_scores(df.limit(0), FEATS, "y", members=L.LINEAR).count() == 0
    far = spark.createDataFrame([(float(x), int(x > 0), i % 2) for i, x in enumerate([-9, -8, -7, -6, 6, 7, 8, 9])], "x double, y int, fold int")
    assert all((r.p_logistic_regression > 0.5) == (r.y == 1) for r in L.linear_oof(far, ["x"], "y").collect())  # classes apart: the penalty holds the weights


def test_vote_and_voted_path(df):
    members = ("logistic_regression", "linear_svm", "decision_tree")
    each = {r.id: r for r in L.member_scores(df, FEATS, "y", members=members).collect()}
    voted = {r.id: r.y_prob for r in L.oof_scores(df, FEATS, "y", members=members).collect()}
    assert len(voted) == 600 and all(0 <= p <= 1 for p in voted.values())
    assert all(voted[i] == pytest.approx(sum(r[f"p_{m}"] for m in members) / 3) for i, r in each.items())
    tests = df.withColumnRenamed("id", "test_idx")
    sel = L.voted_selection(tests, FEATS, "y", 0.8, 3, members=members)
    rows = sel.collect()
    assert len(rows) == 600
    by = {}
    for r in rows:
        by.setdefault(r.function_id, []).append(r)
    for part in by.values():
        top = sorted(part, key=lambda r: (-r.y_prob, r.test_idx))[:3]
        keep = {r.test_idx for r in part if r.y_prob >= 0.8} | {r.test_idx for r in top}
        assert {r.test_idx for r in part if r.selected} == keep
    m = M.selection_prf(sel.where("y_true is not null")).first()
    assert m.tp == sum(1 for r in rows if r.selected and r.y_true == 1)
    assert S.flag_selected(sel.drop("selected"), 0.8, 3).where(F.col("selected") == 1).count() == sum(r.selected for r in rows)
