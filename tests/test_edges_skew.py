"""Empty and single-row inputs, a hot key holding a third of the rows, and
closed forms against brute force (SURVEY §5 properties)."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from testsieve.functions.passk import pass_at_k
from testsieve.operators import learn as L
from testsieve.operators import metrics as M
from testsieve.operators import selection as S
from testsieve.operators.ranking import ordinal_within

SCHEMA = "function_id long, test_idx long, y_prob double, y_true int"


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert S.select_threshold_topn(empty, 0.8, 3).count() == 0
    st = M.selection_stats(S.select_threshold_topn(empty, 0.8, 3)).first()
    assert st.total_selected is None or st.total_selected == 0
    p = M.selection_prf(S.flag_selected(empty, 0.8, 3)).first()
    assert (p.tp or 0, p.precision, p.recall, p.f1) == (0, 0.0, 0.0, 0.0)


def test_single_row(spark):
    one = spark.createDataFrame([(1, 0, 0.1, 1)], SCHEMA)
    assert [tuple(r) for r in S.select_threshold_topn(one, 0.8, 5).collect()] == [(1, 0, 0.1, 1)]
    assert S.flag_selected(one, 0.8, 5).first().selected == 1


def test_hot_function_matches_brute_force(spark):
    rnd = random.Random(11)
    rows = [(0, i, round(rnd.random(), 3), rnd.randint(0, 1)) for i in range(3000)]  # a third of all rows
    rows += [(f, i, round(rnd.random(), 3), rnd.randint(0, 1)) for f in range(1, 1500) for i in range(4)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(16)
    pdf = pd.DataFrame(rows, columns=["function_id", "test_idx", "y_prob", "y_true"])
    got = {(r.function_id, r.test_idx) for r in S.flag_selected(df, 0.97, 20).filter("selected = 1").collect()}
    want = set()
    for f, g in pdf.groupby("function_id"):
        g = g.sort_values(["y_prob", "test_idx"], ascending=[False, True])
        keep = set(g[g.y_prob >= 0.97].test_idx) | set(g.head(20).test_idx)
        want |= {(f, t) for t in keep}
    assert got == want


def test_ordinal_within_hot_class(spark):
    df = spark.range(6000).select(F.when(F.col("id") < 4000, 0).otherwise(F.col("id") % 5).alias("c"),
                                  (F.col("id") * 7).alias("v"))
    got = ordinal_within(df, "c", ["v"], out="o", partitions=16, few_classes=False).toPandas()
    for c, g in got.groupby("c"):
        assert sorted(g.o) == list(range(len(g)))
        assert (g.sort_values("v").o.values == np.arange(len(g))).all()


def _mw_brute(x, y):
    allv = np.concatenate([x, y])
    order = pd.Series(allv).rank(method="average").values
    r1 = order[: len(x)].sum()
    u1 = r1 - len(x) * (len(x) + 1) / 2
    n1, n2 = len(x), len(y)
    n = n1 + n2
    _, t = np.unique(allv, return_counts=True)
    sigma = math.sqrt(n1 * n2 / 12 * ((n + 1) - (t ** 3 - t).sum() / (n * (n - 1))))
    z = (max(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / sigma
    return u1, z


def test_mann_whitney_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, size=40).astype(float)
    y = rng.integers(2, 15, size=30).astype(float)
    rows = [("d", "l", 1, float(v)) for v in x] + [("d", "l", 0, float(v)) for v in y]
    df = spark.createDataFrame(rows, "dataset string, llm string, is_valid int, f double")
    r = L.mann_whitney_u(df, ["f"]).first()
    u1, z = _mw_brute(x, y)
    assert r.u == pytest.approx(u1) and r.z == pytest.approx(z)


def test_pass_at_k_matches_combinatorics(spark):
    cases = [(n, c, k) for n in (1, 5, 20) for c in range(0, n + 1, max(1, n // 4)) for k in (1, 2, 10)]
    df = spark.createDataFrame([(n, c) for n, c, _ in cases], "n int, c int")
    for k in (1, 2, 10):
        got = [r.p for r in df.select(pass_at_k(F.col("n"), F.col("c"), k).alias("p")).collect()]
        for (n, c, _), p in zip(cases, got):
            want = 1.0 if n - c < k else 1 - math.comb(n - c, k) / math.comb(n, k)
            assert p == pytest.approx(want, abs=1e-12)
