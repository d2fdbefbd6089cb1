"""FIXTURES §4 selection goldens, metric arithmetic, and properties of the
selection / fold operators checked against brute force."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from testsieve.operators import learn as L
from testsieve.operators import metrics as M
from testsieve.operators import selection as S

SCORES = [(1, 0, 0.95, 1), (1, 1, 0.85, 1), (1, 2, 0.60, 0), (1, 3, 0.10, 0),
          (2, 0, 0.40, 1), (2, 1, 0.40, 0), (2, 2, 0.30, 0), (3, 0, 0.20, 0)]
SCHEMA = "function_id long, test_idx long, y_prob double, y_true int"


@pytest.fixture(scope="module")
def scores(spark):
    return spark.createDataFrame(SCORES, SCHEMA)


@pytest.mark.parametrize("t,n,selected,total,ratio,conf", [
    (0.8, 1, {(1, 0), (1, 1), (2, 0), (3, 0)}, 4, 0.75, (3, 1, 0, 4)),
    (0.8, 3, {(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (3, 0)}, 7, 0.429, (3, 4, 0, 1)),
    (0.8, 0, {(1, 0), (1, 1)}, 2, 1.0, (2, 0, 1, 5)),
    (0.5, 2, {(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (3, 0)}, 6, 0.5, (3, 3, 0, 2)),
])
def test_selection_goldens(spark, scores, t, n, selected, total, ratio, conf):
    sel = S.select_threshold_topn(scores, t, n)
    assert {(r.function_id, r.test_idx) for r in sel.collect()} == selected
    st = M.selection_stats(sel).first()
    assert st.total_selected == total and st.valid_ratio == ratio
    flagged = S.flag_selected(scores, t, n)
    assert {(r.function_id, r.test_idx) for r in flagged.filter("selected = 1").collect()} == selected
    p = M.selection_prf(flagged).first()
    assert (p.tp, p.fp, p.fn, p.tn) == conf


def test_rounded_tp_reproduces_published_arithmetic(spark):
    # 2512 selected at ratio 0.918 -> rounded TP 2306 while the exact count is 2307
    rows = [(i, 0, 0.9, 1 if i < 2307 else 0) for i in range(2512)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("selected", F.lit(1))
    p = M.selection_prf(df).first()
    assert p.tp == 2307 and p.tp_rounded == 2306


def _brute(pdf, t, n):
    out = set()
    for fid, g in pdf.groupby("function_id"):
        g = g.sort_values(["y_prob", "test_idx"], ascending=[False, True])
        above = g[g.y_prob >= t]
        keep = set(above.test_idx)
        if len(above) < n:
            rest = g[~g.test_idx.isin(keep)].head(n - len(above))
            keep |= set(rest.test_idx)
        out |= {(fid, x) for x in keep}
    return out


def test_selection_matches_brute_force_and_is_monotone(spark):
    rnd = random.Random(7)
    rows = [(f, i, round(rnd.random(), 2), rnd.randint(0, 1)) for f in range(12) for i in range(rnd.randint(1, 9))]
    df = spark.createDataFrame(rows, SCHEMA)
    pdf = pd.DataFrame(rows, columns=["function_id", "test_idx", "y_prob", "y_true"])
    prev = None
    for t, n in [(0.9, 0), (0.9, 2), (0.7, 2), (0.5, 3), (0.5, 5)]:
        got = {(r.function_id, r.test_idx) for r in S.select_threshold_topn(df, t, n).collect()}
        assert got == _brute(pdf, t, n)
        if prev is not None:
            assert prev <= got  # lower threshold / larger N never drops a test
        prev = got
        sizes = Counter(f for f, *_ in rows)
        kept = Counter(f for f, _ in got)
        for f, size in sizes.items():
            assert kept[f] >= min(n, size)


def test_threshold_sweep_matches_brute_force(spark):
    rnd = random.Random(3)
    rows = [(f, i, round(rnd.random(), 2), rnd.randint(0, 1)) for f in range(15) for i in range(rnd.randint(1, 8))]
    df = spark.createDataFrame(rows, SCHEMA)
    pdf = pd.DataFrame(rows, columns=["function_id", "test_idx", "y_prob", "y_true"])
    res = {(r.threshold, r.top_n): r for r in M.threshold_sweep(df, (0.5, 0.8), (0, 1, 3)).collect()}
    valid = {(f, i) for f, i, _, y in rows if y == 1}
    for (t, n), r in res.items():
        sel = _brute(pdf, t, n)
        tp = len(sel & valid)
        assert (r.selected, r.tp, r.fp, r.fn) == (len(sel), tp, len(sel) - tp, len(valid) - tp)


def test_group_kfold_group_in_one_fold(spark):
    df = spark.range(2000).select((F.col("id") % 97).alias("function_id"), F.col("id").alias("test_idx"))
    f = S.group_kfold(df, 5)
    assert f.groupBy("function_id").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0
    assert {r.fold for r in f.select("fold").distinct().collect()} <= set(range(5))


def test_stratified_kfold_sizes(spark):
    rows = [(i, i, 1 if i % 3 else 0) for i in range(23)]
    df = spark.createDataFrame(rows, "function_id long, test_idx long, y_true int")
    f = S.stratified_kfold(df, 5).toPandas()
    for _, g in f.groupby("y_true"):
        sizes = g.groupby("fold").size().tolist()
        assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(g)
        # contiguous in key order
        assert g.sort_values("test_idx").fold.is_monotonic_increasing


def test_ordinal_within_matches_row_number(spark):
    from pyspark.sql import Window

    from testsieve.operators.ranking import ordinal_within
    df = spark.range(500).select((F.col("id") % 3).alias("c"), ((F.col("id") * 7919) % 501).alias("v"))
    got = ordinal_within(df, "c", ["v"], out="o", partitions=7)
    ref = df.withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy("v")) - 1)
    a = {(r.c, r.v): r.o for r in got.collect()}
    b = {(r.c, r.v): r.r for r in ref.collect()}
    assert a == b


def test_balance_classes(spark):
    rows = [(i // 4, i, 1 if i % 5 else 0) for i in range(100)]
    df = spark.createDataFrame(rows, "function_id long, test_idx long, is_valid int")
    b = S.balance_classes(df).groupBy("is_valid").count().collect()
    assert sorted(r["count"] for r in b) == [20, 20]
    again = {(r.function_id, r.test_idx) for r in S.balance_classes(df.repartition(7)).collect()}
    assert again == {(r.function_id, r.test_idx) for r in S.balance_classes(df).collect()}


def test_stride_downsample(spark):
    rows = [(1, i) for i in range(12)] + [(2, i) for i in range(3)]
    df = spark.createDataFrame(rows, "function_id long, test_idx long")
    got = sorted((r.function_id, r.test_idx) for r in S.stride_downsample(df, 5).collect())
    assert got == [(1, 0), (1, 2), (1, 4), (1, 6), (1, 8), (2, 0), (2, 1), (2, 2)]


def test_results_invariant_to_partitioning(spark, scores):
    a = {tuple(r) for r in S.select_threshold_topn(scores, 0.8, 3).collect()}
    b = {tuple(r) for r in S.select_threshold_topn(scores.repartition(5), 0.8, 3).collect()}
    assert a == b


def test_group_kfold_balanced(spark):
    rows = [(g, i) for g in range(23) for i in range(g % 7 + 1)]
    df = spark.createDataFrame(rows, "function_id long, test_idx long")
    f = S.group_kfold(df, 5, mode="balanced").toPandas()
    assert (f.groupby("function_id").fold.nunique() == 1).all()
    sizes = f.groupby("fold").size()
    assert len(sizes) == 5 and sizes.max() - sizes.min() <= 7


def greedy(sizes, k):
    load, out = [0] * k, {}
    for g in sorted(sizes, key=lambda g: (-sizes[g], g)):
        out[g] = load.index(min(load))
        load[out[g]] += sizes[g]
    return out


def test_deal_equals_the_greedy_rule():
    rng = random.Random(8)
    for _ in range(400):
        k = rng.randint(1, 7)
        sizes = {g: rng.choice([1, 1, 2, 3, rng.randint(1, 9), rng.randint(1, 60)]) for g in range(rng.randint(0, 80))}
        histogram = Counter(sizes.values())
        runs, got = dict(S._deal(list(histogram.items()), k)), {}
        for size in histogram:
            for nth, g in enumerate(sorted(g for g in sizes if sizes[g] == size)):
                first, folds = [r for r in runs[size] if r[0] <= nth][-1]
                got[g] = folds[(nth - first) % len(folds)]
        assert got == greedy(sizes, k)


def test_group_kfold_balanced_of_a_million_groups(spark):
    # ids 0 .. 999,999 once, some of them again, and one that holds a third of the rows
    df = (spark.range(1_000_000).withColumnRenamed("id", "function_id")
          .unionByName(spark.range(0, 300_000, 3).withColumnRenamed("id", "function_id"))
          .unionByName(spark.range(500_000).select(F.lit(77).cast("long").alias("function_id"))))
    folds = S.group_kfold(df, 5, mode="balanced")
    per = folds.groupBy("fold").count().collect()
    assert folds.count() == 1_600_000 and sorted(r["fold"] for r in per) == list(range(5))
    assert sorted(r["count"] for r in per) == [274_999, 275_000, 275_000, 275_000, 500_001]
    assert folds.groupBy("function_id").agg(F.count_distinct("fold").alias("c")).where("c > 1").count() == 0


def test_group_kfold_balanced_null_group(spark):
    rows = [(None, i) for i in range(5)] + [(g, i) for g in range(4) for i in range(g + 1)]
    got = S.group_kfold(spark.createDataFrame(rows, "function_id int, i int"), 2, mode="balanced").collect()
    assert len(got) == len(rows) and len({r.fold for r in got if r.function_id is None}) == 1


def test_clipped_percentiles_of_one_class_spread(spark):
    rng = np.random.default_rng(3)
    values = np.round(rng.normal(50, 40, 4000), 1)
    df = spark.createDataFrame([(0 if i % 3 else 1, float(v)) for i, v in enumerate(values)] + [(0, None), (2, None), (None, 7.0)], "is_valid int, x double")
    got = M.clipped_percentiles(df, "x", 90.0, ps=(0.0, 0.25, 0.5, 0.999, 1.0))
    rows = {r["is_valid"]: [r[c] for c in ("p0", "p25", "p50", "p99", "p100")] for r in got.collect()}
    for label, keep in ((0, [v for i, v in enumerate(values) if i % 3]), (1, values[::3])):
        assert rows[label] == pytest.approx(np.percentile(np.minimum(keep, 90.0), [0, 25, 50, 99.9, 100]).tolist())
    assert rows[2] == [None] * 5 and rows[None] == [7.0] * 5
    assert "percentile" not in got._jdf.queryExecution().executedPlan().toString().lower()


@pytest.mark.parametrize("n1, n2, u, p", [(3, 4, 0, 0.0571), (4, 4, 0, 0.0286), (5, 5, 2, 0.0317), (5, 5, 3, 0.0556), (8, 8, 13, 0.0499), (8, 8, 14, 0.0650),
                                          (2, 8, 0, 0.0444), (6, 7, 6, 0.0350), (1, 5, 0, 0.3333)])
def test_mann_whitney_exact_p(spark, n1, n2, u, p):
    """Published tables of the exact two-sided p."""
    order = None
    for x in itertools.combinations(range(n1 + n2), n1):  # any samples with this U
        if sum(r - i for i, r in enumerate(x)) == u:
            order = set(x)
            break
    df = spark.createDataFrame([("d", "l", int(i in order), float(i)) for i in range(n1 + n2)], "dataset string, llm string, is_valid int, x double")
    r = L.mann_whitney_u(df, ["x"]).first()
    assert (r.u, round(r.p, 4)) == (u, p)


def test_mann_whitney_normal_tail(spark):
    z = [0.0, -1.0, 0.1, 1.0, 1.959964, 3.0, 4.2, 4.25, 5.0, 8.0, 20.0, None]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(z)], "i int, z double").orderBy("i").select(L.normal_two_sided(F.col("z"))).collect()]
    assert got[-1] is None
    assert got[:-1] == pytest.approx([1.0 if x <= 0 else math.erfc(x / math.sqrt(2)) for x in z[:-1]], rel=1e-9, abs=1e-15)
    big = spark.createDataFrame([("d", "l", i % 2, float(i * 37 % 101)) for i in range(101)] + [("d", "one", 1, 3.0), ("d", "same", 1, 2.0), ("d", "same", 0, 2.0)],
                                "dataset string, llm string, is_valid int, x double")
    p = {r.llm: r.p for r in L.mann_whitney_u(big, ["x"]).collect()}
    assert 0 < p["l"] <= 1 and p["one"] is None and p["same"] is None
