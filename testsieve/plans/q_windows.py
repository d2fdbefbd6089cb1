"""Queries: selection, baselines, samplers, folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import selection as S
from ..sources import adapters as A
from .registry import query, r6
from .views import with_views

# Parameters of the registered queries.
T, N = 0.8, 20

SEL_SQL = f"""sel AS (
  SELECT function_id, test_idx, y_prob, y_true FROM (
    SELECT *, row_number() OVER (PARTITION BY function_id ORDER BY y_prob DESC, test_idx) AS rn FROM scores_v)
  WHERE y_prob >= {T} OR rn <= {N})"""


@query("select_threshold_topn", with_views("scores_v") + f", {SEL_SQL}\n"
       "SELECT function_id, test_idx, round(y_prob, 6) AS y_prob, y_true FROM sel")
def q_select_threshold_topn(spark, sf):
    return r6(S.select_threshold_topn(A.scores_v(spark, sf), T, N))


@query("selection_stats", with_views("scores_v") + f", {SEL_SQL}\n" + """
SELECT CAST(count(*) AS BIGINT) AS total_selected, CAST(sum(y_true) AS BIGINT) AS valid_selected,
       CAST(count(DISTINCT function_id) AS BIGINT) AS functions,
       round(round(CASE WHEN count(*) = 0 THEN 0.0 ELSE sum(y_true) / count(*) END, 3), 6) AS valid_ratio
FROM sel""")
def q_selection_stats(spark, sf):
    return r6(M.selection_stats(S.select_threshold_topn(A.scores_v(spark, sf), T, N)))


@query("first_n_baseline", with_views("scores_v") + """
SELECT function_id, test_idx, y_true FROM (
  SELECT *, row_number() OVER (PARTITION BY function_id ORDER BY test_idx) AS rn FROM scores_v) WHERE rn <= 7""")
def q_first_n_baseline(spark, sf):
    return S.first_n_baseline(A.scores_v(spark, sf), 7).select("function_id", "test_idx", "y_true")


@query("reviewer_baseline", with_views("scores_v") + """
, j AS (SELECT CASE WHEN y_prob >= 0.5 THEN 1 ELSE 0 END AS jv, y_true FROM scores_v),
a AS (SELECT CAST(sum(CASE WHEN jv = 1 THEN 1 ELSE 0 END) AS BIGINT) AS judged_valid,
             CAST(sum(CASE WHEN jv = 1 AND y_true = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
             CAST(sum(CASE WHEN jv = 1 AND y_true <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
             CAST(sum(CASE WHEN jv <> 1 AND y_true = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
             count(*) AS total FROM j),
b AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS p,
                CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS r FROM a)
SELECT judged_valid, total, round(round(CASE WHEN judged_valid = 0 THEN 0.0 ELSE tp / judged_valid END, 3), 6) AS valid_ratio,
       tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall,
       round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM b""")
def q_reviewer_baseline(spark, sf):
    s = A.scores_v(spark, sf).withColumn("judged_valid", F.when(F.col("y_prob") >= 0.5, 1).otherwise(0))
    return r6(M.reviewer_baseline(s, "judged_valid", "y_true"))


@query("stride_downsample", with_views("scores_v") + """
SELECT function_id, test_idx FROM (
  SELECT function_id, test_idx, row_number() OVER (PARTITION BY function_id ORDER BY test_idx) - 1 AS i,
         count(*) OVER (PARTITION BY function_id) // 5 AS step FROM scores_v)
WHERE step = 0 OR (i % step = 0 AND i // step < 5)""")
def q_stride_downsample(spark, sf):
    return S.stride_downsample(A.scores_v(spark, sf), 5).select("function_id", "test_idx")


@query("balance_classes", with_views("scores_v") + """
, h AS (SELECT function_id, test_idx, y_true,
               row_number() OVER (PARTITION BY y_true ORDER BY md5(concat_ws('|', '42', CAST(function_id AS VARCHAR),
                                  CAST(test_idx AS VARCHAR))), function_id, test_idx) AS rn FROM scores_v),
m AS (SELECT min(c) AS m FROM (SELECT y_true, count(*) AS c FROM scores_v GROUP BY y_true))
SELECT function_id, test_idx, y_true FROM h, m WHERE rn <= m.m""")
def q_balance_classes(spark, sf):
    return S.balance_classes(A.scores_v(spark, sf), "y_true").select("function_id", "test_idx", "y_true")


@query("limit_tests_per_sample", with_views("tests_v") + """
SELECT task_id, sample_idx, pos, test_id FROM tests_v
QUALIFY row_number() OVER (PARTITION BY task_id, sample_idx ORDER BY pos) <= 5""")
def q_limit_tests_per_sample(spark, sf):
    return S.limit_tests_per_sample(A.tests_v(spark, sf), 5).select("task_id", "sample_idx", "pos", "test_id")


@query("group_kfold", with_views("scores_v") + """
SELECT function_id, test_idx, CAST(CAST(('0x' || substr(md5(CAST(function_id AS VARCHAR)), 1, 8)) AS BIGINT) % 5 AS INTEGER) AS fold
FROM scores_v""")
def q_group_kfold(spark, sf):
    return S.group_kfold(A.scores_v(spark, sf), 5).select("function_id", "test_idx", "fold")


@query("group_kfold_balanced", with_views("scores_v").replace("WITH ", "WITH RECURSIVE ", 1) + """
, g AS (SELECT function_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, function_id NULLS FIRST) AS i FROM scores_v GROUP BY function_id),
d AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS function_id, CAST(NULL AS INTEGER) AS fold, [0::BIGINT, 0, 0, 0, 0] AS load
      UNION ALL
      SELECT i, function_id, f - 1, list_transform(load, lambda x, j: CASE WHEN j = f THEN x + n ELSE x END)
      FROM (SELECT g.i, g.function_id, g.n, d.load, CAST(list_position(d.load, list_min(d.load)) AS INTEGER) AS f FROM d JOIN g ON g.i = d.i + 1))
SELECT s.function_id, s.test_idx, d.fold FROM scores_v s JOIN d ON d.i > 0 AND d.function_id IS NOT DISTINCT FROM s.function_id""")
def q_group_kfold_balanced(spark, sf):
    return S.group_kfold(A.scores_v(spark, sf), 5, mode="balanced").select("function_id", "test_idx", "fold")


@query("stratified_kfold", with_views("scores_v") + """
, r AS (SELECT function_id, test_idx, y_true,
               row_number() OVER (PARTITION BY y_true ORDER BY function_id, test_idx) - 1 AS r,
               count(*) OVER (PARTITION BY y_true) AS n FROM scores_v),
q AS (SELECT *, n // 5 AS q, n - (n // 5) * 5 AS rem FROM r)
SELECT function_id, test_idx, y_true,
       CAST(CASE WHEN r < rem * (q + 1) THEN r // (q + 1)
                 ELSE rem + (r - rem * (q + 1)) // greatest(q, 1) END AS INTEGER) AS fold FROM q""")
def q_stratified_kfold(spark, sf):
    return S.stratified_kfold(A.scores_v(spark, sf), 5, "y_true").select("function_id", "test_idx", "y_true", "fold")
