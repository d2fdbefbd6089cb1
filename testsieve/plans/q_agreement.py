"""Queries: agreement, clusters, ranking, solution choice and
the pair joins of §2.6."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement as AG
from ..sources import adapters as A
from .registry import query, r6
from .views import with_views

AG_SQL = with_views("solutions_v", "tests_v", "exec_v", "ground_truth_v") + """
, sf AS (SELECT task_id, solution_id, count(*) AS sol_freq FROM solutions_v GROUP BY task_id, solution_id),
tf AS (SELECT task_id, test_id, count(*) AS test_freq, sum(score) AS test_score FROM tests_v
       GROUP BY task_id, test_id),
pp AS (SELECT DISTINCT e.task_id, e.solution_id, e.test_id FROM exec_v e
       WHERE e.passed AND EXISTS (SELECT 1 FROM tf WHERE tf.task_id = e.task_id AND tf.test_id = e.test_id)),
ex AS (SELECT pp.task_id, pp.solution_id, pp.test_id, sf.sol_freq, tf.test_freq, tf.test_score,
              sf.sol_freq * tf.test_freq AS expanded_pairs
       FROM pp JOIN sf ON pp.task_id = sf.task_id AND pp.solution_id = sf.solution_id
               JOIN tf ON pp.task_id = tf.task_id AND pp.test_id = tf.test_id),
ps AS (SELECT task_id, solution_id, list_sort(list(test_id)) AS test_set, first(sol_freq) AS sol_freq,
              CAST(sum(test_freq) AS BIGINT) AS set_tests, sum(test_score) AS set_score FROM ex GROUP BY task_id, solution_id),
cl AS (SELECT task_id, test_set, min(solution_id) AS cluster_id, CAST(len(test_set) AS BIGINT) AS set_size,
              CAST(sum(sol_freq) AS BIGINT) AS n_solutions, first(set_tests) AS n_tests, first(set_score) AS tests_score
       FROM ps GROUP BY task_id, test_set),
mb AS (SELECT ps.task_id, ps.solution_id, cl.cluster_id FROM ps JOIN cl ON ps.task_id = cl.task_id AND ps.test_set = cl.test_set),
sc AS (SELECT *, sqrt(n_solutions) * n_tests AS score FROM cl),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY task_id ORDER BY score DESC, cluster_id) AS INTEGER) AS rank FROM sc),
os AS (SELECT task_id, arg_min(solution_id, sample_idx) AS solution_id FROM solutions_v GROUP BY task_id),
best AS (SELECT task_id, cluster_id AS solution_id, 'cluster' AS source FROM rk WHERE rank = 1
         UNION ALL SELECT task_id, solution_id, 'first_sample' FROM os WHERE task_id NOT IN (SELECT task_id FROM rk))
"""


# tasks whose number ends in 0 or 5 pass nothing: they have no cluster
AG_SOME_SQL = AG_SQL.replace("bool_and(ok) AS passed", "bool_and(ok) AND CAST(task_id AS BIGINT) % 5 <> 0 AS passed", 1)


def frames(spark, sf, ex=None):
    sols, tests, ex = A.solutions_v(spark, sf), A.tests_v(spark, sf), A.exec_v(spark, sf) if ex is None else ex
    sfreq, tfreq = AG.sol_freq(sols), AG.test_freq(tests)
    pairs = AG.passed_pairs(ex, tfreq)
    expanded = AG.expand_pairs(pairs, sfreq, tfreq)
    return sols, ex, sfreq, tfreq, pairs, expanded


def clusters(spark, sf, mode="plain", ex=None):
    *_, expanded = frames(spark, sf, ex)
    return AG.consensus_score(AG.consensus_clusters(expanded), mode)


def members(spark, sf):
    *_, expanded = frames(spark, sf)
    return AG.cluster_members(expanded)


def best(spark, sf):
    sols = A.solutions_v(spark, sf)
    return AG.best_solution(AG.rank_clusters(clusters(spark, sf)), sols)


@query("passed_pairs", AG_SQL + "SELECT task_id, solution_id, test_id FROM pp")
def q_passed_pairs(spark, sf):
    return frames(spark, sf)[4]


@query("expand_pairs", AG_SQL + "SELECT task_id, solution_id, test_id, sol_freq, test_freq, expanded_pairs FROM ex")
def q_expand_pairs(spark, sf):
    return frames(spark, sf)[5].select("task_id", "solution_id", "test_id", "sol_freq", "test_freq", "expanded_pairs")


@query("consensus_clusters", AG_SQL + "SELECT task_id, cluster_id, set_size, n_solutions, n_tests FROM cl")
def q_consensus_clusters(spark, sf):
    *_, expanded = frames(spark, sf)
    return AG.consensus_clusters(expanded).select("task_id", "cluster_id", "set_size", "n_solutions", "n_tests")


@query("cluster_members", AG_SQL + "SELECT task_id, solution_id, cluster_id FROM mb")
def q_cluster_members(spark, sf):
    *_, expanded = frames(spark, sf)
    return AG.cluster_members(expanded)


@query("consensus_score", AG_SQL + "SELECT task_id, cluster_id, round(score, 6) AS score FROM sc")
def q_consensus_score(spark, sf):
    return r6(clusters(spark, sf).select("task_id", "cluster_id", "score"))


@query("consensus_score_weighted", AG_SQL +
       "SELECT task_id, cluster_id, round(sqrt(n_solutions) * tests_score, 6) AS score FROM cl")
def q_consensus_score_weighted(spark, sf):
    return r6(clusters(spark, sf, "weighted").select("task_id", "cluster_id", "score"))


@query("consensus_linear_weighted", AG_SQL +
       "SELECT task_id, cluster_id, round(n_solutions * coalesce(tests_score, n_tests), 6) AS score FROM cl")
def q_consensus_linear_weighted(spark, sf):
    return r6(clusters(spark, sf, "linear").select("task_id", "cluster_id", "score"))


@query("rank_clusters", AG_SQL + "SELECT task_id, cluster_id, round(score, 6) AS score, rank FROM rk")
def q_rank_clusters(spark, sf):
    return r6(AG.rank_clusters(clusters(spark, sf)).select("task_id", "cluster_id", "score", "rank"))


@query("best_solution", AG_SQL + "SELECT task_id, solution_id, source FROM best")
def q_best_solution(spark, sf):
    return best(spark, sf).select("task_id", "solution_id", "source")


@query("best_solution_of_failing_tasks", AG_SOME_SQL + "SELECT task_id, solution_id, source FROM best")
def q_best_solution_of_failing_tasks(spark, sf):
    ex = A.exec_v(spark, sf).withColumn("passed", F.col("passed") & (F.col("task_id").cast("long") % 5 != 0))
    ranked = AG.rank_clusters(clusters(spark, sf, ex=ex))
    return AG.best_solution(ranked, A.solutions_v(spark, sf)).select("task_id", "solution_id", "source")


@query("fingerprint_conflicts", AG_SQL + """
, m AS (SELECT task_id, cluster_id, count(*) AS members FROM mb GROUP BY task_id, cluster_id),
c AS (SELECT mb.task_id, mb.cluster_id, ex.test_id, count(*) AS passers FROM ex JOIN mb ON mb.task_id = ex.task_id AND mb.solution_id = ex.solution_id GROUP BY ALL)
SELECT count(*) AS checked, count(*) FILTER (WHERE passers <> members) AS conflicts FROM c JOIN m ON m.task_id = c.task_id AND m.cluster_id = c.cluster_id""")
def q_fingerprint_conflicts(spark, sf):
    *_, expanded = frames(spark, sf)
    checked = AG.cluster_members(expanded).join(expanded, ["task_id", "solution_id"]).select("task_id", "cluster_id", "test_id").distinct()
    conflicts = AG.fingerprint_conflicts(expanded).withColumn("conflict", F.lit(1))
    return checked.join(conflicts, ["task_id", "cluster_id", "test_id"], "left").agg(
        F.count(F.lit(1)).alias("checked"), F.count("conflict").alias("conflicts"))


@query("one_shot", AG_SQL + "SELECT task_id, solution_id FROM os")
def q_one_shot(spark, sf):
    return AG.one_shot(A.solutions_v(spark, sf))


@query("validate_by_solution", AG_SQL + """
, lab AS (SELECT task_id, test_id, CASE WHEN passed THEN 1 ELSE 0 END AS is_valid FROM exec_v WHERE solution_id = 0),
pr AS (SELECT l.is_valid, CASE WHEN e.passed THEN 1 ELSE 0 END AS pred
       FROM lab l JOIN best b ON l.task_id = b.task_id
       LEFT JOIN exec_v e ON e.task_id = l.task_id AND e.solution_id = b.solution_id AND e.test_id = l.test_id),
a AS (SELECT CAST(sum(CASE WHEN is_valid = 1 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
             CAST(sum(CASE WHEN is_valid = 0 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
             CAST(sum(CASE WHEN is_valid = 0 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
             CAST(sum(CASE WHEN is_valid = 1 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM pr),
b2 AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS p,
                 CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS r FROM a)
SELECT tp, fp, tn, fn, round(p, 6) AS precision, round(r, 6) AS recall,
       round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM b2""")
def q_validate_by_solution(spark, sf):
    ex = A.exec_v(spark, sf)
    labels = ex.filter(F.col("solution_id") == 0).select("task_id", "test_id",
                                                           F.when(F.col("passed"), 1).otherwise(0).alias("is_valid"))
    return r6(AG.validate_by_solution(best(spark, sf), ex, labels))


@query("original_tests_pass_count", AG_SQL + """
, r AS (SELECT b.task_id, coalesce(bool_and(e.passed), true) AS ok FROM best b
        LEFT JOIN exec_v e ON e.task_id = b.task_id AND e.solution_id = b.solution_id AND e.test_id = 0
        GROUP BY b.task_id)
SELECT CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS passing_functions, count(*) AS functions FROM r""")
def q_original_tests_pass_count(spark, sf):
    ex = A.exec_v(spark, sf)
    return AG.original_tests_pass_count(best(spark, sf), ex.filter(F.col("test_id") == 0))


@query("join_groundtruth", AG_SQL + """
, gt AS (SELECT DISTINCT s.task_id, s.completion, g.passed FROM solutions_v s
         JOIN ground_truth_v g ON s.task_id = g.task_id AND s.solution_id = g.solution_id)
SELECT s.task_id, s.sample_idx, s.completion, gt.passed FROM solutions_v s
JOIN gt ON s.task_id = gt.task_id AND s.completion = gt.completion""")
def q_join_groundtruth(spark, sf):
    sols = A.solutions_v(spark, sf)
    gt = (sols.join(A.ground_truth_v(spark, sf), ["task_id", "solution_id"])
          .select("task_id", "completion", "passed").distinct())
    return AG.join_groundtruth(sols, gt).select("task_id", "sample_idx", "completion", "passed")
