"""Queries: pass@k family."""

from __future__ import annotations

from ..operators import agreement as AG
from ..operators import passk as PK
from ..sources import adapters as A
from .q_agreement import AG_SQL, clusters, frames
from .registry import query, r6


def samples(spark, sf):
    """One row per sample with the ground-truth result of its solution."""
    return A.solutions_v(spark, sf).join(A.ground_truth_v(spark, sf), ["task_id", "solution_id"]).select("task_id", "passed")


def _est(k):
    return (f"CASE WHEN n - c < {k} THEN 0.0 WHEN c = 0 THEN 1.0 ELSE "
            f"list_reduce(list_transform(range(n - c + 1, n + 1), lambda i: 1.0 - {k} / i), lambda a, b: a * b) END")


PK_SQL = AG_SQL + f"""
, smp AS (SELECT s.task_id, g.passed FROM solutions_v s JOIN ground_truth_v g ON s.task_id = g.task_id AND s.solution_id = g.solution_id),
tc AS (SELECT task_id, count(*) AS n, CAST(sum(CASE WHEN passed THEN 1 ELSE 0 END) AS BIGINT) AS c FROM smp GROUP BY task_id),
pt AS (SELECT task_id, n, c, 1.0 - ({_est(1)}) AS pass_at_1, 1.0 - ({_est(2)}) AS pass_at_2,
              1.0 - ({_est(10)}) AS pass_at_10, 1.0 - ({_est(100)}) AS pass_at_100 FROM tc)
"""


@query("pass_at_k_task", PK_SQL + """
SELECT task_id, n, c, round(pass_at_1, 6) AS pass_at_1, round(pass_at_10, 6) AS pass_at_10 FROM pt""")
def q_pass_at_k_task(spark, sf):
    return r6(PK.pass_at_k_task(samples(spark, sf), (1, 10)))


@query("pass_at_k", PK_SQL + """
, m AS (SELECT min(n) AS mn, avg(pass_at_1) AS m1, avg(pass_at_10) AS m10, avg(pass_at_100) AS m100 FROM pt)
SELECT k, round(round(v, 4), 6) AS pass_at_k FROM (
  SELECT 1 AS k, m1 AS v, mn FROM m UNION ALL SELECT 10, m10, mn FROM m UNION ALL SELECT 100, m100, mn FROM m)
WHERE mn >= k""")
def q_pass_at_k(spark, sf):
    return r6(PK.pass_at_k(samples(spark, sf), (1, 10, 100)))


MERGE_SQL = """
, gr AS (SELECT *, dense_rank() OVER (PARTITION BY task_id ORDER BY round(score, 9) DESC) - 1 AS grp FROM {src}),
gr2 AS (SELECT *, max(grp) OVER (PARTITION BY task_id) + 1 AS ng FROM gr),
pk AS (SELECT kk.k, gr2.*, CAST(CASE WHEN ng >= kk.k THEN CASE WHEN grp < kk.k THEN 1 ELSE 0 END
                              ELSE 1 + greatest(0, ceil((kk.k - ng - grp) / ng)) END AS INTEGER) AS picks
       FROM gr2, (VALUES (1), (2), (3), (10)) kk(k))
"""


@query("merge_ties", AG_SQL + MERGE_SQL.format(src="sc") + """
SELECT task_id, cluster_id, CAST(grp AS INTEGER) AS "group", picks FROM pk WHERE k = 3 AND picks > 0""")
def q_merge_ties(spark, sf):
    return PK.merge_ties(clusters(spark, sf), 3).select("task_id", "cluster_id", "group", "picks")


@query("ranked_pass_at_k", PK_SQL + """
, mem AS (SELECT mb.task_id, sc.score, mb.cluster_id AS cid, mb.solution_id FROM mb
         JOIN sc ON mb.task_id = sc.task_id AND mb.cluster_id = sc.cluster_id),
st AS (SELECT f.task_id, f.solution_id, f.sol_freq, g.passed FROM sf f
       JOIN ground_truth_v g ON f.task_id = g.task_id AND f.solution_id = g.solution_id),
pc AS (SELECT m.task_id, m.cid, m.score, sum(st.sol_freq) AS n_g,
              sum(CASE WHEN st.passed THEN st.sol_freq ELSE 0 END) AS c_g
       FROM mem m JOIN st ON m.task_id = st.task_id AND m.solution_id = st.solution_id GROUP BY m.task_id, m.cid, m.score)
""" + MERGE_SQL.format(src="pc") + """
, grp_k AS (SELECT k, task_id, grp, picks, sum(n_g) AS n_g, sum(c_g) AS c_g FROM pk WHERE picks > 0 GROUP BY k, task_id, grp, picks),
rt AS (SELECT k, task_id, 1.0 - product(pow(CASE WHEN n_g - c_g < 1 THEN 0.0 ELSE (n_g - c_g) / n_g END, picks)) AS p
       FROM grp_k GROUP BY k, task_id),
u AS (SELECT 1 AS k, task_id, pass_at_1 AS pu FROM pt UNION ALL SELECT 2, task_id, pass_at_2 FROM pt
      UNION ALL SELECT 10, task_id, pass_at_10 FROM pt)
SELECT u.k, round(round(avg(coalesce(rt.p, u.pu)), 4), 6) AS pass_at_k
FROM u LEFT JOIN rt ON u.k = rt.k AND u.task_id = rt.task_id GROUP BY u.k""")
def q_ranked_pass_at_k(spark, sf):
    *_, expanded = frames(spark, sf)
    per_cluster = AG.cluster_truth(expanded, A.ground_truth_v(spark, sf))
    return r6(PK.ranked_pass_at_k(per_cluster, samples(spark, sf), (1, 2, 10)))
