"""FIXTURES §5: clusters, scores, agreement, pass@k and ranked pass@k."""

import pytest
from pyspark.sql import functions as F

from testsieve.functions.passk import pass_at_k
from testsieve.operators import agreement as AG
from testsieve.operators import passk as PK

# task t: samples A, A, B, C, D; tests 1, 2, 3, 3 (3 twice); A, B pass 1 and 2; C passes 3; D nothing
SOLS = [("t", 0, 1, "A"), ("t", 1, 1, "A"), ("t", 2, 2, "B"), ("t", 3, 3, "C"), ("t", 4, 4, "D")]
TESTS = [("t", 0, 0, 1, "assert 1", 0.9), ("t", 0, 1, 2, "assert 2", 0.8), ("t", 1, 0, 3, "assert 3", 0.1),
         ("t", 2, 0, 3, "assert 3", 0.1)]
EXEC = [("t", s, t, s in (1, 2) and t in (1, 2) or (s == 3 and t == 3)) for s in (1, 2, 3, 4) for t in (1, 2, 3)]


@pytest.fixture(scope="module")
def frames(spark):
    sols = spark.createDataFrame(SOLS, "task_id string, sample_idx int, solution_id int, completion string")
    tests = spark.createDataFrame(TESTS, "task_id string, sample_idx int, pos int, test_id int, text string, score double")
    ex = spark.createDataFrame(EXEC, "task_id string, solution_id int, test_id int, passed boolean")
    tf = AG.test_freq(tests, 20)
    expanded = AG.expand_pairs(AG.passed_pairs(ex, tf), AG.sol_freq(sols), tf)
    return sols, tests, ex, expanded


def _scores(frames, mode):
    return {r.cluster_id: r.score for r in AG.consensus_score(AG.consensus_clusters(frames[3]), mode).collect()}


def test_cluster_scores(frames):
    assert _scores(frames, "plain") == pytest.approx({1: 3 ** 0.5 * 2, 3: 2.0})
    assert _scores(frames, "weighted") == pytest.approx({1: 3 ** 0.5 * 1.7, 3: 0.2})
    assert _scores(frames, "linear") == pytest.approx({1: 5.1, 3: 0.2})
    members = {r.solution_id: r.cluster_id for r in AG.cluster_members(frames[3]).collect()}
    assert members == {1: 1, 2: 1, 3: 3}


def test_fingerprint_separates_sets(spark):
    # {1,2} vs {1,3} vs {2,3} vs {1,2,3}: same sizes must not merge
    rows = [("t", s, t) for s, ts in {1: (1, 2), 2: (1, 3), 3: (2, 3), 4: (1, 2, 3), 5: (2, 1)}.items() for t in ts]
    ex = spark.createDataFrame(rows, "task_id string, solution_id int, test_id int").withColumn("sol_freq", F.lit(1)) \
        .withColumn("test_freq", F.lit(1)).withColumn("test_score", F.lit(0.5))
    got = {r.solution_id: r.cluster_id for r in AG.cluster_members(ex).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_rank_best_and_one_shot(frames):
    sols = frames[0]
    ranked = AG.rank_clusters(AG.consensus_score(AG.consensus_clusters(frames[3])))
    best = AG.best_solution(ranked, sols).first()
    assert (best.solution_id, best.source) == (1, "cluster")
    assert AG.one_shot(sols).first().solution_id == 1


def test_agreement(frames, spark):
    _, tests, ex, _ = frames
    t = tests.groupBy("task_id", "test_id").agg(F.avg("score").alias("score"))
    extra = spark.createDataFrame([("t", 9, 0.7)], "task_id string, test_id int, score double")
    got = {r.test_id: r.agreement for r in AG.test_agreement(ex, t.unionByName(extra)).collect()}
    assert got == pytest.approx({1: 2 / 3, 2: 2 / 3, 3: 1 / 3, 9: 0.0})


def test_agreement_fallback_when_task_has_no_pass(spark):
    ex = spark.createDataFrame([("u", 1, 1, False)], "task_id string, solution_id int, test_id int, passed boolean")
    t = spark.createDataFrame([("u", 1, 0.35)], "task_id string, test_id int, score double")
    assert AG.test_agreement(ex, t).first().agreement == 0.35


@pytest.mark.parametrize("n,c,k,expected", [(5, 2, 1, 0.4), (5, 2, 2, 0.7), (5, 0, 2, 0.0), (5, 4, 2, 1.0),
                                            (7, 3, 1, 0.428571)])
def test_pass_at_k(spark, n, c, k, expected):
    df = spark.createDataFrame([(n, c)], "n int, c int")
    assert df.select(pass_at_k(F.col("n"), F.col("c"), k).alias("p")).first().p == pytest.approx(expected, abs=1e-6)


def test_pass_at_k_non_decreasing_in_k(spark):
    df = spark.createDataFrame([(10, c) for c in range(11)], "n int, c int")
    rows = df.select(*[pass_at_k(F.col("n"), F.col("c"), k).alias(f"k{k}") for k in (1, 2, 5, 10)]).collect()
    for r in rows:
        assert r.k1 <= r.k2 + 1e-12 <= r.k5 + 2e-12 <= r.k10 + 3e-12


def _ranked(spark, clusters, truth, ks):
    t = {s: (f, p) for _, s, f, p in truth}
    per = [(task, sols[0], score, sum(t[s][0] for s in sols), sum(t[s][0] for s in sols if t[s][1]))
           for task, sols, score in clusters]
    pc = spark.createDataFrame(per, "task_id string, cluster_id int, score double, n_g long, c_g long")
    st = spark.createDataFrame(truth, "task_id string, solution_id int, sol_freq long, passed boolean")
    samples = st.select("task_id", "passed", F.explode(F.sequence(F.lit(1), "sol_freq")).alias("_")).drop("_")
    return {r.k: r.pass_at_k for r in PK.ranked_pass_at_k(pc, samples, ks).collect()}


def test_cluster_truth(frames, spark):
    truth = spark.createDataFrame([("t", 1, True), ("t", 2, False), ("t", 3, True), ("t", 4, False)],
                                  "task_id string, solution_id int, passed boolean")
    got = {r.cluster_id: (r.n_g, r.c_g) for r in AG.cluster_truth(frames[3], truth).collect()}
    assert got == {1: (3, 2), 3: (1, 1)}


def test_ranked_pass_at_k(spark):
    # cluster 1: two solutions, one correct (c/n = 1/2); cluster 2: one wrong (0/1)
    clusters = [("t", [1, 2], 2.0), ("t", [3], 1.0)]
    truth = [("t", 1, 1, True), ("t", 2, 1, False), ("t", 3, 1, False)]
    assert _ranked(spark, clusters, truth, (1, 2, 3)) == pytest.approx({1: 0.5, 2: 0.5, 3: 0.75})


def test_equal_scores_merge(spark):
    clusters = [("t", [1, 2], 2.0), ("t", [3], 2.0)]
    truth = [("t", 1, 1, True), ("t", 2, 1, False), ("t", 3, 1, False)]
    assert _ranked(spark, clusters, truth, (1,)) == pytest.approx({1: 1 / 3}, abs=1e-4)  # 4 decimals


def test_fingerprint_clusters_are_exact_on_driver_data(spark):
    from testsieve.plans.q_agreement import frames
    *_, expanded = frames(spark, "/root/testdata/sf0.01")
    assert AG.fingerprint_conflicts(expanded).count() == 0


def test_clusters_and_ranked_pass_invariant_to_partitioning(spark):
    from testsieve.plans.q_agreement import frames
    from testsieve.sources import adapters as A
    *_, expanded = frames(spark, "/root/testdata/sf0.001")
    gt = A.ground_truth_v(spark, "/root/testdata/sf0.001")
    a = {(r.task_id, r.cluster_id, r.n_solutions, r.n_tests) for r in AG.consensus_clusters(expanded).collect()}
    b = {(r.task_id, r.cluster_id, r.n_solutions, r.n_tests) for r in AG.consensus_clusters(expanded.repartition(7)).collect()}
    assert a == b and a
    samples = A.solutions_v(spark, "/root/testdata/sf0.001").join(gt, ["task_id", "solution_id"]).select("task_id", "passed")
    p1 = {r.k: r.pass_at_k for r in PK.ranked_pass_at_k(AG.cluster_truth(expanded, gt), samples).collect()}
    p2 = {r.k: r.pass_at_k for r in PK.ranked_pass_at_k(AG.cluster_truth(expanded.repartition(5), gt),
                                                          samples.repartition(3)).collect()}
    assert p1 == p2


def test_limit_counts_tests_not_positions(spark):
    rows = [("t", 0, p, p, f"a{p}", 0.5) for p in (3, 10, 40, 41, 90, 95, 99)] + [("t", 1, 7, 3, "a3", 0.5)]
    tests = spark.createDataFrame(rows, "task_id string, sample_idx int, pos long, test_id int, text string, score double")
    assert {r.text: r["count"] for r in AG.test_frequency(tests, 5).collect()} == {"a3": 2, "a10": 1, "a40": 1, "a41": 1, "a90": 1}
    assert AG.test_freq(tests).count() == 7
