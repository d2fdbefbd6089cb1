"""Solution/test agreement: frequencies, passed pairs, consensus clusters,
cluster scores and ranking, solution choice and its validation (SURVEY §2.5,
§2.6, §2.8).

Input model (all keyed by task_id):
  exec_results(task_id, solution_id, test_id, passed)   equal completion => equal solution_id
  solutions(task_id, sample_idx, solution_id, completion)
  tests(task_id, sample_idx, pos, test_id, text, score?)

Pair multiplication (every solution copy x every test copy) is never
materialised: multiplicities travel as ``sol_freq`` / ``test_freq`` columns and
are summed, which is algebraically the same cluster score.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import prf
from .selection import limit_tests_per_sample


def dedupe_work(solutions: DataFrame, keys: Sequence[str] = ("task_id", "completion")) -> DataFrame:
    """Distinct (task, completion) before any pairing."""
    return solutions.dropDuplicates(list(keys))


def solution_frequency(solutions: DataFrame) -> DataFrame:
    return solutions.groupBy("task_id", "completion").agg(F.count(F.lit(1)).alias("count"))


def _limited(tests: DataFrame, limit: int | None) -> DataFrame:
    return tests if limit is None else limit_tests_per_sample(tests, limit)


def test_frequency(tests: DataFrame, limit: int | None = None, key: str = "text") -> DataFrame:
    """Occurrences of each test per task; with ``limit``, among the first tests of every sample."""
    return _limited(tests, limit).groupBy("task_id", key).agg(F.count(F.lit(1)).alias("count"))


def sol_freq(solutions: DataFrame) -> DataFrame:
    return solutions.groupBy("task_id", "solution_id").agg(F.count(F.lit(1)).alias("sol_freq"))


def test_freq(tests: DataFrame, limit: int | None = None) -> DataFrame:
    """Per (task, test_id): occurrences and summed validity score of the occurrences."""
    return (_limited(tests, limit).groupBy("task_id", "test_id")
            .agg(F.count(F.lit(1)).alias("test_freq"), F.sum("score").alias("test_score")))


def passed_pairs(exec_results: DataFrame, known_tests: DataFrame) -> DataFrame:
    """Distinct (task, solution, test) pairs that passed, restricted to known tests."""
    return (exec_results.filter(F.col("passed"))
            .join(known_tests.select("task_id", "test_id"), ["task_id", "test_id"], "left_semi")
            .select("task_id", "solution_id", "test_id").distinct())


def expand_pairs(pairs: DataFrame, sfreq: DataFrame, tfreq: DataFrame) -> DataFrame:
    """Multiplicities of each passed pair: sol_freq x test_freq expanded pairs
    (the explicit form would be ``explode(sequence(...))``)."""
    return (pairs.join(sfreq, ["task_id", "solution_id"]).join(tfreq, ["task_id", "test_id"])
            .withColumn("expanded_pairs", F.col("sol_freq") * F.col("test_freq")))


def solution_sets(expanded: DataFrame) -> DataFrame:
    """Per (task, solution): an order-independent fingerprint of the set of
    tests it passes — the set size and two xors of independent 64-bit hashes
    (different sets agree with probability ~2^-128) — plus the set's summed
    multiplicity and score.  An aggregation: no set is materialised, so a
    solution passing millions of tests costs no more memory than one passing two."""
    return expanded.groupBy("task_id", "solution_id").agg(
        F.count(F.lit(1)).alias("set_size"),
        F.bit_xor(F.xxhash64("test_id")).alias("_fp1"),
        F.bit_xor(F.xxhash64(F.lit("second hash"), "test_id")).alias("_fp2"),
        F.max("sol_freq").alias("sol_freq"),
        F.sum("test_freq").alias("set_tests"),
        F.sum("test_score").alias("set_score"))


_FP = ["task_id", "set_size", "_fp1", "_fp2"]


def consensus_clusters(expanded: DataFrame) -> DataFrame:
    """Solutions of a task with the same set of passed tests form a cluster,
    named by its lowest solution id.  Grouping is on the set fingerprint."""
    return solution_sets(expanded).groupBy(*_FP).agg(
        F.min("solution_id").alias("cluster_id"),
        F.sum("sol_freq").alias("n_solutions"),
        F.max("set_tests").alias("n_tests"),
        F.max("set_score").alias("tests_score")).drop("_fp1", "_fp2")


def cluster_members(expanded: DataFrame) -> DataFrame:
    """Membership (task, solution, cluster) as rows — the relational form of
    the reference's per-cluster solution lists."""
    sets = solution_sets(expanded)
    ids = sets.groupBy(*_FP).agg(F.min("solution_id").alias("cluster_id"))
    return sets.join(ids, _FP).select("task_id", "solution_id", "cluster_id")


def cluster_truth(expanded: DataFrame, sol_truth: DataFrame, mode: str = "plain") -> DataFrame:
    """Per cluster in one aggregation over the solution fingerprints: its
    score, and n_g / c_g = solutions (with multiplicity) and correct ones
    among them — the inputs of ranked pass@k.  sol_truth: (task_id,
    solution_id, passed)."""
    sets = solution_sets(expanded).join(sol_truth.select("task_id", "solution_id", "passed"),
                                        ["task_id", "solution_id"], "left")
    per = sets.groupBy(*_FP).agg(
        F.min("solution_id").alias("cluster_id"),
        F.sum("sol_freq").alias("n_solutions"),
        F.max("set_tests").alias("n_tests"),
        F.max("set_score").alias("tests_score"),
        F.sum(F.when(F.col("passed"), F.col("sol_freq")).otherwise(0)).alias("c_g")).drop("_fp1", "_fp2")
    return consensus_score(per, mode).withColumn("n_g", F.col("n_solutions"))


def fingerprint_conflicts(expanded: DataFrame) -> DataFrame:
    """Exactness check of the fingerprint clustering: within a cluster every
    member passes the same tests, so each test of the cluster must be passed
    by all of its members.  Returns the (task, cluster, test) triples where
    that fails — empty unless two different sets collided.  Aggregations
    only (no pairs of solutions are formed)."""
    sets = solution_sets(expanded)
    ids = sets.groupBy(*_FP).agg(F.min("solution_id").alias("cluster_id"), F.count(F.lit(1)).alias("_members"))
    member = sets.join(ids, _FP).select("task_id", "solution_id", "cluster_id", "_members")
    per_test = (expanded.select("task_id", "solution_id", "test_id").join(member, ["task_id", "solution_id"])
                .groupBy("task_id", "cluster_id", "test_id")
                .agg(F.count(F.lit(1)).alias("_passers"), F.max("_members").alias("_members")))
    return per_test.filter(F.col("_passers") != F.col("_members")).select("task_id", "cluster_id", "test_id")


def consensus_score(clusters: DataFrame, mode: str = "plain") -> DataFrame:
    """plain: sqrt(solutions) x tests;  weighted: sqrt(solutions) x summed test
    scores;  linear: solutions x summed scores (plain count when no score)."""
    s = F.col("n_solutions").cast("double")
    if mode == "plain":
        score = F.sqrt(s) * F.col("n_tests")
    elif mode == "weighted":
        score = F.sqrt(s) * F.col("tests_score")
    elif mode == "linear":
        score = s * F.coalesce(F.col("tests_score"), F.col("n_tests").cast("double"))
    else:
        raise ValueError(mode)
    return clusters.withColumn("score", score.cast("double"))


def rank_clusters(scored: DataFrame) -> DataFrame:
    """Clusters ordered by score (desc) per task; ties by the lowest solution
    id.  Range-partitioned ordinals: a task with very many clusters is spread
    over all tasks instead of being sorted in one."""
    from .ranking import ordinal_within
    r = ordinal_within(scored, "task_id", [F.col("score").desc(), F.col("cluster_id").asc()], out="_r",
                       few_classes=False)
    return r.withColumn("rank", (F.col("_r") + 1).cast("int")).drop("_r", "_r_n")


def best_solution(ranked: DataFrame, solutions: DataFrame) -> DataFrame:
    """The first (lowest) solution of the top cluster; tasks without a cluster
    fall back to their first sample."""
    top = (ranked.filter(F.col("rank") == 1)
           .select("task_id", F.col("cluster_id").alias("solution_id"), F.lit("cluster").alias("source")))
    first = one_shot(solutions).withColumn("source", F.lit("first_sample"))
    return first.join(top.select("task_id"), "task_id", "left_anti").unionByName(top)


def one_shot(solutions: DataFrame) -> DataFrame:
    """Always the first sample of a task."""
    return solutions.groupBy("task_id").agg(F.min_by("solution_id", "sample_idx").alias("solution_id"))


def join_groundtruth(solutions: DataFrame, ground_truth: DataFrame) -> DataFrame:
    """Every sample gets the shared result of its (task, completion)."""
    return solutions.join(ground_truth, ["task_id", "completion"], "inner")


def test_agreement(exec_results: DataFrame, tests: DataFrame) -> DataFrame:
    """Passes of a test / distinct solutions with at least one pass in the task;
    never-passed tests 0; tasks without any pass keep the test's own score."""
    pp = exec_results.filter(F.col("passed")).select("task_id", "solution_id", "test_id").distinct()
    nsol = pp.groupBy("task_id").agg(F.countDistinct("solution_id").alias("_n"))
    tp = pp.groupBy("task_id", "test_id").agg(F.count(F.lit(1)).alias("_c"))
    out = tests.join(nsol, "task_id", "left").join(tp, ["task_id", "test_id"], "left")
    return out.select("task_id", "test_id", F.when(F.col("_n").isNull(), F.col("score"))
                      .otherwise(F.coalesce(F.col("_c"), F.lit(0)) / F.col("_n")).alias("agreement"))


def validate_by_solution(chosen: DataFrame, exec_results: DataFrame, labels: DataFrame) -> DataFrame:
    """A test is predicted valid iff the chosen solution passes it.  labels:
    (task_id, test_id, is_valid?) — NULL labels are skipped."""
    pred = (labels.join(chosen.select("task_id", "solution_id"), "task_id")
            .join(exec_results, ["task_id", "solution_id", "test_id"], "left")
            .withColumn("pred", F.when(F.col("passed"), 1).otherwise(0)))
    t, p = F.col("is_valid"), F.col("pred")
    cnt = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    a = pred.agg(cnt((t == 1) & (p == 1)).alias("tp"), cnt((t == 0) & (p == 1)).alias("fp"),
                 cnt((t == 0) & (p == 0)).alias("tn"), cnt((t == 1) & (p == 0)).alias("fn"))
    return a.select("tp", "fp", "tn", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def original_tests_pass_count(chosen: DataFrame, original_results: DataFrame) -> DataFrame:
    """Functions whose chosen solution passes all original tests (no original test = pass)."""
    r = (chosen.join(original_results, ["task_id", "solution_id"], "left")
         .groupBy("task_id").agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("ok")))
    return r.agg(F.sum(F.when(F.col("ok"), 1).otherwise(0)).cast("bigint").alias("passing_functions"),
                 F.count(F.lit(1)).alias("functions"))
