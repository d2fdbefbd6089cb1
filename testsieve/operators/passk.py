"""pass@k: unbiased per-task estimate, the corpus mean, and pass@k of a
ranked choice with merged ties (SURVEY §2.9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.passk import pass_at_k as pass_at_k_col
from .ranking import ordinal_within


def task_counts(samples: DataFrame, passed: str = "passed") -> DataFrame:
    """n samples and c correct per task (one partial aggregation)."""
    return samples.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"),
                                          F.sum(F.when(F.col(passed), 1).otherwise(0)).alias("c"))


def pass_at_k_task(samples: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Per task: n, c and pass@k for each k (1 - comb(n-c, k)/comb(n, k))."""
    tc = task_counts(samples)
    return tc.select("task_id", "n", "c", *[pass_at_k_col(F.col("n"), F.col("c"), k).alias(f"pass_at_{k}") for k in ks])


def pass_at_k(samples: DataFrame, ks: Sequence[int] = (1, 10, 100)) -> DataFrame:
    """Mean over tasks rounded to 4, one row per k, only for k <= min n."""
    per = pass_at_k_task(samples, ks)
    a = per.agg(F.min("n").alias("_min_n"), *[F.avg(f"pass_at_{k}").alias(f"m{k}") for k in ks])
    rows = a.select("_min_n", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"m{k}").alias("pass_at_k"))
                                                  for k in ks])))
    return rows.filter(F.col("_min_n") >= F.col("k")).select("k", F.round("pass_at_k", 4).alias("pass_at_k"))


def _picks(group, n_groups, k):
    """Picks of a choice group: with G >= k groups the first k get one each;
    otherwise every group gets one and the k - G spare picks are dealt round
    robin from the best group on."""
    return F.when(n_groups >= k, F.when(group < k, 1).otherwise(0)).otherwise(
        1 + F.greatest(F.lit(0), F.ceil((k - n_groups - group) / n_groups))).cast("int")


def _choice_groups(scored_clusters: DataFrame) -> DataFrame:
    """Clusters of equal (9-decimal) score form one choice group, numbered in
    score order (0-based), with the number of groups of the task: the dense rank is
    the ordinal among the task's distinct scores, which spread over ranges, so a
    task of very many scores is no single task's work."""
    sc = scored_clusters.withColumn("_r9", F.round(F.col("score"), 9))
    distinct = sc.select("task_id", "_r9").distinct()
    g = ordinal_within(distinct, "task_id", [F.col("_r9").desc()], out="group", few_classes=False)
    g = g.select("task_id", "_r9", F.col("group").cast("int").alias("group"), F.col("group_n").cast("int").alias("n_groups"))
    return sc.join(g, ["task_id", "_r9"]).drop("_r9")


def merge_ties(scored_clusters: DataFrame, k: int) -> DataFrame:
    """Choice groups and their picks for a budget of k choices."""
    g = _choice_groups(scored_clusters)
    return g.withColumn("picks", _picks(F.col("group"), F.col("n_groups"), F.lit(k))).filter(F.col("picks") > 0)


def ranked_pass_at_k(per_cluster: DataFrame, samples: DataFrame, ks: Sequence[int] = (1, 2, 10)) -> DataFrame:
    """1 - prod_g ((n_g - c_g)/n_g)^picks_g over merged groups; tasks without
    clusters use their unranked pass@k; mean over ground-truth tasks, 4 decimals.
    All k are evaluated in one pass: the groups are built once and the k
    values are generated on the (small) per-group table.

    per_cluster: (task_id, cluster_id, score, n_g, c_g) — see
    ``agreement.cluster_truth`` ; samples: (task_id, passed) per sample."""
    groups = (_choice_groups(per_cluster.select("task_id", "cluster_id", "score", "n_g", "c_g"))
              .groupBy("task_id", "group", "n_groups").agg(F.sum("n_g").alias("n_g"), F.sum("c_g").alias("c_g")))
    gk = groups.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    gk = gk.withColumn("picks", _picks(F.col("group"), F.col("n_groups"), F.col("k"))).filter(F.col("picks") > 0)
    wrong = F.when(F.col("n_g") - F.col("c_g") < 1, F.lit(0.0)).otherwise((F.col("n_g") - F.col("c_g")) / F.col("n_g"))
    ranked = gk.groupBy("task_id", "k").agg((1 - F.product(F.pow(wrong, F.col("picks")))).alias("_p"))
    unranked = pass_at_k_task(samples, ks).select("task_id", F.inline(F.array(*[
        F.struct(F.lit(k).alias("k"), F.col(f"pass_at_{k}").alias("_u")) for k in ks])))
    return (unranked.join(ranked, ["task_id", "k"], "left").groupBy("k")
            .agg(F.round(F.avg(F.coalesce(F.col("_p"), F.col("_u"))), 4).alias("pass_at_k")))
