"""Per-function test selection (threshold with a top-N floor) and the
baselines, samplers and fold assignment that order tests within a group.

Skew: one function may hold a third of all tests.  Nothing here sorts a whole
function in one task: top-N uses ``row_number() <= N`` alone, which Spark
plans as a partial ``WindowGroupLimit`` before the shuffle (each map task
keeps N rows per key) and a final one after it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ordinal_within

KEY = ("function_id",)


def top_n(df: DataFrame, n: int, by: Sequence[str], order: Sequence[Column], rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..n inside each group (ties broken by the trailing keys of ``order``)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)


def select_threshold_topn(scores: DataFrame, threshold: float, n: int, by: Sequence[str] = KEY,
                          test_key: str = "test_idx", score: str = "y_prob") -> DataFrame:
    """All tests with score >= t; groups with fewer than n such tests are
    filled up with the next best (score desc, test key asc).

    = (score >= t)  UNION ALL  (top-n AND score < t): the two parts are
    disjoint, so no dedupe shuffle is needed."""
    above = scores.filter(F.col(score) >= threshold)
    if n <= 0:
        return above
    floor = (top_n(scores, n, by, [F.col(score).desc(), F.col(test_key).asc()], "_rank")
             .filter(F.col(score) < threshold).drop("_rank"))
    return above.unionByName(floor)


def selection_cutoffs(scores: DataFrame, n: int, by: Sequence[str] = KEY, test_key: str = "test_idx",
                      score: str = "y_prob") -> DataFrame:
    """Per group, the n-th best (score, test key) — or the last one when the
    group is smaller.  One row per group."""
    top = top_n(scores, n, by, [F.col(score).desc(), F.col(test_key).asc()], "_rank")
    return top.groupBy(*by).agg(
        F.max_by(F.col(score), F.col("_rank")).alias("_cut_score"),
        F.max_by(F.col(test_key), F.col("_rank")).alias("_cut_key"),
    )


def flag_selected(scores: DataFrame, threshold: float, n: int, by: Sequence[str] = KEY,
                  test_key: str = "test_idx", score: str = "y_prob", out: str = "selected") -> DataFrame:
    """Every row with a 0/1 ``selected`` flag equal to membership in
    ``select_threshold_topn``.  The full table joins one cutoff row per group
    (AQE broadcasts it when its measured size is small, and splits skewed
    keys otherwise) instead of sorting whole groups."""
    if n <= 0:
        return scores.withColumn(out, F.when(F.col(score) >= threshold, 1).otherwise(0))
    cut = selection_cutoffs(scores, n, by, test_key, score)
    in_top = (F.col(score) > F.col("_cut_score")) | (
        (F.col(score) == F.col("_cut_score")) & (F.col(test_key) <= F.col("_cut_key")))
    return (scores.join(cut, list(by), "left")
            .withColumn(out, F.when((F.col(score) >= threshold) | F.coalesce(in_top, F.lit(False)), 1).otherwise(0))
            .drop("_cut_score", "_cut_key"))


def first_n_baseline(tests: DataFrame, n: int, by: Sequence[str] = KEY, test_key: str = "test_idx") -> DataFrame:
    """The first n tests of every function."""
    return top_n(tests, n, by, [F.col(test_key).asc()], "_rank").drop("_rank")


def entropy_rank_baseline(features: DataFrame, n: int, by: Sequence[str] = KEY, test_key: str = "test_idx",
                          metric: str = "output_mean") -> DataFrame:
    """n tests per function with the lowest mean output entropy."""
    return top_n(features, n, by, [F.col(metric).asc(), F.col(test_key).asc()], "_rank").drop("_rank")


def limit_tests_per_sample(tests: DataFrame, limit: int, by: Sequence[str] = ("task_id", "sample_idx"),
                           pos: str = "pos") -> DataFrame:
    """The first ``limit`` tests of each generated sample, in the order of ``pos``."""
    return top_n(tests, limit, by, [F.col(pos).asc()], "_rank").drop("_rank")


def stride_downsample(tests: DataFrame, desired: int = 5, by: Sequence[str] = KEY,
                      test_key: str = "test_idx") -> DataFrame:
    """Every (n // desired)-th test, at most ``desired`` of them; fewer than
    ``desired`` tests -> all.  Needs the group size, so a count window."""
    assert len(by) == 1, "one group column"
    r = ordinal_within(tests, by[0], [test_key], out="_i", few_classes=False)
    step = F.floor(F.col("_i_n") / desired)
    return (r.filter((step == 0) | ((F.pmod(F.col("_i"), F.greatest(step, F.lit(1))) == 0)
                                    & (F.floor(F.col("_i") / F.greatest(step, F.lit(1))) < desired)))
            .drop("_i", "_i_n"))


def balance_classes(df: DataFrame, label: str = "is_valid", key: Sequence[str] = ("function_id", "test_idx"),
                    seed: int = 42) -> DataFrame:
    """Undersample every class to the size of the smallest, choosing rows by
    a seeded hash order (deterministic, no driver round trip)."""
    hkey = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    from .small import bounded_rows
    sizes = bounded_rows(df.groupBy(label).agg(F.count(F.lit(1)).alias("_c")), 1000, "class sizes")
    if not sizes:
        return df
    m = min(r["_c"] for r in sizes)
    ranked = ordinal_within(df.withColumn("_h", hkey), label, ["_h", *key], out="_ord")
    return ranked.filter(F.col("_ord") < m).drop("_h", "_ord", "_ord_n")


# ---------------------------------------------------------------- folds
def md5_bucket(col: Column, k: int) -> Column:
    """pmod(first 32 bits of md5(str(col)), k) — the same value in DuckDB."""
    return F.pmod(F.conv(F.substring(F.md5(col.cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(k)).cast("int")


def group_kfold(df: DataFrame, k: int = 5, group: str = "function_id", out: str = "fold", mode: str = "hash") -> DataFrame:
    """A function never spans two folds.

    hash:     fold = md5(group) mod k — no driver round trip, any number of groups.
    balanced: the size-balancing rule — groups by size (largest first, ties by
              key, null first) each go to the fold with the fewest rows so far
              (the first such).  Only the histogram of group sizes is dealt in
              order: n rows have at most sqrt(2 n) distinct sizes, and groups of
              equal size follow a cycle (``_deal``), so a group finds its fold by
              its ordinal among the groups of its size."""
    if mode == "hash":
        return df.withColumn(out, md5_bucket(F.col(group), k))
    if mode != "balanced":
        raise ValueError(mode)
    from ..session import stored
    sizes = stored(df.groupBy(F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("_size")), "group-sizes")
    histogram = [(r["_size"], r["c"]) for r in sizes.groupBy("_size").agg(F.count(F.lit(1)).alias("c")).collect()]
    dealt = df.sparkSession.createDataFrame(_deal(histogram, k), "_size long, _runs array<struct<first:long,folds:array<int>>>")
    numbered = ordinal_within(sizes, "_size", ["_group"], out="_nth", few_classes=False).join(dealt, "_size")
    run = F.element_at(F.filter("_runs", lambda r: r["first"] <= F.col("_nth")), -1)
    fold = F.get(run["folds"], F.pmod(F.col("_nth") - run["first"], F.size(run["folds"])).cast("int"))
    folds = numbered.select("_group", fold.alias(out))
    return df.join(folds, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def _deal(histogram: Sequence[tuple[int, int]], k: int) -> list[tuple[int, list[tuple[int, list[int]]]]]:
    """For every group size the runs (first ordinal, folds in turn) of the groups of that size,
    when all groups go, largest first, to the fold with the least load (the first such).

    ``c`` groups of size ``s`` go to the folds in the order of (load + j * s, fold): fold i takes
    part from level load // s on, and in a level the folds come by (load % s, i).  So there
    are at most k runs, each a cycle over the folds that have joined."""
    load, out = [0] * k, []
    for s, c in sorted(histogram, reverse=True):
        turn = sorted(range(k), key=lambda i: (load[i] % s, i))
        joins = sorted({x // s for x in load})
        before, runs, before_load = 0, [], list(load)
        for t, level in enumerate(joins):
            if before >= c:
                break
            active = [i for i in turn if before_load[i] // s <= level]
            runs.append((before, active))
            levels = joins[t + 1] - level if t + 1 < len(joins) else c
            n = min(c - before, levels * len(active))
            for place, i in enumerate(active):
                load[i] += s * (n // len(active) + (place < n % len(active)))
            before += n
        out.append((s, runs))
    return out


def stratified_kfold(df: DataFrame, k: int = 5, label: str = "y_true",
                     order: Sequence[str] = ("function_id", "test_idx"), out: str = "fold") -> DataFrame:
    """Contiguous folds per class in key order, sizes n//k (+1 for the first
    n % k folds) — the rule of an unshuffled stratified k-fold."""
    r = ordinal_within(df, label, list(order), out="_r")
    n = F.col("_r_n")
    q = F.floor(n / k)
    rem = n - q * k
    big = rem * (q + 1)
    fold = F.when(F.col("_r") < big, F.floor(F.col("_r") / (q + 1))).otherwise(
        rem + F.floor((F.col("_r") - big) / F.greatest(q, F.lit(1))))
    return r.withColumn(out, fold.cast("int")).drop("_r", "_r_n")
