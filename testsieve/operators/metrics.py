"""Counting metrics: validity, confusion counts, precision/recall/F1,
selection statistics, the threshold x top-N sweep.

All of them are single ``agg``/``groupBy`` passes with conditional sums, so
Spark pre-aggregates per map task before any shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import selection as sel
from .ranking import weight_before


def _sum_if(cond: Column) -> Column:
    """Count of rows meeting ``cond`` (0, not NULL, on empty input)."""
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("bigint")


def safe_div(a: Column, b: Column) -> Column:
    """a / b, 0 on an empty denominator (the reference's convention)."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p = safe_div(tp, tp + fp)
    r = safe_div(tp, tp + fn)
    f1 = F.when((p + r) == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))
    return [p.alias("precision"), r.alias("recall"), f1.alias("f1")]


def confusion(df: DataFrame, truth: str = "y_true", pred: str = "y_pred", by: Sequence[str] = ()) -> DataFrame:
    """TP/FP/FN/TN, accuracy, precision, recall, F1 (NULL truths skipped)."""
    t, p = F.col(truth), F.col(pred)
    agg = (df.groupBy(*by) if by else df.groupBy()).agg(
        _sum_if((t == 1) & (p == 1)).alias("tp"), _sum_if((t == 0) & (p == 1)).alias("fp"),
        _sum_if((t == 1) & (p == 0)).alias("fn"), _sum_if((t == 0) & (p == 0)).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return agg.select(*by, "tp", "fp", "fn", "tn",
                      safe_div(tp + tn, tp + fp + fn + tn).alias("accuracy"), *prf(tp, fp, fn))


def fold_metrics(scored: DataFrame, cut: float = 0.5, truth: str = "y_true", fold: str = "fold") -> DataFrame:
    """Per fold: confusion counts and accuracy/precision/recall/F1 of y_prob >= cut."""
    return confusion(scored.withColumn("y_pred", F.when(F.col("y_prob") >= cut, 1).otherwise(0)),
                     truth, "y_pred", [fold])


def validity_counts(tests: DataFrame, label: str = "is_valid", by: Sequence[str] = ()) -> DataFrame:
    """Number valid, invalid (anything but 1, NULL included) and the ratio."""
    agg = (df_group(tests, by)).agg(_sum_if(F.col(label) == 1).alias("valid"),
                                    F.count(F.lit(1)).alias("total"))
    return agg.select(*by, "valid", (F.col("total") - F.col("valid")).alias("invalid"), "total",
                      safe_div(F.col("valid"), F.col("total")).alias("valid_ratio"))


def df_group(df: DataFrame, by: Sequence[str]):
    return df.groupBy(*by) if by else df.groupBy()


def selection_stats(selected: DataFrame, truth: str = "y_true", by: Sequence[str] = ("function_id",)) -> DataFrame:
    """Totals of a selection: tests, valid tests, the valid ratio rounded to 3,
    and the number of functions that kept at least one test."""
    per_fn = selected.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), _sum_if(F.col(truth) == 1).alias("_v"))
    return per_fn.agg(F.sum("_n").cast("bigint").alias("total_selected"),
                      F.sum("_v").cast("bigint").alias("valid_selected"),
                      F.count(F.lit(1)).alias("functions"),
                      F.round(safe_div(F.sum("_v"), F.sum("_n")), 3).alias("valid_ratio"))


def selection_prf(flagged: DataFrame, truth: str = "y_true", flag: str = "selected") -> DataFrame:
    """Selection against all tests: TP FP FN TN, precision, recall, F1, plus the
    reference's rounded variant (TP = round(total * round(ratio, 3)), D6)."""
    t, s = F.col(truth), F.col(flag)
    a = flagged.agg(
        _sum_if((t == 1) & (s == 1)).alias("tp"), _sum_if((t != 1) & (s == 1)).alias("fp"),
        _sum_if((t == 1) & (s == 0)).alias("fn"), _sum_if((t != 1) & (s == 0)).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    sel_n = tp + fp
    r_tp = F.bround(sel_n * F.bround(safe_div(tp, sel_n), 3), 0).cast("bigint")
    r_p = safe_div(r_tp, sel_n)
    r_r = safe_div(r_tp, tp + fn)
    return a.select("tp", "fp", "fn", "tn", *prf(tp, fp, fn),
                    r_tp.alias("tp_rounded"),
                    F.when(r_p + r_r == 0, F.lit(0.0)).otherwise(2 * r_p * r_r / (r_p + r_r)).alias("f1_rounded"))


def threshold_sweep(scores: DataFrame, thresholds: Sequence[float], ns: Sequence[int],
                    by: Sequence[str] = ("function_id",), test_key: str = "test_idx",
                    truth: str = "y_true") -> DataFrame:
    """Selection metrics for every (threshold, N) pair in one pass over the
    scores plus one pass over the (small) top-max(N) rows.

    Both become counts by the number of thresholds that a score reaches (and by rank):
    a table of at most (thresholds + 1) x (max(N) + 1) cells, from which every
    pair's counts are sums.  No join of scores with parameters."""
    levels, yp = sorted(float(t) for t in thresholds), F.col("y_prob")
    reached = sum((F.coalesce((yp >= t).cast("int"), F.lit(0)) for t in levels), F.lit(0))
    counts = [F.count(F.lit(1)).alias("n"), _sum_if(F.col(truth) == 1).alias("v")]
    full = scores.groupBy(reached.alias("reached")).agg(*counts).withColumn("rank", F.lit(None).cast("int"))
    top = sel.top_n(scores, max(ns), by, [yp.desc(), F.col(test_key).asc()], "rank").groupBy("rank", reached.alias("reached")).agg(*counts)
    cells = full.unionByName(top).agg(F.collect_list(F.struct("rank", "reached", "n", "v")).alias("cells"))
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("threshold"), F.lit(int(n)).alias("top_n"))
                      for i, t in enumerate(levels) for n in ns])
    m = cells.select("cells", F.inline(pairs))
    total = lambda field, cond: F.aggregate(F.filter("cells", cond), F.lit(0).cast("bigint"), lambda a, x: a + x[field])
    kept = lambda x: F.when(x["rank"].isNull(), x["reached"] > F.col("i")).otherwise((x["rank"] <= F.col("top_n")) & (x["reached"] <= F.col("i")))
    m = m.select("threshold", "top_n", total("n", kept).alias("selected"), total("v", kept).alias("tp"),
                 total("n", lambda x: x["rank"].isNull()).alias("_all"), total("v", lambda x: x["rank"].isNull()).alias("_valid"))
    tp, selected = F.col("tp"), F.col("selected")
    fp, fn = selected - tp, F.col("_valid") - tp
    return m.select("threshold", "top_n", selected, tp, fp.alias("fp"), fn.alias("fn"), (F.col("_all") - F.col("_valid") - fp).alias("tn"),
                    F.round(safe_div(tp, selected), 3).alias("valid_ratio"), *prf(tp, fp, fn))


def feature_means_by_validity(features: DataFrame, by: Sequence[str] = ("dataset", "llm"),
                              cols: Sequence[str] = ("input_mean", "output_mean"), label: str = "is_valid") -> DataFrame:
    return features.groupBy(*by, label).agg(*[F.round(F.avg(c), 3).alias(f"avg_{c}") for c in cols],
                                            F.count(F.lit(1)).alias("tests"))


def clipped_percentiles(features: DataFrame, col: str = "output_mean", cap: float = 100.0,
                        label: str = "is_valid", ps: Sequence[float] = (0.5, 0.75)) -> DataFrame:
    """min(x, cap) then exact percentiles (linear interpolation) per class.

    Selection by rank: rows become counts of their values (map-side), running counts
    over ranges of values give each value its ranks, and a percentile reads the two
    values at the ranks around it.  No class's values meet in one buffer.  Nulls count for
    no rank; a class without values gives nulls."""
    x = F.when(F.col(col).isNotNull(), F.least(F.col(col), F.lit(cap)))
    counts = features.select(F.col(label), x.alias("_x")).groupBy(label, "_x").agg(F.count("_x").alias("_n"))
    r = weight_before(counts, label, ["_x"], "_n", out="_before")
    aggs, out = [F.max("_before_total").alias("_total")], [F.col(label)]
    for i, p in enumerate(ps):
        at = F.lit(p) * (F.col("_before_total") - 1)
        holds = lambda rank: (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n"))
        aggs += [F.max(F.when(holds(F.floor(at)), F.col("_x"))).alias(f"_lo{i}"), F.max(F.when(holds(F.ceil(at)), F.col("_x"))).alias(f"_hi{i}")]
        at = F.lit(p) * (F.col("_total") - 1)
        out.append((F.col(f"_lo{i}") + (at - F.floor(at)) * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(f"p{int(p * 100)}"))
    return r.groupBy(label).agg(*aggs).select(*out)


def reviewer_baseline(tests: DataFrame, judged: str = "judged_valid", truth: str = "is_valid") -> DataFrame:
    """Counts and ratio of tests judged valid by a reviewer (judgement is an input column)."""
    j, t = F.col(judged), F.col(truth)
    a = tests.agg(_sum_if(j == 1).alias("judged_valid"), _sum_if((j == 1) & (t == 1)).alias("tp"),
                  _sum_if((j == 1) & (t != 1)).alias("fp"), _sum_if((j != 1) & (t == 1)).alias("fn"),
                  F.count(F.lit(1)).alias("total"))
    return a.select("judged_valid", "total", F.round(safe_div(F.col("tp"), F.col("judged_valid")), 3).alias("valid_ratio"),
                    "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))
