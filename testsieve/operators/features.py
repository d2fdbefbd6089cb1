"""Per-test features: mean/max/min/sum/total/population variance of token
entropy (or probability) for the input and output sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as tf

TEST_KEY = ("dataset", "llm", "function_id", "test_idx")
STATS = ("mean", "max", "min", "sum", "total", "variance")


def token_stats(token_rows: DataFrame, value: str = "entropy", by: Sequence[str] = TEST_KEY,
                sections: Sequence[str] = ("input", "output")) -> DataFrame:
    """Relational form: one shuffle on the test key, partial aggregation first.
    Conditional aggregates pivot the sections; an empty section gives zeros."""
    aggs = []
    for s in sections:
        v = F.when(F.col("section") == s, F.col(value))
        aggs += [F.coalesce(F.avg(v), F.lit(0.0)).alias(f"{s}_mean"),
                 F.coalesce(F.max(v), F.lit(0.0)).cast("double").alias(f"{s}_max"),
                 F.coalesce(F.min(v), F.lit(0.0)).cast("double").alias(f"{s}_min"),
                 F.coalesce(F.sum(v), F.lit(0.0)).cast("double").alias(f"{s}_sum"),
                 F.count(v).cast("double").alias(f"{s}_total"),
                 F.coalesce(F.var_pop(v), F.lit(0.0)).alias(f"{s}_variance")]
    return token_rows.groupBy(*by).agg(*aggs)


def token_stats_nested(gens: DataFrame, value: str = "entropy", tokens_col: str = "tokens",
                       keep: Sequence[str] = (*TEST_KEY, "is_valid"), punct_filter: bool = True) -> DataFrame:
    """Array form over one generation row: no explode and no shuffle — the
    features are computed where the generation was read.

    Each section's value array and its mean are materialised as columns
    before the statistics: expressions inside a lambda are not shared, so a
    mean referenced from the variance lambda would be recomputed per element.
    Higher-order expressions count as expensive, so Catalyst keeps these
    projections separate instead of inlining them."""
    df = gens
    for s in ("input", "output"):
        df = df.withColumn(f"_{s}", F.filter(F.col(tokens_col), lambda t: t["section"] == s))
        col = F.col(f"_{s}")
        if punct_filter:
            # punctuation-only tokens dropped unless that would empty the section
            df = df.withColumn(f"_{s}_k", F.filter(col, lambda t: tf.is_signal_token(t["token"])))
            col = F.when(F.size(f"_{s}_k") == 0, col).otherwise(F.col(f"_{s}_k"))
        if value == "entropy":
            vals = F.transform(col, lambda t: tf.entropy(t["top"]))
        else:
            vals = F.transform(col, lambda t: tf.prob_percent(t["logprob"]))
        df = df.withColumn(f"_{s}_v", vals)
    for s in ("input", "output"):
        v = F.col(f"_{s}_v")
        df = (df.withColumn(f"_{s}_n", F.size(v))
                .withColumn(f"_{s}_sum", F.aggregate(v, F.lit(0.0), lambda a, x: a + x)))
        df = df.withColumn(f"_{s}_mean", F.when(F.col(f"_{s}_n") > 0, F.col(f"_{s}_sum") / F.col(f"_{s}_n")))
    out = list(keep)
    for s in ("input", "output"):
        v, n, mean = F.col(f"_{s}_v"), F.col(f"_{s}_n"), F.col(f"_{s}_mean")
        sq = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        out += [F.coalesce(mean, F.lit(0.0)).alias(f"{s}_mean"),
                F.coalesce(F.array_max(v), F.lit(0.0)).alias(f"{s}_max"),
                F.coalesce(F.array_min(v), F.lit(0.0)).alias(f"{s}_min"),
                F.col(f"_{s}_sum").alias(f"{s}_sum"), n.cast("double").alias(f"{s}_total"),
                F.when(n > 0, sq / n).otherwise(F.lit(0.0)).alias(f"{s}_variance")]
    return df.select(*out)


def feature_sets(features: DataFrame, sets: str = "all", key: Sequence[str] = TEST_KEY,
                 label: str = "is_valid") -> DataFrame:
    """Column selection for the model: all | input | output (naive: feature_*)."""
    prefixes = {"all": ("input", "output"), "input": ("input",), "output": ("output",),
                "naive": ("feature",)}[sets]
    cols = [f"{p}_{s}" for p in prefixes for s in STATS]
    return features.select(*key, label, *cols)


def naive_features(tests: DataFrame, token_rows: DataFrame, gen_key: Sequence[str]) -> DataFrame:
    """naive_entropy: statistics over the whole response, attached to every test."""
    from .tokens import all_tokens
    return tests.join(all_tokens(token_rows, gen_key), list(gen_key), "left")
