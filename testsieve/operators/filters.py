"""Filters and predicates over tests and generations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_empty_functions(gens: DataFrame, tests_col: str = "testcases") -> DataFrame:
    """Skip generations without tests."""
    return gens.filter(F.size(F.col(tests_col)) > 0)


def drop_untokenized(tests: DataFrame, token_rows: DataFrame, test_key: Sequence[str],
                     function_key: str | Sequence[str]) -> DataFrame:
    """Drop tests with no aligned token in either section (or whose only
    output token is NULL), then functions left without tests.  Both steps are
    semi joins — hash joins, no collection per function."""
    fk = [function_key] if isinstance(function_key, str) else list(function_key)
    live = token_rows.filter(F.col("token").isNotNull()).select(*test_key).distinct()
    kept = tests.join(live, list(test_key), "left_semi")
    return kept.join(kept.select(*fk).distinct(), fk, "left_semi")


def valid_only(tests: DataFrame, label: str = "is_valid") -> DataFrame:
    return tests.filter(F.col(label) == 1)


def below_threshold(tests: DataFrame, threshold: float, score: str = "prediction_y_prob") -> DataFrame:
    """Curation candidates: predicted probability below the threshold."""
    return tests.filter(F.col(score) < threshold)


def drop_subprocess_tests(tests: DataFrame, text: str = "text") -> DataFrame:
    return tests.filter(~F.col(text).contains("subprocess"))


def validity_filter_by_prediction(prompts: DataFrame, functions: DataFrame, tests: DataFrame,
                                  prompt: str = "prompt", fkey: str = "function_id",
                                  order_key: str = "test_idx") -> DataFrame:
    """For each prompt, the predicted-valid tests of the first function (lowest
    ``fkey``) with that prompt, one row per test: (prompt, fkey, order_key,
    test).  A prompt without a function gives one row with test 'No Tests'; a
    matched function without a valid test gives one row with NULL test.  Rows,
    not a list per prompt, so a function with millions of tests is never one
    value.  Prompts meet by 16 bytes of their hash, hot ones over many tasks."""
    from .joins import spread_join, text_key
    first = functions.select(text_key(prompt).alias("_key"), fkey).groupBy("_key").agg(F.min(fkey).alias(fkey))
    kept = tests.filter(F.col("prediction_is_valid") == 1).select(fkey, order_key, F.col("text").alias("_t"))
    p = spread_join(prompts.withColumn("_key", text_key(prompt)), first, "_key").drop("_key")
    out = spread_join(p, kept, fkey)
    return out.select(prompt, fkey, order_key,
                      F.when(F.col(fkey).isNull(), F.lit("No Tests")).otherwise(F.col("_t")).alias("test"))
