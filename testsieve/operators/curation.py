"""Curation: candidate counts, applying reviewed texts,
relabelling from new execution results, prompt assembly per function."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import squash_ws


def curation_candidates(tests: DataFrame, threshold: float = 0.7, label: str = "is_valid",
                        score: str = "prediction_y_prob") -> DataFrame:
    """Totals: valid (=1), invalid (=0) and below-threshold tests."""
    cnt = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    return tests.agg(cnt(F.col(label) == 1).alias("total_valid"), cnt(F.col(label) == 0).alias("total_invalid"),
                     cnt(F.col(score) < threshold).alias("below_threshold"))


def apply_revisions(tests: DataFrame, revisions: DataFrame, key=("function_id", "test_idx"),
                    text: str = "text", revised: str = "validated_text") -> DataFrame:
    """Take the reviewed text when present (non-empty) and different once spaces
    and newlines are removed; keeps the old text and a ``changed`` flag."""
    j = tests.join(revisions.select(*key, revised), list(key), "left")
    has = F.coalesce(F.col(revised), F.lit("")) != ""
    changed = has & (squash_ws(F.col(text)) != squash_ws(F.col(revised)))
    return (j.withColumn("old_text", F.col(text))
            .withColumn("changed", changed)
            .withColumn(text, F.when(changed, F.col(revised)).otherwise(F.col(text)))
            .drop(revised))


def relabel(tests: DataFrame, new_results: DataFrame, key=("function_id", "test_idx"),
            label: str = "is_valid") -> tuple[DataFrame, DataFrame]:
    """Every test is re-run: is_valid = 1 when its new result passed, else 0.
    Returns (relabelled tests, transition counts old -> new)."""
    j = tests.join(new_results.select(*key, "passed"), list(key), "left")
    j = j.withColumn("old_is_valid", F.col(label)) \
         .withColumn(label, F.when(F.coalesce(F.col("passed"), F.lit(False)), 1).otherwise(0)).drop("passed")
    trans = j.groupBy("old_is_valid", label).agg(F.count(F.lit(1)).alias("count"))
    return j, trans


def prompt_assembly(functions: DataFrame, invalid_tests: DataFrame, instruction: str,
                    fkey: str = "function_id", order_key: str = "test_idx",
                    tests_per_prompt: int = 50) -> DataFrame:
    """Prompts for the functions with invalid tests: instruction, description,
    the invalid tests in order (each with its observed and expected value),
    then the implementation.  A function with more than ``tests_per_prompt``
    invalid tests gets several prompts (``part`` 0, 1, ...) covering all of
    them in order — a hot function is split, never dropped or truncated."""
    from .ranking import ordinal_within
    piece = F.concat(F.col("text"), F.lit(" \n"),
                     F.when(F.col("actual").isNotNull(), F.concat(
                         F.lit("\nBy running the test cases, we can see that the actual output is: "), F.col("actual"),
                         F.lit(" but the expected output is: "), F.col("expected"), F.lit("\n"))).otherwise(F.lit("")))
    numbered = ordinal_within(invalid_tests, fkey, [order_key], out="_o", few_classes=False)
    parts = (numbered.withColumn("part", F.floor(F.col("_o") / tests_per_prompt).cast("int"))
             .withColumn("_piece", piece).groupBy(fkey, "part")
             .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order_key, "_piece"))),
                                           lambda s: s["_piece"]), "").alias("_tests")))
    return functions.join(parts, fkey).select(fkey, "part", F.concat(
        F.lit(instruction), F.lit("\nfunction description:\n"), F.col("description"), F.lit("\ngenerated tests:\n"),
        F.col("_tests"), F.lit("\nfunction implementation:\n"), F.col("solution")).alias("prompt"))
