"""Prompt-keyed joins with last-match semantics and the prediction join
(SURVEY §2.6).  Long texts meet by 16 bytes of their sha256, so no text is a
shuffle key; keys that hold more rows than a task should are counted first and
their rows are dealt over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import selection as S

HOT_ROWS = 10_000  # a key of fewer rows is never split


def text_key(text: str) -> Column:
    """16 bytes that stand for a text (null for null)."""
    return F.unhex(F.substring(F.sha2(F.col(text), 256), 1, 32))


def spread_join(left: DataFrame, right: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``left`` left-joined with ``right`` on ``key``, where one key may hold most of ``left``.

    Keys of more rows than an even share of the partitions (and than ``hot_rows``) are
    hot: there are no more of them than partitions, so their list is broadcast.  A hot
    row of ``left`` gets one of as many salts as there are partitions, a hot row of
    ``right`` every salt."""
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    total = sizes.agg(F.sum("_rows").alias("_all"))
    hot = F.broadcast(sizes.join(F.broadcast(total), (F.col("_rows") > hot_rows) & (F.col("_rows") > F.col("_all") / parts))
                      .select(key, F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.monotonically_increasing_id(), F.lit(parts))).otherwise(0).cast("int")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    dealt = left.join(hot, key, "left").withColumn("_salt", salt).drop("_hot")
    copies = right.join(hot, key, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return dealt.join(copies, [key, "_salt"], "left").drop("_salt")


def last_per_prompt(df: DataFrame, prompt: str, value: str, order: str) -> DataFrame:
    """For every distinct prompt (``_key``), ``value`` of its last row by ``order``."""
    return df.select(text_key(prompt).alias("_key"), value, F.col(order).alias("_order")).groupBy("_key").agg(
        F.max_by(F.col(value), F.col("_order")).alias(value))


def join_prompt_last(solutions: DataFrame, benchmark: DataFrame, prompt: str = "prompt",
                     task: str = "task_id", order: str = "line_no") -> DataFrame:
    """Map each solution to the task of the last benchmark row with its prompt;
    a prompt missing from the benchmark fails the job (as the reference does)."""
    last = last_per_prompt(benchmark, prompt, task, order)
    out = spread_join(solutions.withColumn("_key", text_key(prompt)), last, "_key").drop("_key")
    return out.withColumn(task, F.coalesce(F.col(task), F.raise_error(F.lit("prompt not found in benchmark"))))


def join_scores_last(functions: DataFrame, scored: DataFrame, tests: DataFrame, prompt: str = "prompt",
                     fkey: str = "function_id", order: str = "function_id") -> DataFrame:
    """Each function with the tests of the last scored function with its prompt: a row for
    every test, one with nulls where there is no such function or it has no test.

    functions: ``prompt`` and columns of their own; scored: ``fkey``, ``prompt``; tests: ``fkey``
    and a row for each test.  Tests stay rows, so a function of any number of them
    is no single value."""
    last = last_per_prompt(scored.withColumn("_last", F.col(fkey)), prompt, "_last", order)
    found = spread_join(functions.withColumn("_key", text_key(prompt)), last, "_key").drop("_key")
    out = spread_join(found, tests.withColumnRenamed(fkey, "_last"), "_last")
    return out.withColumnRenamed("_last", f"last_{fkey}")


def predict_join(scores: DataFrame, threshold: float, n: int) -> DataFrame:
    """Every test with prediction_is_valid (selected 1 / not 0) and its y_prob."""
    f = S.flag_selected(scores, threshold, n, out="prediction_is_valid")
    return f.withColumnRenamed("y_prob", "prediction_y_prob")
