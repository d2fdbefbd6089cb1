"""Outcomes of running tests, measured elsewhere and read as tables: error
classes, unittest summaries, mutation logs and scores, line coverage, failure
categories, per-task pass/fail reports (SURVEY §2.5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import between_markers, strip_ws
from .metrics import safe_div

# Fixed values that must equal the reference's: the failure classes in the
# order they are tested (the first match wins) and the text that marks them.
ERROR_CLASSES = [
    ("assertion", "AssertionError"),
    ("syntax", "SyntaxError"),
    ("indentation", "IndentationError"),
    ("type", "TypeError"),
    ("value", "ValueError"),
    ("attribute", "AttributeError"),
    ("module_not_found", "ModuleNotFoundError"),
    ("import", "ImportError"),
    ("name", "NameError"),
    ("file_not_found", "FileNotFoundError"),
]

# Fixed values that must equal the reference's: failure categories of invalid tests.
CATEGORIES = [
    (1, "Misunderstanding of Function Logic"),
    (2, "Edge Case Misinterpretation"),
    (3, "Off-by-One or Range Errors"),
    (4, "Incorrect Input-Output Mapping"),
    (5, "Ambiguities or Incompleteness in the Docstring"),
    (6, "Rounding Expectations"),
]
UNKNOWN_CATEGORY = (-1, "Unknown")

# Fixed value that must equal the reference's: a mutation runner progress line.
PROGRESS_LINE = r"^[^\s]+\s+(\d+/\d+)\s+🎉\s+(\d+)\s+⏰\s+(\d+)\s+🤔\s+(\d+)\s+🙁\s+(\d+)\s+🔇\s+(\d+)$"
MUTANT_STATES = ("killed", "timeout", "suspicious", "survived", "skipped")


def error_class(output: Column) -> Column:
    expr = None
    for name, marker in ERROR_CLASSES:
        cond = output.contains(marker)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def error_class_counts(outputs: DataFrame, output: str = "output") -> DataFrame:
    """Count failure outputs per class (first class in the fixed order wins)."""
    c = outputs.select(error_class(F.col(output)).alias("error_class")).filter(F.col("error_class").isNotNull())
    return c.groupBy("error_class").agg(F.count(F.lit(1)).alias("count"))


def unittest_summary(outputs: DataFrame, output: str = "output") -> DataFrame:
    """passed/failed from a unittest runner's text.  'OK (tests=n)' -> (n, 0);
    'FAILED (failures=a, errors=b)' -> (0, a+b); malformed numbers -> (0, 1);
    no parenthesis or neither word -> (0, 0)."""
    o = F.col(output)
    info = F.regexp_extract(o, r"^[^(]*\(([^)]*)\)", 1)
    has_info = o.rlike(r"^[^(]*\([^)]*\)")
    after_eq = lambda c: F.trim(F.get(F.split(c, "="), 1)).try_cast("int")
    ok_n = after_eq(info)
    parts = F.split(info, ",")
    f_n, e_n = after_eq(F.get(parts, 0)), after_eq(F.get(parts, 1))
    passed = F.when(o.contains("OK") & has_info & ok_n.isNotNull(), ok_n).otherwise(0)
    failed = (F.when(o.contains("OK"), F.when(has_info & ok_n.isNull(), 1).otherwise(0))
              .when(o.contains("FAILED"), F.when(~has_info, 0).when(f_n.isNull() | e_n.isNull(), 1).otherwise(f_n + e_n))
              .otherwise(0))
    return outputs.withColumn("passed", passed.cast("int")).withColumn("failed", failed.cast("int"))


def mutation_log_parse(logs: DataFrame, log: str = "log") -> DataFrame:
    """Counters of the last progress line of each log; logs without one give no row."""
    lines = F.filter(F.transform(F.split(F.col(log), "\n"), strip_ws), lambda l: l.rlike(PROGRESS_LINE))
    parsed = logs.withColumn("_last", F.try_element_at(lines, F.lit(-1))).filter(F.col("_last").isNotNull())
    # the matched line is "<spinner> <step> 🎉 k ⏰ t 🤔 s 🙁 v 🔇 sk": one split reads every field
    parts = F.split(F.col("_last"), r"\s+")
    out = parsed.withColumn("step", F.get(parts, 1))
    for i, s in enumerate(MUTANT_STATES):
        out = out.withColumn(s, F.get(parts, 3 + 2 * i).cast("int"))
    return out.drop("_last")


def mutation_score(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum the counters over modules; score = killed / total * 100 (0 when no
    mutant), total includes skipped."""
    g = results.groupBy(*by) if by else results.groupBy()
    a = g.agg(*[F.coalesce(F.sum(s), F.lit(0)).cast("bigint").alias(s) for s in MUTANT_STATES],
              F.count(F.lit(1)).alias("modules"))
    total = sum((F.col(s) for s in MUTANT_STATES[1:]), F.col(MUTANT_STATES[0]))
    return a.withColumn("total", total).withColumn("score", F.round(safe_div(F.col("killed"), total) * 100, 2))


def line_coverage(hits: DataFrame, tests: DataFrame, functions: DataFrame,
                  key: Sequence[str] = ("function_id", "test_idx"), fkey: str = "function_id") -> DataFrame:
    """Per function: distinct lines executed by its valid tests / total lines
    (always a fraction, D7); functions without a valid test get 0.

    Lines are bits: the hits of 64 neighbouring lines of a function are one word, merged by
    ``bit_or`` before and after the one shuffle, whatever the number of tests that hit
    them; a function's count is the sum of its words' bits."""
    valid = tests.filter(F.col("is_valid") == 1).select(*key)
    words = hits.join(valid, list(key), "left_semi").where(F.col("line_no").isNotNull()).groupBy(fkey, F.shiftright("line_no", 6).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(line_no & 63))")).alias("_lines"))
    covered = words.groupBy(fkey).agg(F.sum(F.bit_count("_lines")).alias("covered"))
    return (functions.join(covered, fkey, "left")
            .select(fkey, F.coalesce(F.col("covered"), F.lit(0)).cast("bigint").alias("covered"), "total_lines",
                    safe_div(F.coalesce(F.col("covered"), F.lit(0)), F.col("total_lines")).alias("coverage")))


def mean_coverage(cov: DataFrame, col: str = "coverage") -> DataFrame:
    return cov.agg(F.round(F.avg(col), 3).alias("mean_coverage"), F.count(F.lit(1)).alias("functions"))


def avg_line_branch_coverage(entries: DataFrame) -> DataFrame:
    """Averages over entries without an error; branch only over numeric values;
    branch = NULL ('N/A') when none is numeric."""
    ok = F.col("error").isNull()
    return entries.agg(
        F.round(F.coalesce(F.avg(F.when(ok, F.col("line_coverage_percent"))), F.lit(0.0)), 2).alias("avg_line_coverage"),
        F.round(F.avg(F.when(ok, F.col("branch_coverage_percent"))), 2).alias("avg_branch_coverage"))


def category_table(spark: SparkSession) -> DataFrame:
    """Fixed dimension table (7 rows)."""
    return spark.createDataFrame(CATEGORIES + [UNKNOWN_CATEGORY], "category_index int, category_name string")


def map_categories(responses: DataFrame, invalid_tests: DataFrame, spark: SparkSession,
                   fkey: str = "function_id", order_key: str = "test_idx") -> DataFrame:
    """The k-th line between the ***** markers of a function's response names
    the category of its k-th invalid test ('Category n'); missing or unknown
    -> Unknown (-1).  Invalid tests are numbered in key order per function."""
    from .ranking import ordinal_within
    lines = responses.select(fkey, F.posexplode(F.split(between_markers(F.col("text")), "\n")).alias("k", "line"))
    lines = lines.withColumn("category_index",
                             F.expr(r"try_cast(nullif(regexp_extract(line, 'Category\\s*(\\d+)', 1), '') AS INT)"))
    cats = F.broadcast(category_table(spark).filter(F.col("category_index") > 0))  # 6 rows
    lines = lines.join(cats, "category_index", "left").select(fkey, "k", F.col("category_name").alias("_name"),
                                                               F.col("category_index").alias("_idx"))
    # number invalid tests per function without sorting a whole function in one task
    inv = ordinal_within(invalid_tests, fkey, [order_key], out="k", few_classes=False).drop("k_n")
    out = inv.join(lines, [fkey, "k"], "left")
    known = F.col("_name").isNotNull()
    return out.select(*invalid_tests.columns,
                      F.when(known, F.col("_idx")).otherwise(F.lit(UNKNOWN_CATEGORY[0])).alias("category_index"),
                      F.when(known, F.col("_name")).otherwise(F.lit(UNKNOWN_CATEGORY[1])).alias("category_name"))


def category_counts(categorized: DataFrame) -> DataFrame:
    return categorized.groupBy("category_name").agg(F.count(F.lit(1)).alias("count"))


def category_counts_by_prediction(categorized: DataFrame, pred: str = "prediction_is_valid") -> DataFrame:
    p = F.col(pred)
    return categorized.groupBy("category_name").agg(
        F.count(F.lit(1)).alias("count"),
        F.sum(F.when(p == 0, 1).otherwise(0)).cast("bigint").alias("predicted_invalid"),
        F.sum(F.when(p != 0, 1).otherwise(0)).cast("bigint").alias("predicted_valid"))


def all_tests_pass(results: DataFrame, task: str = "task_id", case: str = "case_idx") -> DataFrame:
    """Per task: did every case pass; each failing case as a row with its
    message 'Test i: msg' (1-based, 'Output mismatch' when empty).  The
    reference joins these messages with '; ' in case order; rows keep a task
    with millions of cases from becoming one value.  Tasks without a failure
    get one row with NULL case and message."""
    summary = results.groupBy(task).agg(F.bool_and("passed").alias("passed"))
    fails = results.filter(~F.col("passed")).select(
        task, F.col(case).alias("failed_case"),
        F.concat(F.lit("Test "), (F.col(case) + 1).cast("string"), F.lit(": "),
                 F.coalesce(F.nullif(F.col("error_msg"), F.lit("")), F.lit("Output mismatch"))).alias("error_message"))
    return summary.join(fails, task, "left")
