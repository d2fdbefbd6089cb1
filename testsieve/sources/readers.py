"""Readers: generations (partitioned parquet), JSONL tasks / problems /
generated code, benchmark normalisation, id subsets, exclusions, overrides
(SURVEY §2.1).  Path-based readers call DataFrame-level parsers, so that lines
from elsewhere (a stream, a table) are parsed by the same rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DoubleType, IntegerType, LongType, StringType, StructField,
                               StructType)

from ..functions import text as T
from . import sinks

TOP = StructType([StructField("token", StringType()), StructField("logprob", DoubleType())])
TOKEN = StructType([StructField("pos", IntegerType()), StructField("token", StringType()),
                    StructField("logprob", DoubleType()), StructField("section", StringType()),
                    StructField("top", ArrayType(TOP))])
GENERATIONS = StructType([
    StructField("function_id", LongType()), StructField("test_idx", LongType()),
    StructField("prompt", StringType()), StructField("solution", StringType()),
    StructField("test_type", IntegerType()), StructField("testcases", ArrayType(StringType())),
    StructField("is_valid", IntegerType()), StructField("tokens", ArrayType(TOKEN)),
    StructField("dataset", StringType()), StructField("llm", StringType()),
])
ASSERTIONS, UNIT_TESTS = 0, 1  # values of test_type
PROBLEM = StructType([
    StructField("id", StringType()), StructField("function_name", StringType()),
    StructField("public_test_cases", ArrayType(StructType([StructField("input", StringType()),
                                                           StructField("output", StringType())]))),
])
GENERATED = StructType([StructField("task_id", StringType()), StructField("response_code", StringType()),
                        StructField("response", StringType())])


# ------------------------------------------------------------------ generations
def read_generations(spark: SparkSession, path: str, dataset: str | None = None, llm: str | None = None) -> DataFrame:
    """Generations stored as a snapshot table by (dataset, llm): prompt, solution, kind and
    texts of the tests, tokens with their alternatives.  Folders of other datasets and
    models are not opened."""
    only = {c: v for c, v in (("dataset", dataset), ("llm", llm)) if v is not None}
    return sinks.read_snapshot(spark, path, GENERATIONS, **only)


# ------------------------------------------------------------------ JSONL
def read_jsonl_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines of JSONL files (blank ones left out) with a line-order column: file name,
    start of the split in the file, and place in the split (splits are read largest
    first, so the running id alone does not follow the files)."""
    return (spark.read.text(path)
            .select("value", F.col("_metadata.file_path").alias("_file"),
                    F.struct("_metadata.file_path", "_metadata.file_block_start",
                             F.monotonically_increasing_id().alias("id")).alias("line_no"))
            .where(F.trim("value") != ""))


def parsed(lines: DataFrame, schema: StructType, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(the other columns and ``record``, the rejects with their text): lines that are no JSON
    object or do not fit the schema are rejects, not nulls among the records."""
    whole = StructType([*schema.fields, StructField("_bad", StringType())])
    rows = lines.withColumn("record", F.from_json(F.col(value), whole, {"columnNameOfCorruptRecord": "_bad"}))
    bad = F.coalesce(F.col("record._bad").isNotNull(), F.lit(True))
    good = rows.where(~bad).drop(value).withColumn("record", F.struct(*(F.col(f"record.`{f.name}`") for f in schema.fields)))
    return good, rows.where(bad).drop("record")


def scan_jsonl_tasks(spark: SparkSession, path: str | Sequence[str], schema: StructType, key: str = "task_id") -> tuple[DataFrame, DataFrame]:
    """Records of JSONL files by ``key`` (the last duplicate, in the order of files and lines, wins)
    and the rejected lines."""
    good, bad = parsed(read_jsonl_lines(spark, path), schema)
    return latest_per_key(good.select("record.*", "line_no"), key, "line_no").drop("line_no"), bad


def scan_problems(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return parse_problems(read_jsonl_lines(spark, path))


def scan_generated_code(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return parse_generated_code(read_jsonl_lines(spark, path))


def latest_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row per key by ``order`` — an aggregation (partial per map
    task), not a window, so a hot key never sorts in one task."""
    cols = [c for c in df.columns if c != key]
    packed = df.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_r"))
    return packed.select(key, "_r.*")


def parse_jsonl_tasks(lines: DataFrame, schema: StructType, value: str = "value", order: str = "line_no",
                      key: str = "task_id") -> DataFrame:
    """JSON records keyed by ``key``; the last duplicate wins."""
    rows = parsed(lines, schema, value)[0].select("record.*", order)
    return latest_per_key(rows, key, order)


def parse_problems(lines: DataFrame, value: str = "value", order: str = "line_no") -> DataFrame:
    """One row per public test case holding both input and output, trimmed; of problems
    with one id the last by ``order`` wins (all stay where lines have no such column)."""
    good = parsed(lines, PROBLEM, value)[0]
    p = latest_per_key(good.select("record.*", order), "id", order) if order in lines.columns else good.select("record.*")
    cases = p.select("id", "function_name", F.posexplode_outer("public_test_cases").alias("case_idx", "case"))
    return (cases.filter(F.col("case.input").isNotNull() & F.col("case.output").isNotNull())
            .select(F.col("id").alias("task_id"), "function_name", "case_idx",
                    T.strip_ws(F.col("case.input")).alias("input"), T.strip_ws(F.col("case.output")).alias("output")))


def choose_generated_code(response_code: Column, response: Column) -> Column:
    """response_code; else the first ```python block (from the line after the
    fence); else the first fenced block (a leading 'python\\n' removed)."""
    py = T.strip_ws(F.regexp_extract(response, r"(?s)```python[^\n]*\n(.*?)```", 1))
    fenced = T.strip_ws(F.regexp_extract(response, r"(?s)```(.*?)```", 1))
    fenced = F.when(fenced.startswith("python\n"), F.substring(fenced, 8, 1 << 30)).otherwise(fenced)
    from_resp = (F.when(response.contains("```python"), F.nullif(py, F.lit("")))
                 .when(response.contains("```"), F.nullif(fenced, F.lit(""))))
    return F.when(F.coalesce(response_code, F.lit("")) != "", response_code).otherwise(from_resp)


def parse_generated_code(lines: DataFrame, value: str = "value", order: str = "line_no") -> DataFrame:
    """task_id -> code; rows without code are dropped; the last task_id wins."""
    g = parsed(lines, GENERATED, value)[0].select("record.*", order)
    g = g.select("task_id", choose_generated_code(F.col("response_code"), F.col("response")).alias("code"), order)
    g = g.filter(F.col("code").isNotNull() & (F.col("code") != "") & F.col("task_id").isNotNull() & (F.col("task_id") != ""))
    return latest_per_key(g, "task_id", order).drop(order)


# ------------------------------------------------------------------ benchmarks
def normalize(df: DataFrame, benchmark: str, task_id: Column, prompt: Column, solution: Column,
              tests: Column) -> DataFrame:
    """One benchmark brought to (benchmark, task_id, prompt, solution, tests)."""
    return df.select(F.lit(benchmark).alias("benchmark"), task_id.cast("string").alias("task_id"),
                     prompt.alias("prompt"), solution.alias("solution"), tests.alias("tests"))


def normalize_benchmarks(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def subset_by_ids(tasks: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Keep only tasks listed in the id table (semi join; AQE broadcasts the id
    list after measuring it)."""
    return tasks.join(ids.select(key), key, "left_semi")


def exclude_known_bad(tasks: DataFrame, exclusions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Remove listed positions (anti join on the exclusion table)."""
    return tasks.join(exclusions.select(*keys), list(keys), "left_anti")


def name_override(tasks: DataFrame, overrides: DataFrame, key: str, name: str = "function_name") -> DataFrame:
    """Replace the derived name where the override table has one."""
    o = overrides.select(key, F.col(name).alias("_override"))
    return (tasks.join(o, key, "left")
            .withColumn(name, F.coalesce(F.col("_override"), F.col(name))).drop("_override"))


def verified_tasks(tasks: DataFrame, solutions: DataFrame, tests: DataFrame, reference_runs: DataFrame,
                   key: str = "task_id") -> tuple[DataFrame, DataFrame]:
    """Tasks with a solution, at least one test and a reference run; returns
    (those whose reference run passed, counts per result over all)."""
    t = (tasks.join(solutions.select(key).distinct(), key, "left_semi")
         .join(tests.select(key).distinct(), key, "left_semi")
         .join(reference_runs.select(key, "passed"), key, "inner"))
    return t.filter("passed"), t.groupBy("passed").agg(F.count(F.lit(1)).alias("count"))


def assign_ids(df: DataFrame, function_key: str, order_key: str) -> DataFrame:
    """Consecutive function ids (0-based dense rank of the function key) and
    the test position inside each function — without a global window."""
    from ..operators.ranking import ordinal_within
    keys = df.select(function_key).distinct().withColumn("_one", F.lit(1))
    ids = ordinal_within(keys, "_one", [function_key], out="function_id").select(function_key, "function_id")
    pos = ordinal_within(df, function_key, [order_key], out="test_pos", few_classes=False).drop("test_pos_n")
    return pos.join(ids, function_key)
