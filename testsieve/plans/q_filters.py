"""Queries: filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as FL
from ..sources import adapters as A
from ..sources.tables import load
from .registry import query, r6
from .views import with_views


def _gens(spark, sf):
    """Generations over documents: the tests of a response are its lines holding a comma."""
    d = load(spark, sf, "documents", "doc_id", "text")
    return d.select("doc_id", F.filter(F.split("text", "\n"), lambda l: l.contains(",")).alias("testcases"))


@query("drop_empty_functions", """
SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda l: contains(l, ','))) AS INTEGER) AS n_tests
FROM documents WHERE len(list_filter(string_split(text, chr(10)), lambda l: contains(l, ','))) > 0""")
def q_drop_empty_functions(spark, sf):
    return FL.drop_empty_functions(_gens(spark, sf)).select("doc_id", F.size("testcases").alias("n_tests"))


@query("valid_only", with_views("corpus_v") + "SELECT function_id, test_idx FROM corpus_v WHERE is_valid = 1")
def q_valid_only(spark, sf):
    return FL.valid_only(A.corpus_v(spark, sf)).select("function_id", "test_idx")


@query("below_threshold", with_views("scores_v") +
       "SELECT function_id, test_idx, round(y_prob, 6) AS prediction_y_prob FROM scores_v WHERE y_prob < 0.7")
def q_below_threshold(spark, sf):
    s = A.scores_v(spark, sf).withColumnRenamed("y_prob", "prediction_y_prob")
    return r6(FL.below_threshold(s, 0.7).select("function_id", "test_idx", "prediction_y_prob"))


@query("drop_subprocess_tests", with_views("corpus_v") + """
SELECT function_id, test_idx FROM (
  SELECT function_id, test_idx, CASE WHEN test_idx % 10 = 0 THEN 'import subprocess' || chr(10) ELSE '' END || text AS text
  FROM corpus_v) WHERE NOT contains(text, 'subprocess')""")
def q_drop_subprocess_tests(spark, sf):
    c = A.corpus_v(spark, sf).withColumn(
        "text", F.concat(F.when(F.pmod("test_idx", F.lit(10)) == 0, F.lit("import subprocess\n")).otherwise(F.lit("")),
                         F.col("text")))
    return FL.drop_subprocess_tests(c).select("function_id", "test_idx")


@query("validity_filter_by_prediction", """
WITH f AS (SELECT text AS prompt, min(doc_id) AS function_id FROM documents GROUP BY text),
t AS (SELECT doc_id AS function_id, CAST(i - 1 AS INTEGER) AS test_idx, string_split(text, chr(10))[i] AS line
      FROM documents, range(1, len(string_split(text, chr(10))) + 1) r(i)),
v AS (SELECT * FROM t WHERE contains(line, ',')),
p AS (SELECT text AS prompt FROM documents UNION ALL SELECT text FROM benchmark)
SELECT md5(p.prompt) AS prompt_md5, f.function_id, v.test_idx,
       CASE WHEN f.function_id IS NULL THEN 'No Tests' ELSE v.line END AS test
FROM p LEFT JOIN f ON p.prompt = f.prompt LEFT JOIN v ON f.function_id = v.function_id""")
def q_validity_filter_by_prediction(spark, sf):
    d = load(spark, sf, "documents", "doc_id", "text")
    functions = d.select(F.col("doc_id").alias("function_id"), F.col("text").alias("prompt"))
    tests = d.select(F.col("doc_id").alias("function_id"),
                     F.posexplode(F.split("text", "\n")).alias("test_idx", "text"))
    tests = tests.withColumn("prediction_is_valid", F.when(F.col("text").contains(","), 1).otherwise(0))
    prompts = d.select(F.col("text").alias("prompt")).unionByName(
        load(spark, sf, "benchmark", "text").select(F.col("text").alias("prompt")))
    out = FL.validity_filter_by_prediction(prompts, functions, tests)
    return out.select(F.md5("prompt").alias("prompt_md5"), "function_id", "test_idx", "test")
