"""Queries: prompt joins and the prediction join."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..sources import adapters as A
from ..sources.tables import load
from .q_windows import N, SEL_SQL, T
from .registry import query, r6
from .views import with_views


@query("join_prompt_last", """
SELECT d.doc_id, l.task_id FROM documents d
JOIN (SELECT text, max(doc_id) AS task_id FROM documents GROUP BY text) l ON d.text = l.text""")
def q_join_prompt_last(spark, sf):
    d = load(spark, sf, "documents", "doc_id", "text")
    sols = d.select("doc_id", F.col("text").alias("prompt"))
    bench = d.select(F.col("doc_id").alias("task_id"), F.col("text").alias("prompt"), F.col("doc_id").alias("line_no"))
    return J.join_prompt_last(sols, bench).select("doc_id", "task_id")


@query("join_scores_last", """
WITH f AS (SELECT 'doc' AS kind, doc_id AS id, text AS prompt FROM documents
           UNION ALL SELECT 'bench', item_id, text FROM benchmark),
s AS (SELECT text AS prompt, max(doc_id) AS last_id FROM documents GROUP BY text),
t AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS test_idx, ls[i] AS test FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), range(1, len(ls) + 1) r(i)
      WHERE contains(ls[i], ','))
SELECT f.kind, f.id, s.last_id, t.test_idx, md5(t.test) AS test FROM f LEFT JOIN s ON f.prompt = s.prompt LEFT JOIN t ON t.doc_id = s.last_id""")
def q_join_scores_last(spark, sf):
    d = load(spark, sf, "documents", "doc_id", "text")
    b = load(spark, sf, "benchmark", "item_id", "text")
    functions = d.select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("prompt")) \
        .unionByName(b.select(F.lit("bench").alias("kind"), F.col("item_id").alias("id"), F.col("text").alias("prompt")))
    scored = d.select(F.col("doc_id").alias("function_id"), F.col("text").alias("prompt"))
    tests = d.select(F.col("doc_id").alias("function_id"), F.posexplode(F.split("text", "\n")).alias("test_idx", "test")).where(F.contains("test", F.lit(",")))
    out = J.join_scores_last(functions, scored, tests.withColumn("test", F.md5("test")))
    return out.select("kind", "id", F.col("last_function_id").alias("last_id"), "test_idx", "test")


@query("predict_join", with_views("scores_v") + f", {SEL_SQL}\n" + """
SELECT s.function_id, s.test_idx, CASE WHEN sel.test_idx IS NULL THEN 0 ELSE 1 END AS prediction_is_valid,
       round(s.y_prob, 6) AS prediction_y_prob, s.y_true
FROM scores_v s LEFT JOIN sel ON s.function_id = sel.function_id AND s.test_idx = sel.test_idx""")
def q_predict_join(spark, sf):
    return r6(J.predict_join(A.scores_v(spark, sf), T, N)
              .select("function_id", "test_idx", "prediction_is_valid", "prediction_y_prob", "y_true"))
