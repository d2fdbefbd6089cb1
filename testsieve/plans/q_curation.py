"""Queries: curation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curation as C
from ..sources import adapters as A
from ..sources.tables import load
from .q_aggregates import cat_tests
from .registry import query
from .views import with_views

PART = 2  # tests of a prompt: small, so that functions of several prompts occur
INSTRUCTION = "Categorize each invalid test below."  # the prompt text is a parameter


@query("curation_candidates", with_views("scores_v") + """
SELECT CAST(sum(CASE WHEN y_true = 1 THEN 1 ELSE 0 END) AS BIGINT) AS total_valid,
       CAST(sum(CASE WHEN y_true = 0 THEN 1 ELSE 0 END) AS BIGINT) AS total_invalid,
       CAST(sum(CASE WHEN y_prob < 0.7 THEN 1 ELSE 0 END) AS BIGINT) AS below_threshold FROM scores_v""")
def q_curation_candidates(spark, sf):
    s = A.scores_v(spark, sf).withColumnRenamed("y_true", "is_valid").withColumnRenamed("y_prob", "prediction_y_prob")
    return C.curation_candidates(s, 0.7)


REV_SQL = with_views("corpus_v", "revisions_v") + r"""
, rv AS (SELECT c.function_id, c.test_idx, c.is_valid, c.text, r.validated_text,
                coalesce(r.validated_text, '') <> '' AND regexp_replace(c.text, '[ \n]', '', 'g')
                  <> regexp_replace(r.validated_text, '[ \n]', '', 'g') AS changed
         FROM corpus_v c LEFT JOIN revisions_v r ON c.function_id = r.function_id AND c.test_idx = r.test_idx),
cur AS (SELECT function_id, test_idx, is_valid, changed, CASE WHEN changed THEN validated_text ELSE text END AS text FROM rv)
"""


def _curated(spark, sf):
    return C.apply_revisions(A.corpus_v(spark, sf), A.revisions_v(spark, sf))


@query("apply_revisions", REV_SQL + "SELECT function_id, test_idx, changed, md5(text) AS text_md5 FROM cur")
def q_apply_revisions(spark, sf):
    return _curated(spark, sf).select("function_id", "test_idx", "changed", F.md5("text").alias("text_md5"))


@query("relabel", REV_SQL + """
, nr AS (SELECT cur.is_valid AS old_is_valid, CASE WHEN coalesce(l.toxic = 0, false) THEN 1 ELSE 0 END AS is_valid
         FROM cur LEFT JOIN labels l ON cur.test_idx = l.doc_id)
SELECT old_is_valid, is_valid, count(*) AS count FROM nr GROUP BY old_is_valid, is_valid""")
def q_relabel(spark, sf):
    lab = load(spark, sf, "labels", "doc_id", "toxic")
    cur = _curated(spark, sf)
    new = cur.select("function_id", "test_idx").join(lab, cur.test_idx == lab.doc_id) \
        .select("function_id", "test_idx", (F.col("toxic") == 0).alias("passed"))
    return C.relabel(cur, new)[1]


@query("prompt_assembly", f"""
WITH t AS (SELECT d.doc_id // 10 AS function_id, d.doc_id AS test_idx, l.quality AS is_valid, l.toxic, d.text
           FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
inv AS (SELECT function_id, test_idx, text || ' ' || chr(10) || chr(10) || 'By running the test cases, we can see that the actual output is: '
               || CAST(toxic AS VARCHAR) || ' but the expected output is: ' || CAST(is_valid AS VARCHAR) || chr(10) AS piece
        FROM t WHERE is_valid = 0),
n AS (SELECT *, CAST((row_number() OVER (PARTITION BY function_id ORDER BY test_idx) - 1) // {PART} AS INTEGER) AS part FROM inv),
g AS (SELECT function_id, part, string_agg(piece, '' ORDER BY test_idx) AS tests FROM n GROUP BY function_id, part)
SELECT function_id, part, '{INSTRUCTION}' || chr(10) || 'function description:' || chr(10) || 'Function ' || CAST(function_id AS VARCHAR)
       || chr(10) || 'generated tests:' || chr(10) || tests || chr(10) || 'function implementation:' || chr(10)
       || 'def f(x):' || chr(10) || '    return x' AS prompt FROM g""")
def q_prompt_assembly(spark, sf):
    d = load(spark, sf, "documents", "doc_id", "text")
    t = cat_tests(spark, sf).join(d, d.doc_id == F.col("test_idx")).drop("doc_id")
    inv = t.filter(F.col("is_valid") == 0).select(
        "function_id", "test_idx", "text", F.col("prediction_is_valid").cast("string").alias("actual"),
        F.col("is_valid").cast("string").alias("expected"))
    funcs = inv.select("function_id").distinct().select(
        "function_id", F.concat(F.lit("Function "), F.col("function_id").cast("string")).alias("description"),
        F.lit("def f(x):\n    return x").alias("solution"))
    return C.prompt_assembly(funcs, inv, INSTRUCTION, tests_per_prompt=PART)
