"""Queries: aggregations over outcomes, coverage, mutation, categories,
frequencies (SURVEY §2.5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement as AG
from ..operators import metrics as M
from ..operators import outcomes as O
from ..sources import adapters as A
from ..sources.tables import load
from .registry import query, r6
from .views import with_views

_ERR_CASE = "CASE " + " ".join(f"WHEN contains(output, '{m}') THEN '{n}'" for n, m in O.ERROR_CLASSES) + " END"


@query("error_class_counts", with_views("outcomes_v") + f"""
SELECT error_class, count(*) AS count FROM (SELECT {_ERR_CASE} AS error_class FROM outcomes_v)
WHERE error_class IS NOT NULL GROUP BY error_class""")
def q_error_class_counts(spark, sf):
    return O.error_class_counts(A.outcomes_v(spark, sf))


@query("unittest_summary", with_views("outcomes_v") + r"""
, i AS (SELECT function_id, test_idx, output, regexp_matches(output, '^[^(]*\([^)]*\)') AS has_info,
               regexp_extract(output, '^[^(]*\(([^)]*)\)', 1) AS info FROM outcomes_v),
n AS (SELECT *, TRY_CAST(trim(string_split(info, '=')[2]) AS INTEGER) AS ok_n,
             TRY_CAST(trim(string_split(string_split(info, ',')[1], '=')[2]) AS INTEGER) AS f_n,
             TRY_CAST(trim(string_split(string_split(info, ',')[2], '=')[2]) AS INTEGER) AS e_n FROM i)
SELECT function_id, test_idx, output,
  CAST(CASE WHEN contains(output, 'OK') AND has_info AND ok_n IS NOT NULL THEN ok_n ELSE 0 END AS INTEGER) AS passed,
  CAST(CASE WHEN contains(output, 'OK') THEN CASE WHEN has_info AND ok_n IS NULL THEN 1 ELSE 0 END
            WHEN contains(output, 'FAILED') THEN CASE WHEN NOT has_info THEN 0 WHEN f_n IS NULL OR e_n IS NULL THEN 1
                                                      ELSE f_n + e_n END
            ELSE 0 END AS INTEGER) AS failed
FROM n""")
def q_unittest_summary(spark, sf):
    return O.unittest_summary(A.outcomes_v(spark, sf))


_PL = O.PROGRESS_LINE


@query("mutation_log_parse", with_views("mutation_log_v") + rf"""
, l AS (SELECT module, run_id,
               list_filter(list_transform(string_split(log, chr(10)), lambda x: regexp_replace(x, '\A\s+|\s+\z', '', 'g')),
                           lambda x: regexp_matches(x, '{_PL}')) AS lines FROM mutation_log_v),
z AS (SELECT module, run_id, lines[-1] AS last FROM l WHERE len(lines) > 0)
SELECT module, run_id, regexp_extract(last, '{_PL}', 1) AS step,
       CAST(regexp_extract(last, '{_PL}', 2) AS INTEGER) AS killed,
       CAST(regexp_extract(last, '{_PL}', 3) AS INTEGER) AS timeout,
       CAST(regexp_extract(last, '{_PL}', 4) AS INTEGER) AS suspicious,
       CAST(regexp_extract(last, '{_PL}', 5) AS INTEGER) AS survived,
       CAST(regexp_extract(last, '{_PL}', 6) AS INTEGER) AS skipped FROM z""")
def q_mutation_log_parse(spark, sf):
    return O.mutation_log_parse(A.mutation_log_v(spark, sf)).drop("log")


MUT_SCORE_SQL = """
SELECT CAST(sum(killed) AS BIGINT) AS killed, CAST(sum(timeout) AS BIGINT) AS timeout,
       CAST(sum(suspicious) AS BIGINT) AS suspicious, CAST(sum(survived) AS BIGINT) AS survived,
       CAST(sum(skipped) AS BIGINT) AS skipped, count(*) AS modules,
       CAST(sum(killed + timeout + suspicious + survived + skipped) AS BIGINT) AS total,
       round(round(CASE WHEN sum(killed + timeout + suspicious + survived + skipped) = 0 THEN 0.0
                  ELSE sum(killed) / sum(killed + timeout + suspicious + survived + skipped) END * 100, 2), 6) AS score
FROM {src}"""


@query("mutation_score", with_views("mutant_results_v") + MUT_SCORE_SQL.format(src="mutant_results_v"))
def q_mutation_score(spark, sf):
    return r6(O.mutation_score(A.mutant_results_v(spark, sf)))


COV_SQL = with_views("hits_v", "hit_tests_v", "hit_functions_v") + """
, cov AS (
  SELECT f.function_id, CAST(coalesce(c.covered, 0) AS BIGINT) AS covered, f.total_lines,
         CASE WHEN f.total_lines = 0 THEN 0.0 ELSE coalesce(c.covered, 0) / f.total_lines END AS coverage
  FROM hit_functions_v f LEFT JOIN (
    SELECT function_id, count(DISTINCT line_no) AS covered FROM hits_v h
    WHERE EXISTS (SELECT 1 FROM hit_tests_v t WHERE t.function_id = h.function_id AND t.test_idx = h.test_idx
                                                AND t.is_valid = 1)
    GROUP BY function_id) c ON f.function_id = c.function_id)
"""


def _coverage(spark, sf):
    return O.line_coverage(A.hits_v(spark, sf), A.hit_tests_v(spark, sf), A.hit_functions_v(spark, sf))


@query("line_coverage", COV_SQL + "SELECT function_id, covered, total_lines, round(coverage, 6) AS coverage FROM cov")
def q_line_coverage(spark, sf):
    return r6(_coverage(spark, sf))


@query("mean_coverage", COV_SQL + "SELECT round(round(avg(coverage), 3), 6) AS mean_coverage, count(*) AS functions FROM cov")
def q_mean_coverage(spark, sf):
    return r6(O.mean_coverage(_coverage(spark, sf)))


@query("avg_line_branch_coverage", COV_SQL + """
, e AS (SELECT coverage * 100 AS lc, CASE WHEN function_id % 3 = 0 THEN NULL ELSE coverage * 50 END AS bc,
               CASE WHEN function_id % 7 = 0 THEN 'timeout' END AS error FROM cov)
SELECT round(round(coalesce(avg(CASE WHEN error IS NULL THEN lc END), 0.0), 2), 6) AS avg_line_coverage,
       round(round(avg(CASE WHEN error IS NULL THEN bc END), 2), 6) AS avg_branch_coverage FROM e""")
def q_avg_line_branch_coverage(spark, sf):
    c = _coverage(spark, sf)
    e = c.select((F.col("coverage") * 100).alias("line_coverage_percent"),
                 F.when(F.pmod("function_id", F.lit(3)) == 0, F.lit(None).cast("double"))
                 .otherwise(F.col("coverage") * 50).alias("branch_coverage_percent"),
                 F.when(F.pmod("function_id", F.lit(7)) == 0, F.lit("timeout")).alias("error"))
    return r6(O.avg_line_branch_coverage(e))


# ------------------------------------------------------------------ categories
def cat_tests(spark, sf):
    d = load(spark, sf, "documents", "doc_id")
    lab = load(spark, sf, "labels", "doc_id", "quality", "toxic")
    return d.join(lab, "doc_id").select(F.floor(F.col("doc_id") / 10).cast("bigint").alias("function_id"),
                                        F.col("doc_id").alias("test_idx"), F.col("quality").alias("is_valid"),
                                        F.col("toxic").alias("prediction_is_valid"))


def cat_responses(inv):
    """One categorisation response per function (at most 10 invalid tests each)."""
    line = F.when(F.pmod("test_idx", F.lit(5)) != 0, F.concat(
        F.lit("Test "), F.col("test_idx").cast("string"), F.lit(" -> (Category "),
        F.pmod("test_idx", F.lit(8)).cast("string"), F.lit(")")))
    g = inv.groupBy("function_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(line.isNotNull(), F.struct("test_idx", line.alias("l"))))),
                                 lambda s: s["l"]), "\n").alias("_body"))
    return g.select("function_id", F.concat(F.lit("*****\n"), F.col("_body"), F.lit("\n*****")).alias("text"))


def categorized(spark, sf):
    inv = cat_tests(spark, sf).filter(F.col("is_valid") == 0)
    return O.map_categories(cat_responses(inv), inv, spark)


CAT_SQL = r"""
WITH t AS (SELECT d.doc_id // 10 AS function_id, d.doc_id AS test_idx, l.quality AS is_valid, l.toxic AS prediction_is_valid
           FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
inv AS (SELECT *, row_number() OVER (PARTITION BY function_id ORDER BY test_idx) - 1 AS k FROM t WHERE is_valid = 0),
resp AS (SELECT function_id, '*****' || chr(10) || coalesce(string_agg(CASE WHEN test_idx % 5 <> 0 THEN 'Test '
               || CAST(test_idx AS VARCHAR) || ' -> (Category ' || CAST(test_idx % 8 AS VARCHAR) || ')' END, chr(10)
               ORDER BY test_idx), '') || chr(10) || '*****' AS text FROM inv GROUP BY function_id),
b AS (SELECT function_id, string_split(regexp_replace(regexp_extract(text, '(?s)\*{5}(.*?)\*{5}', 1), '\A\s+|\s+\z', '', 'g'),
                                      chr(10)) AS arr FROM resp),
ln AS (SELECT function_id, CAST(r.k AS BIGINT) AS k,
              TRY_CAST(nullif(regexp_extract(arr[r.k + 1], 'Category\s*(\d+)', 1), '') AS INTEGER) AS ci
       FROM b, range(len(arr)) r(k)),
cats AS (SELECT * FROM (VALUES (1, 'Misunderstanding of Function Logic'), (2, 'Edge Case Misinterpretation'),
         (3, 'Off-by-One or Range Errors'), (4, 'Incorrect Input-Output Mapping'),
         (5, 'Ambiguities or Incompleteness in the Docstring'), (6, 'Rounding Expectations')) c(category_index, category_name)),
m AS (SELECT inv.function_id, inv.test_idx, inv.is_valid, inv.prediction_is_valid,
             coalesce(cats.category_index, -1) AS category_index, coalesce(cats.category_name, 'Unknown') AS category_name
      FROM inv LEFT JOIN ln ON inv.function_id = ln.function_id AND inv.k = ln.k
               LEFT JOIN cats ON ln.ci = cats.category_index)
"""


@query("map_categories", CAT_SQL + "SELECT function_id, test_idx, category_index, category_name FROM m")
def q_map_categories(spark, sf):
    return categorized(spark, sf).select("function_id", "test_idx", "category_index", "category_name")


@query("category_counts", CAT_SQL + "SELECT category_name, count(*) AS count FROM m GROUP BY category_name")
def q_category_counts(spark, sf):
    return O.category_counts(categorized(spark, sf))


@query("category_counts_by_prediction", CAT_SQL + """
SELECT category_name, count(*) AS count,
       CAST(sum(CASE WHEN prediction_is_valid = 0 THEN 1 ELSE 0 END) AS BIGINT) AS predicted_invalid,
       CAST(sum(CASE WHEN prediction_is_valid <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS predicted_valid
FROM m GROUP BY category_name""")
def q_category_counts_by_prediction(spark, sf):
    return O.category_counts_by_prediction(categorized(spark, sf))


# ------------------------------------------------------------------ pass/fail
@query("all_tests_pass", with_views("outcomes_v") + """
, r AS (SELECT test_idx // 8 AS task_id, test_idx % 8 AS case_idx, contains(output, 'OK') AS passed, output AS error_msg
        FROM outcomes_v)
SELECT s.task_id, s.passed, f.failed_case, f.error_message
FROM (SELECT task_id, bool_and(passed) AS passed FROM r GROUP BY task_id) s
LEFT JOIN (SELECT task_id, case_idx AS failed_case, 'Test ' || CAST(case_idx + 1 AS VARCHAR) || ': '
                  || coalesce(nullif(error_msg, ''), 'Output mismatch') AS error_message FROM r WHERE NOT passed) f
  ON s.task_id = f.task_id""")
def q_all_tests_pass(spark, sf):
    o = A.outcomes_v(spark, sf)
    r = o.select(F.floor(F.col("test_idx") / 8).cast("bigint").alias("task_id"),
                 F.pmod("test_idx", F.lit(8)).alias("case_idx"),
                 F.col("output").contains("OK").alias("passed"), F.col("output").alias("error_msg"))
    return O.all_tests_pass(r)


@query("validity_counts", with_views("corpus_v") + """
SELECT function_id, CAST(sum(CASE WHEN is_valid = 1 THEN 1 ELSE 0 END) AS BIGINT) AS valid,
       count(*) - CAST(sum(CASE WHEN is_valid = 1 THEN 1 ELSE 0 END) AS BIGINT) AS invalid, count(*) AS total,
       round(CAST(sum(CASE WHEN is_valid = 1 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS valid_ratio
FROM corpus_v GROUP BY function_id""")
def q_validity_counts(spark, sf):
    return r6(M.validity_counts(A.corpus_v(spark, sf), "is_valid", ["function_id"]))


# ------------------------------------------------------------------ frequencies
@query("solution_frequency", with_views("solutions_v") +
       "SELECT task_id, completion, count(*) AS count FROM solutions_v GROUP BY task_id, completion")
def q_solution_frequency(spark, sf):
    return AG.solution_frequency(A.solutions_v(spark, sf))


@query("test_frequency", with_views("tests_v") +
       """, kept AS (SELECT * FROM tests_v QUALIFY row_number() OVER (PARTITION BY task_id, sample_idx ORDER BY pos) <= 5)
SELECT task_id, text, count(*) AS count FROM kept GROUP BY task_id, text""")
def q_test_frequency(spark, sf):
    return AG.test_frequency(A.tests_v(spark, sf), 5)


@query("dedupe_work", with_views("solutions_v") + "SELECT DISTINCT task_id, completion FROM solutions_v")
def q_dedupe_work(spark, sf):
    return AG.dedupe_work(A.solutions_v(spark, sf)).select("task_id", "completion")


@query("test_agreement", with_views("exec_v", "tests_v") + """
, pp AS (SELECT DISTINCT task_id, solution_id, test_id FROM exec_v WHERE passed),
nsol AS (SELECT task_id, count(DISTINCT solution_id) AS n FROM pp GROUP BY task_id),
tp AS (SELECT task_id, test_id, count(*) AS c FROM pp GROUP BY task_id, test_id),
tt AS (SELECT task_id, test_id, avg(score) AS score FROM tests_v GROUP BY task_id, test_id)
SELECT tt.task_id, tt.test_id,
       round(CASE WHEN nsol.n IS NULL THEN tt.score ELSE coalesce(tp.c, 0) / nsol.n END, 6) AS agreement
FROM tt LEFT JOIN nsol ON tt.task_id = nsol.task_id
        LEFT JOIN tp ON tt.task_id = tp.task_id AND tt.test_id = tp.test_id""")
def q_test_agreement(spark, sf):
    tests = A.tests_v(spark, sf).groupBy("task_id", "test_id").agg(F.avg("score").alias("score"))
    return r6(AG.test_agreement(A.exec_v(spark, sf), tests))
