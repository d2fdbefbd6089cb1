"""Queries: scans, sources and sinks.

JSONL sources are files: lines that Spark derives from the driver's tables are
written as several files of unequal size, with blank and broken lines among them,
and read back.  All folders are new for each run, under the shared checkpoint folder."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.ml.feature import Bucketizer
from pyspark.sql import functions as F
from pyspark.sql.types import StructType as T_

from ..functions import text as T
from ..operators import joins as J
from ..session import run_path
from ..sources import adapters as A
from ..sources import readers as R
from ..sources import sinks as K
from ..sources.tables import load
from .q_curation import REV_SQL, _curated
from .q_text import CODE_SQL, code_v
from .q_windows import N, SEL_SQL, T as THRESH
from .registry import query, r6
from .views import with_views


@query("scan_generations", with_views("tokens_v") + """
SELECT function_id, test_idx, is_valid, CAST(count(*) AS INTEGER) AS n_tokens, CAST(test_idx % 2 AS INTEGER) AS test_type,
       'Write f_' || CAST(function_id AS VARCHAR) AS prompt, 'def f_' || CAST(function_id AS VARCHAR) || '(x): return x' AS solution,
       'assert f_' || CAST(function_id AS VARCHAR) || '(' || CAST(test_idx AS VARCHAR) || ') == 1' AS testcase FROM tokens_v
WHERE dataset = 'HumanEval' AND llm = 'gpt-4o' GROUP BY function_id, test_idx, is_valid""")
def q_scan_generations(spark, sf):
    path = run_path(spark, "generations")
    K.write_snapshot(A.generations_v(spark, sf).select(*R.GENERATIONS.names), path, ("dataset", "llm"))
    g = R.read_generations(spark, path, "HumanEval", "gpt-4o")
    return g.select("function_id", "test_idx", "is_valid", F.size("tokens").alias("n_tokens"), "test_type", "prompt", "solution",
                    F.explode("testcases").alias("testcase"))


FILE_BYTES = 64 << 20  # of lines in a file, about


NONE = float("-inf")  # stands for a null in the order


def _file_starts(lines, order):
    """Values of ``order`` at which a next file begins: each file holds twice the bytes of the
    one before, up to half of all or FILE_BYTES, and the last one what is left.  Where one value
    has more, several files begin at it.  A line counts once for each quarter of the mean length."""
    n, size = lines.agg(F.count(F.lit(1)), F.sum(F.octet_length("value"))).first()
    unit = max(1, (size or 0) // (4 * max(n, 1)))
    weighted = lines.select(order, F.explode(F.sequence(F.lit(0), F.floor(F.octet_length("value") / unit).cast("int"))))
    most = min(0.5, FILE_BYTES / ((size or 0) + n * unit + 1))
    share = most / 16
    at = [share]
    while at[-1] < 1:
        share = min(2 * share, most)
        at.append(at[-1] + share)
    return sorted(weighted.approxQuantile(order, at[:-1], most / 64))


def _jsonl(spark, name, lines, order):
    """The path of files that hold ``lines`` (``value``) in ``order``: ranges of it that double in
    bytes up to a bound, so the files are of unequal size and none grows with the table; a broken
    line before every 50th, a blank one before every 60th.  Lines of one value of ``order`` are
    dealt over the files that begin at it."""
    path = run_path(spark, name)
    broken = F.when(F.pmod(order, F.lit(50)) == 7, F.concat(F.substring("value", 1, 12), F.lit("\n"))).otherwise("")
    blank = F.when(F.pmod(order, F.lit(60)) == 9, F.lit(" \n")).otherwise("")
    lines = lines.withColumn("_at", F.coalesce(F.col(order).cast("double"), F.lit(NONE)))
    starts = _file_starts(lines, "_at")
    values = [NONE, *(sorted(set(starts) - {NONE}) or [0.0])]  # no rows: any value will do
    last = [bisect_right(starts, v) for v in values]
    # whole numbers from 2 ** 53 on can share a double, and must not change places
    several = [max(1, e - bisect_left(starts, v)) if v == NONE or abs(v) < 2**53 else 1 for v, e in zip(values, last, strict=True)]
    bins = Bucketizer(splits=[*values, float("inf")], inputCol="_at", outputCol="_bin")
    here = F.col("_bin").cast("int")
    back = F.when(F.col("_at") == F.get(F.lit(values), here), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.get(F.lit(several), here))).otherwise(0)
    (bins.transform(lines).withColumn("_file", (F.get(F.lit(last), here) - back).cast("int"))
     .repartitionById(len(starts) + 1, "_file").sortWithinPartitions(order)
     .select(F.concat(broken, blank, "value").alias("value")).write.text(path))
    return path


def _task_file(spark, sf):
    d = load(spark, sf, "documents", "doc_id", "source", "lang", "n_chars")
    lines = d.select(F.to_json(F.struct(F.col("source").alias("task_id"), "doc_id", "lang", "n_chars")).alias("value"), "doc_id")
    return _jsonl(spark, "tasks", lines, "doc_id")


_TASK = "task_id string, doc_id long, lang string, n_chars long"


@query("scan_jsonl_tasks", """
SELECT source AS task_id, arg_max(doc_id, doc_id) AS doc_id, arg_max(lang, doc_id) AS lang, arg_max(n_chars, doc_id) AS n_chars
FROM documents GROUP BY source""")
def q_scan_jsonl_tasks(spark, sf):
    return R.scan_jsonl_tasks(spark, _task_file(spark, sf), T_.fromDDL(_TASK))[0].select("task_id", "doc_id", "lang", "n_chars")


@query("scan_jsonl_rejects", """
SELECT '{"task_id":"' AS start, count(*) AS n FROM documents WHERE doc_id % 50 = 7""")
def q_scan_jsonl_rejects(spark, sf):
    bad = R.scan_jsonl_tasks(spark, _task_file(spark, sf), T_.fromDDL(_TASK))[1]
    return bad.groupBy(F.col("value").alias("start")).agg(F.count(F.lit(1)).alias("n"))


@query("scan_problems", CODE_SQL + r"""
, l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM resp_v),
c AS (SELECT CAST(doc_id AS VARCHAR) AS task_id, CAST(i - 1 AS INTEGER) AS case_idx, ls[i] AS inp,
             nullif(regexp_extract(ls[i], ',([^,]*)$', 1), '') AS outp FROM l, range(1, len(ls) + 1) r(i))
SELECT c.task_id, v.nm AS function_name, c.case_idx, regexp_replace(inp, '\A\s+|\s+\z', '', 'g') AS input,
       regexp_replace(outp, '\A\s+|\s+\z', '', 'g') AS output
FROM c JOIN resp_v v ON c.task_id = CAST(v.doc_id AS VARCHAR) WHERE inp IS NOT NULL AND outp IS NOT NULL""")
def q_scan_problems(spark, sf):
    c = code_v(spark, sf)
    cases = F.transform(F.split("text", "\n"), lambda l: F.struct(
        l.alias("input"), F.nullif(F.regexp_extract(l, ",([^,]*)$", 1), F.lit("")).alias("output")))
    lines = c.select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("nm").alias("function_name"),
                                        cases.alias("public_test_cases"))).alias("value"), "doc_id")
    return R.scan_problems(spark, _jsonl(spark, "problems", lines, "doc_id"))


@query("scan_generated_code", CODE_SQL + r"""
, g AS (SELECT CAST(regexp_extract(text, '([A-Za-z]+)', 1) AS VARCHAR) AS tk, doc_id,
               CASE WHEN doc_id % 4 = 1 THEN code END AS response_code, resp AS response FROM resp_v),
s AS (SELECT 't' || CAST(doc_id % 40 AS VARCHAR) AS task_id, doc_id,
        CASE WHEN coalesce(response_code, '') <> '' THEN response_code
             WHEN contains(response, '```python') THEN
                nullif(regexp_replace(regexp_extract(response, '(?s)```python[^\n]*\n(.*?)```', 1), '\A\s+|\s+\z', '', 'g'), '')
             WHEN contains(response, '```') THEN nullif(CASE
                WHEN starts_with(regexp_replace(regexp_extract(response, '(?s)```(.*?)```', 1), '\A\s+|\s+\z', '', 'g'), 'python' || chr(10))
                THEN substr(regexp_replace(regexp_extract(response, '(?s)```(.*?)```', 1), '\A\s+|\s+\z', '', 'g'), 8)
                ELSE regexp_replace(regexp_extract(response, '(?s)```(.*?)```', 1), '\A\s+|\s+\z', '', 'g') END, '') END AS code
      FROM g)
SELECT task_id, arg_max(code, doc_id) AS code FROM s WHERE code IS NOT NULL AND code <> '' GROUP BY task_id""")
def q_scan_generated_code(spark, sf):
    c = code_v(spark, sf)
    rec = F.struct(F.concat(F.lit("t"), F.pmod("doc_id", F.lit(40)).cast("string")).alias("task_id"),
                   F.when(F.pmod("doc_id", F.lit(4)) == 1, F.col("code")).alias("response_code"),
                   F.col("resp").alias("response"))
    lines = c.select(F.to_json(rec).alias("value"), "doc_id")
    return R.scan_generated_code(spark, _jsonl(spark, "generated", lines, "doc_id"))


@query("normalize_benchmark", CODE_SQL + """
, dv AS (SELECT conv_id, turn, text AS prompt, next_text AS response FROM (
          SELECT conv_id, turn, role, text, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
                 lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text FROM conversations)
        WHERE role = 'user' AND next_role = 'assistant')
SELECT 'mbpp' AS benchmark, CAST(doc_id AS VARCHAR) AS task_id, text AS prompt, code AS solution,
       'assert ' || nm || '(1) == 1' || chr(10) || 'assert ' || nm || '(2) == 2' AS tests FROM resp_v
UNION ALL
SELECT 'humaneval', CAST(item_id AS VARCHAR), 'def f(x):' || chr(10) || '    \"\"\"' || text || '\"\"\"' || chr(10),
       'def f(x):' || chr(10) || '    \"\"\"' || text || '\"\"\"' || chr(10) || '    return x' || chr(10),
       'def check(candidate):' || chr(10) || '    assert candidate(1) == 1' || chr(10) FROM benchmark
UNION ALL
SELECT 'livecode', CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR), prompt,
       coalesce(regexp_extract_all(response, '(?s)```python(.*?)```', 1)[1], response), '' FROM dv""".replace('\\"', '"'))
def q_normalize_benchmark(spark, sf):
    c = code_v(spark, sf)
    mbpp = R.normalize(c, "mbpp", F.col("doc_id"), F.col("text"), F.col("code"),
                       F.concat(F.lit("assert "), F.col("nm"), F.lit("(1) == 1\nassert "), F.col("nm"), F.lit("(2) == 2")))
    b = load(spark, sf, "benchmark", "item_id", "text")
    head = F.concat(F.lit('def f(x):\n    """'), F.col("text"), F.lit('"""\n'))
    he = R.normalize(b, "humaneval", F.col("item_id"), head, F.concat(head, F.lit("    return x\n")),
                     F.lit("def check(candidate):\n    assert candidate(1) == 1\n"))
    dv = A.dialog_v(spark, sf)
    lc = R.normalize(dv, "livecode", F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")),
                     F.col("prompt"), T.first_code_block(F.col("response")), F.lit(""))
    return R.normalize_benchmarks([mbpp, he, lc])


@query("subset_by_ids", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def q_subset_by_ids(spark, sf):
    return R.subset_by_ids(load(spark, sf, "documents", "doc_id"), load(spark, sf, "labels", "doc_id"), "doc_id")


@query("exclude_known_bad", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def q_exclude_known_bad(spark, sf):
    ex = load(spark, sf, "labels", "doc_id", "toxic").filter(F.col("toxic") == 1)
    return R.exclude_known_bad(load(spark, sf, "documents", "doc_id"), ex, ["doc_id"])


@query("name_override", CODE_SQL + """
SELECT v.doc_id, coalesce('task_' || CAST(b.item_id AS VARCHAR), v.nm) AS function_name
FROM resp_v v LEFT JOIN benchmark b ON v.doc_id = b.item_id""")
def q_name_override(spark, sf):
    c = code_v(spark, sf).select("doc_id", F.col("nm").alias("function_name"))
    o = load(spark, sf, "benchmark", "item_id").select(
        F.col("item_id").alias("doc_id"), F.concat(F.lit("task_"), F.col("item_id").cast("string")).alias("function_name"))
    return R.name_override(c, o, "doc_id")


@query("verified_tasks", with_views("solutions_v", "tests_v", "ground_truth_v") + """
, t AS (SELECT DISTINCT task_id FROM solutions_v),
k AS (SELECT t.task_id, g.passed FROM t JOIN ground_truth_v g ON g.task_id = t.task_id AND g.solution_id = 0
      WHERE t.task_id IN (SELECT task_id FROM tests_v))
SELECT 'result' AS kind, CAST(passed AS VARCHAR) AS name, count(*) AS count FROM k GROUP BY passed
UNION ALL SELECT 'kept', task_id, 1 FROM k WHERE passed""")
def q_verified_tasks(spark, sf):
    sols = A.solutions_v(spark, sf)
    tasks = sols.select("task_id").distinct()
    ref = A.ground_truth_v(spark, sf).filter(F.col("solution_id") == 0)
    kept, counts = R.verified_tasks(tasks, sols, A.tests_v(spark, sf), ref)
    return counts.select(F.lit("result").alias("kind"), F.col("passed").cast("string").alias("name"), "count").unionByName(
        kept.select(F.lit("kept").alias("kind"), F.col("task_id").alias("name"), F.lit(1).cast("long").alias("count")))


@query("assign_ids", with_views("corpus_v") + """
SELECT function_id AS source, test_idx AS doc_id, CAST(dense_rank() OVER (ORDER BY function_id) - 1 AS BIGINT) AS function_id,
       CAST(row_number() OVER (PARTITION BY function_id ORDER BY test_idx) - 1 AS BIGINT) AS test_pos FROM corpus_v""")
def q_assign_ids(spark, sf):
    c = A.corpus_v(spark, sf).select(F.col("function_id").alias("source"), F.col("test_idx").alias("doc_id"))
    return R.assign_ids(c, "source", "doc_id").select("source", "doc_id", "function_id", "test_pos")


def _ds(c):
    return F.when(F.pmod(c, F.lit(2)) == 0, F.lit("HumanEval")).otherwise(F.lit("MBPP"))


@query("sink_scored", with_views("scores_v") + f", {SEL_SQL}\n" + """
SELECT CASE WHEN s.function_id % 2 = 0 THEN 'HumanEval' ELSE 'MBPP' END AS dataset,
       CASE WHEN s.function_id % 5 < 3 THEN 'gpt-4o' ELSE 'codeqwen' END AS llm,
       s.function_id, s.test_idx, CASE WHEN sel.test_idx IS NULL THEN 0 ELSE 1 END AS prediction_is_valid,
       round(s.y_prob, 6) AS prediction_y_prob
FROM scores_v s LEFT JOIN sel ON s.function_id = sel.function_id AND s.test_idx = sel.test_idx""")
def q_sink_scored(spark, sf):
    p = J.predict_join(A.scores_v(spark, sf), THRESH, N)
    p = p.select(_ds(F.col("function_id")).alias("dataset"),
                 F.when(F.pmod("function_id", F.lit(5)) < 3, F.lit("gpt-4o")).otherwise(F.lit("codeqwen")).alias("llm"),
                 "function_id", "test_idx", "prediction_is_valid", "prediction_y_prob")
    path = run_path(spark, "scored")
    K.sink_scored(p, path)
    return r6(K.read_snapshot(spark, path).select("dataset", "llm", "function_id", "test_idx", "prediction_is_valid",
                                              "prediction_y_prob"))


@query("sink_curated", REV_SQL + """
SELECT 'documents' AS dataset, d.lang AS llm, cur.function_id, cur.test_idx, cur.changed, md5(cur.text) AS text_md5
FROM cur JOIN documents d ON cur.test_idx = d.doc_id""")
def q_sink_curated(spark, sf):
    d = load(spark, sf, "documents", "doc_id", "lang")
    cur = _curated(spark, sf).join(d, F.col("test_idx") == d.doc_id).select(
        F.lit("documents").alias("dataset"), F.col("lang").alias("llm"), "function_id", "test_idx", "changed",
        F.md5("text").alias("text_md5"))
    path = run_path(spark, "curated")
    K.sink_curated(cur, path)
    return K.read_snapshot(spark, path).select("dataset", "llm", "function_id", "test_idx", "changed", "text_md5")
