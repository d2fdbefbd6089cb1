"""Queries: text extraction.

The driver's documents carry no code, so ``code_v`` wraps every whole
document into a model-style response (fenced code, assertions, markers) by
concatenation — the same expressions in Spark and in the SQL oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import parsing as P
from ..operators import text as X
from ..sources.tables import load
from .registry import query

NL = "\n"


def code_v(spark, sf):
    d = load(spark, sf, "documents", "doc_id", "text")
    w1 = F.coalesce(F.nullif(F.regexp_extract("text", "([A-Za-z]+)", 1), F.lit("")), F.lit("x"))
    d = d.withColumn("w1", w1).withColumn("nm", F.concat(F.lit("get"), F.col("w1"), F.lit("Value")))
    d = d.withColumn("expected_name", F.when(F.pmod("doc_id", F.lit(4)) == 0, F.col("nm")).otherwise(F.lit("solve")))
    code = F.concat(F.lit("class Helper:\n    def __init__(self):\n        pass\n\ndef "), F.col("nm"),
                    F.lit('(x):\n    """'), F.col("w1"), F.lit(' docs\n    more"""\n    # comment\n\n'
                                                            "    from collections import deque\n    import os\n    return x\n"))
    d = d.withColumn("code", code)
    resp = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.col("text")).otherwise(F.concat(
        F.lit("Solution:\n```python\n"), F.col("code"), F.lit("```\n"), F.col("text"),
        F.lit("\n```python\nassert "), F.col("nm"), F.lit("(1) == 1\n  assert "), F.col("nm"),
        F.lit("(2) == 2\nprint("), F.col("nm"), F.lit("(3))\n```")))
    return d.withColumn("resp", resp)


CODE_SQL = """
WITH base AS (SELECT doc_id, text, coalesce(nullif(regexp_extract(text, '([A-Za-z]+)', 1), ''), 'x') AS w1 FROM documents),
nm AS (SELECT *, 'get' || w1 || 'Value' AS nm FROM base),
code_v AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN nm ELSE 'solve' END AS expected_name,
  'class Helper:' || chr(10) || '    def __init__(self):' || chr(10) || '        pass' || chr(10) || chr(10) || 'def ' || nm
  || '(x):' || chr(10) || '    \"\"\"' || w1 || ' docs' || chr(10) || '    more\"\"\"' || chr(10) || '    # comment' || chr(10)
  || chr(10) || '    from collections import deque' || chr(10) || '    import os' || chr(10) || '    return x' || chr(10) AS code
  FROM nm),
resp_v AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN text ELSE 'Solution:' || chr(10) || '```python' || chr(10) || code || '```'
  || chr(10) || text || chr(10) || '```python' || chr(10) || 'assert ' || nm || '(1) == 1' || chr(10) || '  assert ' || nm
  || '(2) == 2' || chr(10) || 'print(' || nm || '(3))' || chr(10) || '```' END AS resp FROM code_v)
""".replace('\\"', '"')

def sql_text(s: str) -> str:
    """A string of letters and line ends as SQL."""
    return "'" + s.replace("\n", "' || chr(10) || '") + "'"


STRIP = r"regexp_replace({x}, '\A\s+|\s+\z', '', 'g')"


def strip(x: str) -> str:
    return STRIP.format(x=x)


@query("extract_code_blocks", CODE_SQL + rf"""
, b AS (SELECT doc_id, regexp_extract_all(resp, '(?s)```python\s*(.*?)```', 1) AS blocks FROM resp_v)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS block_idx, {strip('blocks[i]')} AS block FROM b, range(1, len(blocks) + 1) r(i)""")
def q_extract_code_blocks(spark, sf):
    return X.extract_code_blocks(code_v(spark, sf), "resp", ["doc_id"])


@query("first_code_block", CODE_SQL + r"""
SELECT doc_id, coalesce(regexp_extract_all(resp, '(?s)```python(.*?)```', 1)[1], resp) AS code FROM resp_v""")
def q_first_code_block(spark, sf):
    return X.first_code_block(code_v(spark, sf).select("doc_id", "resp"), "resp").select("doc_id", "code")


@query("assertion_lines", CODE_SQL + f"""
, l AS (SELECT doc_id, string_split(resp, chr(10)) AS ls FROM resp_v)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, {strip('ls[i]')} AS line FROM l, range(1, len(ls) + 1) r(i)
WHERE contains(ls[i], 'assert')""")
def q_assertion_lines(spark, sf):
    return X.assertion_lines(code_v(spark, sf), "resp", ["doc_id"])


@query("split_on_assert", CODE_SQL + rf"""
, p AS (SELECT doc_id, list_filter(string_split('assert ' || resp, 'assert '),
                                   lambda x: contains(x, nm) AND length({strip('x')}) > 0) AS parts FROM resp_v)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS case_idx,
       {strip(f"regexp_replace({strip(chr(39) + 'assert ' + chr(39) + ' || parts[i]')}, '(?s)' || chr(10) || '(class|def|#|if|print).*', '')")} AS test
FROM p, range(1, len(parts) + 1) r(i)""")
def q_split_on_assert(spark, sf):
    return X.split_on_assert(code_v(spark, sf), "resp", "nm", ["doc_id"])


@query("split_candidate_asserts", """
WITH b AS (SELECT doc_id, string_split('def check(candidate):' || chr(10) || replace(text, '.', chr(10) || '    assert candidate'),
                                       'assert candidate') AS parts FROM documents)
SELECT doc_id, CAST(i - 2 AS INTEGER) AS case_idx, 'assert candidate' || parts[i] AS test
FROM b, range(2, len(parts) + 1) r(i)""")
def q_split_candidate_asserts(spark, sf):
    d = load(spark, sf, "documents", "doc_id", "text")
    body = d.select("doc_id", F.concat(F.lit("def check(candidate):\n"),
                                       F.replace("text", F.lit("."), F.lit("\n    assert candidate"))).alias("test"))
    return X.split_candidate_asserts(body, "test", ["doc_id"])


@query("truncate_at_stop", CODE_SQL + r"""
SELECT doc_id, regexp_replace(coalesce(regexp_extract_all(resp, '(?s)```python(.*?)```', 1)[1], resp),
                              '(?s)' || chr(10) || '(class|def|#|if|print).*', '') AS solution FROM resp_v""")
def q_truncate_at_stop(spark, sf):
    c = X.first_code_block(code_v(spark, sf), "resp")
    return c.select("doc_id", T.truncate_at_stop(F.col("code")).alias("solution"))


@query("between_markers", f"""
WITH m AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text ELSE '*****' || text || '*****' END AS resp FROM documents)
SELECT doc_id, {strip(r"regexp_extract(resp, '(?s)\*{5}(.*?)\*{5}', 1)")} AS categorized FROM m""")
def q_between_markers(spark, sf):
    d = load(spark, sf, "documents", "doc_id", "text")
    m = d.select("doc_id", F.when(F.pmod("doc_id", F.lit(5)) == 0, F.col("text"))
                 .otherwise(F.concat(F.lit("*****"), F.col("text"), F.lit("*****"))).alias("resp"))
    return m.select("doc_id", T.between_markers(F.col("resp")).alias("categorized"))


@query("tagged_content", f"""
WITH m AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '<code>' || chr(10) || 'x = load_data()' || chr(10) || text
                               || chr(10) || '</code>' ELSE text END AS resp FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(resp, '(?s)<code>(.*?)</code>') THEN
  {strip(f"array_to_string(list_filter(string_split({strip(r"regexp_extract(resp, '(?s)<code>(.*?)</code>', 1)")}, chr(10)), lambda l: NOT contains(l, 'load_data()')), chr(10))")}
  ELSE '' END AS code FROM m""")
def q_tagged_content(spark, sf):
    d = load(spark, sf, "documents", "doc_id", "text")
    m = d.select("doc_id", F.when(F.pmod("doc_id", F.lit(2)) == 0, F.concat(
        F.lit("<code>\nx = load_data()\n"), F.col("text"), F.lit("\n</code>"))).otherwise(F.col("text")).alias("resp"))
    return X.tagged_content(m, "resp").select("doc_id", "code")


@query("function_name", CODE_SQL + r"""
SELECT doc_id, regexp_extract_all(resp, 'def\s+(\w+)\s*\(', 1)[1] AS name FROM resp_v""")
def q_function_name(spark, sf):
    return code_v(spark, sf).select("doc_id", T.function_name(F.col("resp")).alias("name"))


@query("function_name_not_init", CODE_SQL + r"""
SELECT doc_id, list_filter(regexp_extract_all(resp, 'def\s+([a-zA-Z_]\w*)\s*\(', 1), lambda n: NOT contains(n, '__init__'))[1] AS name
FROM resp_v""")
def q_function_name_not_init(spark, sf):
    return code_v(spark, sf).select("doc_id", T.function_name_not_init(F.col("resp")).alias("name"))


@query("function_signature", CODE_SQL + r"""
SELECT doc_id, regexp_extract_all(resp, 'def\s+[a-zA-Z_][a-zA-Z0-9_]*\s*\([^)]*\)', 0)[1] AS signature FROM resp_v""")
def q_function_signature(spark, sf):
    return code_v(spark, sf).select("doc_id", T.function_signature(F.col("resp")).alias("signature"))


@query("import_statements", CODE_SQL + f"""
SELECT DISTINCT import_line FROM (
  SELECT unnest(list_concat(regexp_extract_all(resp, '{T.IMPORT_PLAIN}', 0), regexp_extract_all(resp, '{T.IMPORT_FROM}', 0),
                            [{", ".join(map(sql_text, T.IMPORT_TAIL))}])) AS import_line
  FROM resp_v)""")
def q_import_statements(spark, sf):
    return X.import_statements(code_v(spark, sf), "resp")


def _desc(c):
    return F.concat(F.lit("Example 1:\n**Input:** x = "), F.col("doc_id").cast("string"), F.lit("\n**Output:** "),
                    F.col("w1"), F.lit(' "\n**Explanation:** '), F.col("text"),
                    F.lit("\nExample 2:\n**Input:** x = 0\n**Output:** 0\n**Note**"))


@query("doc_io_pairs", CODE_SQL + rf"""
, d AS (SELECT doc_id, nm, 'Example 1:' || chr(10) || '**Input:** x = ' || CAST(doc_id AS VARCHAR) || chr(10) || '**Output:** '
               || w1 || ' "' || chr(10) || '**Explanation:** ' || text || chr(10) || 'Example 2:' || chr(10)
               || '**Input:** x = 0' || chr(10) || '**Output:** 0' || chr(10) || '**Note**' AS description FROM resp_v),
s AS (SELECT doc_id, nm, regexp_extract_all(description, '(?s)\*\*Input:\*\*(.*?)\*\*Output:\*\*', 1) AS ins,
             regexp_extract_all(description, '(?s)\*\*Output:\*\*(.*?)\*\*', 1) AS outs FROM d),
z AS (SELECT doc_id, nm, i, {strip('ins[i]')} AS a, {strip('outs[i]')} AS b FROM s, range(1, least(len(ins), len(outs)) + 1) r(i))
SELECT doc_id, CAST(i - 1 AS INTEGER) AS case_idx,
  replace('assert ' || nm || '(' || CASE WHEN suffix(a, ' "') THEN substr(a, 1, length(a) - 2) || '"' ELSE a END || ') == '
          || CASE WHEN suffix(b, ' "') THEN substr(b, 1, length(b) - 2) || '"' ELSE b END, '\', '') AS test FROM z""")
def q_doc_io_pairs(spark, sf):
    c = code_v(spark, sf)
    d = c.select("doc_id", F.col("nm").alias("function_name"), _desc(c).alias("description"))
    return X.doc_io_pairs(d, "description", "function_name", ["doc_id"])


@query("strip_comments_blank", CODE_SQL + rf"""
, c AS (SELECT doc_id, regexp_replace(coalesce(regexp_extract_all(resp, '(?s)```python(.*?)```', 1)[1], resp),
                                      '(\"\"\"[\s\S]*?\"\"\"|''''''[\s\S]*?'''''')', '', 'g') AS code FROM resp_v)
SELECT doc_id, array_to_string(list_filter(string_split(code, chr(10)),
       lambda l: length({strip('l')}) > 0 AND NOT starts_with({strip('l')}, '#')), chr(10)) AS clean FROM c"""
       .replace('\\"', '"'))
def q_strip_comments_blank(spark, sf):
    c = X.first_code_block(code_v(spark, sf), "resp")
    return X.strip_comments_blank(c, "code").select("doc_id", "clean")


@query("rename_function", CODE_SQL + rf"""
, c AS (SELECT doc_id, expected_name, coalesce(regexp_extract_all(resp, '(?s)```python(.*?)```', 1)[1], resp) AS code FROM resp_v),
l AS (SELECT *, string_split(code, chr(10)) AS ls FROM c),
i AS (SELECT *, list_filter(list_transform(ls, lambda x, j: CASE WHEN starts_with({strip('x')}, 'def ') AND contains({strip('x')}, '(')
                  AND substr({strip('x')}, 5, strpos({strip('x')}, '(') - 5) <> expected_name THEN j END),
                  lambda j: j IS NOT NULL)[1] AS idx FROM l)
SELECT doc_id, CASE WHEN expected_name IS NULL OR expected_name = '' OR NOT contains(code, 'def ') OR idx IS NULL THEN code
  ELSE array_to_string(list_transform(ls, lambda x, j: CASE WHEN j = idx THEN
       replace(x, 'def ' || substr({strip('x')}, 5, strpos({strip('x')}, '(') - 5) || '(', 'def ' || expected_name || '(')
       ELSE x END), chr(10)) END AS fixed FROM i""")
def q_rename_function(spark, sf):
    c = X.first_code_block(code_v(spark, sf), "resp")
    return X.rename_function(c, "code", "expected_name").select("doc_id", "fixed")


@query("camel_to_snake", CODE_SQL + r"""
SELECT doc_id, nm AS name, lower(regexp_replace(nm, '([a-z])([A-Z])', '\1_\2', 'g')) AS snake FROM resp_v""")
def q_camel_to_snake(spark, sf):
    return code_v(spark, sf).select("doc_id", F.col("nm").alias("name"), T.camel_to_snake(F.col("nm")).alias("snake"))


@query("normalize_key", CODE_SQL + r"""
SELECT doc_id, replace(lower(lower(regexp_replace(nm, '([a-z])([A-Z])', '\1_\2', 'g'))), '_', '') AS key FROM resp_v""")
def q_normalize_key(spark, sf):
    return code_v(spark, sf).select("doc_id", T.normalize_key(T.camel_to_snake(F.col("nm"))).alias("key"))


@query("prepend_header", CODE_SQL + rf"""
SELECT doc_id, {sql_text(T.IMPORT_HEADER)}
  || array_to_string(list_transform(regexp_extract_all(resp, '(?s)```python\s*(.*?)```', 1), lambda b: {strip('b')}), chr(10))
  AS solution FROM resp_v""")
def q_prepend_header(spark, sf):
    c = code_v(spark, sf).select("doc_id", T.code_blocks(F.col("resp")).alias("blocks"))
    return X.prepend_header(c).select("doc_id", "solution")


# -------------------------------------------------------- parsing jobs (rows)
def _tests(spark, sf):
    c = code_v(spark, sf)
    lines = X.assertion_lines(c, "resp", ["doc_id", "nm"])
    return lines.select(F.col("doc_id").alias("task_id"), "line_no", F.col("line").alias("test"),
                        F.col("nm").alias("function_name"))


@query("syntax_quality_filter")
def q_syntax_quality_filter(spark, sf):
    """Report of kept/rejected tests per task and reason (parse needs Python's parser)."""
    return P.syntax_quality_filter(_tests(spark, sf))[1]
