"""FIXTURES §6-9: error classes, unittest summaries, mutation logs, coverage,
categories, text extraction, revisions, parsing jobs, Mann-Whitney."""

import pytest
from pyspark.sql import functions as F

from testsieve.functions import text as T
from testsieve.operators import curation as C
from testsieve.operators import learn as L
from testsieve.operators import outcomes as O
from testsieve.operators import parsing as P
from testsieve.operators import text as X


def test_error_classes_first_wins(spark):
    df = spark.createDataFrame([("x AssertionError y TypeError",), ("ModuleNotFoundError: No module named x",),
                                ("all good",)], "output string")
    got = {r.error_class: r["count"] for r in O.error_class_counts(df).collect()}
    assert got == {"assertion": 1, "module_not_found": 1}


@pytest.mark.parametrize("text,passed,failed", [("OK (tests=3)", 3, 0), ("FAILED (failures=1, errors=2)", 0, 3),
                                                ("FAILED (failures=1)", 0, 1), ("nothing", 0, 0)])
def test_unittest_summary(spark, text, passed, failed):
    r = O.unittest_summary(spark.createDataFrame([(text,)], "output string")).first()
    assert (r.passed, r.failed) == (passed, failed)


def test_mutation_log_and_score(spark):
    log = "\n".join(["⠋ 1/2  🎉 1 ⏰ 0  🤔 0  🙁 1  🔇 0", "noise", "⠙ 2/2  🎉 8 ⏰ 1  🤔 0  🙁 3  🔇 0", "done"])
    df = spark.createDataFrame([("m1", log), ("m2", "no progress here")], "module string, log string")
    parsed = O.mutation_log_parse(df).collect()
    assert [(r.module, r.killed, r.timeout, r.suspicious, r.survived, r.skipped) for r in parsed] == [("m1", 8, 1, 0, 3, 0)]
    s = O.mutation_score(O.mutation_log_parse(df)).first()
    assert s.score == pytest.approx(66.67)
    empty = spark.createDataFrame([], "module string, killed int, timeout int, suspicious int, survived int, skipped int")
    assert O.mutation_score(empty).first().score == 0.0


def test_published_mutation_arithmetic(spark):
    df = spark.createDataFrame([("m", 1594, 0, 0, 246, 0)],
                               "module string, killed int, timeout int, suspicious int, survived int, skipped int")
    assert O.mutation_score(df).first().score == 86.63


def test_line_coverage(spark):
    hits = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (1, 0, 3), (1, 1, 3), (1, 1, 4), (1, 2, 9), (2, 0, 1)],
                                 "function_id long, test_idx int, line_no int")
    tests = spark.createDataFrame([(1, 0, 1), (1, 1, 1), (1, 2, 0), (2, 0, 0)], "function_id long, test_idx int, is_valid int")
    funcs = spark.createDataFrame([(1, 10), (2, 5)], "function_id long, total_lines int")
    cov = O.line_coverage(hits, tests, funcs)
    assert {r.function_id: r.coverage for r in cov.collect()} == {1: 0.4, 2: 0.0}
    assert O.mean_coverage(cov).first().mean_coverage == 0.2


def test_map_categories(spark):
    resp = spark.createDataFrame([(1, "*****\n1. bad (Category 5)\n2. worse (Category 2)\n*****")], "function_id long, text string")
    inv = spark.createDataFrame([(1, 3), (1, 7), (1, 9)], "function_id long, test_idx int")
    got = [(r.test_idx, r.category_index) for r in O.map_categories(resp, inv, spark).orderBy("test_idx").collect()]
    assert got == [(3, 5), (7, 2), (9, -1)]


def test_text_extraction(spark):
    two = "a\n```python\n x = 1 \n```\nb\n```python\ny = 2\n```"
    df = spark.createDataFrame([(1, two), (2, "no fence")], "id int, text string")
    blocks = X.extract_code_blocks(df, keep=["id"]).orderBy("id", "block_idx").collect()
    assert [(r.id, r.block) for r in blocks] == [(1, "x = 1"), (1, "y = 2")]
    first = {r.id: r.code for r in X.first_code_block(df).collect()}
    assert first[2] == "no fence" and first[1] == "\n x = 1 \n"
    lines = X.assertion_lines(spark.createDataFrame([("x\nassert f(1) == 2\n  assert f(2) == 3",)], "text string")).collect()
    assert [r.line for r in lines] == ["assert f(1) == 2", "assert f(2) == 3"]


def test_markers_truncation_and_names(spark):
    df = spark.createDataFrame([("*****\nA\n*****", "def a(x):\n  pass\nprint(a(1))", "getMaxValue"),
                                ("***** no end", "x", "abc")], "r string, code string, name string")
    got = df.select(T.between_markers(F.col("r")).alias("m"), T.truncate_at_stop(F.col("code")).alias("t"),
                    T.camel_to_snake(F.col("name")).alias("s"), T.normalize_key(F.col("name")).alias("k")).collect()
    assert (got[0].m, got[0].t, got[0].s, got[0].k) == ("A", "def a(x):\n  pass", "get_max_value", "getmaxvalue")
    assert got[1].m == ""


def test_split_on_assert_and_candidate(spark):
    df = spark.createDataFrame([("f(1) == 1\nassert g(2) == 2\nassert f(3) == 3\ndef h(): pass", "f")],
                               "text string, entry_point string")
    got = [r.test for r in X.split_on_assert(df).orderBy("case_idx").collect()]
    assert got == ["assert f(1) == 1", "assert f(3) == 3"]
    body = spark.createDataFrame([("def check(candidate):\n    assert candidate(1) == 1\n    assert candidate(2) == 2",)], "test string")
    tests = [r.test for r in X.split_candidate_asserts(body).orderBy("case_idx").collect()]
    assert tests == ["assert candidate(1) == 1\n    ", "assert candidate(2) == 2"]


def test_rename_and_strip(spark):
    code = "import os\ndef other(x):\n    '''doc'''\n    # c\n\n    return x"
    df = spark.createDataFrame([(code, "solve"), (code, "other")], "code string, expected_name string")
    got = [r.fixed for r in X.rename_function(df).collect()]
    assert got[0].splitlines()[1] == "def solve(x):" and got[1] == code
    clean = X.strip_comments_blank(df.limit(1)).first().clean
    assert clean == "import os\ndef other(x):\n    return x"


def test_doc_io_pairs(spark):
    d = "**Input:** nums = [1,2] \"\n**Output:** 3 \"\n**Explanation:** x\n**Input:** a = 1\n**Output:** 2\n**"
    df = spark.createDataFrame([(d, "solve")], "text string, function_name string")
    got = [r.test for r in X.doc_io_pairs(df).orderBy("case_idx").collect()]
    assert got == ['assert solve(nums = [1,2]") == 3"', "assert solve(a = 1) == 2"]


def test_revisions_and_relabel(spark):
    tests = spark.createDataFrame([(1, 0, "assert f(1) == 1", 1), (1, 1, "assert f(2) == 3", 0)],
                                  "function_id long, test_idx int, text string, is_valid int")
    revs = spark.createDataFrame([(1, 0, "assert f(1)==1"), (1, 1, "assert f(2) == 2")],
                                 "function_id long, test_idx int, validated_text string")
    cur = C.apply_revisions(tests, revs).orderBy("test_idx").collect()
    assert [(r.changed, r.text) for r in cur] == [(False, "assert f(1) == 1"), (True, "assert f(2) == 2")]
    new = spark.createDataFrame([(1, 1, True)], "function_id long, test_idx int, passed boolean")
    relabelled, trans = C.relabel(C.apply_revisions(tests, revs), new)
    assert {(r.old_is_valid, r.is_valid): r["count"] for r in trans.collect()} == {(1, 0): 1, (0, 1): 1}


def test_syntax_filter_reasons(spark):
    kept, report = P.syntax_quality_filter(spark.createDataFrame(
        [("t", "assert f(1) == 1", "f"), ("t", "assert (", "f"), ("t", "assert g(1)", "f")],
        "task_id string, test string, function_name string"))
    assert {r.reason: r["count"] for r in report.collect()} == {"kept": 1, "syntax": 1, "no_function_name": 1}


def test_mann_whitney_golden(spark):
    rows = [("d", "l", 1, 1.0), ("d", "l", 1, 2.0), ("d", "l", 1, 2.0), ("d", "l", 0, 2.0), ("d", "l", 0, 3.0)]
    df = spark.createDataFrame(rows, "dataset string, llm string, is_valid int, x double")
    r = L.mann_whitney_u(df, ["x"]).first()
    assert r.u == 1.0 and (r.n1, r.n2) == (3, 2)
    assert 0.0 < r.p <= 1.0
