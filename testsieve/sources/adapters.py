"""Adapters: map the driver's tables onto the reference's data model.

Each adapter is a deterministic projection of a given table (SURVEY §7);
``plans/views.py`` holds the same definitions in SQL for the DuckDB oracle.
All of them are narrow (no shuffle) except where noted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import load

# Fixed values of the adapter (not reference values): token vocabulary used to
# spell the synthetic responses built from ``embeddings``.
TOKEN_VOCAB = ["assert", " f", "(", "1", ",", " ", "2", ")", " ==", "3", '"a"', "[", "]", "x", " 7", "0"]
TOKENS_PER_TEST = 16
ALTERNATIVES = 4
INPUT_TOKENS = 12


def _vocab_at(idx):
    return F.element_at(F.array(*[F.lit(t) for t in TOKEN_VOCAB]), (F.pmod(idx, F.lit(len(TOKEN_VOCAB))) + 1).cast("int"))


def _dataset_col(fid):
    return F.when(F.pmod(fid, F.lit(2)) == 0, F.lit("HumanEval")).otherwise(F.lit("MBPP"))


def _llm_col(fid):
    return F.when(F.pmod(fid, F.lit(5)) < 3, F.lit("gpt-4o")).otherwise(F.lit("codeqwen"))


# ---------------------------------------------------------------- generations
def generations_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One generated response per ``embeddings`` row (= one test).

    tokens: 16 x STRUCT<pos, token, logprob, section, top: 4 x STRUCT<token, logprob>>,
    logprob = -10*|x|, alternatives = elements 4*pos .. 4*pos+3, the first
    alternative is the chosen token (``top`` includes it, D8)."""
    e = load(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    fid = F.pmod(F.col("vec_id"), F.lit(50))

    def tok(p):
        base = F.col("vec_id") * 3 + p * 5
        top = F.transform(
            F.sequence(F.lit(0), F.lit(ALTERNATIVES - 1)),
            lambda j: F.struct(
                _vocab_at(base + j).alias("token"),
                (F.abs(F.element_at("embedding", p * ALTERNATIVES + j + 1).cast("double")) * -10.0).alias("logprob"),
            ),
        )
        return F.struct(
            p.alias("pos"),
            _vocab_at(base).alias("token"),
            (F.abs(F.element_at("embedding", p * ALTERNATIVES + 1).cast("double")) * -10.0).alias("logprob"),
            F.when(p < INPUT_TOKENS, F.lit("input")).otherwise(F.lit("output")).alias("section"),
            top.alias("top"),
        )

    name = F.concat(F.lit("f_"), fid.cast("string"))
    return e.select(
        _dataset_col(fid).alias("dataset"),
        _llm_col(fid).alias("llm"),
        fid.alias("function_id"),
        F.col("vec_id").alias("test_idx"),
        F.concat(F.lit("Write "), name).alias("prompt"),
        F.concat(F.lit("def "), name, F.lit("(x): return x")).alias("solution"),
        F.pmod("vec_id", F.lit(2)).cast("int").alias("test_type"),
        F.array(F.concat(F.lit("assert "), name, F.lit("("), F.col("vec_id").cast("string"), F.lit(") == 1"))).alias("testcases"),
        F.when(F.col("label") < 7, 1).otherwise(0).alias("is_valid"),
        F.transform(F.sequence(F.lit(0), F.lit(TOKENS_PER_TEST - 1)), tok).alias("tokens"),
    )


def tokens_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token rows: (dataset, llm, function_id, test_idx, is_valid, pos, token, logprob, section, top)."""
    g = generations_v(spark, sf_dir)
    return g.select("dataset", "llm", "function_id", "test_idx", "is_valid",
                    F.inline("tokens"))


def responses_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of several tests, one for each ``embeddings`` row: an introduction that ends in
    ``assert`` and the row's tokens twice (numbered anew), with eight tests of four tokens
    (three of input, one of output): each of the first four comes again as its copy.  The
    input of some is not in the response, the output of some is null."""
    g = generations_v(spark, sf_dir)
    intro = F.struct(F.lit(0).alias("pos"), F.lit("Tests: assert").alias("token"))
    row = F.transform("tokens", lambda t: t["token"])
    twice = F.transform(F.concat(row, row), lambda t, i: F.struct((i + 1).alias("pos"), t.alias("token")))

    def test(n):
        k = F.pmod(n, F.lit(4))
        odd = F.col("test_idx") + n
        return F.struct((F.col("test_idx") * 8 + n).alias("test_idx"),
                        F.when(F.pmod(odd, F.lit(7)) == 3, F.lit("not in it")).otherwise(F.array_join(F.slice(row, 4 * k + 1, F.lit(3)), "")).alias("input_text"),
                        F.when(F.pmod(odd, F.lit(11)) != 5, F.element_at(row, 4 * k + 4)).alias("output_text"))

    # two steps: inside a lambda ``tokens`` would be the alias of the same select
    return (g.withColumn("tests", F.transform(F.sequence(F.lit(0), F.lit(7)), test))
            .select("dataset", "llm", "function_id", F.col("test_idx").alias("response_id"), F.concat(F.array(intro), twice).alias("tokens"), "tests"))


# --------------------------------------------------------------------- scores
def scores_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events", "user_id", "event_id", "value", "event_type")
    return e.select(
        F.col("user_id").alias("function_id"),
        F.col("event_id").alias("test_idx"),
        F.least(F.col("value") / 100.0, F.lit(1.0)).alias("y_prob"),
        F.when(F.col("event_type") != "error", 1).otherwise(0).alias("y_true"),
    )


# ---------------------------------------------------------------- execution
def exec_rows_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event = one (sample, test occurrence, outcome)."""
    e = load(spark, sf_dir, "events", "user_id", "event_id", "value", "event_type")
    return e.select(
        F.col("user_id").cast("string").alias("task_id"),
        F.col("event_id"),
        F.pmod(F.col("event_id"), F.lit(7)).cast("int").alias("solution_id"),
        F.pmod(F.round(F.col("value") * 100).cast("bigint"), F.lit(3)).cast("int").alias("test_id"),
        (F.col("event_type") != "error").alias("ok"),
        F.least(F.col("value") / 100.0, F.lit(1.0)).alias("score"),
    )


def exec_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exec_results(task_id, solution_id, test_id, passed)."""
    return (exec_rows_v(spark, sf_dir)
            .groupBy("task_id", "solution_id", "test_id")
            .agg(F.bool_and("ok").alias("passed")))


def solutions_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """solutions(task_id, sample_idx, solution_id, completion): every event is one sample."""
    r = exec_rows_v(spark, sf_dir)
    return r.select(
        "task_id",
        F.col("event_id").alias("sample_idx"),
        "solution_id",
        F.concat(F.lit("def solution_"), F.col("solution_id").cast("string"), F.lit("(): pass")).alias("completion"),
    )


def tests_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tests(task_id, sample_idx, pos, test_id, text, score): a sample is the
    generation (task, event_id % 7); event_id / 7 orders the tests of a sample
    without ties — a projection, no window."""
    r = exec_rows_v(spark, sf_dir)
    return r.select(
        "task_id",
        F.col("solution_id").alias("sample_idx"),
        F.expr("event_id div 7").alias("pos"),
        "test_id",
        F.concat(F.lit("assert candidate("), F.col("test_id").cast("string"), F.lit(")")).alias("text"),
        "score",
    )


def ground_truth_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ground_truth(task_id, solution_id, passed): passes all of its tests."""
    return (exec_v(spark, sf_dir).groupBy("task_id", "solution_id")
            .agg(F.bool_and("passed").alias("passed")))


# ------------------------------------------------------------------ outcomes
def outcomes_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """failure_output(function_id, test_idx, output): one runner message per event."""
    e = load(spark, sf_dir, "events", "user_id", "event_id", "event_type")
    k = F.pmod(F.col("event_id"), F.lit(11))
    eid = F.col("event_id").cast("string")
    msg = (
        F.when(F.col("event_type") != "error",
               F.concat(F.lit("Ran tests. OK (tests="), (F.pmod(F.col("event_id"), F.lit(5)) + 1).cast("string"), F.lit(")")))
        .when(k == 0, F.concat(F.lit("AssertionError: assert f("), eid, F.lit(") then TypeError")))
        .when(k == 1, F.lit("SyntaxError: invalid syntax"))
        .when(k == 2, F.lit("IndentationError: unexpected indent"))
        .when(k == 3, F.lit("TypeError: unsupported operand"))
        .when(k == 4, F.lit("ValueError: invalid literal"))
        .when(k == 5, F.lit("AttributeError: object has no attribute"))
        .when(k == 6, F.lit("ModuleNotFoundError: No module named x"))
        .when(k == 7, F.lit("ImportError: cannot import name y"))
        .when(k == 8, F.lit("NameError: name z is not defined"))
        .when(k == 9, F.lit("FileNotFoundError: no such file"))
        .when(F.pmod(F.col("event_id"), F.lit(2)) == 0,
              F.concat(F.lit("FAILED (failures="), F.pmod(F.col("event_id"), F.lit(3)).cast("string"),
                       F.lit(", errors="), F.pmod(F.col("event_id"), F.lit(4)).cast("string"), F.lit(")")))
        .otherwise(F.lit("FAILED (failures=1)"))
    )
    return e.select(F.col("user_id").alias("function_id"), F.col("event_id").alias("test_idx"),
                    msg.alias("output"))


# ------------------------------------------------------------------ coverage
def hits_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_hits(function_id, test_idx, line_no, valid)."""
    li = load(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    return li.select(
        F.col("l_orderkey").alias("function_id"),
        F.pmod(F.col("l_partkey"), F.lit(4)).cast("int").alias("test_idx"),
        F.col("l_linenumber").alias("line_no"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("valid"),
    )


def hit_tests_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tests of the coverage view: (function_id, test_idx, is_valid)."""
    return (hits_v(spark, sf_dir).groupBy("function_id", "test_idx")
            .agg(F.max("valid").alias("is_valid")))


def hit_functions_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """functions(function_id, total_lines) with a constant of 10 lines."""
    o = load(spark, sf_dir, "orders", "o_orderkey")
    return o.select(F.col("o_orderkey").alias("function_id"), F.lit(10).alias("total_lines"))


# ------------------------------------------------------------------ mutation
def mutants_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mutant rows (module, order_id, line, status)."""
    li = load(spark, sf_dir, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    status = (
        F.when(F.col("l_linenumber") == 7, F.lit("timeout"))
        .when((F.col("l_linenumber") == 6) & (F.col("l_linestatus") == "O"), F.lit("suspicious"))
        .when((F.col("l_returnflag") == "R") | ((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F")), F.lit("killed"))
        .when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F"), F.lit("skipped"))
        .otherwise(F.lit("survived"))
    )
    return li.select(F.concat(F.lit("mod"), F.col("l_suppkey").cast("string")).alias("module"),
                     F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("step"),
                     status.alias("status"))


def mutation_log_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mutation_log(module, run_id, log): one runner log per (module, order),
    progress lines with running counts, interleaved with noise lines.
    A log holds at most 7 lines (bounded collect)."""
    m = mutants_v(spark, sf_dir)
    w = Window.partitionBy("module", "run_id").orderBy("step")
    run = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0)).over(w).cast("string")
    n = F.count(F.lit(1)).over(Window.partitionBy("module", "run_id"))
    line = F.concat(
        F.lit("⠋ "), F.col("step").cast("string"), F.lit("/"), n.cast("string"),
        F.lit("  🎉 "), run("killed"), F.lit(" ⏰ "), run("timeout"), F.lit(" 🤔 "), run("suspicious"),
        F.lit(" 🙁 "), run("survived"), F.lit(" 🔇 "), run("skipped"),
    )
    lines = m.select("module", "run_id", "step", line.alias("line"))
    return (lines.groupBy("module", "run_id")
            .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("step", "line"))),
                                          lambda s: s["line"]), "\nrunning mutants\n").alias("log")))


def mutant_results_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mutant_results(module, killed, timeout, suspicious, survived, skipped)."""
    m = mutants_v(spark, sf_dir)
    cnt = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0)).cast("bigint").alias(s)
    return m.groupBy("module").agg(cnt("killed"), cnt("timeout"), cnt("suspicious"), cnt("survived"), cnt("skipped"))


# ------------------------------------------------------------------ text
def corpus_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """testcases over documents: (function_id=source, test_idx=doc_id, is_valid=quality?, text)."""
    d = load(spark, sf_dir, "documents", "doc_id", "source", "text")
    lab = load(spark, sf_dir, "labels", "doc_id", "quality")
    return (d.join(lab, "doc_id", "left")
            .select(F.col("source").alias("function_id"), F.col("doc_id").alias("test_idx"),
                    F.col("quality").alias("is_valid"), "text"))


def dialog_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, prompt, response): a user turn and the next assistant turn."""
    c = load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    w = Window.partitionBy("conv_id").orderBy("turn")
    nxt = c.select("conv_id", "turn", "role", "text",
                   F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("next_text"))
    return (nxt.filter((F.col("role") == "user") & (F.col("next_role") == "assistant"))
            .select("conv_id", "turn", F.col("text").alias("prompt"), F.col("next_text").alias("response")))


def revisions_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """revisions(function_id, test_idx, validated_text?)."""
    d = load(spark, sf_dir, "documents", "doc_id", "source", "text")
    k = F.pmod(F.col("doc_id"), F.lit(3))
    rev = (F.when(k == 0, F.replace(F.col("text"), F.lit(" "), F.lit("  ")))
           .when(k == 1, F.replace(F.col("text"), F.lit("."), F.lit(";"))))
    return d.select(F.col("source").alias("function_id"), F.col("doc_id").alias("test_idx"),
                    rev.alias("validated_text"))
