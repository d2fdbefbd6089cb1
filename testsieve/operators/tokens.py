"""Token operators: probability, entropy, perplexity, filters and the
alignment of response tokens to the input/output text of each test."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions import tokens as tf

TEST_KEY = ("dataset", "llm", "function_id", "test_idx")


def token_scores(tokens: DataFrame, base: float = 2.0) -> DataFrame:
    """Add ``prob`` (percent, 2 decimals) and ``entropy`` (bits) to token rows."""
    return tokens.withColumn("prob", tf.prob_percent(F.col("logprob"))) \
                 .withColumn("entropy", tf.entropy(F.col("top"), base))


def punctuation_filter(tokens: DataFrame, by: Sequence[str] = (*TEST_KEY, "section")) -> DataFrame:
    """Drop punctuation-only tokens; a section that would become empty keeps
    all of its tokens.  The count window spans one test section (bounded)."""
    sig = tf.is_signal_token(F.col("token"))
    n_sig = F.sum(F.when(sig, 1).otherwise(0)).over(Window.partitionBy(*by))
    return tokens.withColumn("_nsig", n_sig).filter(sig | (F.col("_nsig") == 0)).drop("_nsig")


def digit_token_filter(tokens: DataFrame) -> DataFrame:
    """Keep only tokens containing a digit (used for one benchmark)."""
    return tokens.filter(tf.has_digit(F.col("token")))


def perplexity(tokens: DataFrame, by: Sequence[str] = (*TEST_KEY, "section")) -> DataFrame:
    """2^(-mean log2 p) over tokens with p > 0, p = exp(logprob); 0 when none."""
    p = F.exp(F.col("logprob"))
    avg_l2 = F.avg(F.when(p > 0, F.log2(p)))
    return tokens.groupBy(*by).agg(F.coalesce(F.pow(F.lit(2.0), -avg_l2), F.lit(0.0)).alias("perplexity"))


# ------------------------------------------------------------------ alignment
def _squeezed(c, strip_ws: bool):
    return F.regexp_replace(c, r"\s", "") if strip_ws else c


def test_spans(responses: DataFrame, tokens: str = "tokens", tests: str = "tests", strip_ws: bool = False,
               marker: str | None = "assert", out: str = "spans") -> DataFrame:
    """Add ``out``: for each test of a response that is found, in order, a struct of
    ``test_idx`` and the character spans [input_start, input_end) and [output_start,
    output_end) of its texts in the response (the concatenated tokens).

    An ordered fold with one cursor per response: it starts behind the first token that
    holds ``marker`` (without such a token nothing is found; None starts at the front),
    a test's input is the first occurrence at or after the cursor, its output the first
    one after the input, and the cursor moves behind the output.  So repeated tests
    align with their own repetition.  A test whose texts are null (it could not be
    split) or not found is left out and leaves the cursor where it is.  All positions
    count characters of the same text: with ``strip_ws`` that without white space."""
    piece = F.transform(tokens, lambda t: _squeezed(F.coalesce(t["token"], F.lit("")), strip_ws))
    df = responses.withColumn("_pieces", piece).withColumn("_text", F.array_join("_pieces", ""))
    if marker is None:
        start = F.lit(0)
    else:
        at = F.array_position(F.transform("_pieces", lambda x: F.contains(x, F.lit(marker))), True).cast("int")
        start = F.when(at > 0, F.length(F.array_join(F.slice("_pieces", F.lit(1), at), "")))
    # an empty text (in white space only) is at once where the search begins
    locate = lambda part, text, after: F.when(F.length(part) == 0, after).otherwise(F.call_function("locate", part, text, after + 1) - 1)
    empty = F.array().cast("array<struct<test_idx:bigint,input_start:int,input_end:int,output_start:int,output_end:int>>")

    def step(state, test):
        i, o = _squeezed(test["input_text"], strip_ws), _squeezed(test["output_text"], strip_ws)
        i_at = locate(i, state["text"], state["cursor"])
        i_end = i_at + F.length(i)
        o_at = locate(o, state["text"], i_end)
        found = F.struct(test["test_idx"].cast("bigint").alias("test_idx"), i_at.alias("input_start"), i_end.alias("input_end"),
                         o_at.alias("output_start"), (o_at + F.length(o)).alias("output_end"))
        here = (i_at >= 0) & (o_at >= i_end)
        return F.struct(state["text"].alias("text"), F.when(here, o_at + F.length(o)).otherwise(state["cursor"]).alias("cursor"),
                        F.when(here, F.concat(state["spans"], F.array(found))).otherwise(state["spans"]).alias("spans"))

    # the text travels in the state: as a column of the row it would be built anew wherever a lambda names it
    first = F.struct(F.col("_text").alias("text"), start.cast("int").alias("cursor"), empty.alias("spans"))
    return df.withColumn(out, F.aggregate(tests, first, step, lambda s: s["spans"])).drop("_text")


@F.pandas_udf(ArrayType(IntegerType()))
def _token_ranges(lengths: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    """For spans of characters: first token and number of tokens that overlap, in turn."""
    out = []
    for n, a, b in zip(lengths, starts, ends, strict=True):
        stop = np.cumsum(n)
        first = np.searchsorted(stop, a, "right")
        last = np.searchsorted(stop - n, b, "left")
        out.append(np.stack([first, np.maximum(last - first, 0)], 1).ravel().astype(np.int32))
    return pd.Series(out)


def token_align(responses: DataFrame, gen_key: Sequence[str], tokens: str = "tokens", tests: str = "tests",
                strip_ws: bool = False, marker: str | None = "assert") -> DataFrame:
    """The tests of every response with the tokens that overlap their input and output
    text: gen_key + (test_idx, input_tokens, output_tokens), a row for each test that
    is found (see ``test_spans``).

    responses: gen_key + ``tokens`` (array of structs with ``token``) + ``tests`` (array of
    structs test_idx, input_text, output_text, in order).
    The token lists stay nested: no token row is made, shuffled or joined; only the
    search for token numbers by character position is an Arrow function."""
    df = test_spans(responses, tokens, tests, strip_ws, marker)
    flat = lambda a, b: F.flatten(F.transform("spans", lambda s: F.array(s[a], s[b])))
    df = df.withColumn("_ranges", _token_ranges(F.transform("_pieces", F.length), flat("input_start", "output_start"), flat("input_end", "output_end")))
    some = lambda k, at: F.slice(tokens, F.get("_ranges", 4 * at + 2 * k) + 1, F.get("_ranges", 4 * at + 2 * k + 1))
    per = F.transform("spans", lambda s, at: F.struct(s["test_idx"].alias("test_idx"), some(0, at).alias("input_tokens"), some(1, at).alias("output_tokens")))
    return df.where(F.size("spans") > 0).select(*gen_key, F.inline(per))


def aligned_tokens(aligned: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Token rows of ``token_align``: keep + (section, the token's fields)."""
    def named(section):
        return F.transform(f"{section}_tokens", lambda t: F.struct(F.lit(section).alias("section"), t.alias("t")))

    both = F.concat(named("input"), named("output"))
    return aligned.select(*keep, F.inline(both)).select(*keep, "section", "t.*")


def all_tokens(tokens: DataFrame, gen_key: Sequence[str]) -> DataFrame:
    """Whole-response statistics, computed once per generation (the reference
    copies the token list into every test; we aggregate then join)."""
    return tokens.groupBy(*gen_key).agg(
        F.avg("entropy").alias("feature_mean"), F.max("entropy").alias("feature_max"),
        F.min("entropy").alias("feature_min"), F.sum("entropy").alias("feature_sum"),
        F.count(F.lit(1)).alias("feature_total"), F.var_pop("entropy").alias("feature_variance"))
