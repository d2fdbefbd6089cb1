"""Queries: token operators, features and feature reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as FE
from ..operators import metrics as M
from ..operators import selection as S
from ..operators import tokens as TK
from ..sources import adapters as A
from .registry import query, r6
from .views import with_views

# ------------------------------------------------------------ SQL fragments
ENT_SQL = "-list_sum(list_transform(top, lambda x: CASE WHEN exp(x.logprob) > 0 THEN exp(x.logprob) * x.logprob / ln(2) ELSE 0.0 END))"
PUNCT_SQL = r"""regexp_matches(coalesce(token, ''), '\A(==|[ ,\[\]''"()\n])*\z')"""
SCORED_SQL = f"""scored AS (
  SELECT dataset, llm, function_id, test_idx, is_valid, pos, token, section, logprob,
         round_even(exp(logprob) * 100.0, 2) AS prob, {ENT_SQL} AS entropy FROM tokens_v),
filt AS (
  SELECT * FROM (SELECT *, sum(CASE WHEN NOT {PUNCT_SQL} THEN 1 ELSE 0 END)
                             OVER (PARTITION BY dataset, llm, function_id, test_idx, section) AS nsig FROM scored)
  WHERE NOT {PUNCT_SQL} OR nsig = 0)"""


def _stats_sql(value: str, src: str, rnd: bool = True) -> str:
    parts = []
    r = (lambda e: f"round({e}, 6)") if rnd else (lambda e: e)
    for s in ("input", "output"):
        v = f"CASE WHEN section = '{s}' THEN {value} END"
        parts += [f"{r(f'coalesce(avg({v}), 0.0)')} AS {s}_mean", f"{r(f'coalesce(max({v}), 0.0)')} AS {s}_max",
                  f"{r(f'coalesce(min({v}), 0.0)')} AS {s}_min", f"{r(f'coalesce(sum({v}), 0.0)')} AS {s}_sum",
                  f"CAST(count({v}) AS DOUBLE) AS {s}_total", f"{r(f'coalesce(var_pop({v}), 0.0)')} AS {s}_variance"]
    return (f"SELECT dataset, llm, function_id, test_idx, is_valid, {', '.join(parts)} FROM {src} "
            "GROUP BY dataset, llm, function_id, test_idx, is_valid")


FEAT_SQL = with_views("tokens_v") + f", {SCORED_SQL},\nfeat AS ({_stats_sql('entropy', 'filt')})\n"
FEAT_RAW_SQL = with_views("tokens_v") + f", {SCORED_SQL},\nfeat AS ({_stats_sql('entropy', 'filt', False)})\n"
PROB_FEAT_SQL = with_views("tokens_v") + f", {SCORED_SQL},\nfeat AS ({_stats_sql('prob', 'filt')})\n"


def features(spark, sf, value="entropy"):
    """Entropy (or probability) features per test, punctuation-filtered, from
    the nested token arrays (no explode, no shuffle)."""
    return FE.token_stats_nested(A.generations_v(spark, sf), value)


def scored_tokens(spark, sf):
    return TK.token_scores(A.tokens_v(spark, sf))


# ------------------------------------------------------------------ queries
@query("token_probability", with_views("tokens_v") +
       "SELECT test_idx, pos, round(round_even(exp(logprob) * 100.0, 2), 6) AS prob FROM tokens_v")
def q_token_probability(spark, sf):
    return r6(scored_tokens(spark, sf).select("test_idx", "pos", "prob"))


@query("token_entropy", with_views("tokens_v") +
       f"SELECT test_idx, pos, round({ENT_SQL}, 6) AS entropy FROM tokens_v")
def q_token_entropy(spark, sf):
    return r6(scored_tokens(spark, sf).select("test_idx", "pos", "entropy"))


@query("perplexity", with_views("tokens_v") + """
SELECT function_id, test_idx, section,
       round(coalesce(pow(2.0, -avg(CASE WHEN exp(logprob) > 0 THEN log2(exp(logprob)) END)), 0.0), 6) AS perplexity
FROM tokens_v GROUP BY function_id, test_idx, section""")
def q_perplexity(spark, sf):
    return r6(TK.perplexity(A.tokens_v(spark, sf), ("function_id", "test_idx", "section")))


@query("punctuation_filter", with_views("tokens_v") + f", {SCORED_SQL}\nSELECT test_idx, section, pos, token FROM filt")
def q_punctuation_filter(spark, sf):
    return TK.punctuation_filter(A.tokens_v(spark, sf)).select("test_idx", "section", "pos", "token")


@query("digit_token_filter", with_views("tokens_v") +
       r"SELECT test_idx, pos, token FROM tokens_v WHERE regexp_matches(token, '\d')")
def q_digit_token_filter(spark, sf):
    return TK.digit_token_filter(A.tokens_v(spark, sf)).select("test_idx", "pos", "token")


@query("token_stats", FEAT_SQL + "SELECT * FROM feat")
def q_token_stats(spark, sf):
    return r6(features(spark, sf))


@query("feature_sets", FEAT_SQL + """
SELECT dataset, llm, function_id, test_idx, is_valid, input_mean, input_max, input_min, input_sum, input_total,
       input_variance, output_mean, output_max, output_min, output_sum, output_total, output_variance FROM feat""")
def q_feature_sets(spark, sf):
    return r6(FE.feature_sets(features(spark, sf), "all"))


@query("feature_sets_probability", PROB_FEAT_SQL + """
SELECT dataset, llm, function_id, test_idx, is_valid, output_mean, output_max, output_min, output_sum,
       output_total, output_variance FROM feat""")
def q_feature_sets_probability(spark, sf):
    return r6(FE.feature_sets(features(spark, sf, "prob"), "output"))


NAIVE_SQL = with_views("tokens_v") + f""", {SCORED_SQL},
naive AS (SELECT dataset, llm, function_id, avg(entropy) AS fm, max(entropy) AS fx, min(entropy) AS fn, sum(entropy) AS fs,
                 count(*) AS ft, var_pop(entropy) AS fv FROM scored GROUP BY dataset, llm, function_id)
SELECT t.function_id, t.test_idx, round(fm, 6) AS feature_mean, round(fx, 6) AS feature_max, round(fn, 6) AS feature_min,
       round(fs, 6) AS feature_sum, ft AS feature_total, round(fv, 6) AS feature_variance
FROM (SELECT DISTINCT dataset, llm, function_id, test_idx FROM tokens_v) t
JOIN naive n ON t.dataset = n.dataset AND t.llm = n.llm AND t.function_id = n.function_id"""


def _naive(spark, sf):
    tok = scored_tokens(spark, sf)
    tests = A.generations_v(spark, sf).select("dataset", "llm", "function_id", "test_idx")
    return FE.naive_features(tests, tok, ("dataset", "llm", "function_id"))


@query("all_tokens", NAIVE_SQL)
def q_all_tokens(spark, sf):
    return r6(_naive(spark, sf).select("function_id", "test_idx", "feature_mean", "feature_max", "feature_min",
                                       "feature_sum", "feature_total", "feature_variance"))


@query("feature_sets_naive", NAIVE_SQL)
def q_feature_sets_naive(spark, sf):
    df = FE.feature_sets(_naive(spark, sf).withColumn("is_valid", F.lit(None)), "naive",
                         key=("function_id", "test_idx"))
    return r6(df.drop("is_valid"))


@query("entropy_rank_baseline", FEAT_SQL + """
SELECT function_id, test_idx, round(output_mean, 6) AS output_mean FROM (
  SELECT *, row_number() OVER (PARTITION BY function_id ORDER BY output_mean, test_idx) AS rn FROM feat) WHERE rn <= 3""")
def q_entropy_rank_baseline(spark, sf):
    return r6(S.entropy_rank_baseline(features(spark, sf), 3).select("function_id", "test_idx", "output_mean"))


@query("feature_means_by_validity", FEAT_SQL + """
SELECT dataset, llm, is_valid, round(round(avg(input_mean), 3), 6) AS avg_input_mean,
       round(round(avg(output_mean), 3), 6) AS avg_output_mean, count(*) AS tests
FROM feat GROUP BY dataset, llm, is_valid""")
def q_feature_means_by_validity(spark, sf):
    return r6(M.feature_means_by_validity(features(spark, sf)))


@query("clipped_percentiles", PROB_FEAT_SQL + """
SELECT is_valid, round(quantile_cont(least(input_sum, 100.0), 0.5), 6) AS p50,
       round(quantile_cont(least(input_sum, 100.0), 0.75), 6) AS p75 FROM feat GROUP BY is_valid""")
def q_clipped_percentiles(spark, sf):
    return r6(M.clipped_percentiles(features(spark, sf, "prob"), "input_sum", 100.0))


# ------------------------------------------------------------------ alignment
# The fold over a response's tests: cur is the cursor, ok whether the test was found.
def _aligned_sql(squeeze: str) -> str:
    q = lambda c: squeeze.format(c)
    return with_views("response_tokens_v", "response_tests_v").replace("WITH ", "WITH RECURSIVE ", 1) + f""",
tk AS (SELECT response_id, pos, {q('token')} AS tk, sum(length({q('token')})) OVER (PARTITION BY response_id ORDER BY pos) AS e FROM response_tokens_v),
tx AS (SELECT response_id, string_agg(tk, '' ORDER BY pos) AS r, min(e) AS begin FROM tk GROUP BY response_id),
ts AS (SELECT response_id, n, test_idx, {q('input_text')} AS i, {q('output_text')} AS o FROM response_tests_v),
f AS (SELECT response_id, -1 AS n, CAST(begin AS BIGINT) AS cur, false AS ok, CAST(0 AS BIGINT) AS i_s, CAST(0 AS BIGINT) AS i_e, CAST(0 AS BIGINT) AS o_s FROM tx
      UNION ALL
      SELECT response_id, n, CASE WHEN ok THEN o_s + length(o) ELSE cur END, ok, i_s, i_e, o_s FROM (
        SELECT *, coalesce(ia > 0 AND strpos(substr(r, cur + ia + length(i)), o) > 0, false) AS ok, cur + ia - 1 AS i_s, cur + ia - 1 + length(i) AS i_e,
               cur + ia - 2 + length(i) + strpos(substr(r, cur + ia + length(i)), o) AS o_s
        FROM (SELECT f.response_id, ts.n, f.cur, ts.i, ts.o, tx.r, strpos(substr(tx.r, f.cur + 1), ts.i) AS ia
              FROM f JOIN ts ON ts.response_id = f.response_id AND ts.n = f.n + 1 JOIN tx ON tx.response_id = f.response_id))),
s AS (SELECT f.response_id, test_idx, unnest([{{'section': 'input', 's': i_s, 'e': i_e}}, {{'section': 'output', 's': o_s, 'e': o_s + length(o)}}]) AS x
      FROM f JOIN ts ON ts.response_id = f.response_id AND ts.n = f.n WHERE ok),
aligned AS (SELECT s.response_id, test_idx, x.section AS section, pos, tk FROM s JOIN tk ON tk.response_id = s.response_id AND e - length(tk) < x.e AND e > x.s)
"""


_AS_IS, _NO_SPACE = "{0}", r"regexp_replace({0}, '\s', '', 'g')"


def _align(spark, sf, strip_ws=False):
    return TK.token_align(A.responses_v(spark, sf), ["function_id", "response_id"], strip_ws=strip_ws)


@query("token_align", _aligned_sql(_AS_IS) + "SELECT response_id, test_idx, section, pos FROM aligned")
def q_token_align(spark, sf):
    return TK.aligned_tokens(_align(spark, sf), ["response_id", "test_idx"]).drop("token")


@query("token_align_ws", _aligned_sql(_NO_SPACE) + "SELECT response_id, test_idx, section, pos FROM aligned")
def q_token_align_ws(spark, sf):
    return TK.aligned_tokens(_align(spark, sf, True), ["response_id", "test_idx"]).drop("token")


@query("drop_untokenized", _aligned_sql(_AS_IS) + """
SELECT function_id, test_idx FROM response_tests_v SEMI JOIN aligned USING (test_idx)""")
def q_drop_untokenized(spark, sf):
    from ..operators import filters as FL
    tests = A.responses_v(spark, sf).select("function_id", F.inline("tests"))
    tokens = TK.aligned_tokens(_align(spark, sf), ["function_id", "test_idx"])
    return FL.drop_untokenized(tests, tokens, ("function_id", "test_idx"), "function_id").select("function_id", "test_idx")
