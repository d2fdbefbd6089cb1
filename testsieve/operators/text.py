"""Text extraction over generation corpora: projections and
generators over whole texts, all JVM-side regex / higher-order functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def extract_code_blocks(df: DataFrame, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """One row per fenced python block, stripped, with its position."""
    return df.select(*keep, F.posexplode(T.code_blocks(F.col(text))).alias("block_idx", "block"))


def first_code_block(df: DataFrame, text: str = "text", out: str = "code", or_null: bool = False) -> DataFrame:
    f = T.first_code_block_or_null if or_null else T.first_code_block
    return df.withColumn(out, f(F.col(text)))


def assertion_lines(df: DataFrame, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Lines holding ``assert``, stripped, with their line number."""
    lines = df.select(*keep, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    return lines.filter(F.col("line").contains("assert")).withColumn("line", T.strip_ws(F.col("line")))


def split_on_assert(df: DataFrame, text: str = "text", entry_point: str = "entry_point",
                    keep: Sequence[str] = ()) -> DataFrame:
    """'assert ' + content split on 'assert '; parts naming the entry point,
    each re-prefixed, stripped and cut at the first stop marker."""
    parts = F.split(F.concat(F.lit("assert "), F.col(text)), "assert ")
    kept = F.filter(parts, lambda p: p.contains(F.col(entry_point)) & (F.length(T.strip_ws(p)) > 0))
    cases = F.transform(kept, lambda p: T.strip_ws(T.truncate_at_stop(T.strip_ws(F.concat(F.lit("assert "), p)))))
    return df.select(*keep, F.posexplode(cases).alias("case_idx", "test"))


def split_candidate_asserts(df: DataFrame, text: str = "test", keep: Sequence[str] = ()) -> DataFrame:
    """A check body split at 'assert candidate': one row per assertion, prefix restored."""
    parts = F.split(F.col(text), "assert candidate")
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return df.select(*keep, F.posexplode(F.transform(rest, lambda p: F.concat(F.lit("assert candidate"), p)))
                     .alias("case_idx", "test"))


def tagged_content(df: DataFrame, text: str = "text", out: str = "code") -> DataFrame:
    """Content of the first <code>…</code>, stripped, without lines calling load_data(); '' if none."""
    inner = T.strip_ws(F.regexp_extract(F.col(text), T.CODE_TAGS, 1))
    kept = T.strip_ws(T.keep_lines(inner, lambda l: ~l.contains("load_data()")))
    return df.withColumn(out, F.when(F.col(text).rlike(T.CODE_TAGS), kept).otherwise(F.lit("")))


def import_statements(df: DataFrame, text: str = "text") -> DataFrame:
    """Distinct import lines across the corpus plus the fixed tail list."""
    found = F.concat(F.regexp_extract_all(F.col(text), F.lit(T.IMPORT_PLAIN), 0),
                     F.regexp_extract_all(F.col(text), F.lit(T.IMPORT_FROM), 0),
                     F.array(*[F.lit(s) for s in T.IMPORT_TAIL]))
    return df.select(F.explode(found).alias("import_line")).distinct()


def doc_io_pairs(df: DataFrame, text: str = "text", name: str = "function_name",
                 keep: Sequence[str] = ()) -> DataFrame:
    """Zip **Input:** / **Output:** sections into 'assert name(in) == out' (backslashes removed)."""
    ins = F.regexp_extract_all(F.col(text), F.lit(T.INPUT_SECTION), 1)
    outs = F.regexp_extract_all(F.col(text), F.lit(T.OUTPUT_SECTION), 1)

    def fix(c):
        s = T.strip_ws(c)
        return F.when(s.endswith(' "'), F.concat(F.substring(s, 1, F.length(s) - 2), F.lit('"'))).otherwise(s)

    n = F.least(F.size(ins), F.size(outs))
    pairs = F.transform(F.sequence(F.lit(1), n), lambda i: F.replace(F.concat(
        F.lit("assert "), F.col(name), F.lit("("), fix(F.element_at(ins, i)), F.lit(") == "), fix(F.element_at(outs, i))),
        F.lit("\\"), F.lit("")))
    pairs = F.when(n > 0, pairs).otherwise(F.array().cast("array<string>"))
    return df.select(*keep, F.posexplode(pairs).alias("case_idx", "test"))


def strip_comments_blank(df: DataFrame, text: str = "code", out: str = "clean") -> DataFrame:
    """Remove triple-quoted text, blank lines and lines starting with '#'."""
    no_doc = F.regexp_replace(F.col(text), T.TRIPLE_QUOTED, "")
    kept = T.keep_lines(no_doc, lambda l: (F.length(T.strip_ws(l)) > 0) & ~T.strip_ws(l).startswith("#"))
    return df.withColumn(out, kept)


def rename_function(df: DataFrame, code: str = "code", expected: str = "expected_name", out: str = "fixed") -> DataFrame:
    """Rename the first ``def`` whose name differs from the expected one."""
    lines = F.split(F.col(code), "\n")
    st = lambda l: T.strip_ws(l)
    name_of = lambda l: F.substring(st(l), 5, F.locate("(", st(l)) - 5)
    is_def = lambda l: st(l).startswith("def ") & st(l).contains("(")
    idx = F.get(F.filter(F.transform(lines, lambda l, i: F.when(is_def(l) & (name_of(l) != F.col(expected)), i)),
                         lambda i: i.isNotNull()), 0)
    fixed = F.array_join(F.transform(lines, lambda l, i: F.when(i == idx, F.replace(
        l, F.concat(F.lit("def "), name_of(l), F.lit("(")), F.concat(F.lit("def "), F.col(expected), F.lit("(")))
    ).otherwise(l)), "\n")
    skip = F.col(expected).isNull() | (F.col(expected) == "") | ~F.col(code).contains("def ") | idx.isNull()
    return df.withColumn(out, F.when(skip, F.col(code)).otherwise(fixed))


def prepend_header(df: DataFrame, blocks: str = "blocks", out: str = "solution") -> DataFrame:
    """Fixed import header + the sample's code blocks joined by newlines."""
    return df.withColumn(out, F.concat(F.lit(T.IMPORT_HEADER), F.array_join(F.col(blocks), "\n")))
