"""Column expressions over text (JVM regex; only constructs shared by Java
and RE2 so that the SQL oracle can use the same patterns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for equal results.
PY_BLOCK = r"(?s)```python\s*(.*?)```"          # fenced python block, DOTALL, stripped after
PY_BLOCK_RAW = r"(?s)```python(.*?)```"          # first-block variant, content kept as is
DEF_NAME = r"def\s+(\w+)\s*\("                   # first function name
DEF_NAME_STRICT = r"def\s+([a-zA-Z_]\w*)\s*\("   # name variant that skips __init__
DEF_SIGNATURE = r"def\s+[a-zA-Z_][a-zA-Z0-9_]*\s*\([^)]*\)"
STOP_MARKERS = r"(?s)\n(class|def|#|if|print).*"  # cut at the first \nclass \ndef \n# \nif \nprint
IMPORT_PLAIN = r"(?m)^\s*import\s+[a-zA-Z_][a-zA-Z0-9_]*(?:\s+as\s+[a-zA-Z_][a-zA-Z0-9_]*)?"
IMPORT_FROM = r"(?m)^\s*from\s+[a-zA-Z_][a-zA-Z0-9_]*\s+import\s+[a-zA-Z_][a-zA-Z0-9_]*"
IMPORT_TAIL = ["import matplotlib as plt", "import numpy as np", "import pandas as pd"]
FIVE_STARS = r"(?s)\*{5}(.*?)\*{5}"
CODE_TAGS = r"(?s)<code>(.*?)</code>"
INPUT_SECTION = r"(?s)\*\*Input:\*\*(.*?)\*\*Output:\*\*"
OUTPUT_SECTION = r"(?s)\*\*Output:\*\*(.*?)\*\*"
TRIPLE_QUOTED = "(\"\"\"[\\s\\S]*?\"\"\"|'''[\\s\\S]*?''')"
CAMEL_BOUNDARY = r"([a-z])([A-Z])"
IMPORT_HEADER = ("from typing import *\nimport math\nfrom heapq import *\nimport itertools\nimport re\n"
                 "import typing\nimport heapq\n_str=str\nimport re\n")


# the ASCII whitespace of a regex \s: space, tab, newline, vertical tab, form feed, carriage return
WHITESPACE = " \t\n\x0b\f\r"


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()`` for ASCII whitespace — a character trim, no regex."""
    return F.btrim(c, F.lit(WHITESPACE))


def code_blocks(text: Column) -> Column:
    """array<string>: every fenced python block, stripped, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(PY_BLOCK), 1), strip_ws)


def first_code_block(text: Column) -> Column:
    """First fenced python block (raw content), else the text itself."""
    return F.coalesce(F.get(F.regexp_extract_all(text, F.lit(PY_BLOCK_RAW), 1), 0), text)


def first_code_block_or_null(text: Column) -> Column:
    return F.get(F.regexp_extract_all(text, F.lit(PY_BLOCK_RAW), 1), 0)


def function_name(code: Column) -> Column:
    """First ``def name(``; NULL when absent."""
    return F.get(F.regexp_extract_all(code, F.lit(DEF_NAME), 1), 0)


def function_name_not_init(code: Column) -> Column:
    return F.get(F.filter(F.regexp_extract_all(code, F.lit(DEF_NAME_STRICT), 1), lambda n: ~n.contains("__init__")), 0)


def function_signature(code: Column) -> Column:
    return F.get(F.regexp_extract_all(code, F.lit(DEF_SIGNATURE), 0), 0)


def between_markers(text: Column) -> Column:
    """Text between the first two ``*****`` markers, stripped; '' when a marker is missing."""
    return strip_ws(F.regexp_extract(text, FIVE_STARS, 1))


def truncate_at_stop(text: Column) -> Column:
    return F.regexp_replace(text, STOP_MARKERS, "")


def camel_to_snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, CAMEL_BOUNDARY, "$1_$2"))


def normalize_key(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit("_"), F.lit(""))


def squash_ws(text: Column) -> Column:
    """Text without spaces and newlines (revision comparison); ``translate``
    deletes the characters without a regex engine."""
    return F.translate(text, " \n", "")


def keep_lines(text: Column, pred) -> Column:
    """Lines of ``text`` (split on newline) for which ``pred(line)`` holds, joined by newline."""
    return F.array_join(F.filter(F.split(text, "\n"), pred), "\n")
