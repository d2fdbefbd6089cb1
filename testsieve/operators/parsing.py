"""Syntax filter: the standard library's parser gives a flag for each row inside Arrow
batches; reasons and counts are Spark aggregations.  Nothing is executed."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType


# ------------------------------------------------------------ syntax filter
def _parses(code: str) -> bool:
    try:
        ast.parse(code)
        return True
    except Exception:  # noqa: BLE001 - any parse failure rejects the test
        return False


def syntax_flags(df: DataFrame, code: str = "test") -> DataFrame:
    """Adds ``parses`` (bool) via the standard parser, Arrow-batched."""
    schema = StructType(list(df.schema.fields) + [StructField("parses", BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.copy()
            pdf["parses"] = [_parses(c) if c is not None else False for c in pdf[code]]
            yield pdf

    return df.mapInPandas(run, schema)


def syntax_quality_filter(df: DataFrame, code: str = "test", name: str = "function_name",
                          task: str = "task_id") -> tuple[DataFrame, DataFrame]:
    """Keep tests that parse and mention the function name.  Returns (kept,
    report) where report counts kept/rejected per task and reason."""
    f = syntax_flags(df, code)
    reason = (F.when(~F.col("parses"), F.lit("syntax"))
              .when(F.col(name).isNotNull() & ~F.col(code).contains(F.col(name)), F.lit("no_function_name"))
              .otherwise(F.lit("kept")))
    f = f.withColumn("reason", reason)
    kept = f.filter(F.col("reason") == "kept").drop("parses", "reason")
    report = f.groupBy(task, "reason").agg(F.count(F.lit(1)).alias("count"))
    return kept, report
