"""Registry of the queries (one per operator of SURVEY §2) and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``key``; ``sql`` is the
    DuckDB oracle (omitted for operators that SQL cannot express)."""

    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return deco


def r6(df: DataFrame) -> DataFrame:
    """Round double columns to 6 decimals so the two engines hash equal."""
    return df.select(*[F.round(F.col(f.name), 6).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType))
                       else F.col(f.name) for f in df.schema.fields])


def load_all() -> None:
    """Import every ``q_*`` module of this package; importing registers."""
    import importlib
    import pkgutil

    from . import __path__ as pkg_path
    for m in sorted(pkgutil.iter_modules(pkg_path), key=lambda m: m.name):
        if m.name.startswith("q_"):
            importlib.import_module(f"{__package__}.{m.name}")
