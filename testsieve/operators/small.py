"""Bounded side tables.

A model fitted on aggregates (fold moments, class priors) has a size fixed by
its parameters — k folds x classes rows — not by the data.  ``bounded_rows``
reads such a table once and checks the bound."""

from __future__ import annotations

from pyspark.sql import DataFrame


def bounded_rows(df: DataFrame, max_rows: int, what: str = "table") -> list:
    """The rows of a table whose size is fixed by parameters; fails instead of
    pulling an unbounded table to the driver."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what}: more than {max_rows} rows; not a bounded side table")
    return rows
