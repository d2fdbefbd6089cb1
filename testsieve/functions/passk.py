"""pass@k estimator as a Column expression (doubles throughout)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_wrong(n: Column, c: Column, k) -> Column:
    """comb(n-c, k) / comb(n, k), the chance that k draws miss every correct
    sample; 0 when n-c < k.  Written as prod_{j<k} (n-c-j)/(n-j): k factors
    (k is a small constant) instead of the c factors of the textbook form,
    so a task with millions of samples costs k multiplications."""
    k_lit = k if isinstance(k, int) else None
    n = n.cast("double")
    c = c.cast("double")
    kk = F.lit(k) if k_lit is not None else k
    prod = F.aggregate(
        F.sequence(F.lit(0), kk - 1),
        F.lit(1.0),
        lambda acc, j: acc * (n - c - j) / (n - j),
    )
    return F.when(n - c < kk, F.lit(0.0)).when(c == 0, F.lit(1.0)).otherwise(prod)


def pass_at_k(n: Column, c: Column, k) -> Column:
    return F.lit(1.0) - all_wrong(n, c, k)
