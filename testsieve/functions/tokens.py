"""Column expressions over token records."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's: tokens made only of these
# pieces carry no signal and are dropped by the punctuation filter
# (``==``, space, comma, square brackets, quotes, parentheses, newline).
PUNCT_ONLY = r"\A(==|[ ,\[\]'\"()\n])*\z"
HAS_DIGIT = r"\d"


def entropy(top: Column, base: float = 2.0) -> Column:
    """-sum p*log_base(p) over the top-k alternatives, p = exp(logprob).
    Not renormalised; p <= 0 skipped (as in the reference)."""
    ln_base = math.log(base)
    return F.aggregate(
        top, F.lit(0.0),
        lambda acc, x: acc - F.when(F.exp(x["logprob"]) > 0,
                                    F.exp(x["logprob"]) * x["logprob"] / ln_base).otherwise(F.lit(0.0)),
    )


def prob_percent(logprob: Column) -> Column:
    """Chosen-token probability in percent, rounded half-even to 2 decimals."""
    return F.bround(F.exp(logprob) * 100.0, 2)


def is_signal_token(token: Column) -> Column:
    """False for tokens made only of punctuation (or empty)."""
    return ~F.coalesce(token, F.lit("")).rlike(PUNCT_ONLY)


def has_digit(token: Column) -> Column:
    return F.coalesce(token, F.lit("")).rlike(HAS_DIGIT)
