"""Small statistics over bounded arrays and aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 6


def r6(column: Column | str) -> Column:
    """Output rounding; removes the noise of unordered floating sums."""
    return F.round(column, DIGITS)


def stable_mean(column: Column | str) -> Column:
    """Mean cut to 9 decimals, so that it does not depend on summation order."""
    return F.round(F.avg(column), 9)


def tail_rise(values: Column) -> Column:
    """Strict rises counted back from the end of a short array until the first
    step that does not rise."""
    n = F.size(values)
    last_break = F.array_max(
        F.filter(
            F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
            lambda i: (i < n) & ~(F.get(values, i) > F.get(values, i - 1)),
        )
    )
    return F.when(n < 2, F.lit(0)).otherwise(n - 1 - F.coalesce(last_break, F.lit(0))).cast("bigint")


def slope(value: Column | str, index: Column | str) -> Column:
    """Least-squares slope of value against index, 0 for fewer than two points."""
    return F.coalesce(F.regr_slope(value, index), F.lit(0.0))
