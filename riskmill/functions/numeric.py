"""Arithmetic helpers with one convention: undefined results are NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Money is summed as a decimal, so a total does not depend on the order in which rows reach a task.
EXACT = "decimal(28,6)"


def exact(amount: Column | str) -> Column:
    """The amount as a decimal with six fractional digits."""
    return (F.col(amount) if isinstance(amount, str) else amount).cast(EXACT)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division that is NULL for a zero denominator (ANSI mode would raise)."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def flag(condition: Column) -> Column:
    return condition.cast("tinyint")


def count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def sum_or_zero(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast("double")
