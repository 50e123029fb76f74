"""Column arithmetic that turns staffing and elapsed time into a queue length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmill.params import STEPS_PER_DAY


def days_between(first: Column, last: Column) -> Column:
    """Inclusive length of a step range in days; zero for an empty range."""
    return F.coalesce((last - first + 1) / F.lit(float(STEPS_PER_DAY)), F.lit(0.0))


def capacity_k(days: Column, reviews_per_day: Column, rows: Column) -> Column:
    """Reviews the team can do in the window, rounded half to even and kept within [1, rows]."""
    wanted = F.bround(reviews_per_day * days).cast("bigint")
    return F.least(F.greatest(wanted, F.lit(1)), rows)


def window_length(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return rows.groupBy(*by).agg(
        days_between(F.min("step"), F.max("step")).alias("window_days"), F.count("*").alias("n_rows"))
