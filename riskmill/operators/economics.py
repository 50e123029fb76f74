"""Net value of review capacity. Inputs are sweep rows; every function takes optional group columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskmill.functions.numeric import ratio
from riskmill.params import (
    COST_PER_REVIEW,
    LIABILITY_RATE,
    RECOVERY_GRID,
    RECOVERY_RATE,
    SATURATED_RECALL,
    TICKET_GRID,
)

SWEEP = ("reviews_per_day", "k", "n_flagged", "true_positives", "false_positives", "false_negatives",
         "precision", "recall")


def net_value(amount: Column, cost: Column | float = COST_PER_REVIEW, recovery: Column | float = RECOVERY_RATE,
              liability: Column | float = LIABILITY_RATE) -> Column:
    """Recovered fraud, less the cost of reviews, less the liability for missed fraud."""
    def column(value: Column | float) -> Column:
        return value if isinstance(value, Column) else F.lit(float(value))

    return (F.col("true_positives") * amount * column(recovery)
            - F.col("n_flagged") * column(cost)
            - F.col("false_negatives") * amount * column(liability))


def net_value_curve(sweep: DataFrame, amount: Column, by: Sequence[str] = (), cost: float = COST_PER_REVIEW,
                    recovery: float = RECOVERY_RATE, liability: float = LIABILITY_RATE) -> DataFrame:
    return sweep.select(*by, *SWEEP, net_value(amount, cost, recovery, liability).alias("net_value")) \
        .orderBy(*by, "reviews_per_day")


def _low_high(sweep: DataFrame, low: float, high: float, by: Sequence[str]) -> DataFrame:
    """The two staffing levels side by side; a missing level leaves NULLs."""
    def at(level: float, name: str) -> Column:
        return F.max(F.when(F.col("reviews_per_day") == level, F.col(name)))

    return sweep.groupBy(*by).agg(
        (at(high, "true_positives") - at(low, "true_positives")).alias("marginal_frauds"),
        (at(high, "n_flagged") - at(low, "n_flagged")).alias("marginal_reviews"),
    )


def _grid(values: Sequence[float]) -> Column:
    return F.explode(F.array(*[F.lit(float(value)) for value in values]))


def break_even_cost(sweep: DataFrame, amount: Column, low: float, high: float, by: Sequence[str] = (),
                    recovery_grid: Sequence[float] = RECOVERY_GRID, liability: float = LIABILITY_RATE) -> DataFrame:
    """Review cost at which staffing up from ``low`` to ``high`` stops paying; NULL when no review is added."""
    swept = _low_high(sweep, low, high, by).withColumn("recovery_rate", _grid(recovery_grid))
    gain = F.col("marginal_frauds") * amount * (F.col("recovery_rate") + F.lit(float(liability)))
    return swept.select(*by, "recovery_rate", F.lit(float(liability)).alias("liability_rate"), "marginal_frauds",
                        "marginal_reviews", ratio(gain, F.col("marginal_reviews")).alias("break_even_cost_per_review"))


def constraint_cost(sweep: DataFrame, amount: Column, low: float, high: float, by: Sequence[str] = ()) -> DataFrame:
    """Fraud missed by staffing ``low`` instead of ``high``, in cases, in money, and per seat."""
    seats = F.lit(float(high - low))
    exposure = F.col("marginal_frauds") * amount
    return _low_high(sweep, low, high, by).select(
        *by, F.lit(float(low)).alias("low_reviews_per_day"), F.lit(float(high)).alias("high_reviews_per_day"),
        F.col("marginal_frauds").alias("frauds_missed_by_constraint"), amount.alias("avg_fraud_amount"),
        exposure.alias("exposure"), seats.alias("marginal_seats"),
        ratio(exposure, seats).alias("exposure_per_marginal_seat"),
    )


def _best(level: str, value: str) -> Column:
    """The highest value's staffing level; equal values go to the lowest level."""
    return F.min(F.struct((-F.col(value)).alias("o"), F.col(level).alias("level"), F.col(value).alias("value")))


def ticket_crossover(sweep: DataFrame, by: Sequence[str] = (), tickets: Sequence[float] = TICKET_GRID,
                     cost: float = COST_PER_REVIEW, recovery: float = RECOVERY_RATE,
                     liability: float = LIABILITY_RATE) -> DataFrame:
    """Recommended staffing per ticket size, and where the recommendation changes."""
    valued = sweep.withColumn("avg_fraud_amount", _grid(tickets))
    valued = valued.withColumn("net_value", net_value(F.col("avg_fraud_amount"), cost, recovery, liability))
    best = valued.groupBy(*by, "avg_fraud_amount").agg(_best("reviews_per_day", "net_value").alias("b")).select(
        *by, "avg_fraud_amount", F.col("b.level").alias("recommended_reviews_per_day"),
        F.col("b.value").alias("net_value_at_recommendation"))
    previous = F.lag("recommended_reviews_per_day").over(Window.partitionBy(*by).orderBy("avg_fraud_amount"))
    return best.withColumn(
        "is_crossover", F.coalesce(F.col("recommended_reviews_per_day") != previous, F.lit(False)))


def saturation(sweep: DataFrame, amount: Column, by: Sequence[str] = (),
               recovery_grid: Sequence[float] = RECOVERY_GRID, cost: float = COST_PER_REVIEW,
               liability: float = LIABILITY_RATE, saturated: float = SATURATED_RECALL) -> DataFrame:
    """Smallest staffing with saturated recall, the optimum per recovery rate, and whether all optima reach it."""
    point = F.min(F.when(F.col("recall") >= saturated, F.col("reviews_per_day"))).over(Window.partitionBy(*by))
    valued = sweep.withColumn("saturation_reviews_per_day", point).withColumn("recovery_rate", _grid(recovery_grid))
    valued = valued.withColumn("net_value", net_value(amount, cost, F.col("recovery_rate"), liability))
    best = valued.groupBy(*by, "recovery_rate").agg(
        F.max("saturation_reviews_per_day").alias("saturation_reviews_per_day"),
        _best("reviews_per_day", "net_value").alias("b"))
    reached = F.coalesce(F.col("b.level") >= F.col("saturation_reviews_per_day"), F.lit(False))
    return best.select(
        *by, "recovery_rate", "saturation_reviews_per_day", F.col("b.level").alias("optimal_reviews_per_day"),
        F.every(reached).over(Window.partitionBy(*by)).alias("always_reaches_saturation"),
    )


def rate_sensitivity(sweep: DataFrame, amount: Column, by: Sequence[str] = (), shift: float = 0.5,
                     cost: float = COST_PER_REVIEW, recovery: float = RECOVERY_RATE,
                     liability: float = LIABILITY_RATE) -> DataFrame:
    """Recommended staffing when one business rate at a time moves by +-``shift``."""
    rates = {"cost": cost, "recovery": recovery, "liability": liability}
    cases = [("base", 1.0, rates)]
    for name in rates:
        for factor in (1 - shift, 1 + shift):
            cases.append((name, factor, {**rates, name: rates[name] * factor}))
    grid = F.explode(F.array(*[
        F.struct(F.lit(name).alias("shifted_rate"), F.lit(float(factor)).alias("factor"),
                 *[F.lit(float(value)).alias(rate) for rate, value in values.items()])
        for name, factor, values in cases
    ]))
    valued = sweep.withColumn("r", grid).withColumn(
        "net_value", net_value(amount, F.col("r.cost"), F.col("r.recovery"), F.col("r.liability")))
    return valued.groupBy(*by, F.col("r.shifted_rate").alias("shifted_rate"), F.col("r.factor").alias("factor")).agg(
        _best("reviews_per_day", "net_value").alias("b"),
    ).select(*by, "shifted_rate", "factor", F.col("b.level").alias("recommended_reviews_per_day"),
             F.col("b.value").alias("net_value"))
