"""Expanding-window folds over ``step``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmill.functions.numeric import ratio
from riskmill.operators.capacity import capacity_k, days_between
from riskmill.params import FOLD_BOUNDARIES


def step_quantiles(ledger: DataFrame, boundaries: Sequence[float] = FOLD_BOUNDARIES) -> DataFrame:
    """Exact interpolated quantiles of ``step`` as one array.

    Steps are counted first; the quantile then runs over one row per step of the calendar, weighted by its count.
    """
    if len(boundaries) < 2:
        raise ValueError("at least two boundaries are needed for a fold")
    shares = ", ".join(f"{float(b)!r}D" for b in boundaries)
    counted = ledger.groupBy("step").agg(F.count("*").alias("rows"))
    return counted.agg(F.expr(f"percentile(step, array({shares}), rows)").alias("cuts"))


def fold_cuts(ledger: DataFrame, boundaries: Sequence[float] = FOLD_BOUNDARIES) -> DataFrame:
    """One row per boundary: (boundary, cut)."""
    pairs = [F.struct(F.lit(float(b)).alias("boundary"), F.col("cuts")[i].alias("cut"))
             for i, b in enumerate(boundaries)]
    return step_quantiles(ledger, boundaries).select(F.inline(F.array(*pairs)))


def fitted_cuts(ledger: DataFrame, boundaries: Sequence[float] = FOLD_BOUNDARIES) -> list[float]:
    """Compute the cuts now. A handful of numbers, which as literals can be pushed down to the scan."""
    return [float(cut) for cut in step_quantiles(ledger, boundaries).first().cuts]


def assign_folds(rows: DataFrame, cuts: Sequence[float]) -> DataFrame:
    """Each row once per fold it belongs to, with its ``role``: train up to the fold's cut, test in the next block."""
    places = []
    for i in range(len(cuts) - 1):
        role = F.when(F.col("step") <= cuts[i], "train").when(F.col("step") <= cuts[i + 1], "test")
        places.append(F.when(role.isNotNull(), F.struct(F.lit(i + 1).alias("fold"), role.alias("role"))))
    placed = rows.withColumn("_place", F.explode(F.array(*places))).where("_place IS NOT NULL")
    return placed.select(*rows.columns, F.col("_place.fold").alias("fold"), F.col("_place.role").alias("role"))


def fold_part(rows: DataFrame, cuts: Sequence[float], fold: int, role: str) -> DataFrame:
    """One fold's train or test rows as a plain range filter on ``step``."""
    if role == "train":
        return rows.where(F.col("step") <= cuts[fold - 1])
    return rows.where((F.col("step") > cuts[fold - 1]) & (F.col("step") <= cuts[fold]))


def time_folds(ledger: DataFrame, boundaries: Sequence[float] = FOLD_BOUNDARIES,
               rows: DataFrame | None = None) -> DataFrame:
    """Folds of ``rows`` (the ledger itself by default) with cuts taken from the ledger's steps."""
    return assign_folds(ledger if rows is None else rows, fitted_cuts(ledger, boundaries))


def positive_weight(negatives: Column, positives: Column) -> Column:
    return negatives / F.greatest(positives, F.lit(1))


def fold_summary(folded: DataFrame, reviews_per_day: float, label: str = "isFraud") -> DataFrame:
    fraud = F.col("n_fraud")
    return folded.groupBy("fold", "role").agg(
        F.count("*").alias("n_rows"), F.sum(label).cast("bigint").alias("n_fraud"),
        F.min("step").alias("first_step"), F.max("step").alias("last_step"),
    ).select(
        "fold", "role", "n_rows", "n_fraud", "first_step", "last_step",
        days_between(F.col("first_step"), F.col("last_step")).alias("window_days"),
        capacity_k(days_between(F.col("first_step"), F.col("last_step")), F.lit(float(reviews_per_day)),
                   F.col("n_rows")).alias("capacity_k"),
        positive_weight(F.col("n_rows") - fraud, fraud).alias("pos_weight"),
        ratio(fraud, F.col("n_rows")).alias("fraud_rate"),
    )


def class_weight(rows: DataFrame, by: Sequence[str] = (), label: str = "isFraud") -> DataFrame:
    positives = F.sum(label).cast("bigint")
    return rows.groupBy(*by).agg(
        (F.count("*") - positives).alias("n_negative"), positives.alias("n_positive"),
    ).withColumn("pos_weight", positive_weight(F.col("n_negative"), F.col("n_positive")))
