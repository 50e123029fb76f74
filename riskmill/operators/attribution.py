"""Contribution tables: exact linear attribution, global importance, and reason codes for the alert queue."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskmill.functions.features import FEATURES
from riskmill.functions.numeric import ratio
from riskmill.operators.scaling import Fitted
from riskmill.params import MAX_EXPLAINED_ALERTS, REASONS_PER_ALERT, ZERO_ATTRIBUTION

PREFIX = "c_"


def linear_contributions(rows: DataFrame, coefficients: Mapping[str, float], fitted: Fitted,
                         names: Sequence[str] = FEATURES) -> DataFrame:
    """Adds one ``c_<feature>`` column per feature: coefficient times the scaled value.

    For a linear model on standardized features these are the exact attributions: with the training mean as the
    base they add up to the margin minus the intercept.
    """
    made = [
        (F.lit(float(coefficients.get(name, 0.0))) * ((F.col(name) - fitted[name]["mean"]) / fitted[name]["scale"]))
        .alias(PREFIX + name) for name in names
    ]
    return rows.select("*", *made)


def margin(intercept: float, names: Sequence[str] = FEATURES) -> Column:
    total = F.lit(float(intercept))
    for name in names:
        total = total + F.col(PREFIX + name)
    return total


def probability(log_odds: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-log_odds))


def long_contributions(rows: DataFrame, keep: Sequence[str] = ("row_id",),
                       names: Sequence[str] = FEATURES) -> DataFrame:
    """(row, feature, contribution, value), one row per feature."""
    entries = [F.struct(F.lit(name).alias("feature"), F.col(PREFIX + name).alias("contribution"),
                        F.col(name).cast("double").alias("value")) for name in names]
    return rows.select(*keep, F.inline(F.array(*entries)))


def global_importance(rows: DataFrame, names: Sequence[str] = FEATURES, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute and mean signed contribution, share of the total, and rank; one wide aggregate."""
    wide = rows.groupBy(*by).agg(*[
        F.struct(F.avg(F.abs(PREFIX + name)).alias("a"), F.avg(PREFIX + name).alias("s")).alias(name)
        for name in names
    ])
    entries = [F.struct(F.lit(name).alias("feature"), F.col(f"{name}.a").alias("mean_abs"),
                        F.col(f"{name}.s").alias("mean_signed")) for name in names]
    whole = Window.partitionBy(*by)
    return wide.select(*by, F.inline(F.array(*entries))).select(
        *by, "feature", "mean_abs", "mean_signed",
        ratio(F.col("mean_abs"), F.sum("mean_abs").over(whole)).alias("share_of_total"),
        F.row_number().over(whole.orderBy(F.desc("mean_abs"), "feature")).cast("bigint").alias("rank"),
    )


def inert_features(importance: DataFrame, tolerance: float = ZERO_ATTRIBUTION) -> DataFrame:
    return importance.where(F.col("mean_abs") <= tolerance)


def alert_queue(scored: DataFrame, flagged: Column, max_alerts: int = MAX_EXPLAINED_ALERTS) -> DataFrame:
    """The highest-scoring flagged rows, numbered; a top-k report, so the limit is the feature."""
    top = scored.where(flagged).orderBy(F.desc("score"), "row_id").limit(max_alerts)
    return top.withColumn("alert_rank", F.row_number().over(Window.orderBy(F.desc("score"), "row_id")).cast("bigint"))


def top_reasons(names: Sequence[str] = FEATURES, count: int = REASONS_PER_ALERT) -> Column:
    """The row's strongest contributions as an array of (feature, contribution, value); ties in feature order."""
    ordered = F.array(*[
        F.struct((-F.abs(PREFIX + name)).alias("order"), F.lit(place).alias("place"), F.lit(name).alias("feature"),
                 F.col(PREFIX + name).alias("contribution"), F.col(name).cast("double").alias("value"))
        for place, name in enumerate(names)
    ])
    best = F.slice(F.sort_array(ordered), 1, count)
    return F.arrays_zip(*[best[field].alias(field) for field in ("feature", "contribution", "value")])


def explain_alerts(alerts: DataFrame, names: Sequence[str] = FEATURES, count: int = REASONS_PER_ALERT) -> DataFrame:
    """One row per alert and reason."""
    return alerts.select(
        "alert_rank", "row_id", "score", "is_fraud", F.posexplode(top_reasons(names, count)).alias("at", "reason"),
    ).select(
        "alert_rank", "row_id", "score", "is_fraud", (F.col("at") + 1).cast("bigint").alias("reason_rank"),
        "reason.feature", "reason.value", "reason.contribution",
    )
