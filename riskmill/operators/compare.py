"""Summaries across folds and model selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Which metrics get a mean only and which also a deviation.
MEAN_AND_SPREAD = ("pr_auc", "precision_at_k", "recall_at_k", "capacity_precision", "capacity_recall")
MEAN_ONLY = ("roc_auc", "weighted_bce")


def _summary(names: tuple[str, ...], spread: bool) -> list[Column]:
    columns = []
    for name in names:
        columns.append(F.avg(name).alias(f"{name}_mean"))
        if spread:
            columns.append(F.stddev_samp(name).alias(f"{name}_std"))
    return columns


def compare_models(results: DataFrame) -> DataFrame:
    """Mean and sample deviation over folds per model, best capacity precision first."""
    return results.groupBy("model").agg(
        *_summary(MEAN_AND_SPREAD, True), *_summary(MEAN_ONLY, False), F.count("fold").alias("n_folds"),
    ).orderBy(F.desc("capacity_precision_mean"), "model")


def summarize_curves(curves: DataFrame) -> DataFrame:
    return curves.groupBy("model", "k_multiplier").agg(*_summary(("precision_at_k", "recall_at_k"), True))


def select_model(results: DataFrame, curves: DataFrame) -> DataFrame:
    """The model with the best mean capacity precision, and the leaders on the two other criteria.

    Equal means are decided by name, the smaller one first.
    """
    def leader(frame: DataFrame, metric: str) -> Column:
        means = frame.groupBy("model").agg(F.avg(metric).alias("mean"))
        best = means.agg(F.min(F.struct((-F.col("mean")).alias("order"), F.col("model"))).alias("best"))
        return best.select("best.model").scalar()

    first = curves.where(F.col("k_multiplier") == 1)
    capacity = leader(results, "capacity_precision")
    summary = results.where(F.col("model") == capacity).groupBy("model").agg(
        F.avg("capacity_precision").alias("capacity_precision_mean"),
        F.stddev_samp("capacity_precision").alias("capacity_precision_std"),
    )
    return summary.select(
        F.col("model").alias("best_model"), "capacity_precision_mean", "capacity_precision_std",
        leader(results, "pr_auc").alias("pr_auc_leader"), leader(first, "precision_at_k").alias("k1_leader"),
    ).withColumn("pr_auc_disagrees", F.col("pr_auc_leader") != F.col("best_model")) \
     .withColumn("k1_disagrees", F.col("k1_leader") != F.col("best_model"))


def mean_fraud_amount(rows: DataFrame, label: str = "is_fraud") -> DataFrame:
    return rows.where(F.col(label) == 1).agg(
        (F.sum(F.col("amount").cast("decimal(28,6)")).cast("double") / F.nullif(F.count("*"), F.lit(0)))
        .alias("avg_fraud_amount"), F.count("*").alias("n_fraud"))
