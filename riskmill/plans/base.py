"""Inputs shared by the registered queries, all derived from the ``events`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmill.lineage import ensure_checkpoint_dir
from riskmill.operators.decisions import score_linear
from riskmill.operators.folds import fitted_cuts, fold_part, time_folds
from riskmill.operators.history import build_features
from riskmill.operators.metrics import capacity_sweep
from riskmill.operators.scaling import Fitted, fit_scaler, fitted_values
from riskmill.params import FOLD_BOUNDARIES, SEED
from riskmill.sources import sinks
from riskmill.sources.events import ledger_from_events, scored_ledger

# Business parameters at this table's scale: a few hundred rows per day and amounts of two or three digits.
REVIEWS_GRID = (5, 10, 20, 50, 100, 200)
REVIEWS_PER_DAY = 10
LOW_REVIEWS, HIGH_REVIEWS = 10, 50
COST_PER_REVIEW = 2.0
TICKETS = (1, 5, 10, 25, 50, 100, 250, 500, 1000)
HARD_BLOCK_AMOUNT = 200.0
BATCH_ROWS = 1000
FOLDS = len(FOLD_BOUNDARIES) - 1
SAMPLE_SEED = SEED

# Three fixture models: (name, multiplier, lift) of the deterministic score.
MODELS = (("alpha", 48271, 700), ("beta", 69621, 500), ("gamma", 16807, 300))

# A logistic model given as numbers, on standardized features.
COEFFICIENTS = {
    "amount": 0.35, "hour_of_day": -0.05, "is_night": 0.1, "orig_balance_delta": 0.2, "dest_balance_delta": 0.0,
    "orig_balance_mismatch": -0.15, "orig_emptied": 0.8, "amount_to_balance_ratio": 0.1, "dest_is_merchant": -0.4,
    "is_transfer": 0.9, "is_cash_out": 0.7, "is_cash_in": -0.3, "is_debit": -0.3,
    "dest_prior_txn_count": 0.05, "dest_prior_avg_amount": -0.1, "dest_amount_to_prior_avg_ratio": 0.45,
    "dest_txn_count_24h": 0.15, "dest_amount_sum_24h": 0.25,
}
INTERCEPT = -2.0
DECISION_THRESHOLD = 0.3
# Means of cents end in a half of the sixth digit, so that the order of a sum would decide there; not at the eighth.
SCALER_DIGITS = 8
SCORE_DIGITS = 9


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_from_events(spark, sf_dir)


def faulty_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with contract violations worked in, for the validation operators."""
    key = F.col("row_id")
    return ledger(spark, sf_dir).withColumns({
        "amount": F.col("amount") - 1.0,
        "type": F.when(key % 97 == 0, "UNKNOWN").otherwise(F.col("type")),
        "nameDest": F.when(key % 101 == 0, F.lit(None)).otherwise(F.col("nameDest")),
        "nameOrig": F.when(key % 103 == 0, "").otherwise(F.col("nameOrig")),
        "isFraud": F.when(key % 89 == 0, 2).otherwise(F.col("isFraud")),
        "batch_id": F.floor(key / 100).cast("bigint"),
    })


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_features(ledger(spark, sf_dir))


def stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table, built once for these files and read from then on by every query of the application."""
    return sinks.materialize(spark, f"{sf_dir}/events.parquet", _stored(spark, "features"), lambda: features(spark, sf_dir))[0]


def _stored(spark: SparkSession, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stored-{name}"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_ledger(ledger(spark, sf_dir))


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capacity_sweep(scored(spark, sf_dir), REVIEWS_GRID)


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_folds(ledger(spark, sf_dir))


def folded_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_folds(ledger(spark, sf_dir), rows=stored_features(spark, sf_dir))


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, fold, row_id, step, amount, is_fraud, score) over the test part of every fold."""
    variants = F.explode(F.array(*[
        F.struct(F.lit(name).alias("model"), _score(mult, lift).alias("score")) for name, mult, lift in MODELS]))
    return folded(spark, sf_dir).where("role = 'test'").withColumn("v", variants).select(
        F.col("v.model").alias("model"), "fold", "row_id", "step", "amount",
        F.col("isFraud").alias("is_fraud"), F.col("v.score").alias("score"))


def _score(multiplier: int, lift: int) -> Column:
    raised = F.when(F.col("isFraud") == 1, lift).otherwise(0)
    return ((F.col("row_id") * multiplier) % 997 + raised) / F.lit(997.0 + lift)


def final_part(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    """Features of the last fold's train or test rows."""
    return fold_part(stored_features(spark, sf_dir), fitted_cuts(ledger(spark, sf_dir)), FOLDS, role)


def final_scaler(spark: SparkSession, sf_dir: str) -> Fitted:
    """Fitted on the last fold's training rows, and stored like the features."""
    table, _ = sinks.materialize(spark, f"{sf_dir}/events.parquet", _stored(spark, "scaler"),
                                 lambda: fit_scaler(final_part(spark, sf_dir, "train"), digits=SCALER_DIGITS))
    return fitted_values(table)


def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of every row with contributions, score, flag and reasons of the numeric model."""
    made = score_linear(stored_features(spark, sf_dir), COEFFICIENTS, INTERCEPT, final_scaler(spark, sf_dir),
                        DECISION_THRESHOLD, SCORE_DIGITS)
    return made.withColumn("is_fraud", F.col("isFraud"))


def rounded(frame: DataFrame, names: tuple[str, ...] | list[str], digits: int = 6) -> DataFrame:
    """Round order-dependent doubles for comparison between engines."""
    return frame.withColumns({name: F.round(F.col(name), digits) for name in names})
