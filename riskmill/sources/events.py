"""Adapter that reads the ``events`` table as a payment ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Event type -> transaction type, and the hour that counts as step 0.
EVENT_KINDS = {
    "signup": "CASH_IN",
    "purchase": "CASH_OUT",
    "error": "DEBIT",
    "view": "PAYMENT",
    "click": "TRANSFER",
}
EPOCH = "2024-01-01 00:00:00"


def ledger_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_ledger(spark.read.parquet(f"{sf_dir}/events.parquet"))


def as_ledger(events: DataFrame) -> DataFrame:
    """A projection only: column pruning and filters pass through it down to the scan."""
    kind = F.lit(None).cast("string")
    for event, transaction in EVENT_KINDS.items():
        kind = F.when(F.col("event_type") == event, transaction).otherwise(kind)
    prefix = F.when(F.col("user_id") % 5 == 0, "M").otherwise("C")
    residue = F.col("event_id") % 4
    opening = F.when(residue == 0, F.col("value")).when(residue == 1, F.lit(0.0)).otherwise(F.col("value") * 2)
    labelled = kind.isin("TRANSFER", "CASH_OUT") & (F.col("event_id") % 13 == 0)
    return events.select(
        F.col("event_id").alias("row_id"),
        F.expr(f"timestampdiff(HOUR, TIMESTAMP_NTZ'{EPOCH}', ts)").cast("bigint").alias("step"),
        kind.alias("type"),
        F.col("value").alias("amount"),
        F.concat(F.lit("C"), (F.col("event_id") + 100000).cast("string")).alias("nameOrig"),
        opening.alias("oldbalanceOrg"),
        F.greatest(opening - F.col("value"), F.lit(0.0)).alias("newbalanceOrig"),
        F.concat(prefix, F.col("user_id").cast("string")).alias("nameDest"),
        (F.col("user_id") * F.lit(10.0)).alias("oldbalanceDest"),
        (F.col("user_id") * F.lit(10.0) + F.col("value")).alias("newbalanceDest"),
        labelled.cast("int").alias("isFraud"),
        F.lit(0).alias("isFlaggedFraud"),
    )


def fixture_score(multiplier: int = 48271, lift: int = 700) -> Column:
    """Deterministic score with many ties, higher for labelled rows; stands in for a model's output."""
    noise = (F.col("row_id") * multiplier) % 997
    return (noise + F.when(F.col("isFraud") == 1, lift).otherwise(0)) / F.lit(997.0 + lift)


def scored_ledger(ledger: DataFrame) -> DataFrame:
    return ledger.select("row_id", "step", "amount", F.col("isFraud").alias("is_fraud"),
                         fixture_score().alias("score"))
