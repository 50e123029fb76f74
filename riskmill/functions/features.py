"""Stateless features and the canonical feature order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskmill.functions.numeric import flag

# Feature names and their order in a feature vector.
BASE_FEATURES = (
    "amount", "hour_of_day", "is_night",
    "orig_balance_delta", "dest_balance_delta", "orig_balance_mismatch",
    "orig_emptied", "amount_to_balance_ratio", "dest_is_merchant",
)
TYPE_FEATURES = ("is_transfer", "is_cash_out", "is_cash_in", "is_debit")
DESTINATION_FEATURES = (
    "dest_prior_txn_count", "dest_prior_avg_amount", "dest_amount_to_prior_avg_ratio",
    "dest_txn_count_24h", "dest_amount_sum_24h",
)
FEATURES = BASE_FEATURES + TYPE_FEATURES + DESTINATION_FEATURES
FEATURE_VERSION = 3

MERCHANT_PREFIX = "M"
BALANCE_TOLERANCE = 0.01


def is_merchant(name: Column | str) -> Column:
    return (F.col(name) if isinstance(name, str) else name).startswith(MERCHANT_PREFIX)


def stateless_features() -> dict[str, Column]:
    """The thirteen features that need nothing but the row itself."""
    hour = F.col("step") % 24
    sent = F.col("oldbalanceOrg") - F.col("newbalanceOrig")
    kinds = {"is_transfer": "TRANSFER", "is_cash_out": "CASH_OUT", "is_cash_in": "CASH_IN", "is_debit": "DEBIT"}
    return {
        "amount": F.col("amount"),
        "hour_of_day": hour.cast("int"),
        "is_night": flag(hour.between(0, 5)),
        "orig_balance_delta": sent,
        "dest_balance_delta": F.col("newbalanceDest") - F.col("oldbalanceDest"),
        "orig_balance_mismatch": flag(F.abs(sent - F.col("amount")) > BALANCE_TOLERANCE),
        "orig_emptied": flag((F.col("oldbalanceOrg") > 0) & (F.col("newbalanceOrig") == 0)),
        "amount_to_balance_ratio": F.col("amount") / (F.col("oldbalanceOrg") + 1),
        "dest_is_merchant": flag(is_merchant("nameDest")),
        **{name: flag(F.col("type") == kind) for name, kind in kinds.items()},
    }


def amount_to_average(amount: Column, average: Column) -> Column:
    """How unusual the amount is for its destination; with no history it is the amount itself."""
    return amount / (average + 1)


def feature_vector(names: Sequence[str] = FEATURES) -> Column:
    """Features as one array in canonical order."""
    return F.array(*[F.col(name).cast("double") for name in names])
