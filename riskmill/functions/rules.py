"""Hard-block rules and the decision expression.

A rule is a (name, boolean Column) pair; callers extend the list with their own Columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskmill.params import HARD_BLOCK_AMOUNT

Rule = tuple[str, Column]


def full_balance_sweep(limit: float = HARD_BLOCK_AMOUNT) -> Rule:
    """A large transfer or cash-out that leaves the origin account empty."""
    moves_out = (F.col("is_transfer") == 1) | (F.col("is_cash_out") == 1)
    condition = moves_out & (F.col("orig_emptied") == 1) & (F.col("amount") >= limit)
    return "full_balance_sweep_large_amount", condition


def default_rules(limit: float = HARD_BLOCK_AMOUNT) -> list[Rule]:
    return [full_balance_sweep(limit)]


def first_matching_rule(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that holds, NULL when none does."""
    if not rules:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(condition, F.lit(name)) for name, condition in rules])


def decision(rule: Column, flagged: Column) -> Column:
    """BLOCK when a rule fired, else REVIEW when the model flagged the row, else PASS."""
    return F.when(rule.isNotNull(), "BLOCK").when(flagged, "REVIEW").otherwise("PASS")
