"""Frozen destination state: building it, looking it up, merging it with a batch, and auditing it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskmill.functions.features import FEATURES, amount_to_average, is_merchant, stateless_features
from riskmill.functions.numeric import count_where, exact, sum_or_zero
from riskmill.operators.history import build_features
from riskmill.params import BATCH_MAX_ROWS, VELOCITY_HOURS

STATE_COLUMNS = ("prior_txn_count", "prior_avg_amount", "txn_count_24h", "amount_sum_24h")


def exclude_merchants(ledger: DataFrame) -> DataFrame:
    return ledger.where(~is_merchant("nameDest"))


def destination_snapshot(ledger: DataFrame) -> DataFrame:
    """Whole history per non-merchant destination plus the slice of the last 24 steps.

    The last step is a scalar subquery over all rows; the aggregate combines map-side, so a destination with a
    third of the ledger reaches its reducer as one row per task.
    """
    last = ledger.agg(F.max("step").alias("last")).scalar()
    recent = F.col("step") > F.col("snapshot_step") - VELOCITY_HOURS
    return (
        exclude_merchants(ledger).select("nameDest", "step", "amount", last.alias("snapshot_step"))
        .groupBy(F.col("nameDest").alias("name_dest"))
        .agg(
            F.count("*").alias("prior_txn_count"),
            (F.sum(exact("amount")).cast("double") / F.count("*")).alias("prior_avg_amount"),
            count_where(recent).alias("txn_count_24h"),
            sum_or_zero(F.when(recent, exact("amount"))).alias("amount_sum_24h"),
            F.max("snapshot_step").alias("snapshot_step"),
        )
    )


def _cold(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).alias(name)


def lookup_state(rows: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Attach snapshot state; unknown destinations and merchants get zeros and ``state_hit`` = false.

    The snapshot has one row per destination, so a hot destination only makes the row side large, which
    adaptive execution splits. Whether the snapshot is broadcast is decided from its measured size.
    """
    state = snapshot.select("name_dest", *STATE_COLUMNS)
    joined = rows.join(state, F.col("nameDest") == F.col("name_dest"), "left")
    return joined.select(
        *[rows[name] for name in rows.columns],
        *[_cold(name) for name in STATE_COLUMNS],
        F.col("name_dest").isNotNull().alias("state_hit"),
    )


def state_features(amount: Column | None = None) -> dict[str, Column]:
    """Destination features from resolved state, no window involved."""
    amount = F.col("amount") if amount is None else amount
    return {
        "dest_prior_txn_count": F.col("prior_txn_count").cast("bigint"),
        "dest_prior_avg_amount": F.col("prior_avg_amount"),
        "dest_amount_to_prior_avg_ratio": amount_to_average(amount, F.col("prior_avg_amount")),
        "dest_txn_count_24h": F.col("txn_count_24h").cast("bigint"),
        "dest_amount_sum_24h": F.col("amount_sum_24h"),
    }


def features_from_state(resolved: DataFrame, keep: tuple[str, ...] = ("row_id", "step", "state_hit")) -> DataFrame:
    made = {**stateless_features(), **state_features()}
    return resolved.select(*keep, *[made[name].alias(name) for name in FEATURES])


def with_batches(rows: DataFrame, seq: str = "seq", size: int = BATCH_MAX_ROWS) -> DataFrame:
    """Cut an upload into batches of ``size`` rows by its gap-free position column."""
    return rows.withColumn("batch_id", F.expr(f"`{seq}` DIV {int(size)}"))


def accumulate_in_batch(rows: DataFrame, snapshot: DataFrame, seq: str = "seq") -> DataFrame:
    """Snapshot state merged with the rows submitted earlier in the same batch for the same destination.

    Submission order is trusted as given. A window partition never exceeds one batch.
    """
    earlier = Window.partitionBy("batch_id", "nameDest").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    counted = (
        rows.withColumn("acc_rows", F.count("*").over(earlier))
        .withColumn("acc_total", F.coalesce(F.sum(exact("amount")).over(earlier), F.lit(0)).cast("double"))
    )
    resolved = lookup_state(counted, snapshot)
    merged = F.col("prior_txn_count") + F.col("acc_rows")
    average = F.when(F.col("acc_rows") == 0, F.col("prior_avg_amount")).otherwise(
        (F.col("prior_avg_amount") * F.col("prior_txn_count") + F.col("acc_total")) / F.nullif(merged, F.lit(0)))
    return resolved.select(
        *[F.col(name) for name in rows.columns],
        merged.cast("bigint").alias("prior_txn_count"),
        average.alias("prior_avg_amount"),
        (F.col("txn_count_24h") + F.col("acc_rows")).cast("bigint").alias("txn_count_24h"),
        (F.col("amount_sum_24h") + F.col("acc_total")).alias("amount_sum_24h"),
        (F.col("state_hit") | (F.col("acc_rows") > 0)).alias("state_hit"),
    )


def compare_states(left: DataFrame, right: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Keys on which two snapshots disagree: counts exactly, amounts to a relative tolerance, missing keys always."""
    a = left.select(F.col("name_dest"), *[F.col(c).alias(f"a_{c}") for c in STATE_COLUMNS], F.lit(1).alias("in_a"))
    b = right.select(F.col("name_dest"), *[F.col(c).alias(f"b_{c}") for c in STATE_COLUMNS], F.lit(1).alias("in_b"))
    both = a.join(b, "name_dest", "full_outer")

    def far(name: str) -> Column:
        x, y = F.col(f"a_{name}"), F.col(f"b_{name}")
        return F.abs(x - y) > tolerance * F.greatest(F.abs(x), F.abs(y))

    reason = (
        F.when(F.col("in_b").isNull(), "only_left").when(F.col("in_a").isNull(), "only_right")
        .when((F.col("a_prior_txn_count") != F.col("b_prior_txn_count"))
              | (F.col("a_txn_count_24h") != F.col("b_txn_count_24h")), "count")
        .when(far("prior_avg_amount") | far("amount_sum_24h"), "amount")
    )
    return both.withColumn("reason", reason)


def recomputed_state(ledger: DataFrame) -> DataFrame:
    """The snapshot derived from per-step totals instead of rows; an independent route for the audit."""
    last = ledger.agg(F.max("step").alias("last")).scalar()
    steps = (
        ledger.where(F.substring("nameDest", 1, 1) != "M")
        .groupBy("nameDest", "step").agg(F.count("*").alias("rows"), F.sum(exact("amount")).alias("total"))
        .withColumn("late", F.col("step") >= last - (VELOCITY_HOURS - 1))
    )
    return steps.groupBy(F.col("nameDest").alias("name_dest")).agg(
        F.sum("rows").alias("prior_txn_count"),
        (F.sum("total").cast("double") / F.sum("rows")).alias("prior_avg_amount"),
        F.coalesce(F.sum(F.when(F.col("late"), F.col("rows"))), F.lit(0)).alias("txn_count_24h"),
        sum_or_zero(F.when(F.col("late"), F.col("total"))).alias("amount_sum_24h"),
    )


def state_audit(ledger: DataFrame, snapshot: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Counts of agreement between a stored snapshot and the recomputation, and of merchants stored by mistake."""
    compared = compare_states(snapshot, recomputed_state(ledger), tolerance)
    return compared.agg(
        F.count("*").alias("keys"),
        F.count_if(F.col("reason").isNotNull()).alias("mismatches"),
        F.count_if(F.col("reason") == "only_left").alias("unexpected_keys"),
        F.count_if(F.col("reason") == "only_right").alias("missing_keys"),
        F.count_if(is_merchant("name_dest")).alias("stored_merchants"),
        F.sum("b_prior_txn_count").cast("bigint").alias("recomputed_rows"),
    )


def path_parity(ledger: DataFrame, cut: Column | int) -> DataFrame:
    """Window features against (snapshot of steps <= cut) + lookup, for the non-merchant rows of step cut + 1.

    The 24-hour aggregates must agree on every row; the all-history ones on a destination's first row of that
    step, because later rows of the step see their peers in the window but not in the snapshot. The first row is
    found with an aggregate, not a window, so a crowded step stays spread out.
    """
    upto = ledger.where(F.col("step") <= cut)
    # The slice ends at the cut even if the cut step itself is empty.
    recent = F.col("step") > F.lit(cut) - VELOCITY_HOURS
    prefix = exclude_merchants(upto).groupBy(F.col("nameDest").alias("name_dest")).agg(
        F.count("*").alias("prior_txn_count"),
        (F.sum(exact("amount")).cast("double") / F.count("*")).alias("prior_avg_amount"),
        count_where(recent).alias("txn_count_24h"),
        sum_or_zero(F.when(recent, exact("amount"))).alias("amount_sum_24h"),
    )
    target = exclude_merchants(ledger.where(F.col("step") == F.lit(cut) + 1))
    first = target.groupBy("nameDest").agg(F.min("row_id").alias("row_id")).select("row_id", F.lit(True).alias("first"))
    served = features_from_state(lookup_state(target, prefix)).select(
        "row_id", *[F.col(name).alias(f"s_{name}") for name in FEATURES])
    trained = build_features(ledger.where(F.col("step") <= F.lit(cut) + 1))
    pairs = trained.join(served, "row_id").join(first, "row_id", "left")

    def same(name: str) -> Column:
        return F.abs(F.col(name) - F.col(f"s_{name}")) <= 1e-9 * F.greatest(F.abs(F.col(name)), F.lit(1.0))

    opening = F.col("first").isNotNull()
    return pairs.agg(
        F.count("*").alias("rows_compared"),
        F.count_if(opening).alias("first_rows"),
        F.count_if(~same("dest_txn_count_24h")).alias("count24_mismatches"),
        F.count_if(~same("dest_amount_sum_24h")).alias("sum24_mismatches"),
        F.count_if(opening & ~same("dest_prior_txn_count")).alias("prior_count_mismatches"),
        F.count_if(opening & ~same("dest_prior_avg_amount")).alias("prior_avg_mismatches"),
    )


def captured_fraud(decided: DataFrame, inputs: DataFrame) -> DataFrame:
    """Decisions joined back to the labelled inputs: how much of the fraud was stopped or queued."""
    joined = inputs.select("row_id", "isFraud", "amount").join(decided.select("row_id", "decision"), "row_id")
    fraud = F.col("isFraud") == 1
    caught = fraud & F.col("decision").isin("BLOCK", "REVIEW")
    return joined.agg(
        F.count("*").alias("n_rows"),
        count_where(fraud).alias("n_fraud"),
        count_where(caught).alias("n_caught"),
        (count_where(caught) / F.nullif(count_where(fraud), F.lit(0))).alias("share_caught"),
        sum_or_zero(F.when(caught, exact("amount"))).alias("amount_caught"),
    )
