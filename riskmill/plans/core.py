"""Registered queries: sources, validation, features, history and state (A - E)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmill.functions.features import FEATURES, feature_vector, stateless_features
from riskmill.functions.rules import default_rules
from riskmill.operators import history, state, validation
from riskmill.operators.decisions import decide
from riskmill.operators.sampling import sample_rows
from riskmill.plans import base

Query = Callable[[SparkSession, str], DataFrame]


def a3_feature_scan(spark, sf_dir):
    return history.feature_scan(base.features(spark, sf_dir))


def b1_validation_report(spark, sf_dir):
    return validation.validation_report(base.faulty_ledger(spark, sf_dir))


def b2_row_sample(spark, sf_dir):
    return sample_rows(base.ledger(spark, sf_dir), 500, base.SAMPLE_SEED).select("row_id", "step", "amount")


def b3_admission(spark, sf_dir):
    return validation.admission(base.faulty_ledger(spark, sf_dir))


def b4_exclude_merchants(spark, sf_dir):
    return state.exclude_merchants(base.ledger(spark, sf_dir)).select("row_id", "nameDest", "amount")


def b5_violations(spark, sf_dir):
    return validation.violations(base.faulty_ledger(spark, sf_dir))


def _stateless(name: str) -> Query:
    def query(spark, sf_dir):
        return base.ledger(spark, sf_dir).select("row_id", stateless_features()[name].alias(name))
    return query


def c14_feature_vector(spark, sf_dir):
    made = base.features(spark, sf_dir).withColumn("vector", feature_vector())
    return made.select("row_id", F.size("vector").alias("width"),
                       *[F.element_at("vector", i + 1).alias(f"v{i + 1:02d}") for i in range(len(FEATURES))])


def _history(name: str) -> Query:
    def query(spark, sf_dir):
        return base.features(spark, sf_dir).select("row_id", name)
    return query


def d6_features(spark, sf_dir):
    return base.features(spark, sf_dir)


def d7_leakage_audit(spark, sf_dir):
    return history.leakage_audit(base.ledger(spark, sf_dir))


def d6_features_split(spark, sf_dir):
    """The same features with destinations split from 50 rows on, as a hot destination is at scale."""
    return history.build_features(base.ledger(spark, sf_dir), hot_rows=50, row_block=16)


def d7_leakage_audit_split(spark, sf_dir):
    return history.leakage_audit(base.ledger(spark, sf_dir), row_block=16)


def d8_structure_profile(spark, sf_dir):
    return history.structure_profile(base.ledger(spark, sf_dir))


def d8_fraud_rate_by_type(spark, sf_dir):
    return history.fraud_rate_by_type(base.ledger(spark, sf_dir))


def e1_snapshot(spark, sf_dir):
    return state.destination_snapshot(base.ledger(spark, sf_dir))


def e2_state_lookup(spark, sf_dir):
    ledger = base.ledger(spark, sf_dir)
    found = state.lookup_state(ledger, state.destination_snapshot(ledger))
    return found.select("row_id", *state.STATE_COLUMNS, "state_hit")


def e3_state_features(spark, sf_dir):
    ledger = base.ledger(spark, sf_dir)
    found = state.lookup_state(ledger, state.destination_snapshot(ledger))
    return state.features_from_state(found, ("row_id", "state_hit"))


def _batched(spark, sf_dir):
    upload = base.ledger(spark, sf_dir).withColumn("seq", F.col("row_id"))
    return state.with_batches(upload, size=base.BATCH_ROWS)


def e4_batch_accumulation(spark, sf_dir):
    snapshot = state.destination_snapshot(base.ledger(spark, sf_dir))
    merged = state.accumulate_in_batch(_batched(spark, sf_dir), snapshot)
    return merged.select("row_id", "batch_id", *state.STATE_COLUMNS, "state_hit")


def e5_batches(spark, sf_dir):
    return _batched(spark, sf_dir).groupBy("batch_id").agg(
        F.count("*").alias("n_rows"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def e6_state_audit(spark, sf_dir):
    ledger = base.ledger(spark, sf_dir)
    return state.state_audit(ledger, state.destination_snapshot(ledger))


def e7_path_parity(spark, sf_dir):
    ledger = base.ledger(spark, sf_dir)
    # A literal, so that the scans below read only the steps up to it.
    span = ledger.agg(F.min("step").alias("low"), F.max("step").alias("high")).first()
    return state.path_parity(ledger, ((span.low or 0) + (span.high or 0)) // 2)


def e8_captured_fraud(spark, sf_dir):
    made = base.explained(spark, sf_dir)
    decided = decide(made, F.col("flagged"), default_rules(base.HARD_BLOCK_AMOUNT))
    return state.captured_fraud(decided, base.ledger(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "a3_feature_scan": a3_feature_scan, "b1_validation_report": b1_validation_report, "b2_row_sample": b2_row_sample, "b3_admission": b3_admission,
    "b4_exclude_merchants": b4_exclude_merchants, "b5_violations": b5_violations,
    "c1_amount": _stateless("amount"), "c2_hour_of_day": _stateless("hour_of_day"),
    "c3_is_night": _stateless("is_night"), "c4_orig_balance_delta": _stateless("orig_balance_delta"),
    "c5_dest_balance_delta": _stateless("dest_balance_delta"),
    "c6_orig_balance_mismatch": _stateless("orig_balance_mismatch"), "c7_orig_emptied": _stateless("orig_emptied"),
    "c8_amount_to_balance_ratio": _stateless("amount_to_balance_ratio"),
    "c9_dest_is_merchant": _stateless("dest_is_merchant"), "c10_is_transfer": _stateless("is_transfer"),
    "c11_is_cash_out": _stateless("is_cash_out"), "c12_is_cash_in": _stateless("is_cash_in"),
    "c13_is_debit": _stateless("is_debit"), "c14_feature_vector": c14_feature_vector,
    "d1_dest_prior_txn_count": _history("dest_prior_txn_count"),
    "d2_dest_prior_avg_amount": _history("dest_prior_avg_amount"),
    "d3_dest_amount_to_prior_avg_ratio": _history("dest_amount_to_prior_avg_ratio"),
    "d4_dest_txn_count_24h": _history("dest_txn_count_24h"),
    "d5_dest_amount_sum_24h": _history("dest_amount_sum_24h"),
    "d6_features": d6_features, "d7_leakage_audit": d7_leakage_audit,
    "d6_features_split": d6_features_split, "d7_leakage_audit_split": d7_leakage_audit_split,
    "d8_structure_profile": d8_structure_profile, "d8_fraud_rate_by_type": d8_fraud_rate_by_type,
    "e1_snapshot": e1_snapshot, "e2_state_lookup": e2_state_lookup, "e3_state_features": e3_state_features,
    "e4_batch_accumulation": e4_batch_accumulation, "e5_batches": e5_batches, "e6_state_audit": e6_state_audit,
    "e7_path_parity": e7_path_parity, "e8_captured_fraud": e8_captured_fraud,
}
