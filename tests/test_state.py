from __future__ import annotations

import pytest
from ledger_cases import rows_of
from pyspark.sql import functions as F

from riskmill.operators import state

SNAPSHOT = "name_dest string, prior_txn_count long, prior_avg_amount double, txn_count_24h long, amount_sum_24h double"


def test_snapshot_values(six):
    made = state.destination_snapshot(six)
    assert dict(made.dtypes)["prior_txn_count"] == "bigint"
    assert rows_of(made, "name_dest", *state.STATE_COLUMNS, "snapshot_step") == [
        ("C1", 4, 187.5, 2, 600.0, 30), ("C2", 1, 75.0, 0, 0.0, 30)]


def test_lookup_hit_and_miss(spark, six):
    snapshot = spark.createDataFrame([("C1", 5, 200.0, 2, 150.0)], SNAPSHOT)
    found = state.lookup_state(six, snapshot)
    hit = found.where("row_id = 1").first()
    assert (hit.prior_txn_count, hit.prior_avg_amount, hit.txn_count_24h, hit.amount_sum_24h, hit.state_hit) == \
        (5, 200.0, 2, 150.0, True)
    miss = found.where("row_id = 6").first()
    assert (miss.prior_txn_count, miss.prior_avg_amount, miss.state_hit) == (0, 0.0, False)
    assert not any(r.state_hit for r in state.lookup_state(six, snapshot.limit(0)).collect())


def test_three_rows_to_a_new_destination(spark):
    rows = spark.createDataFrame(
        [(0, 0, "C9", 10.0), (1, 0, "C9", 20.0), (2, 0, "C9", 60.0), (3, 1, "C9", 5.0)],
        "seq long, batch_id long, nameDest string, amount double")
    made = state.accumulate_in_batch(rows, spark.createDataFrame([], SNAPSHOT))
    assert rows_of(made, "seq", "state_hit", "prior_txn_count", "prior_avg_amount", "amount_sum_24h") == [
        (0, False, 0, 0.0, 0.0), (1, True, 1, 10.0, 10.0), (2, True, 2, 15.0, 30.0), (3, False, 0, 0.0, 0.0)]


def test_merge_with_snapshot_and_merchants(spark):
    rows = spark.createDataFrame(
        [(0, 0, "C1", 100.0), (1, 0, "C1", 50.0), (2, 0, "M5", 7.0), (3, 0, "M5", 9.0)],
        "seq long, batch_id long, nameDest string, amount double")
    snapshot = spark.createDataFrame([("C1", 4, 187.5, 2, 600.0)], SNAPSHOT)
    made = {r.seq: r for r in state.accumulate_in_batch(rows, snapshot).collect()}
    assert made[1].prior_txn_count == 5 and made[1].txn_count_24h == 3
    assert made[1].prior_avg_amount == pytest.approx((187.5 * 4 + 100) / 5) and made[1].amount_sum_24h == 700.0
    assert (made[2].state_hit, made[3].state_hit, made[3].prior_avg_amount) == (False, True, 7.0)


def test_batches_cut_by_position(spark):
    made = state.with_batches(spark.range(25).withColumnRenamed("id", "seq"), size=10)
    assert rows_of(made.groupBy("batch_id").count(), "batch_id", "count") == [(0, 10), (1, 10), (2, 5)]


def test_state_audit_and_planted_errors(ledger):
    snapshot = state.destination_snapshot(ledger)
    clean = state.state_audit(ledger, snapshot).first()
    assert clean.mismatches == 0 and clean.stored_merchants == 0 and clean.keys == snapshot.count()
    broken = snapshot.where("name_dest <> 'C777'").withColumn("prior_txn_count", F.col("prior_txn_count") + 1)
    found = state.state_audit(ledger, broken).first()
    assert found.missing_keys == 1 and found.mismatches == clean.keys


def test_path_parity(ledger):
    row = state.path_parity(ledger, 299).first()
    assert row.rows_compared > 100 and 0 < row.first_rows < row.rows_compared
    assert (row.count24_mismatches, row.sum24_mismatches, row.prior_count_mismatches, row.prior_avg_mismatches) == (0, 0, 0, 0)


def test_captured_fraud(spark):
    inputs = spark.createDataFrame([(1, 1, 10.0), (2, 1, 20.0), (3, 0, 5.0)], "row_id long, isFraud int, amount double")
    decided = spark.createDataFrame([(1, "BLOCK"), (2, "PASS"), (3, "REVIEW")], "row_id long, decision string")
    row = state.captured_fraud(decided, inputs).first()
    assert (row.n_rows, row.n_fraud, row.n_caught, row.share_caught, row.amount_caught) == (3, 2, 1, 0.5, 10.0)
