from __future__ import annotations

import re
from decimal import Decimal

import pytest
from ledger_cases import rows_of
from pyspark.sql import functions as F

from riskmill.functions.features import FEATURES, stateless_features
from riskmill.operators import history


def exact_sum(rows):
    return float(sum((Decimal(str(r[2])) for r in rows), Decimal(0)))


def brute_force(rows):
    """Direct restatement over plain tuples (row_id, step, amount, dest)."""
    out = {}
    for row_id, step, _, dest in rows:
        before = [r for r in rows if r[3] == dest and (r[1], r[0]) < (step, row_id)]
        recent = [r for r in rows if r[3] == dest and step - 24 <= r[1] <= step - 1]
        out[row_id] = (len(before), exact_sum(before) / len(before) if before else 0.0, len(recent), exact_sum(recent))
    return out


def history_of(frame):
    picked = frame.select("row_id", "dest_prior_txn_count", "dest_prior_avg_amount",
                          "dest_txn_count_24h", "dest_amount_sum_24h")
    return {row[0]: tuple(row[1:]) for row in picked.collect()}


def test_six_row_history(six):
    assert history_of(history.build_features(six)) == {
        1: (0, 0.0, 0, 0.0), 2: (1, 100.0, 0, 0.0), 3: (2, 75.0, 2, 150.0), 4: (3, 350 / 3, 1, 200.0),
        5: (0, 0.0, 0, 0.0), 6: (0, 0.0, 0, 0.0),
    }


def test_first_transaction_ratio_is_the_amount(six):
    made = history.build_features(six).where("row_id IN (1, 5)")
    assert rows_of(made, "row_id", "dest_amount_to_prior_avg_ratio") == [(1, 100.0), (5, 75.0)]


@pytest.mark.parametrize("hot_rows,row_block", [(10**9, 1 << 20), (50, 16), (0, 1), (0, 7), (100, 10**6)])
def test_hot_destinations_give_the_same_history(ledger, hot_rows, row_block):
    rows = [tuple(r) for r in ledger.select("row_id", "step", "amount", "nameDest").collect()]
    assert history_of(history.build_features(ledger, hot_rows=hot_rows, row_block=row_block)) == brute_force(rows)


def test_hot_cells_are_bounded(ledger):
    """No window partition of a hot destination holds more rows than the block allows."""
    cells = history._cell_offsets(ledger, history.hot_destinations(ledger, 50), 16)
    assert cells.count() > 20
    sizes = ledger.where("nameDest = 'C777'").groupBy("step", F.floor(F.col("row_id") / 16)).count()
    assert sizes.agg(F.max("count")).first()[0] <= 16


def test_one_wide_shuffle_and_no_single_partition(spark, ledger):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = history.build_features(ledger, hot_rows=50, row_block=16)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    by_cell = [line for line in plan.splitlines() if re.search("Exchange hashpartitioning.*cell_block", line)]
    # One for the rows, whose windows and join share it, and one for the pre-aggregated offsets.
    assert len(by_cell) == 2
    assert "SinglePartition" not in plan
    assert plan.count("WindowExec") == 0 and plan.count("SortMergeJoin [nameDest") == 2


def test_stateless_values(six):
    made = six.select("row_id", *[c.alias(n) for n, c in stateless_features().items()])
    first = made.where("row_id = 1").first()
    assert (first.hour_of_day, first.is_night, first.orig_balance_delta, first.dest_balance_delta) == (0, 1, 100.0, 100.0)
    assert (first.orig_balance_mismatch, first.orig_emptied, first.is_transfer, first.is_cash_out) == (0, 0, 1, 0)
    assert first.amount_to_balance_ratio == pytest.approx(100 / 1001)
    third = made.where("row_id = 3").first()
    assert (third.hour_of_day, third.is_night, third.is_cash_out) == (10, 0, 1)
    assert made.where("row_id = 6").first().dest_is_merchant == 1
    assert made.where("row_id = 4").first().orig_balance_mismatch == 1


@pytest.mark.parametrize("step,night", [(0, 1), (5, 1), (6, 0), (23, 0), (24, 1), (29, 1), (30, 0)])
def test_night_bounds(six, step, night):
    row = six.limit(1).withColumn("step", F.lit(step).cast("long")).select(stateless_features()["is_night"].alias("n"))
    assert row.first().n == night


def test_feature_order(six):
    assert [c for c in history.build_features(six).columns if c in FEATURES] == list(FEATURES)
    assert len(FEATURES) == 18


def test_leakage_audit_finds_nothing_and_counts_rows(ledger):
    row = history.leakage_audit(ledger, row_block=16).first()
    assert row.rows_checked == ledger.count()
    assert (row.prior_count_mismatches, row.prior_sum_mismatches, row.recent_count_mismatches,
            row.recent_sum_mismatches) == (0, 0, 0, 0)
    assert row.prior_count_total > 0
    assert row.destinations == ledger.select("nameDest").distinct().count()


def test_leakage_audit_counts_wrong_and_missing_rows(ledger, monkeypatch):
    right = history.with_history
    late = F.col("row_id") % 10 == 0
    monkeypatch.setattr(history, "with_history", lambda rows: right(rows).withColumns({
        "prior_rows": F.col("prior_rows") + F.when(late, 1).otherwise(0),
        "recent_total": F.when(late, None).otherwise(F.col("recent_total"))}))
    row, wrong = history.leakage_audit(ledger, row_block=16).first(), ledger.where(late).count()
    assert (row.prior_count_mismatches, row.prior_sum_mismatches, row.recent_count_mismatches,
            row.recent_sum_mismatches) == (wrong, 0, 0, wrong)
    gone = ledger.agg(F.min("nameDest")).first()[0]
    monkeypatch.setattr(history, "with_history", lambda rows: right(rows).where(F.col("nameDest") != gone))
    row = history.leakage_audit(ledger, row_block=16).first()
    assert row.rows_checked == ledger.where(F.col("nameDest") != gone).count() and row.prior_count_mismatches > 0


def test_feature_scan_fills_nulls(six):
    made = history.build_features(six).withColumn("amount", F.lit(None).cast("double"))
    assert history.feature_scan(made).where("amount = 0").count() == 6


def test_sketch_names_exactly_the_hot_destinations(spark, ledger):
    counts = {r.nameDest: r["count"] for r in ledger.groupBy("nameDest").count().collect()}
    for hot_rows in (0, 5, 20, 50, 300):
        wanted = {name for name, n in counts.items() if n > hot_rows}
        found = history.hot_destinations(ledger, hot_rows)
        assert (set() if found is None else {r.hot_dest for r in found.collect()}) == wanted
    assert history.hot_destinations(ledger, 10**6) is None and history.hot_destinations(ledger.limit(0), 0) is None


def test_sketches_grow_with_the_table_up_to_a_bound():
    assert history.sketch_slots(10**12, 10**8) == 1 << 17 and history.sketch_slots(10**12, 2_000_000) is None
    assert history.sketch_slots(6_400_000, 2_000_000) == 32 and history.sketch_slots(5, 0) is None


def test_a_ledger_without_hot_destinations_takes_one_shuffle(ledger):
    plan = history.with_history(ledger)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Aggregate" not in plan
