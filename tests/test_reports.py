from __future__ import annotations

import pytest
from ledger_cases import rows_of
from pyspark.sql import functions as F

from riskmill.functions.rules import default_rules
from riskmill.operators import attribution, decisions, economics

# Published sweep rows: (reviews_per_day, k, n_flagged, tp, fp, fn)
SWEEP = [(100.0, 1617, 1619, 1619, 0, 2631), (250.0, 4042, 4042, 4042, 0, 208), (500.0, 8083, 8083, 4250, 3833, 0)]
AVERAGE = 1_572_443.0


@pytest.fixture(scope="module")
def sweep(spark):
    made = spark.createDataFrame(
        SWEEP, "reviews_per_day double, k long, n_flagged long, true_positives long, false_positives long, false_negatives long")
    return made.withColumn("precision", F.col("true_positives") / F.col("n_flagged")) \
        .withColumn("recall", F.col("true_positives") / 4250.0)


def test_net_value(spark):
    row = spark.createDataFrame([(10, 20, 2)], "true_positives long, n_flagged long, false_negatives long")
    assert row.select(economics.net_value(F.lit(100.0), 5.0, 0.5, 1.0).alias("v")).first().v == 200.0


def test_break_even_range(sweep):
    made = {r.recovery_rate: r.break_even_cost_per_review for r in economics.break_even_cost(sweep, F.lit(AVERAGE), 250, 500).collect()}
    assert made[0.05] == pytest.approx(84_984.3, abs=1) and made[1.0] == pytest.approx(161_874.9, abs=1)


def test_break_even_without_added_reviews_is_null(sweep):
    assert {r.break_even_cost_per_review for r in economics.break_even_cost(sweep, F.lit(AVERAGE), 250, 250).collect()} == {None}


def test_constraint_cost(sweep):
    row = economics.constraint_cost(sweep, F.lit(AVERAGE), 250, 500).first()
    assert row.frauds_missed_by_constraint == 208 and row.exposure == 208 * 1_572_443.0
    assert row.exposure_per_marginal_seat == pytest.approx(row.exposure / 250)
    assert economics.constraint_cost(sweep, F.lit(AVERAGE), 250, 250).first().exposure_per_marginal_seat is None


def test_curve_is_sorted(sweep):
    assert [r.reviews_per_day for r in economics.net_value_curve(sweep.orderBy(F.desc("k")), F.lit(AVERAGE)).collect()] == [100, 250, 500]


def test_crossover_moves_to_less_staff_for_small_tickets(sweep):
    made = economics.ticket_crossover(sweep, tickets=(10, 1_000, 1_000_000)).orderBy("avg_fraud_amount").collect()
    assert [r.recommended_reviews_per_day for r in made] == [100, 250, 500]
    assert [r.is_crossover for r in made] == [False, True, True]


def test_saturation(sweep):
    made = economics.saturation(sweep, F.lit(AVERAGE)).collect()
    assert {r.saturation_reviews_per_day for r in made} == {500.0} and all(r.always_reaches_saturation for r in made)
    cheap = economics.saturation(sweep, F.lit(10.0)).collect()
    assert not any(r.always_reaches_saturation for r in cheap)


def contributions(spark, a, b):
    return spark.createDataFrame(
        [(i, x, y, float(i), float(i)) for i, (x, y) in enumerate(zip(a, b))],
        "row_id long, c_a double, c_b double, a double, b double")


def test_global_importance(spark):
    made = {r.feature: r for r in attribution.global_importance(contributions(spark, [1., -1., 3.], [-2., -2., 0.]), ("a", "b")).collect()}
    assert made["a"].mean_abs == pytest.approx(5 / 3) and made["b"].mean_abs == pytest.approx(4 / 3)
    assert made["a"].mean_signed == 1.0 and made["b"].mean_signed == pytest.approx(-4 / 3)
    assert (made["a"].rank, made["b"].rank) == (1, 2)
    assert made["a"].share_of_total + made["b"].share_of_total == pytest.approx(1.0)


def test_zero_importance_has_no_share(spark):
    made = attribution.global_importance(contributions(spark, [0., 0.], [0., 0.]), ("a", "b"))
    assert {r.share_of_total for r in made.collect()} == {None}
    assert rows_of(attribution.inert_features(made), "feature") == [("a",), ("b",)]


def test_alerts_and_reasons(spark):
    rows = spark.createDataFrame(
        [(0, .1, 0, 1., 0., 1., 2.), (1, .6, 0, .1, -5., 16., 14.), (3, .9, 1, 4., 2., 16., 20.)],
        "row_id long, score double, is_fraud int, c_a double, c_b double, a double, b double")
    alerts = attribution.alert_queue(rows, F.col("score") >= 0.5, 2)
    made = attribution.explain_alerts(alerts, ("a", "b"), 1).orderBy("alert_rank").collect()
    assert [(r.alert_rank, r.row_id, r.reason_rank, r.feature, r.value) for r in made] == [(1, 3, 1, "a", 16.0), (2, 1, 1, "b", 14.0)]
    assert attribution.alert_queue(rows, F.col("score") >= 0.95).count() == 0


def test_contributions_add_up(spark):
    rows = spark.createDataFrame([(1, 4.0, 10.0)], "row_id long, a double, b double")
    fitted = {"a": {"mean": F.lit(2.0), "scale": F.lit(2.0)}, "b": {"mean": F.lit(0.0), "scale": F.lit(5.0)}}
    made = attribution.linear_contributions(rows, {"a": 0.5, "b": -1.0}, fitted, ("a", "b"))
    row = made.select("c_a", "c_b", attribution.margin(0.25, ("a", "b")).alias("m")).first()
    assert (row.c_a, row.c_b, row.m) == (0.5, -2.0, -1.25)


@pytest.mark.parametrize("transfer,cash_out,emptied,amount,flagged,expected", [
    (1, 0, 1, 1_000_000.0, False, "BLOCK"), (0, 1, 1, 2e6, True, "BLOCK"), (1, 0, 1, 999_999.99, True, "REVIEW"),
    (1, 0, 0, 2e6, False, "PASS"), (0, 0, 1, 2e6, True, "REVIEW"),
])
def test_decisions(spark, transfer, cash_out, emptied, amount, flagged, expected):
    row = spark.createDataFrame([(transfer, cash_out, emptied, amount)], "is_transfer int, is_cash_out int, orig_emptied int, amount double")
    made = decisions.decide(row, F.lit(flagged)).first()
    assert made.decision == expected and (made.rule is not None) == (expected == "BLOCK")


def test_first_rule_wins_and_no_rules_pass(spark):
    row = spark.createDataFrame([(1, 0, 1, 2e6)], "is_transfer int, is_cash_out int, orig_emptied int, amount double")
    rules = [("mine", F.col("amount") > 1), *default_rules()]
    assert decisions.apply_rules(row, rules).first().rule == "mine"
    assert decisions.apply_rules(row, []).first().rule is None


def test_two_meanings_of_flagged(spark):
    made = spark.createDataFrame([(1, "BLOCK", True), (1, "REVIEW", True), (1, "PASS", False)], "batch_id long, decision string, flagged boolean")
    summary = decisions.batch_summary(made).first()
    assert (summary.n_scored, summary.n_blocked, summary.n_flagged, summary.n_passed) == (3, 1, 1, 1)
    assert summary.alert_rate == pytest.approx(2 / 3)
    telemetry = decisions.score_telemetry(made).first()
    assert (telemetry.flagged_count, telemetry.blocked_count) == (2, 1)


def test_histogram_closes_the_last_bucket(spark):
    made = spark.createDataFrame([(0.0,), (0.2,), (0.999,), (1.0,)], "score double")
    assert rows_of(decisions.score_histogram(made), "bucket", "n_scores") == [
        ("[0.0-0.2)", 1), ("[0.2-0.4)", 1), ("[0.4-0.6)", 0), ("[0.6-0.8)", 0), ("[0.8-1.0]", 2)]


def test_latency_percentiles(spark):
    made = spark.range(100).select(F.col("id").alias("seq"), (F.col("id") + 1.0).alias("latency_ms"))
    row = decisions.latency_percentiles(made).first()
    assert (row.latency_p50_ms, row.latency_p95_ms, row.latency_p99_ms) == (51.0, 96.0, 100.0)
    kept = decisions.latency_percentiles(made, keep=10).first()
    assert (kept.n_latencies, kept.latency_p50_ms) == (10, 96.0)
    assert decisions.latency_percentiles(made.limit(0)).first().latency_p99_ms == 0.0
