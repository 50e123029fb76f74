"""Registered queries: folds, sampling, ranking, comparison, errors, attribution, economics, decisions (F - M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskmill.functions.rules import default_rules
from riskmill.operators import (
    attribution,
    capacity,
    compare,
    decisions,
    economics,
    errors,
    folds,
    metrics,
    ranking,
    sampling,
    scaling,
)
from riskmill.operators.models import prepared_fold_summary
from riskmill.plans import base
from riskmill.plans.core import Query

KEYS = ("model", "fold")


def f1_step_quantiles(spark, sf_dir):
    return folds.fold_cuts(base.ledger(spark, sf_dir))


def f2_time_folds(spark, sf_dir):
    return base.folded(spark, sf_dir).select("row_id", "step", "fold", "role")


def f3_fold_summary(spark, sf_dir):
    return folds.fold_summary(base.folded(spark, sf_dir), base.REVIEWS_PER_DAY)


def f4_class_weight(spark, sf_dir):
    return folds.class_weight(base.folded(spark, sf_dir), ("fold", "role"))


def f5_undersample(spark, sf_dir):
    train = base.folded(spark, sf_dir).where("role = 'train'")
    kept = sampling.undersample_negatives(train, 5.0, base.SAMPLE_SEED, ("fold",))
    return kept.select("fold", "row_id", "isFraud")


def f6_scaler_fit(spark, sf_dir):
    train = base.folded_features(spark, sf_dir).where("role = 'train'")
    fitted = scaling.fit_scaler(train, ("fold",), digits=base.SCALER_DIGITS)
    return scaling.scaler_table(fitted, ("fold",))


def f7_scaler_apply(spark, sf_dir):
    rows = base.stored_features(spark, sf_dir).drop("isFraud")
    return scaling.apply_scaler(rows, base.final_scaler(spark, sf_dir))


def f7_scaler_inverse(spark, sf_dir):
    fitted = base.final_scaler(spark, sf_dir)
    there = scaling.apply_scaler(base.stored_features(spark, sf_dir).drop("isFraud"), fitted)
    return scaling.invert_scaler(there, fitted)


def f8_stratified_sample(spark, sf_dir):
    test = base.folded(spark, sf_dir).where(f"role = 'test' AND fold = {base.FOLDS}")
    return sampling.stratified_sample(test, 200, base.SAMPLE_SEED).select("row_id", "isFraud", "amount")


def f9_all_positives_filled(spark, sf_dir):
    kept = sampling.all_positives_filled(base.ledger(spark, sf_dir), 5000, base.SAMPLE_SEED, grow=True)
    return kept.select("row_id", "isFraud", "amount")


def f10_explanation_sample(spark, sf_dir):
    made = base.explained(spark, sf_dir)
    return sampling.sample_rows(made, 300, base.SAMPLE_SEED).select("row_id", "score", "is_fraud")


def g1_window_days(spark, sf_dir):
    return capacity.window_length(base.folded(spark, sf_dir), ("fold", "role"))


def g2_capacity_k(spark, sf_dir):
    summary = capacity.window_length(base.folded(spark, sf_dir).where("role = 'test'"), ("fold",))
    grid = F.explode(F.array(*[F.lit(float(r)) for r in base.REVIEWS_GRID]))
    return summary.withColumn("reviews_per_day", grid).select(
        "fold", "reviews_per_day",
        capacity.capacity_k(F.col("window_days"), F.col("reviews_per_day"), F.col("n_rows")).alias("k"))


def g3_threshold_at_k(spark, sf_dir):
    return metrics.thresholds_at_k(base.scored(spark, sf_dir), (1, 10, 50, 100, 500))


def g4_operating_point(spark, sf_dir):
    histogram = ranking.cumulative_histogram(base.scored(spark, sf_dir))
    return metrics.operating_points(histogram, metrics.staffing_ks((base.REVIEWS_PER_DAY,))).drop("first_step", "last_step")


def g5_capacity_sweep(spark, sf_dir):
    return base.sweep(spark, sf_dir)


def g5_capacity_sweep_by_model(spark, sf_dir):
    return metrics.capacity_sweep(base.model_scores(spark, sf_dir), base.REVIEWS_GRID, KEYS)


def g6_precision_at_k(spark, sf_dir):
    made = metrics.precision_recall_at_k(base.scored(spark, sf_dir), (1, 10, 100, 500))
    return made.select("k", "hits", "precision_at_k")


def g7_recall_at_k(spark, sf_dir):
    made = metrics.precision_recall_at_k(base.scored(spark, sf_dir), (1, 10, 100, 500))
    return made.select("k", "hits", "recall_at_k")


def g8_k_curve(spark, sf_dir):
    return metrics.k_curve(base.model_scores(spark, sf_dir), KEYS)


def _areas(spark, sf_dir, aggregate, name):
    histogram = ranking.cumulative_histogram(base.model_scores(spark, sf_dir), KEYS)
    return base.rounded(histogram.groupBy(*KEYS).agg(aggregate.alias(name)), [name], 9)


def g9_average_precision(spark, sf_dir):
    return _areas(spark, sf_dir, metrics.average_precision(), "pr_auc")


def g10_roc_auc(spark, sf_dir):
    return _areas(spark, sf_dir, metrics.roc_auc(), "roc_auc")


def g11_weighted_bce(spark, sf_dir):
    made = metrics.weighted_log_loss(base.model_scores(spark, sf_dir), metrics.balance_weight(), KEYS)
    return base.rounded(made, ["weighted_bce"])


def _results(spark, sf_dir):
    return metrics.evaluate(base.model_scores(spark, sf_dir), base.REVIEWS_PER_DAY)


def g12_evaluation(spark, sf_dir):
    return base.rounded(_results(spark, sf_dir), ["pr_auc", "roc_auc", "weighted_bce"])


def g13_global_rank(spark, sf_dir):
    return ranking.global_rank(base.scored(spark, sf_dir)).select("row_id", "score", "rank")


def h1_compare_models(spark, sf_dir):
    made = compare.compare_models(_results(spark, sf_dir))
    return base.rounded(made, [c for c in made.columns if c.endswith(("_mean", "_std"))])


def h2_curve_summary(spark, sf_dir):
    made = compare.summarize_curves(metrics.k_curve(base.model_scores(spark, sf_dir), KEYS))
    return base.rounded(made, [c for c in made.columns if c.endswith(("_mean", "_std"))])


def h3_select_model(spark, sf_dir):
    scores = base.model_scores(spark, sf_dir)
    made = compare.select_model(metrics.evaluate(scores, base.REVIEWS_PER_DAY),
                                metrics.k_curve(scores, KEYS))
    return base.rounded(made, ["capacity_precision_mean", "capacity_precision_std"])


def h5_mean_fraud_amount(spark, sf_dir):
    test = base.model_scores(spark, sf_dir).where(f"fold = {base.FOLDS} AND model = 'alpha'")
    return compare.mean_fraud_amount(test)


def i1_segment_profile(spark, sf_dir):
    made = errors.segment_profile(base.explained(spark, sf_dir), F.col("flagged"))
    return base.rounded(made, [c for c in made.columns if c.endswith(("_mean", "_gap"))], digits=8)


def i2_missed_fraud(spark, sf_dir):
    scores = base.scored(spark, sf_dir)
    point = metrics.capacity_sweep(scores, (base.REVIEWS_PER_DAY,))
    return errors.missed_fraud_ranking(scores, point.select("n_flagged").scalar())


def i3_queue_composition(spark, sf_dir):
    return errors.queue_composition(base.explained(spark, sf_dir), F.col("flagged"))


def j1_global_importance(spark, sf_dir):
    made = attribution.global_importance(base.explained(spark, sf_dir))
    return base.rounded(made, ["mean_abs", "mean_signed", "share_of_total"])


def j2_alert_queue(spark, sf_dir):
    return attribution.alert_queue(base.explained(spark, sf_dir), F.col("flagged")) \
        .select("alert_rank", "row_id", "score", "is_fraud")


def j3_reason_codes(spark, sf_dir):
    alerts = attribution.alert_queue(base.explained(spark, sf_dir), F.col("flagged"))
    return attribution.explain_alerts(alerts)


def j4_contributions(spark, sf_dir):
    return attribution.long_contributions(base.explained(spark, sf_dir))


def j5_inert_features(spark, sf_dir):
    importance = attribution.global_importance(base.explained(spark, sf_dir))
    return attribution.inert_features(importance).select("feature")


def _amount(spark, sf_dir):
    return compare.mean_fraud_amount(base.scored(spark, sf_dir)).select("avg_fraud_amount").scalar()


def _valued(spark, sf_dir):
    return base.sweep(spark, sf_dir).withColumn("amount", _amount(spark, sf_dir))


def k1_net_value(spark, sf_dir):
    made = _valued(spark, sf_dir)
    value = economics.net_value(F.col("amount"), base.COST_PER_REVIEW)
    return base.rounded(made.select("reviews_per_day", value.alias("net_value")), ["net_value"])


def k2_net_value_curve(spark, sf_dir):
    made = economics.net_value_curve(_valued(spark, sf_dir), F.col("amount"), cost=base.COST_PER_REVIEW)
    return base.rounded(made, ["net_value"])


def k3_break_even_cost(spark, sf_dir):
    made = economics.break_even_cost(base.sweep(spark, sf_dir), _amount(spark, sf_dir),
                                     base.LOW_REVIEWS, base.HIGH_REVIEWS)
    return base.rounded(made, ["break_even_cost_per_review"])


def k4_constraint_cost(spark, sf_dir):
    made = economics.constraint_cost(base.sweep(spark, sf_dir), _amount(spark, sf_dir),
                                     base.LOW_REVIEWS, base.HIGH_REVIEWS)
    return base.rounded(made, ["avg_fraud_amount", "exposure", "exposure_per_marginal_seat"])


def k5_ticket_crossover(spark, sf_dir):
    made = economics.ticket_crossover(base.sweep(spark, sf_dir), tickets=base.TICKETS, cost=base.COST_PER_REVIEW)
    return base.rounded(made, ["net_value_at_recommendation"])


def k6_saturation(spark, sf_dir):
    return economics.saturation(_valued(spark, sf_dir), F.col("amount"), cost=base.COST_PER_REVIEW)


def _decided(spark, sf_dir):
    return decisions.decide(base.explained(spark, sf_dir), F.col("flagged"), default_rules(base.HARD_BLOCK_AMOUNT))


def l1_hard_block(spark, sf_dir):
    return decisions.apply_rules(base.features(spark, sf_dir), default_rules(base.HARD_BLOCK_AMOUNT)) \
        .select("row_id", "rule")


def l2_decision(spark, sf_dir):
    return _decided(spark, sf_dir).select("row_id", "flagged", "rule", "decision")


def l3_rule_effectiveness(spark, sf_dir):
    return decisions.rule_effectiveness(
        decisions.apply_rules(base.stored_features(spark, sf_dir), default_rules(base.HARD_BLOCK_AMOUNT)))


def l4_score_rows(spark, sf_dir):
    made = base.explained(spark, sf_dir)
    first = F.col("reasons")[0]
    return made.select("row_id", "score", "flagged", F.size("reasons").alias("n_reasons"),
                       first["feature"].alias("top_feature"), first["contribution"].alias("top_contribution"))


def l5_batch_summary(spark, sf_dir):
    return decisions.batch_summary(
        _decided(spark, sf_dir).withColumn("batch_id", F.floor(F.col("row_id") / base.BATCH_ROWS).cast("bigint")))


def m1_score_telemetry(spark, sf_dir):
    return decisions.score_telemetry(_decided(spark, sf_dir))


def m2_score_histogram(spark, sf_dir):
    return decisions.score_histogram(base.scored(spark, sf_dir))


def m3_latency_percentiles(spark, sf_dir):
    rows = base.ledger(spark, sf_dir).select(
        F.col("row_id").alias("seq"), ((F.col("row_id") * 7919) % 1000 / F.lit(10.0)).alias("latency_ms"))
    return decisions.latency_percentiles(rows)


def n6_prepare_fold(spark, sf_dir):
    return prepared_fold_summary(base.folded(spark, sf_dir), 5.0, base.SAMPLE_SEED)


QUERIES: dict[str, Query] = {
    name: value for name, value in list(globals().items())
    if callable(value) and name[0] in "fghijklmn" and name[1].isdigit()
}

