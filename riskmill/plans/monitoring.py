"""Registered queries: drift, destination graph, feedback and model uncertainty (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskmill.functions.features import FEATURES
from riskmill.functions.rules import default_rules
from riskmill.lineage import cut_lineage
from riskmill.operators import compare, decisions, drift, economics, graph, metrics, review
from riskmill.operators.folds import fitted_cuts, fold_part
from riskmill.plans import base
from riskmill.plans.core import Query

REPLICATES = 50


def p1_stability_index(spark, sf_dir):
    window = F.floor(F.col("step") / 48).cast("bigint").alias("window")
    scores = base.scored(spark, sf_dir).select("row_id", "score")
    train, test = (base.final_part(spark, sf_dir, role).join(scores, "row_id") for role in ("train", "test"))
    made = drift.stability_index(train, test.select(window, *FEATURES, "score"), (*FEATURES, "score"), ("window",), score="score")
    return base.rounded(made, ["psi"])


def _train_edges(spark, sf_dir):
    """Training rows, with origins that some destinations share: chains of up to ten neighbouring destinations."""
    ledger = base.ledger(spark, sf_dir)
    number = F.regexp_extract("nameDest", "[0-9]+", 0).cast("bigint")
    shared = F.when(F.col("row_id") % 7 == 0, F.concat(F.lit("S"), F.floor(number / 2).cast("string"))) \
        .when((F.col("row_id") % 7 == 1) & (number % 10 != 9), F.concat(F.lit("T"), F.floor((number + 1) / 2).cast("string")))
    rows = ledger.withColumn("nameOrig", F.coalesce(shared, F.col("nameOrig")))
    return fold_part(rows, fitted_cuts(ledger), base.FOLDS, "train")


def p2_destination_degrees(spark, sf_dir):
    return graph.destination_degrees(_train_edges(spark, sf_dir))


def p3_component_statistics(spark, sf_dir):
    return graph.component_statistics(_train_edges(spark, sf_dir))


def p3_grown_components(spark, sf_dir):
    """Component of every destination of the training rows, grown fold by fold from the labels before."""
    source = base.ledger(spark, sf_dir)
    cuts, labels, before = fitted_cuts(source), None, -1
    for number in range(base.FOLDS):
        rows = _train_edges(spark, sf_dir).where((F.col("step") > before) & (F.col("step") <= cuts[number]))
        pairs = rows.select(F.concat(F.lit("o:"), "nameOrig").alias("o"), F.concat(F.lit("d:"), "nameDest").alias("d")).distinct()
        labels = cut_lineage(graph.connected_components(pairs, "o", "d") if labels is None
                             else graph.grown_components(labels, pairs, "o", "d"))
        before = cuts[number]
    return labels.where(F.col("node").startswith("d:")).select(F.expr("substring(node, 3)").alias("nameDest"), "component")


def p4_feedback(spark, sf_dir):
    decided = decisions.decide(base.explained(spark, sf_dir), F.col("flagged"), default_rules(base.HARD_BLOCK_AMOUNT))
    queue = decided.where("decision = 'REVIEW'").select("row_id", "score", "isFraud")
    verdicts = F.array(
        F.struct(F.lit(1).alias("ts"), F.lit("FALSE_POSITIVE").alias("label")),
        F.struct(F.lit(2).alias("ts"),
                 F.when(F.col("isFraud") == 1, "CONFIRMED_FRAUD").otherwise("FALSE_POSITIVE").alias("label")))
    feedback = queue.where("row_id % 3 <> 0").select("row_id", F.inline(verdicts))
    return review.labelled_predictions(queue.select("row_id", "score"), feedback)


def p5_bootstrap_precision(spark, sf_dir):
    """Precision at the operating capacity in each replicate, which finds its own threshold."""
    scores = base.scored(spark, sf_dir)
    k = metrics.capacity_sweep(scores, (base.REVIEWS_PER_DAY,)).first().k
    return review.bootstrap_at_capacity(scores, k, REPLICATES, base.SAMPLE_SEED)


def p5_precision_interval(spark, sf_dir):
    return base.rounded(review.interval(p5_bootstrap_precision(spark, sf_dir)), ["mean", "low", "high"])


def p6_mcnemar(spark, sf_dir):
    scores = base.model_scores(spark, sf_dir)
    right = (F.col("score") >= 0.5) == (F.col("is_fraud") == 1)
    judged = scores.select("model", "fold", "row_id", right.alias("correct"))
    return base.rounded(review.mcnemar(judged.where("model = 'alpha'"), judged.where("model = 'beta'"), ("fold",)), ["statistic"])


def p7_rate_sensitivity(spark, sf_dir):
    amount = compare.mean_fraud_amount(base.scored(spark, sf_dir)).select("avg_fraud_amount").scalar()
    made = economics.rate_sensitivity(base.sweep(spark, sf_dir), amount, cost=base.COST_PER_REVIEW)
    return base.rounded(made, ["net_value"])


QUERIES: dict[str, Query] = {
    "p1_stability_index": p1_stability_index, "p2_destination_degrees": p2_destination_degrees,
    "p3_component_statistics": p3_component_statistics, "p3_grown_components": p3_grown_components,
    "p4_feedback": p4_feedback,
    "p5_bootstrap_precision": p5_bootstrap_precision, "p5_precision_interval": p5_precision_interval,
    "p6_mcnemar": p6_mcnemar, "p7_rate_sensitivity": p7_rate_sensitivity,
}
