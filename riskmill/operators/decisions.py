"""Decisions, their summaries, and score telemetry."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmill.functions.features import FEATURES
from riskmill.functions.numeric import count_where, ratio
from riskmill.functions.rules import Rule, decision, default_rules, first_matching_rule
from riskmill.operators.attribution import linear_contributions, margin, probability, top_reasons
from riskmill.operators.scaling import Fitted
from riskmill.params import REASONS_PER_ALERT, SCORE_BUCKETS, TRACKED_LATENCIES


def apply_rules(features: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    return features.withColumn("rule", first_matching_rule(default_rules() if rules is None else rules))


def decide(scored_features: DataFrame, flagged: Column, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Adds rule, flagged and decision; a rule beats the model's flag."""
    ruled = apply_rules(scored_features, rules).withColumn("flagged", flagged)
    return ruled.withColumn("decision", decision(F.col("rule"), F.col("flagged")))


def rule_effectiveness(ruled: DataFrame, label: str = "isFraud") -> DataFrame:
    """How often any rule fires, and how often rightly."""
    fired = F.col("rule").isNotNull()
    right = fired & (F.col(label) == 1)
    return ruled.agg(
        F.count("*").alias("n_rows"), count_where(fired).alias("n_fired"), count_where(right).alias("n_fraud"),
        ratio(count_where(fired), F.count("*")).alias("fire_rate"),
        ratio(count_where(right), count_where(fired)).alias("rule_precision"),
    )


def score_linear(features: DataFrame, coefficients: Mapping[str, float], intercept: float,
                 fitted: Fitted, threshold: float, digits: int | None = None,
                 names: Sequence[str] = FEATURES, reasons: int = REASONS_PER_ALERT) -> DataFrame:
    """Scale, score and flag with a logistic model given as numbers, with the strongest reasons per row."""
    explained = linear_contributions(features, coefficients, fitted, names)
    score = probability(margin(intercept, names))
    scored = explained.withColumn("score", score if digits is None else F.round(score, digits))
    return scored.withColumn("flagged", F.col("score") >= F.lit(float(threshold))) \
        .withColumn("reasons", top_reasons(names, reasons))


def batch_summary(decided: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Decision counts per batch; ``n_flagged`` counts REVIEW only."""
    def count(name: str) -> Column:
        return count_where(F.col("decision") == name)

    return decided.groupBy(batch).agg(
        F.count("*").alias("n_scored"), count("BLOCK").alias("n_blocked"),
        count("REVIEW").alias("n_flagged"), count("PASS").alias("n_passed"),
    ).withColumn("alert_rate", ratio(F.col("n_blocked") + F.col("n_flagged"), F.col("n_scored")))


def score_telemetry(decided: DataFrame) -> DataFrame:
    """Totals over scored rows. Here ``flagged_count`` counts the model's flags even on blocked rows."""
    return decided.agg(
        F.count("*").alias("score_count"), count_where(F.col("flagged")).alias("flagged_count"),
        count_where(F.col("decision") == "BLOCK").alias("blocked_count"),
        F.coalesce(ratio(count_where(F.col("flagged")), F.count("*")), F.lit(0.0)).alias("flag_rate"),
    )


def score_histogram(scored: DataFrame) -> DataFrame:
    """Five fixed buckets, the last one closed; empty buckets are reported as zero."""
    slot = F.least(F.floor(F.col("score") * len(SCORE_BUCKETS)), F.lit(len(SCORE_BUCKETS) - 1))
    counts = scored.agg(*[count_where(slot == i).alias(f"b{i}") for i in range(len(SCORE_BUCKETS))])
    entries = [F.struct(F.lit(label).alias("bucket"), F.col(f"b{i}").alias("n_scores"))
               for i, label in enumerate(SCORE_BUCKETS)]
    return counts.select(F.inline(F.array(*entries)))


def latency_percentiles(latencies: DataFrame, sequence: str = "seq", value: str = "latency_ms",
                        shares: Sequence[float] = (0.50, 0.95, 0.99), keep: int = TRACKED_LATENCIES) -> DataFrame:
    """Nearest-rank percentiles over the most recent ``keep`` latencies; zero when there are none."""
    recent = latencies.orderBy(F.desc(sequence)).limit(keep)
    ordered = recent.agg(F.sort_array(F.collect_list(value)).alias("v"), F.count("*").alias("n"))

    def nearest(share: float) -> Column:
        at = F.least(F.floor(F.col("n") * F.lit(share)), F.col("n") - 1).cast("int")
        return F.when(F.col("n") > 0, F.get("v", at)).otherwise(F.lit(0.0))

    return ordered.select(F.col("n").alias("n_latencies"),
                          *[nearest(s).alias(f"latency_p{round(s * 100)}_ms") for s in shares])
