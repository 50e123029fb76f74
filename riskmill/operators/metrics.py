"""Ranking metrics, thresholds and the capacity sweep; every function works per group (``by``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmill.functions.numeric import count_where, ratio
from riskmill.operators.capacity import capacity_k, days_between
from riskmill.operators.ranking import cumulative_histogram, global_rank, histogram_of_ranks, ranked_scores
from riskmill.params import (
    CEILING_TOLERANCE,
    FRAUD_MULTIPLES,
    HEADLINE_MULTIPLE,
    MIN_REPORTED_K,
    PROBABILITY_FLOOR,
)


def _checked_k(k: Column, rows: Column) -> Column:
    problem = F.raise_error(F.format_string("k must be between 1 and %d, got %d", rows, k)).cast("bigint")
    return F.when((k < 1) | (k > rows), problem).otherwise(k)


def _inside_step(k: Column) -> Column:
    """True on the one histogram row whose score is the k-th highest."""
    return (F.col("cum_rows") - F.col("rows") < k) & (k <= F.col("cum_rows"))


def _confusion(k: Column, threshold: Column, flagged: Column, caught: Column) -> dict[str, Column]:
    rows, fraud = F.col("total_rows"), F.col("total_positives")
    return {
        "k": k, "threshold": threshold, "n_flagged": flagged, "n_rows": rows,
        "true_positives": caught, "false_positives": flagged - caught, "false_negatives": fraud - caught,
        "total_fraud": fraud,
        "precision": ratio(caught, flagged), "recall": ratio(caught, fraud), "alert_rate": ratio(flagged, rows),
    }


def operating_points(histogram: DataFrame, ks: Column, by: Sequence[str] = (),
                     extra: Sequence[str] = ()) -> DataFrame:
    """Confusion counts when everything at or above the K-th highest score is flagged, for many K in one pass.

    ``ks`` is an array of structs with a field ``k``; its other fields are passed through (``extra``). Only the
    histogram rows that contain a wanted position survive the explode.
    """
    wanted = F.transform(ks, lambda item: item.withField("k", _checked_k(item["k"], F.col("total_rows"))))
    hits = histogram.withColumn("_hit", F.explode(F.filter(wanted, lambda item: _inside_step(item["k"]))))
    point = _confusion(F.col("_hit.k"), F.col("score"), F.col("cum_rows"), F.col("cum_positives"))
    spans = ["first_step", "last_step"] if "first_step" in histogram.columns else []
    return hits.select(*by, *[F.col(f"_hit.{name}").alias(name) for name in extra],
                       *[column.alias(name) for name, column in point.items()], *spans)


def fixed_ks(ks: Sequence[int]) -> Column:
    return F.array(*[F.struct(F.lit(int(k)).cast("bigint").alias("k")) for k in ks])


def thresholds_at_k(scored: DataFrame, ks: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """The K-th highest score for each K; K outside 1..rows fails the job."""
    points = operating_points(cumulative_histogram(scored, by), fixed_ks(ks), by)
    return points.select(*by, "k", "threshold")


def staffing_ks(grid: Sequence[float]) -> Column:
    """K for each staffing level, from the group's own step range and row count."""
    days = days_between(F.col("first_step"), F.col("last_step"))
    return F.array(*[
        F.struct(F.lit(float(reviews)).alias("reviews_per_day"), days.alias("window_days"),
                 capacity_k(days, F.lit(float(reviews)), F.col("total_rows")).alias("k"))
        for reviews in grid
    ])


def capacity_sweep(scored: DataFrame, grid: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Operating point per staffing level with the best precision any ranking could reach there."""
    return histogram_sweep(cumulative_histogram(scored, by), grid, by)


def histogram_sweep(histogram: DataFrame, grid: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """The sweep from a cumulative histogram with step ranges."""
    points = operating_points(histogram, staffing_ks(grid), by, ("reviews_per_day", "window_days"))
    ceiling = F.least(F.lit(1.0), ratio(F.col("total_fraud"), F.col("n_flagged")))
    return points.drop("first_step", "last_step").withColumn("precision_ceiling", ceiling).withColumn(
        "at_ceiling", F.coalesce(F.col("precision") >= F.col("precision_ceiling") - CEILING_TOLERANCE, F.lit(False)))


def multiple_k(multiple: int) -> Column:
    """K as a multiple of the group's positives, at least ten and at most all rows."""
    return F.least(F.greatest(F.col("total_positives") * multiple, F.lit(MIN_REPORTED_K)), F.col("total_rows"))


def top_k_hits(ranked: DataFrame, ks: dict[str, Column], by: Sequence[str] = (), label: str = "is_fraud") -> DataFrame:
    """Positives among the exact top K rows; ``ks`` names K expressions over the group totals."""
    fraud = F.col(label) == 1
    return ranked.groupBy(*by).agg(
        F.max("total_rows").alias("total_rows"), F.max("total_positives").alias("total_positives"),
        *[F.max(k).alias(f"{name}_k") for name, k in ks.items()],
        *[count_where(fraud & (F.col("rank") <= k)).alias(f"{name}_hits") for name, k in ks.items()],
    )


def precision_recall_at_k(scored: DataFrame, ks: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Precision and recall of exactly K rows; recall is NULL without positives."""
    named = {f"at{k}": _checked_k(F.lit(int(k)).cast("bigint"), F.col("total_rows")) for k in ks}
    hits = top_k_hits(global_rank(scored, by), named, by)
    entries = [F.struct(F.col(f"{name}_k").alias("k"), F.col(f"{name}_hits").alias("hits")) for name in named]
    return hits.select(*by, "total_positives", F.inline(F.array(*entries))).select(
        *by, "k", "hits",
        ratio(F.col("hits"), F.col("k")).alias("precision_at_k"),
        ratio(F.col("hits"), F.col("total_positives")).alias("recall_at_k"),
    )


def k_curve(scored: DataFrame, by: Sequence[str] = (), multiples: Sequence[int] = FRAUD_MULTIPLES,
            ranked: DataFrame | None = None) -> DataFrame:
    """Precision and recall at multiples of the positive count."""
    ranked = global_rank(scored, by) if ranked is None else ranked
    hits = top_k_hits(ranked, {f"x{m}": multiple_k(m) for m in multiples}, by)
    entries = [F.struct(F.lit(int(m)).alias("k_multiplier"), F.col(f"x{m}_k").alias("k"),
                        F.col(f"x{m}_hits").alias("hits")) for m in multiples]
    return hits.select(*by, "total_positives", F.inline(F.array(*entries))).select(
        *by, "k_multiplier", "k",
        ratio(F.col("hits"), F.col("k")).alias("precision_at_k"),
        ratio(F.col("hits"), F.col("total_positives")).alias("recall_at_k"),
    )


def average_precision() -> Column:
    """Aggregate over a cumulative histogram: precision weighted by the recall gained at each distinct score."""
    return F.sum(ratio(F.col("positives"), F.col("total_positives")) * F.col("cum_positives") / F.col("cum_rows"))


def roc_auc() -> Column:
    """Aggregate over a cumulative histogram: share of (positive, negative) pairs ranked right, ties counting half."""
    negatives = F.col("total_rows") - F.col("total_positives")
    tied = F.col("rows") - F.col("positives")
    below = negatives - (F.col("cum_rows") - F.col("cum_positives"))
    won = F.col("positives") * (below + tied / F.lit(2.0))
    return F.sum(won) / F.nullif(F.max(F.col("total_positives") * negatives.cast("double")), F.lit(0.0))


def log_loss_sums() -> tuple[Column, Column]:
    """Aggregates over a histogram: the log-likelihood of its positives and of its negatives."""
    p = F.least(F.greatest(F.col("score"), F.lit(PROBABILITY_FLOOR)), F.lit(1 - PROBABILITY_FLOOR))
    return F.sum(F.col("positives") * F.log(p)), F.sum((F.col("rows") - F.col("positives")) * F.log(1 - p))


def weighted_log_loss(scored: DataFrame, weight: Column, by: Sequence[str] = ()) -> DataFrame:
    """Weighted binary cross-entropy; ``weight`` may use n_rows and n_positive. Runs on the score histogram."""
    histogram = scored.groupBy(*by, "score").agg(
        F.count("*").alias("rows"), F.sum("is_fraud").cast("bigint").alias("positives"))
    hit, miss = log_loss_sums()
    sums = histogram.groupBy(*by).agg(
        F.sum("rows").alias("n_rows"), F.sum("positives").alias("n_positive"), hit.alias("_hit"), miss.alias("_miss"))
    return sums.select(*by, "n_rows", "n_positive", weight.alias("pos_weight"),
                       (-(weight * F.col("_hit") + F.col("_miss")) / F.col("n_rows")).alias("weighted_bce"))


def balance_weight() -> Column:
    return (F.col("n_rows") - F.col("n_positive")) / F.greatest(F.col("n_positive"), F.lit(1))


def evaluate(scored: DataFrame, reviews_per_day: float, by: Sequence[str] = ("model", "fold"),
             ranked: DataFrame | None = None) -> DataFrame:
    """The full result row per group: curve areas, loss, headline top-K, and the capacity operating point.

    ``ranked`` are the ``ranked_scores`` when a caller has them.
    """
    by = list(by)
    # One stored order serves the ranks and, grouped by score, the cumulative histogram.
    in_head = (F.col("is_fraud") == 1) & (F.col("rank") <= multiple_k(HEADLINE_MULTIPLE))
    ranked = ranked_scores(scored, by) if ranked is None else ranked
    histogram = histogram_of_ranks(ranked, by, count_where(in_head).alias("head_hits"))
    days = days_between(F.col("first_step"), F.col("last_step"))
    k = capacity_k(days, F.lit(float(reviews_per_day)), F.col("total_rows"))
    at = _inside_step(k)
    hit, miss = log_loss_sums()
    joined = histogram.groupBy(*by).agg(
        F.max("total_rows").alias("total_rows"), F.max("total_positives").alias("total_positives"),
        average_precision().alias("pr_auc"), roc_auc().alias("roc_auc"), hit.alias("_hit"), miss.alias("_miss"),
        F.max(k).alias("capacity_k"), F.max(F.when(at, F.col("score"))).alias("capacity_threshold"),
        F.max(F.when(at, F.col("cum_rows"))).alias("_flagged"),
        F.max(F.when(at, F.col("cum_positives"))).alias("_caught"),
        F.max(multiple_k(HEADLINE_MULTIPLE)).alias("k"), F.sum("head_hits").alias("_hits"),
    )
    rows, fraud = F.col("total_rows"), F.col("total_positives")
    weight = (rows - fraud) / F.greatest(fraud, F.lit(1))
    return joined.select(
        *by, "pr_auc", "roc_auc",
        (-(weight * F.col("_hit") + F.col("_miss")) / rows).alias("weighted_bce"),
        ratio(F.col("_hits"), F.col("k")).alias("precision_at_k"),
        ratio(F.col("_hits"), fraud).alias("recall_at_k"),
        "k", fraud.alias("n_test_fraud"), "capacity_k", "capacity_threshold",
        ratio(F.col("_caught"), F.col("_flagged")).alias("capacity_precision"),
        ratio(F.col("_caught"), fraud).alias("capacity_recall"),
        ratio(F.col("_flagged"), rows).alias("capacity_alert_rate"),
        (F.col("_flagged") - F.col("_caught")).alias("capacity_false_positives"),
        (fraud - F.col("_caught")).alias("capacity_false_negatives"),
    )
