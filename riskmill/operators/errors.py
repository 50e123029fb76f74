"""What the review queue contains and where missed fraud sits in the ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmill.functions.features import FEATURES
from riskmill.functions.numeric import count_where, ratio
from riskmill.operators.ranking import exact_median_of_ranks, global_rank

GROUPS = ("true_positive", "false_positive", "false_negative")


def queue_groups(flagged: Column, label: str = "is_fraud") -> dict[str, Column]:
    fraud = F.col(label) == 1
    return {"true_positive": flagged & fraud, "false_positive": flagged & ~fraud, "false_negative": ~flagged & fraud}


def segment_profile(rows: DataFrame, flagged: Column, names: Sequence[str] = FEATURES, by: Sequence[str] = (),
                    label: str = "is_fraud") -> DataFrame:
    """Per feature: overall mean, size and mean of each queue group, and gaps in units of the sample deviation.

    One wide aggregate per group of rows, turned to one row per feature only afterwards.
    """
    groups = queue_groups(flagged, label)
    wide = []
    for name in names:
        value = F.col(name).cast("double")
        wide.append(F.struct(
            F.avg(value).alias("overall_mean"), F.stddev_samp(value).alias("_std"),
            *[F.avg(F.when(inside, value)).alias(f"{group}_mean") for group, inside in groups.items()],
        ).alias(name))
    sizes = [count_where(inside).alias(f"{group}_n") for group, inside in groups.items()]
    totals = rows.groupBy(*by).agg(*sizes, *wide)
    entries = [F.struct(F.lit(name).alias("feature"), F.col(name).alias("s")) for name in names]
    long = totals.select(*by, *[f"{group}_n" for group in GROUPS], F.inline(F.array(*entries)))
    return long.select(
        *by, "feature", "s.overall_mean",
        *[column for group in GROUPS for column in (F.col(f"{group}_n"), F.col(f"s.{group}_mean"))],
        ratio(F.col("s.false_positive_mean") - F.col("s.true_positive_mean"), F.col("s._std")).alias("fp_vs_tp_std_gap"),
        ratio(F.col("s.false_negative_mean") - F.col("s.true_positive_mean"), F.col("s._std")).alias("fn_vs_tp_std_gap"),
    )


def by_gap(profile: DataFrame) -> DataFrame:
    """Largest false-positive gap first; undefined gaps last."""
    return profile.orderBy(F.abs("fp_vs_tp_std_gap").desc_nulls_last(), "feature")


def queue_composition(rows: DataFrame, flagged: Column, by: Sequence[str] = (), label: str = "is_fraud") -> DataFrame:
    return rows.groupBy(*by).agg(
        *[count_where(inside).alias(f"{group}_n") for group, inside in queue_groups(flagged, label).items()])


def missed_fraud_ranking(scored: DataFrame, flagged_count: Column, by: Sequence[str] = (),
                         ranked: DataFrame | None = None) -> DataFrame:
    """Ranks of the fraud outside the queue. ``flagged_count`` is the number of rows really flagged, ties included.

    A group without fraud yields no row; without misses the rank statistics are NULL. ``ranked`` are the ``global_rank`` rows
    when a caller has them.
    """
    ranked = (global_rank(scored, by) if ranked is None else ranked).withColumn("_k", flagged_count)
    fraud = ranked.where("is_fraud = 1")
    missed = F.col("rank") > F.col("_k")
    stats = fraud.groupBy(*by).agg(
        F.count("*").alias("total_fraud"),
        count_where(~missed).alias("fraud_in_top_k"), count_where(missed).alias("fraud_missed"),
        F.max("total_rows").alias("n_rows"), F.max("_k").cast("bigint").alias("k"),
        F.min(F.when(missed, F.col("rank"))).alias("missed_rank_min"),
        F.max(F.when(missed, F.col("rank"))).alias("missed_rank_max"),
        count_where(missed & (F.col("rank") <= 2 * F.col("_k"))).alias("_near"),
        count_where(missed & (F.col("rank") > F.col("total_rows") / 2)).alias("_far"),
    ).where("total_fraud > 0")
    median = exact_median_of_ranks(fraud.where(missed), by)
    if by:
        joined = stats.join(median, list(by), "left")
    else:
        joined = stats.withColumn("median_rank", median.select(F.max("median_rank")).scalar())
    some = F.col("fraud_missed") > 0
    return joined.select(
        *by, "total_fraud", "fraud_in_top_k", "fraud_missed", "n_rows", "k",
        "missed_rank_min", F.col("median_rank").alias("missed_rank_median"), "missed_rank_max",
        F.floor("median_rank").cast("bigint").alias("k_to_catch_half_of_missed"),
        F.col("missed_rank_max").alias("k_to_catch_all_missed"),
        F.when(some, F.col("_near")).alias("missed_within_2x_k"),
        F.when(some, F.col("_far")).alias("missed_in_bottom_half"),
    )
