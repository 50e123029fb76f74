"""Global ranks and cumulative score histograms without a single-task sort.

Rows are range-partitioned by their place in the order, the partitions are stored and counted, and each gets the rows
before it as an offset to a window of its own. Partitions follow the row count, with at least as many as a shuffle
has, so their size is bounded at any scale, and small tables take the same way as large ones. Equal scores are ordered
by row id and may lie in several partitions. Boundaries come from a sample; offsets are counted, so results are exact.

Scores must be neither NULL nor NaN.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskmill.lineage import cut_lineage

PART_ROWS = 250_000


def ordered_parts(rows: DataFrame, order: Sequence[Column], part_rows: int = PART_ROWS) -> DataFrame:
    """The rows, stored in range partitions of ``order``, with the number of their partition as ``_part``.

    What they are made from runs once: counting and the sample of the boundaries read the stored rows.
    """
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stored = cut_lineage(rows)
    parts = max(least, math.ceil(stored.count() / part_rows))
    return cut_lineage(stored.repartitionByRange(parts, *order)).withColumn("_part", F.spark_partition_id())


def cumulative_histogram(scored: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "is_fraud",
                         part_rows: int = PART_ROWS) -> DataFrame:
    """One row per (group, distinct score): rows, positives, and both accumulated from the highest score down.

    Group totals (rows, positives, step range when there is a ``step``) ride along on the offsets, so nothing is ever
    shuffled by the group alone.
    """
    by = list(by)
    stepped = "step" in scored.columns
    span = [F.min("step").alias("first_step"), F.max("step").alias("last_step")] if stepped else []
    histogram = ordered_parts(scored.groupBy(*by, F.col(score).alias("score")).agg(
        F.count("*").alias("rows"), F.sum(label).cast("bigint").alias("positives"), *span),
        [*map(F.col, by), F.desc("score")], part_rows)

    higher = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*by)
    span = [F.min("first_step").alias("first_step"), F.max("last_step").alias("last_step")] if stepped else []
    offsets = histogram.groupBy(*by, "_part").agg(
        F.sum("rows").alias("_rows"), F.sum("positives").alias("_positives"), *span,
    )
    spans = [F.min("first_step").over(everything).alias("first_step"),
             F.max("last_step").over(everything).alias("last_step")] if stepped else []
    offsets = offsets.select(
        *by, "_part",
        F.coalesce(F.sum("_rows").over(higher), F.lit(0)).alias("_rows_above"),
        F.coalesce(F.sum("_positives").over(higher), F.lit(0)).alias("_positives_above"),
        F.sum("_rows").over(everything).alias("total_rows"),
        F.sum("_positives").over(everything).alias("total_positives"),
        *spans,
    )
    inside = Window.partitionBy(*by, "_part").orderBy(F.desc("score")) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = histogram.select(
        *by, "_part", "score", "rows", "positives",
        F.sum("rows").over(inside).alias("_rows"), F.sum("positives").over(inside).alias("_positives"),
    )
    return local.join(offsets, [*by, "_part"]).select(
        *by, "score", "rows", "positives",
        (F.col("_rows") + F.col("_rows_above")).alias("cum_rows"),
        (F.col("_positives") + F.col("_positives_above")).alias("cum_positives"),
        "total_rows", "total_positives", *(["first_step", "last_step"] if stepped else []),
    )


def ranked_scores(scored: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "is_fraud",
                  part_rows: int = PART_ROWS) -> DataFrame:
    """Adds ``rank`` (1 = highest score, ties by row_id), ``positives_so_far`` (this row's included), the group's
    total_rows and total_positives, and its step range when there is a ``step``."""
    by = list(by)
    order = [F.desc(score), F.asc("row_id")]
    placed = ordered_parts(scored, [*map(F.col, by), *order], part_rows)
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*by)
    ends = [(F.min, "first_step"), (F.max, "last_step")] if "step" in scored.columns else []
    offsets = placed.groupBy(*by, "_part").agg(
        F.count("*").alias("_rows"), F.sum(label).cast("bigint").alias("_positives"),
        *[end("step").alias(name) for end, name in ends]).select(
        *by, "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
        F.coalesce(F.sum("_positives").over(before), F.lit(0)).alias("_positives_above"),
        F.sum("_rows").over(everything).alias("total_rows"),
        F.sum("_positives").over(everything).alias("total_positives"),
        *[end(name).over(everything).alias(name) for end, name in ends])
    inside = Window.partitionBy(*by, "_part").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.withColumn("_position", F.row_number().over(inside)).withColumn("_positives", F.sum(label).over(upto))
    return local.join(offsets, [*by, "_part"]).select(
        *[F.col(name) for name in scored.columns], (F.col("_position") + F.col("_offset")).cast("bigint").alias("rank"),
        (F.col("_positives") + F.col("_positives_above")).cast("bigint").alias("positives_so_far"),
        "total_rows", "total_positives", *[name for _, name in ends])


def global_rank(scored: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "is_fraud",
                part_rows: int = PART_ROWS) -> DataFrame:
    """Adds ``rank`` (1 = highest score, ties by row_id) and the group's total_rows and total_positives."""
    ranked = ranked_scores(scored, by, score, label, part_rows)
    return ranked.select(*[F.col(name) for name in scored.columns], "rank", "total_rows", "total_positives")


def histogram_of_ranks(ranked: DataFrame, by: Sequence[str] = (), *more: Column) -> DataFrame:
    """The cumulative histogram from ``ranked_scores``: a score's last rank says how many rows reach it. No second order.

    ``more`` are further aggregates over the rows of a score.
    """
    ends = [name for name in ("first_step", "last_step") if name in ranked.columns]
    return ranked.groupBy(*by, "score").agg(
        F.count("*").alias("rows"), F.sum("is_fraud").cast("bigint").alias("positives"), F.max("rank").alias("cum_rows"),
        F.max("positives_so_far").alias("cum_positives"),
        *[F.max(name).alias(name) for name in ("total_rows", "total_positives", *ends)], *more)


def exact_median_of_ranks(ranked: DataFrame, by: Sequence[str] = (), slot_rows: int = PART_ROWS) -> DataFrame:
    """Median of distinct positions 1..total_rows per group, without gathering them in one task.

    Positions are different integers, so a slot of ``slot_rows`` positions has no more rows, whatever the total.
    """
    by = list(by)
    slots = ranked.select(*by, "rank", F.floor(F.col("rank") / slot_rows).alias("_slot"))
    earlier = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slots.groupBy(*by, "_slot").agg(F.count("*").alias("_rows")).select(
        *by, "_slot", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy(*by)).alias("_all"))
    position = F.row_number().over(Window.partitionBy(*by, "_slot").orderBy("rank"))
    placed = slots.withColumn("_at", position).join(offsets, [*by, "_slot"])
    at, middle = F.col("_at") + F.col("_before"), (F.col("_all") + 1) / 2
    return placed.where((at == F.floor(middle)) | (at == F.ceil(middle))) \
        .groupBy(*by).agg(F.avg("rank").alias("median_rank"))
