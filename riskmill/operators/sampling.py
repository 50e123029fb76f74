"""Repeatable samples with exact sizes, without a global sort.

Rows are ordered by a seeded digest of their id. A histogram over the leading digits of the digest tells in which
bucket the quota is reached; that bucket's digests are stored and cut again by their next digits, and only the bucket
reached there is ranked, which yields one cutoff digest per group. The sample is then a plain filter over the rows:
nothing wide is shuffled and nothing is gathered in one task. The histogram and the cut read stored keys (group, class and
digest), so the rows themselves are read twice: for their keys and by the filter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskmill.functions.hashing import hash_bucket, hash_key
from riskmill.lineage import cut_lineage

# Hex digits of the first and the second histogram: of 10^12 rows about 15 million are stored and 60 are ranked.
BUCKET_DIGITS, FINE_DIGITS = 4, 5


def _cutoffs(keyed: DataFrame, by: list[str], quota: Column) -> DataFrame:
    """Per (by, class): the largest digest that still belongs to the sample."""
    groups = [*by, "_class"]
    along = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    overall = Window.partitionBy(*by)
    histogram = keyed.groupBy(*groups, "_bucket").agg(F.count("*").alias("_n"))
    reached = (
        histogram
        .withColumn("positives", F.coalesce(F.sum(F.when(F.col("_class") == 1, F.col("_n"))).over(overall), F.lit(0)))
        .withColumn("negatives", F.coalesce(F.sum(F.when(F.col("_class") == 0, F.col("_n"))).over(overall), F.lit(0)))
        .withColumn("_need", quota - F.coalesce(F.sum("_n").over(along), F.lit(0)))
        .where("_need > 0")
        .groupBy(*groups).agg(F.max_by(F.struct("_bucket", "_need"), "_bucket").alias("_edge"))
        .select(*groups, "_edge._bucket", "_edge._need")
    )
    position = F.row_number().over(Window.partitionBy(*groups).orderBy("_digest"))
    fine = F.conv(F.substring("_digest", BUCKET_DIGITS + 1, FINE_DIGITS), 16, 10).cast("bigint")
    near = cut_lineage(keyed.select(*groups, "_bucket", "_digest").join(F.broadcast(reached), [*groups, "_bucket"])
                       .withColumn("_fine", fine).drop("_bucket"))
    inner = Window.partitionBy(*groups).orderBy("_fine").rowsBetween(Window.unboundedPreceding, -1)
    last = near.groupBy(*groups, "_fine").agg(F.count("*").alias("_n"), F.first("_need").alias("_need")) \
        .withColumn("_need", F.col("_need") - F.coalesce(F.sum("_n").over(inner), F.lit(0))).where("_need > 0") \
        .groupBy(*groups).agg(F.max_by(F.struct("_fine", "_need"), "_fine").alias("_edge")) \
        .select(*groups, "_edge._fine", "_edge._need")
    edge = near.drop("_need").join(F.broadcast(last), [*groups, "_fine"])
    return edge.withColumn("_at", position).where("_at <= _need").groupBy(*groups).agg(F.max("_digest").alias("_last"))


def _keep(rows: DataFrame, label: Column, quota: Column, seed: int, by: Sequence[str], row_id: str) -> DataFrame:
    """``by`` must be labels of a small fixed set such as folds: each group is one row of the broadcast cutoffs."""
    keyed = (
        rows.withColumn("_class", label.cast("int"))
        .withColumn("_digest", hash_key(seed, row_id))
        .withColumn("_bucket", hash_bucket(F.col("_digest"), BUCKET_DIGITS))
    )
    cutoffs = _cutoffs(cut_lineage(keyed.select(*by, "_class", "_bucket", "_digest")), list(by), quota)
    return keyed.join(F.broadcast(cutoffs), [*by, "_class"]).where("_digest <= _last").select(*rows.columns)


def sample_rows(rows: DataFrame, size: int, seed: int, by: Sequence[str] = (), row_id: str = "row_id") -> DataFrame:
    """Exactly ``size`` rows per group (all rows of a smaller group)."""
    return _keep(rows, F.lit(0), F.lit(int(size)), seed, by, row_id)


def sample_classes(rows: DataFrame, positive_quota: Column, negative_quota: Column, seed: int,
                   by: Sequence[str] = (), label: str = "isFraud", row_id: str = "row_id") -> DataFrame:
    """Exact per-class sample; quotas may refer to the group's ``positives`` and ``negatives`` counts."""
    quota = F.when(F.col("_class") == 1, positive_quota).otherwise(negative_quota)
    return _keep(rows, F.col(label), quota, seed, by, row_id)


def undersample_negatives(rows: DataFrame, per_positive: float, seed: int, by: Sequence[str] = (),
                          label: str = "isFraud") -> DataFrame:
    """All positives and at most floor(positives * per_positive) negatives. For training rows only."""
    wanted = F.floor(F.col("positives") * F.lit(float(per_positive))).cast("bigint")
    return sample_classes(rows, F.col("positives"), F.least(F.col("negatives"), wanted), seed, by, label)


def stratified_sample(rows: DataFrame, size: int, seed: int, label: str = "isFraud") -> DataFrame:
    """Half positives, or all there are, and other rows up to ``size``."""
    positives = F.least(F.lit(size // 2), F.col("positives"))
    return sample_classes(rows, positives, F.lit(size) - positives, seed, label=label)


def all_positives_filled(rows: DataFrame, size: int, seed: int, label: str = "isFraud", grow: bool = False) -> DataFrame:
    """Every positive and random other rows up to ``size``. When positives alone exceed it, they are the sample if it
    may ``grow``; otherwise that fails."""
    if grow:
        positives = F.col("positives")
        return sample_classes(rows, positives, F.lit(size) - positives, seed, label=label)
    too_many = F.raise_error(F.lit(f"positives exceed the sample size {size}")).cast("bigint")
    positives = F.when(F.col("positives") > size, too_many).otherwise(F.col("positives"))
    return sample_classes(rows, positives, F.lit(size) - positives, seed, label=label)
