"""Analyst feedback, and how sure a comparison between models is."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskmill.functions.hashing import hash_bucket
from riskmill.functions.numeric import count_where, ratio
from riskmill.lineage import cut_lineage
from riskmill.operators.ranking import cumulative_histogram, ordered_parts

LABELS = {"CONFIRMED_FRAUD": 1, "FALSE_POSITIVE": 0}
# Cumulative probabilities of a Poisson variable with mean 1, up to where no 32-bit uniform number lies above.
POISSON_ONE = tuple(math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(13))
assert POISSON_ONE[-1] > 1 - 2.0 ** -32


def labelled_predictions(predictions: DataFrame, feedback: DataFrame, key: str = "row_id") -> DataFrame:
    """Predictions with the latest verdict an analyst gave; those without feedback are left out."""
    latest = feedback.groupBy(key).agg(
        F.max_by("label", F.struct("ts", "label")).alias("label"), F.count("*").alias("n_verdicts"))
    verdict = F.lit(None).cast("int")
    for name, value in LABELS.items():
        verdict = F.when(F.col("label") == name, value).otherwise(verdict)
    return predictions.join(latest, key).withColumn("confirmed", verdict)


def poisson_weight(seed: int, row_id: Column, replicate: Column) -> Column:
    """How often a bootstrap replicate draws the row; a function of the ids only, so every run agrees."""
    digest = F.md5(F.concat_ws("-", F.lit(str(seed)), replicate.cast("string"), row_id.cast("string")))
    uniform = hash_bucket(digest, 8) / F.lit(float(16 ** 8))
    weight = F.lit(0)
    for bound in POISSON_ONE:
        weight = weight + (uniform > bound).cast("int")
    return weight


def bootstrap_precision(flagged: DataFrame, replicates: int, seed: int, by: Sequence[str] = (),
                        label: str = "is_fraud") -> DataFrame:
    """Precision of the queue per bootstrap replicate; replicates combine map-side."""
    drawn = flagged.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))) \
        .withColumn("w", poisson_weight(seed, F.col("row_id"), F.col("replicate")))
    return drawn.groupBy(*by, "replicate").agg(
        F.sum("w").alias("n_drawn"),
        ratio(F.sum(F.col("w") * F.col(label)), F.sum("w")).alias("precision"))


def bootstrap_at_capacity(scored: DataFrame, k: int, replicates: int, seed: int, label: str = "is_fraud",
                          spare: float = 10.0) -> DataFrame:
    """(replicate, threshold, n_flagged, precision): each replicate draws the rows anew and finds its own threshold, the
    score at which the rows drawn reach the team's capacity ``k``.

    Rows below the k-th score by more than chance allows can't matter, so weights are drawn for the highest scores only;
    should a replicate not reach k there, more scores are taken, up to all. Each score gets the sums of all replicates as
    columns, one pass without copies of rows; running sums over range partitions find the thresholds. A replicate that
    draws fewer than k rows of all flags them all and has no threshold.
    """
    wanted = k
    while True:
        wanted = wanted + math.ceil(spare * math.sqrt(wanted)) + 100
        histogram = cumulative_histogram(scored)
        at = (F.col("cum_rows") - F.col("rows") < wanted) & (F.col("cum_rows") >= wanted)
        lowest = histogram.where(at).select("score").first()
        top = scored if lowest is None else scored.where(F.col("score") >= lowest.score)
        made = cut_lineage(_replicate_points(top, k, replicates, seed, label))
        if lowest is None or not made.where("threshold is null").take(1):
            return made
        spare *= 4


def _replicate_points(rows: DataFrame, k: int, replicates: int, seed: int, label: str) -> DataFrame:
    numbers = range(1, replicates + 1)
    drawn = cut_lineage(rows.select("score", F.col(label).alias("_label"), F.transform(
        F.sequence(F.lit(1), F.lit(replicates)), lambda r: poisson_weight(seed, F.col("row_id"), r)).alias("w")))
    by_score = drawn.groupBy("score").agg(
        *[F.sum(F.col("w")[r - 1]).alias(f"w{r}") for r in numbers],
        *[F.sum(F.col("w")[r - 1] * F.col("_label")).alias(f"p{r}") for r in numbers])
    placed = ordered_parts(by_score, [F.desc("score")])
    names = [f"{kind}{r}" for r in numbers for kind in "wp"]
    above = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(*[F.sum(n).alias(n) for n in names]).select(
        "_part", *[F.coalesce(F.sum(n).over(above), F.lit(0)).alias(f"{n}_above") for n in names])
    upto = Window.partitionBy("_part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = placed.select("_part", "score", *[F.col(f"w{r}").alias(f"own{r}") for r in numbers],
                            *[F.sum(n).over(upto).alias(n) for n in names]).join(offsets, "_part") \
        .select("score", *[F.col(f"own{r}") for r in numbers], *[(F.col(n) + F.col(f"{n}_above")).alias(n) for n in names])
    found = running.agg(*[entry for r in numbers for hit in [(F.col(f"w{r}") >= k) & (F.col(f"w{r}") - F.col(f"own{r}") < k)] for entry in (
        F.max(F.when(hit, F.col("score"))).alias(f"t{r}"),
        F.coalesce(F.max(F.when(hit, F.col(f"w{r}"))), F.max(f"w{r}"), F.lit(0)).alias(f"n{r}"),
        F.coalesce(F.max(F.when(hit, F.col(f"p{r}"))), F.max(f"p{r}"), F.lit(0)).alias(f"c{r}"))])
    entries = F.array(*[F.struct(F.lit(r).alias("replicate"), F.col(f"t{r}").alias("threshold"), F.col(f"n{r}").cast("bigint").alias("n_flagged"),
                                 ratio(F.col(f"c{r}"), F.col(f"n{r}")).alias("precision")) for r in numbers])
    return found.select(F.inline(entries))


def interval(replicated: DataFrame, by: Sequence[str] = (), coverage: float = 0.95) -> DataFrame:
    """Percentile interval over the replicates, of which there are few."""
    tail = (1 - coverage) / 2
    return replicated.groupBy(*by).agg(
        F.avg("precision").alias("mean"),
        F.expr(f"percentile(precision, {tail!r}D)").alias("low"),
        F.expr(f"percentile(precision, {1 - tail!r}D)").alias("high"))


def mcnemar(left: DataFrame, right: DataFrame, by: Sequence[str] = (), key: str = "row_id") -> DataFrame:
    """Rows on which only one of two models is right, and the continuity-corrected statistic."""
    keys = [*by, key]
    joined = left.select(*keys, F.col("correct").alias("a")).join(right.select(*keys, F.col("correct").alias("b")), keys)
    only_a, only_b = count_where(F.col("a") & ~F.col("b")), count_where(F.col("b") & ~F.col("a"))
    gap = F.greatest(F.abs(F.col("only_left") - F.col("only_right")) - 1, F.lit(0))
    return joined.groupBy(*by).agg(
        count_where(F.col("a") & F.col("b")).alias("both"), only_a.alias("only_left"), only_b.alias("only_right"),
        count_where(~F.col("a") & ~F.col("b")).alias("neither"),
    ).withColumn("statistic", ratio(gap * gap, F.col("only_left") + F.col("only_right")))
