"""Mixing sources to target weights by a curriculum that changes over the training run. DataFrame only.

1. Targets. Sources in code-point order (null last) weigh 1, 2, 3, 1, ... of all words; a target ends at three times
   what its source has, and the excess goes to the others by weight until none is above (``source_targets``).
2. Demand. A source's schedule says how its share of the mix moves over the run, as a piecewise linear weight over
   time 0 to 1. Its integral is the part of the target demanded so far (``Schedule``).
3. Positions. A source's documents follow each other in a seeded order. The words before a document, divided by the
   target, are put into the inverse of the demand; the result is the training time at which the document is read.
   When the target exceeds the source, its documents come again in the next round over the source.
4. Order. A range sort by that time gives the training sequence.

Whole words are taken: the document in which a source's demand ends contributes the words up to that end, so sources
meet their targets to within one word. ``training_rows`` emits whole documents instead, the last one included.

Words before a document: hash ranges of the seeded order are summed first, and blocks of ``1 << BLOCK_BITS`` ranges from
these. Running sums go over a source's blocks, over the ranges of each block and inside each range. A range holds about
``RANGE_ROWS`` rows whatever a source's share is, so a million documents of a source are one row of the only running sum
that takes a source whole.

A very long text counts in full; only its number of words is stored and shuffled.

Null texts have no words. Null ids are ordered before all others. Rows that repeat an id are documents of their own.
An empty table, or one without words, has targets of 0. Further columns are ignored or carried along.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskmill.lineage import cut_lineage
from riskmill.llm.common import global_index, match, repeat_rows, whole_text, word_count

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
RANGE_ROWS = 1024
BLOCK_BITS = 10
SEED = 9


@dataclass(frozen=True)
class Schedule:
    """Weight over training time: straight lines between (time, weight) knots from time 0 to time 1."""

    knots: tuple[tuple[float, float], ...]

    def __post_init__(self) -> None:
        times = [t for t, _ in self.knots]
        if times[0] != 0.0 or times[-1] != 1.0 or any(a >= b for a, b in zip(times, times[1:])):
            raise ValueError("knots must lead from time 0 to time 1")
        if any(w < 0 for _, w in self.knots) or any(a + b <= 0 for (_, a), (_, b) in zip(self.knots, self.knots[1:])):
            raise ValueError("weights must be positive inside every segment")

    def segments(self) -> list[tuple[float, float, float, float, float]]:
        """(start time, weight there, slope, demand before, demand at the end), demand as part of the whole."""
        whole = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(self.knots, self.knots[1:]))
        out, before = [], 0.0
        for (t0, w0), (t1, w1) in zip(self.knots, self.knots[1:]):
            after = before + (t1 - t0) * (w0 + w1) / 2 / whole
            out.append((t0, w0 / whole, (w1 - w0) / (t1 - t0) / whole, before, after))
            before = after
        return out

    def time_of(self, demand: Column) -> Column:
        """The time by which this part of the whole is demanded: the root of each segment's quadratic."""
        found = None
        for start, weight, slope, before, after in reversed(self.segments()):
            rest = demand - F.lit(before)
            time = F.lit(start) + F.lit(2.0) * rest / (
                F.lit(weight) + F.sqrt(F.lit(weight * weight) + F.lit(2.0 * slope) * rest))
            time = F.when(rest <= 0, F.lit(start)).otherwise(time)
            found = time if found is None else F.when(demand < after, time).otherwise(found)
        return found


# One schedule for each weight: small sources early, middle ones throughout, large ones late.
CURRICULUM = (Schedule(((0.0, 1.5), (1.0, 0.5))), Schedule(((0.0, 1.0), (1.0, 1.0))), Schedule(((0.0, 0.5), (1.0, 1.5))))


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size) with weight_no, weight and target.

    The level (words per weight) rises while sources reach their limits; each round asks the table for two sums.
    """
    numbered = global_index(sources, F.col("source").asc_nulls_last(), name="source_no") \
        .withColumn("weight_no", (F.col("source_no") % len(weights)).cast("int"))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), F.col("weight_no") + 1)
    numbered = cut_lineage(numbered.withColumn("weight", weight.cast("bigint")))
    total = numbered.agg(F.sum("source_size")).first()[0] or 0
    most = F.col("source_size") * repeats
    level, above = 0.0, None
    while True:
        full = F.lit(level) * F.col("weight") > most
        sums = numbered.agg(F.sum(F.when(full, most)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("open"),
                            F.count(F.when(full, 1)).alias("full")).first()
        if sums.full == above or not sums.open:
            break
        above, level = sums.full, (total - (sums.held or 0)) / sums.open
    target = F.lit(level) * F.col("weight")
    return numbered.withColumn("target", F.when(target > most, most.cast("double")).otherwise(target)).drop("source_no")


def assign(docs: DataFrame, weights: Sequence[int] = WEIGHTS, curriculum: Sequence[Schedule] = CURRICULUM,
           repeats: int = MOST_REPEATS, range_rows: int = RANGE_ROWS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, need, before, taken, position.

    need: the source's target in whole words; before: its words ahead of the document; position: when the document
    is first read, null if it isn't.
    """
    if len(weights) != len(curriculum):
        raise ValueError("each weight needs a schedule")
    rows = cut_lineage(docs.select("doc_id", "source", word_count(whole_text()).alias("size")))
    ranges = max(1, -(-rows.count() // range_rows))
    order = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))),
                               1, 8), 16, 10).cast("bigint")
    keyed = rows.select("*", F.isnull("source").alias("no_source"), F.coalesce("source", F.lit("")).alias("source_key"),
                        order.alias("order_key")) \
        .withColumn("range", F.shiftright(F.col("order_key") * ranges, 32))
    key = ["no_source", "source_key", "range"]
    sums = cut_lineage(keyed.groupBy(*key).agg(F.sum("size").alias("range_size")))
    sources = sums.groupBy("no_source", "source_key").agg(F.sum("range_size").alias("source_size")) \
        .select(F.when(~F.col("no_source"), F.col("source_key")).alias("source"), "source_size")
    targets = source_targets(sources, weights, repeats).select(
        F.isnull("source").alias("no_source"), F.coalesce("source", F.lit("")).alias("source_key"),
        "source_size", "weight_no", "target")
    starts = cut_lineage(_range_starts(sums).join(targets, ["no_source", "source_key"]))
    inside = Window.partitionBy(*key).orderBy("order_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.join(starts, key) \
        .withColumn("before", F.col("range_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))) \
        .withColumn("need", F.floor(F.col("target") + 0.5))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("need") / F.greatest("source_size", F.lit(1)))).otherwise(0)
    rest = F.col("need") - F.col("rounds") * F.col("source_size") - F.col("before")
    placed = placed.withColumn("rounds", whole).withColumn(
        "taken", F.col("rounds") * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size"))))
    return placed.withColumn("position", F.when(F.col("taken") > 0, position_of(F.col("before"), curriculum))).select(
        "doc_id", "source", "size", "source_size", "weight_no", "target", "need", "before", "taken", "position")


def _range_starts(sums: DataFrame) -> DataFrame:
    """The words of the source before each range: those of earlier blocks and of earlier ranges in its block."""
    source = ["no_source", "source_key"]
    blocked = sums.withColumn("block", F.shiftright("range", BLOCK_BITS))
    ahead = Window.partitionBy(*source).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocked.groupBy(*source, "block").agg(F.sum("range_size").alias("block_size")) \
        .select(*source, "block", F.coalesce(F.sum("block_size").over(ahead), F.lit(0)).alias("block_start"))
    within = Window.partitionBy(*source, "block").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("block_start") + F.coalesce(F.sum("range_size").over(within), F.lit(0))
    return blocked.join(blocks, [*source, "block"]).select(*source, "range", start.alias("range_start"))


def position_of(words_before: Column, curriculum: Sequence[Schedule]) -> Column:
    """Training time of a document that has so many words of its source's demand before it."""
    part = words_before.cast("double") / F.greatest(F.col("need"), F.lit(1)).cast("double")
    found = curriculum[-1].time_of(part)
    for number in range(len(curriculum) - 2, -1, -1):
        found = F.when(F.col("weight_no") == number, curriculum[number].time_of(part)).otherwise(found)
    return found


def mixed(docs: DataFrame, curriculum: Sequence[Schedule] = CURRICULUM, **options) -> DataFrame:
    """``assign`` in training order; documents that are not taken come last."""
    return assign(docs, curriculum=curriculum, **options).orderBy(
        F.col("position").asc_nulls_last(), F.col("doc_id"), F.col("size"))


def training_rows(docs: DataFrame, curriculum: Sequence[Schedule] = CURRICULUM, **options) -> DataFrame:
    """The documents in training order with their own columns, one row each time one is read, always whole.

    The document in which a source's demand ends is read to its end. Rows that repeat id and source share the words
    taken for them: each is read as often as the most read of them.
    """
    plan = assign(docs, curriculum=curriculum, **options).where("taken > 0")
    plan = plan.groupBy("doc_id", "source", "size").agg(
        F.max(F.ceil(F.col("taken") / F.col("size"))).alias("times"), F.min("before").alias("before"),
        F.first("source_size").alias("source_size"), F.first("need").alias("need"), F.first("weight_no").alias("weight_no"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), word_count(whole_text()).alias("size")) \
        .select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), "size")
    met = match(rows, plan, ["doc_id", "source", "size"], "inner")
    read = repeat_rows(met, "times", "round")
    position = position_of(F.col("before") + F.col("round") * F.col("source_size"), curriculum)
    return read.select("row", position.alias("position"), "doc_id") \
        .repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id").select("row.*")
