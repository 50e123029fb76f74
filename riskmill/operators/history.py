"""Destination history features, safe for destinations that own a large share of all rows.

Two frames over each destination's past:

* all rows before the current one in (step, row_id) order - feeds the prior count and prior average;
* all rows of the preceding 24 steps, excluding every row of the current step.

An ordinary destination is one window partition. A *hot* destination (more than ``hot_rows`` rows) is cut into
cells of one step and one block of row ids. Row ids are unique, so a cell holds at most ``row_block`` rows. What a
cell's rows need from outside the cell comes from pre-aggregated totals, joined on the cell key, which is also the
key the rows are already partitioned and sorted by. The ledger rows are therefore shuffled once in either case.

Hot names are found by a frequent-items sketch and an exact count of its few candidates, not by grouping all names; a
ledger without any takes plain windows.

Size bounds for N ledger rows: fewer than N / hot_rows destinations are hot (the broadcast list: half a million
names for 10^12 rows); the per-step table has at most one row per step of the calendar for each hot destination;
a step has at most one block per ``row_block`` row ids.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskmill.functions.features import FEATURES, amount_to_average, stateless_features
from riskmill.functions.numeric import exact
from riskmill.lineage import cut_lineage
from riskmill.params import VELOCITY_HOURS

HOT_ROWS = 2_000_000
# Three quarters of the slots are used, and Spark's sketch takes at most a million names.
MOST_SLOTS = 1 << 20
ROW_BLOCK = 1 << 20

_CELL = ["nameDest", "cell_step", "cell_block"]


def sketch_slots(rows: int, hot_rows: int) -> int | None:
    """Slots with which a frequent-items sketch reports every name of more than ``hot_rows`` of so many rows.

    A sketch of s slots counts a name up to 3.5 * rows / s too high and reports it when its count is surely above that
    error, thus at twice the error at the latest. None when the largest sketch is too small for that.
    """
    if hot_rows < 1:
        return None
    wanted = 8
    while wanted * hot_rows <= 7 * rows:
        wanted *= 2
    return wanted if wanted <= MOST_SLOTS else None


def hot_destinations(ledger: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """The stored names (hot_dest) of destinations with more than ``hot_rows`` rows; None when there cannot be any.

    A ledger of no more rows has none. Otherwise a mergeable sketch, which combines map-side to a bounded size, names
    the candidates, and only their rows are counted. Beyond what the largest sketch can tell apart all names are counted.
    """
    rows = ledger.count()
    if rows <= hot_rows:
        return None
    slots = sketch_slots(rows, hot_rows)
    counted = ledger.select(F.col("nameDest").alias("hot_dest"))
    if slots is not None:
        tracked = slots * 3 // 4
        # Counts in the sketch are upper bounds, so fewer than this many names can seem hot.
        most = min(tracked, 2 * rows // hot_rows + 1)
        found = counted.agg(F.expr(f"approx_top_k(hot_dest, {most}, {tracked})").alias("found"))
        candidates = cut_lineage(found.select(F.inline("found")).where(F.col("count") > hot_rows).select(F.col("item").alias("hot_dest")))
        if candidates.isEmpty():
            return None
        counted = counted.join(F.broadcast(candidates), "hot_dest", "left_semi")
    hot = cut_lineage(counted.groupBy("hot_dest").count().where(F.col("count") > hot_rows).select("hot_dest"))
    return None if hot.isEmpty() else hot


def _block(row_block: int) -> Column:
    return F.expr(f"row_id DIV {int(row_block)}")


def _cell_offsets(ledger: DataFrame, hot: DataFrame, row_block: int) -> DataFrame:
    """For each cell of a hot destination: what lies before it, and in the 24 steps before its step."""
    rows = ledger.select("nameDest", "step", "row_id", "amount")
    cells = (
        rows.join(F.broadcast(hot), F.col("nameDest") == F.col("hot_dest"), "left_semi")
        .groupBy("nameDest", "step", _block(row_block).alias("cell_block"))
        .agg(F.count("*").alias("rows"), F.sum(exact("amount")).alias("total"))
    )
    calendar = Window.partitionBy("nameDest").orderBy("step")
    before = calendar.rowsBetween(Window.unboundedPreceding, -1)
    recent = calendar.rangeBetween(-VELOCITY_HOURS, -1)
    steps = (
        cells.groupBy("nameDest", "step").agg(F.sum("rows").alias("rows"), F.sum("total").alias("total"))
        .select(
            "nameDest", "step",
            F.sum("rows").over(before).alias("step_rows"), F.sum("total").over(before).alias("step_total"),
            F.sum("rows").over(recent).alias("recent_rows"), F.sum("total").over(recent).alias("recent_total"),
        )
    )
    within = Window.partitionBy("nameDest", "step").orderBy("cell_block").rowsBetween(Window.unboundedPreceding, -1)
    return (
        cells.withColumn("block_rows", F.sum("rows").over(within))
        .withColumn("block_total", F.sum("total").over(within))
        .join(steps, ["nameDest", "step"])
        .select(
            "nameDest", F.col("step").alias("cell_step"), "cell_block",
            _plus("step_rows", "block_rows").alias("before_rows"),
            _plus("step_total", "block_total").alias("before_total"),
            "recent_rows", "recent_total",
        )
    )


def _plus(left: str, right: str) -> Column:
    return F.coalesce(F.col(left), F.lit(0)) + F.coalesce(F.col(right), F.lit(0))


def with_history(ledger: DataFrame, hot_rows: int = HOT_ROWS, row_block: int = ROW_BLOCK) -> DataFrame:
    """Every ledger row plus prior_rows, prior_total, recent_rows and recent_total of its destination.

    Without hot destinations this is one shuffle and one sort for both frames, and nothing else.
    """
    hot = hot_destinations(ledger, hot_rows)
    if hot is None:
        return _past(ledger, ["nameDest"]).select(*ledger.columns, *[
            F.coalesce(f"own_{name}", F.lit(0)).alias(shown) for name, shown in
            (("rows", "prior_rows"), ("total", "prior_total"), ("recent_rows", "recent_rows"), ("recent_total", "recent_total"))])
    is_hot = F.col("hot_dest").isNotNull()
    rows = (
        ledger.join(F.broadcast(hot), F.col("nameDest") == F.col("hot_dest"), "left")
        .withColumn("cell_step", F.when(is_hot, F.col("step")).otherwise(F.lit(-1)))
        .withColumn("cell_block", F.when(is_hot, _block(row_block)).otherwise(F.lit(-1)))
        .drop("hot_dest")
    )
    local = _past(rows, _CELL)
    joined = local.join(_cell_offsets(ledger, hot, row_block), _CELL, "left")
    return joined.select(
        *[F.col(name) for name in ledger.columns],
        _plus("own_rows", "before_rows").alias("prior_rows"),
        _plus("own_total", "before_total").alias("prior_total"),
        _plus("own_recent_rows", "recent_rows").alias("recent_rows"),
        _plus("own_recent_total", "recent_total").alias("recent_total"),
    )


def _past(rows: DataFrame, cell: list[str]) -> DataFrame:
    """The rows with counts and totals over the past of their cell."""
    # The row frame comes first: its ordering (step, row_id) also serves the range frame, so one sort is enough.
    past = Window.partitionBy(*cell).orderBy("step", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    recent = Window.partitionBy(*cell).orderBy("step").rangeBetween(-VELOCITY_HOURS, -1)
    return (
        rows.withColumn("own_rows", F.count("*").over(past))
        .withColumn("own_total", F.sum(exact("amount")).over(past))
        .withColumn("own_recent_rows", F.count("*").over(recent))
        .withColumn("own_recent_total", F.sum(exact("amount")).over(recent))
    )


def history_features() -> dict[str, Column]:
    average = F.when(F.col("prior_rows") > 0, F.col("prior_total").cast("double") / F.col("prior_rows")) \
        .otherwise(F.lit(0.0))
    return {
        "dest_prior_txn_count": F.col("prior_rows"),
        "dest_prior_avg_amount": average,
        "dest_amount_to_prior_avg_ratio": amount_to_average(F.col("amount"), average),
        "dest_txn_count_24h": F.col("recent_rows"),
        "dest_amount_sum_24h": F.col("recent_total").cast("double"),
    }


def build_features(ledger: DataFrame, keep: Sequence[str] = ("row_id",), hot_rows: int = HOT_ROWS,
                   row_block: int = ROW_BLOCK) -> DataFrame:
    """step, the kept columns, the eighteen features in canonical order, and the label."""
    made = {**stateless_features(), **history_features()}
    return with_history(ledger, hot_rows, row_block).select(
        *keep, "step", *[made[name].alias(name) for name in FEATURES], "isFraud",
    )


def feature_scan(features: DataFrame, names: Sequence[str] = FEATURES) -> DataFrame:
    """Only the needed columns, with NULL read as zero."""
    return features.select("row_id", "step", *names, "isFraud").na.fill(0)


def leakage_audit(ledger: DataFrame, row_block: int = ROW_BLOCK) -> DataFrame:
    """Restate the four history aggregates by another route and count disagreements with the window features.

    The restatement never pairs rows: each (destination, step) total enters and leaves a running sum, and earlier rows
    are counted from running totals over steps and row-id blocks plus the position inside the block. It is made beside
    the window features, in cells of a destination, step and block, and summed up there: no join by row. A cell of the
    ledger whose rows are missing among the features counts as a disagreement, and so do rows without a cell.
    """
    cell = ["nameDest", "step", "block"]
    cells = ledger.select("nameDest", "step", "amount", _block(row_block).alias("block")).groupBy(*cell).agg(F.count("*").alias("rows"), F.sum(exact("amount")).alias("total"))
    steps = cells.groupBy("nameDest", "step").agg(F.sum("rows").alias("rows"), F.sum("total").alias("total"))

    # A step's total enters the 24-hour sums one step later and leaves them after VELOCITY_HOURS steps: two entries,
    # whose running sum is the window's content.
    none = F.lit(0).cast("bigint"), F.lit(0).cast(steps.schema["total"].dataType)
    changes = steps.select("nameDest", F.inline(F.array(
        F.struct(F.col("step"), "rows", "total", none[0].alias("dr"), none[1].alias("dt")),
        F.struct((F.col("step") + 1).alias("step"), none[0].alias("rows"), none[1].alias("total"),
                 F.col("rows").alias("dr"), F.col("total").alias("dt")),
        F.struct((F.col("step") + VELOCITY_HOURS + 1).alias("step"), none[0].alias("rows"), none[1].alias("total"),
                 (-F.col("rows")).alias("dr"), (-F.col("total")).alias("dt"))))) \
        .groupBy("nameDest", "step").agg(*[F.sum(c).alias(c) for c in ("rows", "total", "dr", "dt")])

    upto_step = Window.partitionBy("nameDest").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    upto_block = Window.partitionBy("nameDest", "step").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    upto_row = Window.partitionBy(*cell).orderBy("row_id").rowsBetween(Window.unboundedPreceding, 0)

    running = changes.select(
        "nameDest", "step", F.col("rows").alias("own"),
        (F.sum("rows").over(upto_step) - F.col("rows")).alias("sr"),
        (F.sum("total").over(upto_step) - F.col("total")).alias("st"),
        F.sum("dr").over(upto_step).alias("r24"), F.sum("dt").over(upto_step).alias("t24"),
    ).where("own > 0").drop("own")
    placed = cells.select(
        *cell,
        (F.sum("rows").over(upto_block) - F.col("rows")).alias("br"),
        (F.sum("total").over(upto_block) - F.col("total")).alias("bt"),
    ).join(running, ["nameDest", "step"])
    own = with_history(ledger).select("row_id", "nameDest", "step", "amount", _block(row_block).alias("block"),
                                      "prior_rows", "prior_total", "recent_rows", "recent_total")
    both = (
        own.withColumn("rr", F.row_number().over(upto_row) - 1)
        .withColumn("rt", F.sum(exact("amount")).over(upto_row) - exact("amount"))
        .join(placed, cell, "full_outer")
        .select(
            "row_id", "prior_rows", "prior_total", "recent_rows", "recent_total",
            (F.coalesce("rr", F.lit(0)) + F.col("br") + F.col("sr")).alias("count_again"),
            (F.coalesce("rt", F.lit(0)) + F.col("bt") + F.col("st")).alias("total_again"),
            F.col("r24").alias("count24_again"),
            F.col("t24").alias("total24_again"),
        )
    )

    def differs(left: str, right: str) -> Column:
        return F.sum(F.when(F.col(left).eqNullSafe(F.col(right)), 0).otherwise(1))

    return both.agg(
        F.count("row_id").alias("rows_checked"),
        # Each destination has one row with nothing before it.
        F.count_if((F.col("count_again") == 0) & F.col("row_id").isNotNull()).alias("destinations"),
        differs("prior_rows", "count_again").alias("prior_count_mismatches"),
        differs("prior_total", "total_again").alias("prior_sum_mismatches"),
        differs("recent_rows", "count24_again").alias("recent_count_mismatches"),
        differs("recent_total", "total24_again").alias("recent_sum_mismatches"),
        F.sum("count_again").alias("prior_count_total"),
        F.sum("count24_again").alias("recent_count_total"),
    )


def structure_profile(ledger: DataFrame) -> DataFrame:
    """How origins and destinations repeat, one row for the whole ledger.

    Names are counted first (map-side combined), so the summary runs over one row per name.
    """
    origins = ledger.groupBy("nameOrig").agg(F.count("*").alias("uses")).agg(
        F.count("*").alias("distinct_origins"),
        F.count_if(F.col("uses") == 1).alias("single_use_origins"),
    )
    merchant = F.col("nameDest").startswith("M")
    destinations = ledger.groupBy("nameDest").agg(F.count("*").alias("uses")).agg(
        F.sum("uses").alias("total_rows"),
        F.count("*").alias("distinct_destinations"),
        F.sum(F.col("uses") - 1).alias("rows_with_history"),
        F.count_if(merchant).alias("merchants"),
        F.sum(F.when(merchant, F.col("uses"))).alias("merchant_rows"),
        F.max(F.when(merchant, F.col("uses"))).alias("merchant_max"),
        F.count_if(~merchant).alias("customers"),
        F.sum(F.when(~merchant, F.col("uses"))).alias("customer_rows"),
        F.max(F.when(~merchant, F.col("uses"))).alias("customer_max"),
    )
    single = origins.select(F.struct("*").alias("o")).scalar()
    return destinations.withColumn("o", single).select(
        "total_rows", "o.distinct_origins", "o.single_use_origins", "distinct_destinations",
        "merchants", "customers", "merchant_max", "customer_max",
        (F.col("merchant_rows") / F.nullif("merchants", F.lit(0))).alias("merchant_mean"),
        (F.col("customer_rows") / F.nullif("customers", F.lit(0))).alias("customer_mean"),
        (F.col("rows_with_history") / F.nullif("total_rows", F.lit(0))).alias("share_with_history"),
    )


def fraud_rate_by_type(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("type").agg(
        F.count("*").alias("n_rows"), F.sum("isFraud").cast("bigint").alias("n_fraud"),
        (F.sum("isFraud") / F.count("*")).alias("fraud_rate"),
    )
