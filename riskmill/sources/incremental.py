"""A feature table that grows with the ledger: new steps are computed from carried state, old rows are not read again.

An append stores the features of its rows, and beside them the state after it: each destination's totals, and its totals
per step of the last 24 steps. A marker written last makes the append count; one that died half-way is written anew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmill.functions.features import FEATURES, stateless_features
from riskmill.functions.numeric import exact
from riskmill.operators.history import HOT_ROWS, ROW_BLOCK, history_features, with_history
from riskmill.params import VELOCITY_HOURS

TOTAL = "decimal(38,6)"
STATE_DDL = f"nameDest string, at_step long, seen_rows long, seen_total {TOTAL}"


def last_append(spark: SparkSession, root: str) -> tuple[int, int]:
    """Number and last step of the latest finished append; (0, -1) before the first."""
    try:
        row = spark.read.parquet(f"{root}/finished/*").agg(F.max(F.struct("number", "last_step")).alias("m")).first().m
    except AnalysisException:
        return 0, -1
    return row.number, row.last_step


def append_steps(rows: DataFrame, root: str, keep: Sequence[str] = ("row_id",), hot_rows: int = HOT_ROWS,
                 row_block: int = ROW_BLOCK) -> DataFrame:
    """Features of rows whose steps come after all stored ones, appended to the table under ``root``; returns the table."""
    spark = rows.sparkSession
    number, last = last_append(spark, root)
    span = rows.agg(F.min("step").alias("low"), F.max("step").alias("high")).first()
    if span.low is None:
        return read_appended(spark, root)
    if span.low <= last:
        raise ValueError(f"rows of step {span.low} come after step {last} was stored")
    state = spark.read.schema(STATE_DDL).parquet(f"{root}/state/number={number}") if number else spark.createDataFrame([], STATE_DDL)
    made = {**stateless_features(), **history_features()}
    features = _with_state(with_history(rows, hot_rows, row_block), rows, state, last).select(
        *keep, "step", *[made[name].alias(name) for name in FEATURES], "isFraud")
    features.write.mode("overwrite").parquet(f"{root}/features/number={number + 1}")
    _grown_state(rows, state, span.high).write.mode("overwrite").parquet(f"{root}/state/number={number + 1}")
    spark.range(1).select(F.lit(number + 1).alias("number"), F.lit(span.high).alias("last_step")) \
        .write.mode("overwrite").parquet(f"{root}/finished/{number + 1}")
    return read_appended(spark, root)


def read_appended(spark: SparkSession, root: str) -> DataFrame:
    """All finished appends; raises when there is none."""
    number, _ = last_append(spark, root)
    if not number:
        raise ValueError(f"no finished append under {root}")
    return spark.read.parquet(*[f"{root}/features/number={n}" for n in range(1, number + 1)])


def _with_state(local: DataFrame, rows: DataFrame, state: DataFrame, last: int) -> DataFrame:
    """Adds what the state brings: a destination's totals to all its rows, those of late steps to rows within 24 steps."""
    totals = state.where("at_step is null").select("nameDest", F.col("seen_rows").alias("_rows"), F.col("seen_total").alias("_total"))
    # At most 24 steps of a destination meet at most 24 stored ones.
    asked = rows.where(F.col("step") <= last + VELOCITY_HOURS).select("nameDest", "step").distinct()
    recent = asked.join(state.where("at_step is not null"), "nameDest").where(F.col("at_step") >= F.col("step") - VELOCITY_HOURS) \
        .groupBy("nameDest", "step").agg(F.sum("seen_rows").alias("_recent_rows"), F.sum("seen_total").alias("_recent_total"))

    def both(own: str, brought: str) -> Column:
        return F.coalesce(F.col(own), F.lit(0)) + F.coalesce(F.col(brought), F.lit(0))
    return local.join(totals, "nameDest", "left").join(recent, ["nameDest", "step"], "left").withColumns({
        "prior_rows": both("prior_rows", "_rows"), "prior_total": both("prior_total", "_total"),
        "recent_rows": both("recent_rows", "_recent_rows"), "recent_total": both("recent_total", "_recent_total")})


def _grown_state(rows: DataFrame, state: DataFrame, last: int) -> DataFrame:
    """Totals (at_step null) and totals per late step, the old ones and those of the rows added up."""
    late = F.when(F.col("step") > last - VELOCITY_HOURS, F.col("step"))
    added = rows.groupBy("nameDest", "step").agg(F.count("*").alias("seen_rows"), F.sum(exact("amount")).alias("seen_total"))
    entries = added.select("nameDest", F.explode(F.array_distinct(F.array(F.lit(None).cast("bigint"), late))).alias("at_step"),
                           "seen_rows", F.col("seen_total").cast(TOTAL).alias("seen_total"))
    kept = state.where(F.col("at_step").isNull() | (F.col("at_step") > last - VELOCITY_HOURS))
    return kept.unionByName(entries).groupBy("nameDest", "at_step").agg(
        F.sum("seen_rows").alias("seen_rows"), F.sum("seen_total").cast(TOTAL).alias("seen_total"))
