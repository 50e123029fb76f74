"""Scoring arriving transactions against a frozen destination snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from riskmill.functions.rules import Rule
from riskmill.operators.decisions import decide
from riskmill.operators.state import features_from_state, lookup_state
from riskmill.sources.ledger import LEDGER_SCHEMA

STREAM_SCHEMA = T.StructType([T.StructField("row_id", T.LongType()), *LEDGER_SCHEMA.fields])


def read_transactions(spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int = 64) -> DataFrame:
    """New ledger files as a stream; the trigger limit bounds the size of a micro-batch."""
    return spark.readStream.schema(STREAM_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def score_transactions(transactions: DataFrame, snapshot: DataFrame, flagged: Column,
                       rules: Sequence[Rule] | None = None) -> DataFrame:
    """Snapshot lookup (stream-static join), features, rules and decision: the batch expressions unchanged.

    The job keeps no state, so late rows are scored like any other.
    """
    made = features_from_state(lookup_state(transactions, snapshot))
    return decide(made, flagged, rules)


def start_scoring(scored: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    return scored.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start(output)


def decision_telemetry(decided: DataFrame, time: str = "event_time", late_by: str = "1 hour",
                       width: str = "1 hour") -> DataFrame:
    """Decision counts per tumbling window; rows later than the watermark are dropped."""
    counted = decided.withWatermark(time, late_by).groupBy(F.window(time, width)).agg(
        F.count("*").alias("n_scored"),
        F.count_if(F.col("decision") == "BLOCK").alias("n_blocked"),
        F.count_if(F.col("decision") == "REVIEW").alias("n_flagged"),
        F.count_if(F.col("decision") == "PASS").alias("n_passed"),
    )
    return counted.select(F.col("window.start").alias("window_start"), "n_scored", "n_blocked", "n_flagged", "n_passed")


def start_telemetry(counted: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Append the windows that the watermark has closed, each once; open ones stay in the state store."""
    return counted.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start(output)
