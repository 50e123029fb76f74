"""Registered queries that write and read back: ingest, versioned tables, sinks and streams (A, T).

Each writes to a folder of its own in the session's shared storage and returns what it reads from there.
"""

from __future__ import annotations

import uuid

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmill.functions.rules import default_rules
from riskmill.lineage import ensure_checkpoint_dir
from riskmill.operators import state, training, validation
from riskmill.operators.decisions import decide
from riskmill.operators.folds import fitted_cuts
from riskmill.plans import base
from riskmill.plans.core import Query
from riskmill.sources import incremental, sinks
from riskmill.sources import ledger as ledgers
from riskmill.streaming import history, scoring

STREAM_PARTS = 10
TELEMETRY_HOURS = 6
# More than a part has files, so that each run of a stream over a new part is one micro-batch.
FILES_PER_BATCH = 1 << 20

HISTORY = ("dest_prior_txn_count", "dest_prior_avg_amount", "dest_txn_count_24h", "dest_amount_sum_24h")


def _folder(spark: SparkSession, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4()}"


def a1_ingest(spark, sf_dir):
    """The ledger as a CSV file, loaded with its fixed schema and numbered; the numbers are new, so they stay out."""
    root = _folder(spark, "ingest")
    base.ledger(spark, sf_dir).select(*ledgers.LEDGER_COLUMNS).write.option("header", True).csv(f"{root}/csv")
    loaded = ledgers.ingest_ledger(spark, f"{root}/csv", f"{root}/ledger")
    return loaded.select(*ledgers.LEDGER_COLUMNS)


def a1_validated_ingest(spark, sf_dir):
    """Violations of a faulty ledger, counted while it is written."""
    root = _folder(spark, "ingest")
    base.faulty_ledger(spark, sf_dir).select("row_id", *ledgers.LEDGER_COLUMNS).write.parquet(f"{root}/source")
    return validation.validated_ingest(spark, f"{root}/source", f"{root}/ledger", "parquet")[1]


def a2_incremental(spark, sf_dir):
    """The feature table after four appends of consecutive steps."""
    root = _folder(spark, "appended")
    rows = _in_parts(base.ledger(spark, sf_dir), 4)
    for number in range(4):
        incremental.append_steps(rows.where(F.col("arrival") == number).drop("arrival"), root)
    return incremental.read_appended(spark, root)


def a2_materialize(spark, sf_dir):
    """The features built once and found again: rows, and which of two calls reused the table."""
    root = _folder(spark, "features")
    calls = [sinks.materialize(spark, f"{sf_dir}/events.parquet", root, lambda: base.features(spark, sf_dir)) for _ in range(2)]
    return calls[1][0].agg(F.count("*").alias("n_rows")).withColumns(
        {"first_reused": F.lit(calls[0][1]), "second_reused": F.lit(calls[1][1])})


def a4_snapshot_sink(spark, sf_dir):
    path = _folder(spark, "snapshot")
    sinks.write_snapshot(state.destination_snapshot(base.ledger(spark, sf_dir)), path)
    return sinks.read_snapshot(spark, path)


def e2_bucketed_lookup(spark, sf_dir):
    """State lookup in a snapshot stored in buckets by destination."""
    rows = base.ledger(spark, sf_dir)
    path = _folder(spark, "buckets")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = sinks.write_bucketed_snapshot(state.destination_snapshot(rows), f"snapshot_{uuid.uuid4().hex}", path, buckets)
    return state.lookup_state(rows, stored).select("row_id", *state.STATE_COLUMNS, "state_hit")


def a5_result_tables(spark, sf_dir):
    """The eleven result tables of one run over all learners and folds, written and read back: rows of each."""
    root = _folder(spark, "run")
    last = training.store_scores(base.folded_features(spark, sf_dir), range(1, base.FOLDS + 1), f"{root}/scores")
    tables = training.result_tables(training.read_scores(spark, f"{root}/scores"), last, base.ledger(spark, sf_dir), f"{root}/model",
                                    base.REVIEWS_PER_DAY, base.REVIEWS_GRID, base.COST_PER_REVIEW)
    written = sinks.write_tables(tables, f"{root}/results")
    counts = [spark.read.schema(tables[name].schema).parquet(path).agg(F.count("*").alias("n_rows"))
              .select(F.lit(name).alias("result"), "n_rows") for name, path in zip(tables, written)]
    return reduce(DataFrame.unionByName, counts)


def a6_audit_sink(spark, sf_dir):
    """Records of decided rows, appended to the audit log and read from it; hits are those of the state lookup."""
    rows = base.ledger(spark, sf_dir)
    snapshot = state.destination_snapshot(rows.where(F.col("step") <= fitted_cuts(rows)[base.FOLDS - 1]))
    hits = state.lookup_state(rows.select("row_id", "nameDest"), snapshot).select("row_id", "state_hit")
    decided = decide(base.explained(spark, sf_dir).join(hits, "row_id"), F.col("flagged"), default_rules(base.HARD_BLOCK_AMOUNT))
    records = sinks.audit_records(decided, "linear", "v1", base.DECISION_THRESHOLD)
    path = _folder(spark, "audit")
    sinks.append_audit(records, path)
    return spark.read.schema(records.schema).json(path)


def a7_upload_columns(spark, sf_dir):
    """Three uploads of the ledger as CSV: what their headers lack or have too much, and the rows admitted of each."""
    rows = base.ledger(spark, sf_dir).select(*ledgers.REQUEST_COLUMNS)
    uploads = {"complete": rows, "incomplete": rows.drop("amount", "nameDest"), "labelled": rows.withColumn("isFraud", F.lit(0))}
    root = _folder(spark, "uploads")
    for name, upload in uploads.items():
        upload.write.option("header", True).csv(f"{root}/{name}")
    return ledgers.upload_report(spark, {name: f"{root}/{name}" for name in uploads})


def _in_parts(rows: DataFrame, parts: int) -> DataFrame:
    """The rows with ``arrival``, the part of the ledger's time, all parts of one length."""
    span = rows.agg(F.min("step").alias("low"), F.max("step").alias("high")).first()
    low, length = (span.low or 0), (span.high or 0) - (span.low or 0) + 1
    return rows.withColumn("arrival", F.expr(f"((step - {low}) * {parts}) DIV {length}"))


def _feed(rows: DataFrame, root: str, parts: int, advance: Callable[[str], None]) -> None:
    """Files arrive part by part in a watched folder, and ``advance`` runs after each; a part has many files."""
    spark = rows.sparkSession
    rows.write.partitionBy("arrival").parquet(f"{root}/sent")
    sent = spark.read.parquet(f"{root}/sent")
    for number in range(parts):
        sent.where(F.col("arrival") == number).drop("arrival").write.parquet(f"{root}/in/part{number}")
        advance(f"{root}/in/*")


def _transactions(spark: SparkSession, sf_dir: str, parts: int) -> DataFrame:
    return _in_parts(base.ledger(spark, sf_dir).select("row_id", *ledgers.LEDGER_COLUMNS), parts)


def _stream_decisions(spark: SparkSession, path: str, snapshot: DataFrame) -> DataFrame:
    return scoring.score_transactions(scoring.read_transactions(spark, path, files_per_trigger=FILES_PER_BATCH), snapshot,
                                      F.col("dest_txn_count_24h") > 3, default_rules(base.HARD_BLOCK_AMOUNT))


def t1_stream_scoring(spark, sf_dir):
    """Rows scored against a snapshot as they arrive: whose destination was known, and the features served."""
    snapshot = state.destination_snapshot(base.ledger(spark, sf_dir))
    root = _folder(spark, "scored")
    _feed(_transactions(spark, sf_dir, 4), root, 4, lambda path: scoring.start_scoring(
        _stream_decisions(spark, path, snapshot), f"{root}/out", f"{root}/progress").awaitTermination())
    return spark.read.parquet(f"{root}/out").select("row_id", "state_hit", "dest_prior_txn_count", "dest_txn_count_24h")


def t2_stream_history(spark, sf_dir):
    """The four history values, carried in the state store over ten runs of one micro-batch each."""
    root = _folder(spark, "history")
    _feed(_transactions(spark, sf_dir, STREAM_PARTS), root, STREAM_PARTS, lambda path: history.start_history(
        scoring.read_transactions(spark, path, files_per_trigger=FILES_PER_BATCH), root).awaitTermination())
    return spark.read.parquet(f"{root}/history").select("row_id", *HISTORY)


def t3_rolling_telemetry(spark, sf_dir):
    """Decisions per window of six hours. Of ten parts of the ledger's time, one row in ten arrives a part late and
    counts; one in fifty of the first three arrives with the last, behind the watermark, and doesn't."""
    ledger = base.ledger(spark, sf_dir)
    snapshot = state.destination_snapshot(ledger)
    last = STREAM_PARTS - 1
    late = F.when((F.col("row_id") % 50 == 7) & (F.col("arrival") <= 2), last) \
        .when((F.col("row_id") % 10 == 3) & (F.col("arrival") < last), F.col("arrival") + 1).otherwise(F.col("arrival"))
    rows = _transactions(spark, sf_dir, STREAM_PARTS).withColumn("arrival", late.cast("bigint"))
    span = ledger.agg((F.max("step") - F.min("step") + 1).alias("hours")).first().hours or 0
    root = _folder(spark, "telemetry")

    def advance(path: str) -> None:
        decided = _stream_decisions(spark, path, snapshot).withColumn("event_time", F.timestamp_seconds(F.col("step") * 3600))
        counted = scoring.decision_telemetry(decided, late_by=f"{late_hours(span)} hours", width=f"{TELEMETRY_HOURS} hours")
        scoring.start_telemetry(counted, f"{root}/out", f"{root}/progress").awaitTermination()
    _feed(rows, root, STREAM_PARTS, advance)
    made = spark.read.parquet(f"{root}/out")
    return made.select((F.unix_timestamp("window_start") / 3600).cast("bigint").alias("window_step"),
                       "n_scored", "n_blocked", "n_flagged", "n_passed")


def late_hours(span: int) -> int:
    """A delay of two of the parts that arrive."""
    return 2 * (span // STREAM_PARTS + 1)


QUERIES: dict[str, Query] = {
    "a1_ingest": a1_ingest, "a1_validated_ingest": a1_validated_ingest, "a2_materialize": a2_materialize,
    "a2_incremental": a2_incremental, "e2_bucketed_lookup": e2_bucketed_lookup, "a4_snapshot_sink": a4_snapshot_sink,
    "a5_result_tables": a5_result_tables, "a6_audit_sink": a6_audit_sink, "a7_upload_columns": a7_upload_columns,
    "t1_stream_scoring": t1_stream_scoring, "t2_stream_history": t2_stream_history,
    "t3_rolling_telemetry": t3_rolling_telemetry,
}
