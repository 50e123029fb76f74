"""Ledger contract: type check, rule counts, offending rows, and whole-batch admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmill.functions.numeric import count_where
from riskmill.params import BATCH_MAX_ROWS, TRANSACTION_TYPES
from riskmill.sources.ledger import LEDGER_SCHEMA, REQUEST_COLUMNS, numbered, read_ledger, require_columns

Check = tuple[str, str, Column]

NON_NEGATIVE = ("step", "amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest")
NAMES = ("nameOrig", "nameDest")
FLAGS = ("isFraud", "isFlaggedFraud")


def ledger_checks() -> list[Check]:
    """(column, check, violated) triples; ``violated`` is never NULL."""
    checks: list[Check] = [(name, "not_null", F.col(name).isNull()) for name in LEDGER_SCHEMA.names]
    checks += [(name, "at_least_zero", F.coalesce(~(F.col(name) >= 0), F.lit(False))) for name in NON_NEGATIVE]
    checks.append(("type", "known_value", F.coalesce(~F.col("type").isin(*TRANSACTION_TYPES), F.lit(False))))
    checks += [(name, "zero_or_one", F.coalesce(~F.col(name).isin(0, 1), F.lit(False))) for name in FLAGS]
    return checks


def request_checks() -> list[Check]:
    """The checks for submitted rows: no labels, and names must not be empty."""
    checks = [check for check in ledger_checks() if check[0] in REQUEST_COLUMNS]
    return checks + [(name, "not_empty", F.coalesce(F.col(name) == "", F.lit(False))) for name in NAMES]


def type_mismatches(ledger: DataFrame) -> list[str]:
    """Columns whose type is not the contract's family; nothing is cast silently."""
    families = {T.LongType: (T.LongType, T.IntegerType, T.ShortType, T.ByteType)}
    families[T.IntegerType] = families[T.LongType]
    problems = []
    for field in LEDGER_SCHEMA:
        actual = ledger.schema[field.name].dataType
        allowed = families.get(type(field.dataType), (type(field.dataType),))
        if not isinstance(actual, allowed):
            problems.append(f"{field.name}: {actual.simpleString()} instead of {field.dataType.simpleString()}")
    return problems


def validation_report(ledger: DataFrame, checks: list[Check] | None = None) -> DataFrame:
    """One row per check with its number of violations; a single pass over the ledger."""
    checks = checks or ledger_checks()
    totals = ledger.agg(*[count_where(bad).alias(f"c{i}") for i, (_, _, bad) in enumerate(checks)])
    entries = [
        F.struct(F.lit(column).alias("column_name"), F.lit(rule).alias("check_name"), F.col(f"c{i}").alias("failures"))
        for i, (column, rule, _) in enumerate(checks)
    ]
    return totals.select(F.inline(F.array(*entries)))


def validated_ingest(spark: SparkSession, source: str, target: str, fmt: str = "csv",
                     checks: list[Check] | None = None) -> tuple[DataFrame, DataFrame]:
    """Load, number and store a ledger, and count the violations of its rows as they are written: (table, report).

    The counts are observed metrics of the write, so the file is scanned once.
    """
    checks = checks or ledger_checks()
    seen = Observation()
    frame = numbered(read_ledger(spark, source, fmt))
    frame.observe(seen, *[count_where(bad).alias(f"c{i}") for i, (_, _, bad) in enumerate(checks)]).write.mode("overwrite").parquet(target)
    counts = seen.get
    report = spark.createDataFrame([(column, rule, counts[f"c{i}"]) for i, (column, rule, _) in enumerate(checks)],
                                   "column_name string, check_name string, failures long")
    return spark.read.parquet(target), report


def validate_ledger(ledger: DataFrame) -> None:
    """Raise with every failing check listed, not just the first."""
    require_columns(ledger.columns, LEDGER_SCHEMA.names)
    problems = type_mismatches(ledger)
    if not problems:
        failing = validation_report(ledger).where("failures > 0").collect()
        problems = [f"{row.column_name}: {row.check_name} fails on {row.failures} rows" for row in failing]
    if problems:
        raise ValueError("ledger violates its contract: " + "; ".join(problems))


def violations(ledger: DataFrame, checks: list[Check] | None = None, key: str = "row_id") -> DataFrame:
    """The offending rows: (key, column_name, check_name), one row per broken check."""
    found = [
        F.when(bad, F.struct(F.lit(column).alias("column_name"), F.lit(rule).alias("check_name")))
        for column, rule, bad in (checks or ledger_checks())
    ]
    return ledger.select(key, F.explode(F.filter(F.array(*found), lambda hit: hit.isNotNull())).alias("hit")) \
        .select(key, "hit.column_name", "hit.check_name")


def admission(rows: DataFrame, batch: str = "batch_id", max_rows: int = BATCH_MAX_ROWS) -> DataFrame:
    """Verdict per batch: one bad row, or a batch over the size limit, rejects the batch as a whole."""
    bad = F.lit(False)
    for _, _, violated in request_checks():
        bad = bad | violated
    return rows.groupBy(batch).agg(
        F.count("*").alias("n_rows"), count_where(bad).alias("bad_rows"),
    ).withColumn("accepted", (F.col("bad_rows") == 0) & (F.col("n_rows") <= max_rows))


def split_batches(rows: DataFrame, batch: str = "batch_id",
                  max_rows: int = BATCH_MAX_ROWS) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) rows. The verdict is aggregated first, so no batch is gathered in one task."""
    verdict = admission(rows, batch, max_rows).select(batch, "accepted")
    judged = rows.join(verdict, batch)
    return judged.where("accepted").drop("accepted"), judged.where("NOT accepted").drop("accepted")
