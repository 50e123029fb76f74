"""Ledger schema, readers and column checks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEDGER_SCHEMA = T.StructType([
    T.StructField("step", T.LongType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("amount", T.DoubleType(), False),
    T.StructField("nameOrig", T.StringType(), False),
    T.StructField("oldbalanceOrg", T.DoubleType(), False),
    T.StructField("newbalanceOrig", T.DoubleType(), False),
    T.StructField("nameDest", T.StringType(), False),
    T.StructField("oldbalanceDest", T.DoubleType(), False),
    T.StructField("newbalanceDest", T.DoubleType(), False),
    T.StructField("isFraud", T.IntegerType(), False),
    T.StructField("isFlaggedFraud", T.IntegerType(), False),
])
LEDGER_COLUMNS = tuple(LEDGER_SCHEMA.names)
# What a caller submits for scoring: the ledger without its labels.
REQUEST_COLUMNS = tuple(name for name in LEDGER_COLUMNS if name not in ("isFraud", "isFlaggedFraud"))


def read_ledger(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Scan a ledger; CSV is parsed against the fixed schema and a malformed line fails the job."""
    if fmt == "csv":
        header = spark.read.option("header", True).csv(path).columns
        require_columns(header, LEDGER_COLUMNS)
        known = {field.name: field.dataType for field in LEDGER_SCHEMA}
        schema = T.StructType([
            T.StructField(name, T.LongType() if name == "row_id" else known.get(name, T.StringType()))
            for name in header
        ])
        return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    frame = spark.read.format(fmt).load(path)
    require_columns(frame.columns, LEDGER_COLUMNS)
    return frame


def numbered(frame: DataFrame) -> DataFrame:
    return frame if "row_id" in frame.columns else frame.withColumn("row_id", F.monotonically_increasing_id())


def ingest_ledger(spark: SparkSession, source: str, target: str, fmt: str = "csv") -> DataFrame:
    """Load a ledger file once, number its rows, and keep it as parquet.

    Generated ids follow file order within a split and are only stable once written, so the table on disk,
    not the CSV scan, is what later steps read.
    """
    frame = numbered(read_ledger(spark, source, fmt))
    frame.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def require_columns(present: Iterable[str], required: Iterable[str], allow_extra: bool = True) -> None:
    """Raise before any job runs when columns are missing (or, for uploads, unexpected)."""
    have, need = list(present), list(required)
    missing = [name for name in need if name not in have]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    extra = [name for name in have if name not in need]
    if extra and not allow_extra:
        raise ValueError(f"unexpected columns: {', '.join(extra)}")


def upload_report(spark: SparkSession, uploads: Mapping[str, str], required: Iterable[str] = REQUEST_COLUMNS) -> DataFrame:
    """(upload, missing, unexpected, n_rows) for CSV uploads by name: only headers decide, and only the rows of an upload
    with exactly the required columns are read, against the fixed schema."""
    need = list(required)
    kinds = {field.name: field for field in LEDGER_SCHEMA}
    reports = None
    for name, path in uploads.items():
        have = spark.read.option("header", True).csv(path).columns
        missing, unexpected = [c for c in need if c not in have], [c for c in have if c not in need]
        report = spark.range(1)
        if not missing and not unexpected:
            schema = T.StructType([kinds[c] for c in have])
            report = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
        made = report.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("upload"), F.lit(",".join(missing)).alias("missing"), F.lit(",".join(unexpected)).alias("unexpected"),
            (F.col("n_rows") if report.columns != ["id"] else F.lit(0).cast("bigint")).alias("n_rows"))
        reports = made if reports is None else reports.unionByName(made)
    return reports
