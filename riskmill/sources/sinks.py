"""Table sinks: versioned feature tables, snapshots, result tables and the prediction audit."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmill.functions.features import FEATURE_VERSION, feature_vector
from riskmill.lineage import side_by_side


def source_fingerprint(spark: SparkSession, path: str, version: int = FEATURE_VERSION) -> str:
    """Digest of the source's file list (path, size, modification time) and the feature version.

    Only file metadata is read. Files are combined with order-free aggregates, so the driver receives one row
    however many files there are.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        .select("path", "modificationTime", "length")
    )
    row = files.agg(
        F.count("*").alias("files"),
        F.sum("length").alias("bytes"),
        F.max("modificationTime").cast("string").alias("latest"),
        F.expr("bit_xor(xxhash64(path, modificationTime, length))").alias("mixed"),
    ).select(F.sha2(F.concat_ws("|", "files", "bytes", "latest", "mixed", F.lit(version)), 256).alias("digest"))
    return row.first().digest[:24]


def materialize(spark: SparkSession, source: str, root: str, build: Callable[[], DataFrame],
                version: int = FEATURE_VERSION) -> tuple[DataFrame, bool]:
    """Reuse the table built from exactly this source and version, or build it; returns (table, reused).

    The marker row is written after the data, so a job that died half-way is never mistaken for a finished one.
    """
    digest = source_fingerprint(spark, source, version)
    data, marker = f"{root}/fingerprint={digest}", f"{root}/finished/{digest}"
    if _exists(spark, marker):
        return spark.read.parquet(data), True
    build().write.mode("overwrite").parquet(data)
    spark.range(1).select(F.lit(digest).alias("digest"), F.lit(version).alias("version")) \
        .write.mode("overwrite").parquet(marker)
    return spark.read.parquet(data), False


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


def write_snapshot(snapshot: DataFrame, path: str) -> None:
    """Destination snapshot as zstd parquet; ``snapshot_step`` travels as a column."""
    snapshot.write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_bucketed_snapshot(snapshot: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """The snapshot as a catalog table bucketed and sorted by destination; joins on it shuffle the other side only.

    Dealing it first gives each bucket one file, whose order then needs no sort either.
    """
    snapshot.repartition(buckets, "name_dest").write.mode("overwrite").format("parquet").option("path", path) \
        .bucketBy(buckets, "name_dest").sortBy("name_dest").saveAsTable(table)
    return snapshot.sparkSession.table(table)


def write_tables(tables: Mapping[str, DataFrame], root: str, fmt: str = "parquet") -> list[str]:
    """Write each result table under its own name, a few at the same time."""
    def put(name: str) -> str:
        writer = tables[name].write.mode("overwrite")
        target = f"{root}/{name}"
        if fmt == "csv":
            writer.option("header", True).csv(target)
        else:
            writer.format(fmt).save(target)
        return target
    return side_by_side(put, list(tables))


def feature_digest() -> Column:
    """SHA-256 over the ordered feature vector: traceable without storing the values.

    Values enter as whole millionths, rounded down, which every engine writes alike.
    """
    millionths = F.transform(feature_vector(), lambda x: F.floor(x * F.lit(1e6)).cast("bigint").cast("string"))
    return F.concat(F.lit("sha256:"), F.sha2(F.array_join(millionths, "|", "null"), 256))


def audit_records(decided: DataFrame, model_version: str, bundle_version: str, threshold: float) -> DataFrame:
    """One audit record per scored row; feature values are replaced by their digest."""
    return decided.select(
        F.lit("prediction").alias("event"),
        F.concat(F.lit("row-"), F.col("row_id").cast("string")).alias("request_id"),
        F.lit(model_version).alias("model_version"),
        F.lit(bundle_version).alias("bundle_version"),
        F.lit(float(threshold)).alias("threshold"),
        "score", "flagged", "decision", "state_hit",
        feature_digest().alias("feature_hash"),
    )


def append_audit(records: DataFrame, path: str) -> None:
    records.withColumn("ts", F.current_timestamp()).write.mode("append").json(path)
