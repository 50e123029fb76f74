"""A corpus pipeline over ``documents``: quality rules, exact and near deduplication, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is written as
Parquet and read again as the next stage's documents. All but the last return the columns they were given.

* quality: documents that fail the base rules or that the weakly supervised rules find improbable go.
* exact_dedup: of equal texts the one with the smallest id stays.
* simhash: of each group of SimHash near copies (parameters of op1_simhash) one document stays.
* mixing: documents in training order, once for each time they are read.
* sentencepiece: piece ids of every text, and whether they decode to it.

No SQL twin: XXH64 shingles and piece encoding have no DuckDB counterpart. Tests hold the result against a
brute-force version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmill.lineage import ensure_checkpoint_dir
from riskmill.llm import exact_dedup, mixing, quality, sentencepiece_codec, simhash

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.training_rows(docs)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = sentencepiece_codec.encode_and_decode(docs.select("doc_id", "source", "text"))
    return encoded.select("doc_id", "source", "piece_ids", F.size("piece_ids").cast("bigint").alias("n_pieces"),
                          F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash", simhash_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", sentencepiece_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored in the session's shared folder before the next one reads it."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
