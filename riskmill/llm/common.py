"""What several training-data operators share: the word pattern, text columns, repeated rows, global order."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskmill.lineage import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

# A list of at most this many keys of under 64 bytes each is sent to every executor; a longer one is shuffled.
BROADCAST_KEYS = 100_000
# Rows that one explode makes of one array; more repeats come from a second explode.
REPEAT_BLOCK = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, null counted as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def small_side(keys: DataFrame) -> DataFrame:
    """A stored table of short keys, marked for broadcast only when a count shows that it is small."""
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def match(left: DataFrame, right: DataFrame, names: list[str], how: str) -> DataFrame:
    """Join on columns of one name where null equals null; the right side's keys go."""
    kept = [F.col(n) for n in right.columns if n not in names]
    keys = right.select(*[F.col(n).alias(f"_key_{n}") for n in names], *kept)
    condition = reduce(and_, [F.col(n).eqNullSafe(F.col(f"_key_{n}")) for n in names])
    return left.join(keys, condition, how).drop(*[f"_key_{n}" for n in names])


def repeat_rows(rows: DataFrame, times: str, number: str) -> DataFrame:
    """Each row ``times`` times, numbered from 0 in ``number``; rows with ``times`` below 1 go. No array is long."""
    block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(times) - 1) / REPEAT_BLOCK)))
    return rows.where(F.col(times) > 0).withColumn("_block", block).withColumn(number, F.explode(F.sequence(
        F.col("_block") * REPEAT_BLOCK,
        F.least(F.col(times), (F.col("_block") + 1) * REPEAT_BLOCK) - 1))).drop("_block")


def global_index(rows: DataFrame, *order: Column, name: str) -> DataFrame:
    """Number the rows from 0 in a total order: range partitions are sorted apart and shifted by the counts before."""
    placed = cut_lineage(rows.repartitionByRange(*order)).withColumn("_part", F.spark_partition_id())
    counts = placed.groupBy("_part").agg(F.count("*").alias("_rows"))
    starts = counts.withColumn("_start", F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).drop("_rows")
    local = placed.withColumn(name, F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    return local.join(F.broadcast(starts), "_part").withColumn(name, F.col(name) + F.col("_start")).drop("_part", "_start")
