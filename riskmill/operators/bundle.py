"""A fitted classifier with its scaler, threshold and version as one stored pipeline, for batches and streams alike."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmill.functions.features import FEATURES

SCALED = "scaled_"


@dataclass(frozen=True)
class Bundle:
    pipeline: PipelineModel
    threshold: float
    version: str
    names: tuple[str, ...]

    def score(self, rows: DataFrame) -> DataFrame:
        """The rows of unscaled features with score and flagged; a stream stays one."""
        made = self.pipeline.transform(rows).withColumn("score", vector_to_array("probability")[1])
        return made.select(*[F.col(f"`{c}`") for c in rows.columns if c not in ("score", "flagged")], "score",
                           (F.col("score") >= F.lit(self.threshold)).alias("flagged"))


def assemble(model, fitted: Mapping[str, Mapping[str, float]], threshold: float, version: str,
             names: Sequence[str] = FEATURES) -> Bundle:
    """Scaling as literals of one projection, the feature vector, and the classifier, which reads ``vector``."""
    scaled = ", ".join(f"(`{n}` - {fitted[n]['mean']!r}D) / {fitted[n]['scale']!r}D AS `{SCALED}{n}`" for n in names)
    stages = [SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__"),
              VectorAssembler(inputCols=[SCALED + n for n in names], outputCol="vector"), model]
    return Bundle(PipelineModel(stages), float(threshold), version, tuple(names))


def save_bundle(bundle: Bundle, spark: SparkSession, path: str) -> None:
    """The description is written last: a bundle without one is unfinished and doesn't load."""
    bundle.pipeline.write().overwrite().save(f"{path}/pipeline")
    spark.range(1).select(F.lit(bundle.threshold).alias("threshold"), F.lit(bundle.version).alias("version"),
                          F.array(*[F.lit(n) for n in bundle.names]).alias("names")) \
        .write.mode("overwrite").parquet(f"{path}/description")


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    told = spark.read.parquet(f"{path}/description").first()
    return Bundle(PipelineModel.load(f"{path}/pipeline"), told.threshold, told.version, tuple(told.names))
