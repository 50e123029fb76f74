"""Fold preparation and model fitting with Spark ML."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import reduce

from pyspark import RDD, SparkContext, StorageLevel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmill.functions.features import BASE_FEATURES, DESTINATION_FEATURES, FEATURES, TYPE_FEATURES
from riskmill.lineage import cut_lineage, side_by_side
from riskmill.operators import newton
from riskmill.operators.folds import class_weight, positive_weight
from riskmill.operators.metrics import average_precision, evaluate
from riskmill.operators.ranking import cumulative_histogram
from riskmill.operators.sampling import undersample_negatives
from riskmill.operators.scaling import apply_scaler, fit_scaler, scaler_numbers
from riskmill.operators.search import Range, Trial, search
from riskmill.params import NEGATIVES_PER_POSITIVE, REVIEWS_PER_DAY, SEED

# Most rounds of a fit; both learners stop earlier once they no longer improve.
LINEAR_ROUNDS, TREE_ROUNDS = 1000, 200
# Most rows of a partition that trees are grown on: the learner holds each as one block of objects, some 30 MB.
TREE_PART_ROWS = 250_000

# The four feature sets of the ablation.
FEATURE_SETS = {
    "base_only": BASE_FEATURES,
    "base_and_type": BASE_FEATURES + TYPE_FEATURES,
    "base_and_destination": BASE_FEATURES + DESTINATION_FEATURES,
    "all_features": FEATURES,
}


@dataclass(frozen=True)
class LinearRows:
    """Training rows for logistic fits on these features: their counts, and their matrices with balanced weights."""

    names: tuple[str, ...]
    n_rows: int
    n_fraud: int
    vectors: DataFrame
    blocks: RDD


@dataclass(frozen=True)
class Logistic:
    """A balanced logistic regression as a learner; ``strength`` is the inverse penalty C applied to the summed loss."""

    strength: float | None = 1.0
    l1: bool = False

    def __call__(self, fold: PreparedFold) -> LogisticRegressionModel:
        return fit_logistic(fold, strength=self.strength, l1=self.l1)


@dataclass(frozen=True)
class PreparedFold:
    """Scaled rows of one fold. Training is resampled, testing is not; each has its own class weight."""

    train: DataFrame
    test: DataFrame
    train_weight: float
    test_weight: float
    scaler: Mapping[str, Mapping[str, float]] | None = None
    linear: LinearRows | None = None


def prepared_fold_summary(folded: DataFrame, per_positive: float = NEGATIVES_PER_POSITIVE,
                          seed: int = SEED) -> DataFrame:
    """Row counts before and after resampling, and the two class weights, per fold."""
    train = folded.where("role = 'train'")
    kept = undersample_negatives(train, per_positive, seed, ("fold",))
    before = train.groupBy("fold").agg(F.count("*").alias("n_train_before"))
    after = class_weight(kept, ("fold",)).select(
        "fold", (F.col("n_negative") + F.col("n_positive")).alias("n_train"),
        F.col("n_positive").alias("n_train_fraud"), F.col("pos_weight").alias("train_pos_weight"))
    test = class_weight(folded.where("role = 'test'"), ("fold",)).select(
        "fold", (F.col("n_negative") + F.col("n_positive")).alias("n_test"),
        F.col("n_positive").alias("n_test_fraud"), F.col("pos_weight").alias("test_pos_weight"))
    return before.join(after, "fold").join(test, "fold")


def prepare_fold(folded: DataFrame, fold: int, per_positive: float = NEGATIVES_PER_POSITIVE,
                 seed: int = SEED) -> PreparedFold:
    """Resample the training part, fit the scaler on it alone, scale both parts, and cut their lineage.

    Fitting reads the training rows many times, so they are written out once rather than re-derived from windows.
    """
    part = folded.where(F.col("fold") == fold)
    train = cut_lineage(undersample_negatives(part.where("role = 'train'"), per_positive, seed))
    test = part.where("role = 'test'")
    fitted = scaler_numbers(fit_scaler(train))
    ready = [cut_lineage(apply_scaler(rows, fitted).withColumnRenamed("isFraud", "is_fraud").drop("fold", "role"))
             for rows in (train, test)]
    weights = [
        rows.agg(positive_weight(F.count("*") - F.sum("is_fraud"), F.sum("is_fraud")).alias("w")).first().w
        for rows in ready
    ]
    return PreparedFold(ready[0], ready[1], float(weights[0]), float(weights[1]), fitted)


def _vectors(rows: DataFrame, names: Sequence[str], positive: float, negative: float = 1.0) -> DataFrame:
    weighted = rows.withColumn("weight", F.when(F.col("is_fraud") == 1, F.lit(positive)).otherwise(F.lit(negative)))
    made = VectorAssembler(inputCols=list(names), outputCol="vector").transform(weighted)
    return made.withColumn("label", F.col("is_fraud").cast("double"))


@contextmanager
def for_logistic(fold: PreparedFold, names: Sequence[str] = FEATURES) -> Iterator[PreparedFold]:
    """The fold with its training rows kept as matrices until the end of the block, for several fits."""
    share = fold.train.agg(F.count("*").alias("rows"), F.sum("is_fraud").alias("fraud")).first()
    n_fraud = share.fraud or 0
    vectors = _vectors(fold.train, names, share.rows / (2.0 * max(n_fraud, 1)), share.rows / (2.0 * max(share.rows - n_fraud, 1)))
    packed = newton.packed(vectors.select(vector_to_array("vector").alias("x"), "label", "weight"), len(names))
    packed.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield replace(fold, linear=LinearRows(tuple(names), share.rows, n_fraud, vectors, newton.blocks(packed, len(names))))
    finally:
        packed.unpersist()


def fit_logistic(fold: PreparedFold, names: Sequence[str] = FEATURES, strength: float | None = 1.0,
                 l1: bool = False, max_iter: int = LINEAR_ROUNDS):
    """Balanced logistic regression; ``strength`` is the inverse penalty C applied to the summed loss.

    The loss is averaged over the total weight, hence the penalty C becomes 1 / (C * total weight). Balanced
    weights give each class half of the rows, so the total weight is the row count. Newton steps find the minimum: Spark's
    own learner runs a job per round, and on these features needs a thousand. The rows of ``for_logistic`` are used if the
    fold has them.
    """
    return fit_logistics(fold, [Logistic(strength, l1)], names, max_iter)[0]


def fit_logistics(fold: PreparedFold, wanted: Sequence[Logistic], names: Sequence[str] = FEATURES,
                  max_iter: int = LINEAR_ROUNDS) -> list[LogisticRegressionModel]:
    """The models of ``fit_logistic`` for several penalties, which share their passes over the rows."""
    kept = fold.linear
    if kept is None or kept.names != tuple(names):
        with for_logistic(fold, names) as ready:
            return fit_logistics(ready, wanted, names, max_iter)
    penalties = [0.0 if one.strength is None else 1.0 / (one.strength * kept.n_rows) for one in wanted]
    learners = [LogisticRegression(
        featuresCol="vector", labelCol="label", weightCol="weight", maxIter=max_iter, standardization=False,
        regParam=penalty, elasticNetParam=1.0 if one.l1 else 0.0) for one, penalty in zip(wanted, penalties)]
    if not 0 < kept.n_fraud < kept.n_rows:
        return [without_summary(learner.fit(kept.vectors)) for learner in learners]  # one label only: nothing to search for
    found = newton.fit(kept.blocks, len(names), [(0.0, p) if one.l1 else (p, 0.0) for one, p in zip(wanted, penalties)], max_iter)
    return [_linear_model(learner, *values) for learner, values in zip(learners, found)]


def _linear_model(learner: LogisticRegression, coefficients: Sequence[float], intercept: float) -> LogisticRegressionModel:
    """Spark's model of these coefficients, with the learner's columns and parameters."""
    vector = _py2java(SparkContext._active_spark_context, Vectors.dense(coefficients))
    made = LogisticRegressionModel._new_java_obj(
        "org.apache.spark.ml.classification.LogisticRegressionModel", learner.uid, vector, float(intercept))
    return learner._copyValues(LogisticRegressionModel(made))


def without_summary(model):
    """The model without its training summary, which holds the session and is sent along with every scoring task.

    A session that has observed metrics cannot be serialized, so scoring with the summary would fail from then on.
    """
    model._java_obj.setSummary(SparkContext._active_spark_context._jvm.scala.Option.empty())
    return model


def coefficient_table(fold: PreparedFold, model, names: Sequence[str] = FEATURES) -> DataFrame:
    """One row per feature with its coefficient; ``n_nonzero`` counts the features the penalty kept."""
    values = [float(v) for v in model.coefficients]
    entries = [F.struct(F.lit(n).alias("feature"), F.lit(v).alias("coefficient")) for n, v in zip(names, values)]
    kept = sum(1 for v in values if v != 0.0)
    return fold.train.sparkSession.range(1).select(F.inline(F.array(*entries))) \
        .withColumn("n_nonzero", F.lit(kept)).withColumn("intercept", F.lit(float(model.intercept)))


def tree_rows(fold: PreparedFold, names: Sequence[str] = FEATURES, part_rows: int = TREE_PART_ROWS) -> DataFrame:
    """Both parts of the fold as the trees' learner reads them, several times a fit, in partitions of ``part_rows`` or
    little more.

    An executor that takes over a task fetches its whole block, and the one that has it serializes it. Partitions of files
    grow with the table, so larger ones are dealt out by their rows' digests, in an order that repeats.
    """
    both = fold.train.withColumn("held_out", F.lit(False)).unionByName(fold.test.withColumn("held_out", F.lit(True)))
    sizes = both.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")) \
        .agg(F.max("n").alias("largest"), F.sum("n").alias("rows")).first()
    if (sizes.largest or 0) > part_rows:
        needed = both.select("row_id", "is_fraud", "held_out", *names)
        both = needed.repartition(math.ceil(sizes.rows / part_rows), F.xxhash64(*needed.columns)) \
            .sortWithinPartitions(*needed.columns)
    return _vectors(both, names, fold.train_weight).select("vector", "label", "weight", "held_out")


def fit_trees(fold: PreparedFold, names: Sequence[str] = FEATURES, max_iter: int = TREE_ROUNDS, max_depth: int = 5,
              step_size: float = 0.1, min_rows: int = 1, row_share: float = 1.0, feature_share: float = 1.0, seed: int = SEED,
              rows: DataFrame | None = None):
    """Boosted trees that stop early on the fold's test part, which makes the result slightly optimistic.

    A leaf has ``min_rows`` rows or more; a tree is grown on a share of the rows, a split looks at one of the features.
    ``rows`` are the fold's ``tree_rows`` when a caller keeps them for several fits.
    """
    learner = GBTClassifier(
        featuresCol="vector", labelCol="label", weightCol="weight", validationIndicatorCol="held_out",
        maxIter=max_iter, maxDepth=max_depth, stepSize=step_size, minInstancesPerNode=min_rows, subsamplingRate=row_share,
        featureSubsetStrategy="all" if feature_share >= 1 else repr(feature_share), seed=seed)
    if rows is not None:
        return learner.fit(rows)
    kept = tree_rows(fold, names).persist(StorageLevel.DISK_ONLY)
    try:
        return learner.fit(kept)
    finally:
        kept.unpersist()


def score_with(model, rows: DataFrame, names: Sequence[str] = FEATURES) -> DataFrame:
    """(row_id, step, is_fraud, score) for any fitted classifier."""
    made = model.transform(_vectors(rows, names, 1.0))
    return made.select("row_id", "step", "is_fraud", vector_to_array("probability")[1].alias("score"))


def held_out_average_precision(model, fold: PreparedFold, names: Sequence[str] = FEATURES) -> float:
    scored = cut_lineage(score_with(model, fold.test, names))
    value = cumulative_histogram(scored).agg(average_precision().alias("ap")).first().ap
    return 0.0 if value is None else float(value)


def evaluate_model(model, name: str, number: int, fold: PreparedFold, names: Sequence[str] = FEATURES,
                   reviews_per_day: float = REVIEWS_PER_DAY) -> DataFrame:
    scored = score_with(model, fold.test, names).withColumn("model", F.lit(name)).withColumn("fold", F.lit(number))
    return evaluate(cut_lineage(scored), reviews_per_day)


# The five parameters of the search and their ranges.
TREE_SPACE = (Range("max_depth", 3, 10, whole=True), Range("step_size", 0.01, 0.3, log=True),
              Range("min_rows", 1, 10, whole=True), Range("row_share", 0.6, 1.0), Range("feature_share", 0.6, 1.0))
SEARCH_TRIALS = 10


def search_trees(folds: Sequence[PreparedFold], names: Sequence[str] = FEATURES, space: Sequence[Range] = TREE_SPACE,
                 n_trials: int = SEARCH_TRIALS, max_iter: int = TREE_ROUNDS, seed: int = SEED) -> list[Trial]:
    """Seeded trials by the mean average precision over all folds, best first.

    A fold's rows are turned into vectors once for all trials; a trial's fits on its folds run at the same time.
    """
    kept = [tree_rows(fold, names).persist(StorageLevel.DISK_ONLY) for fold in folds]

    def objective(params: dict) -> float:
        def area(number: int) -> float:
            model = fit_trees(folds[number], names, max_iter, seed=seed, rows=kept[number], **params)
            return held_out_average_precision(model, folds[number], names)
        areas = side_by_side(area, range(len(folds)))
        return sum(areas) / len(areas)
    try:
        return search(objective, space, n_trials, seed)
    finally:
        for rows in kept:
            rows.unpersist()


def refit_best(folds: Sequence[PreparedFold], tried: Sequence[Trial], names: Sequence[str] = FEATURES,
               max_iter: int = TREE_ROUNDS, seed: int = SEED):
    """The model of the best parameters on the last fold, which has the most training rows."""
    return fit_trees(folds[-1], names, max_iter, seed=seed, **tried[0].params)


def ablate(fold: PreparedFold, number: int, reviews_per_day: float, max_iter: int = TREE_ROUNDS) -> DataFrame:
    """Trees on each feature set, evaluated at the same capacity. Scaling is per column, so no refit is needed.

    The scores of all sets are evaluated in one order.
    """
    def scores(label: str) -> DataFrame:
        names = FEATURE_SETS[label]
        scored = score_with(fit_trees(fold, names, max_iter=max_iter), fold.test, names)
        return scored.withColumn("model", F.lit(label)).withColumn("fold", F.lit(number))
    result = evaluate(reduce(DataFrame.unionByName, side_by_side(scores, list(FEATURE_SETS))), reviews_per_day)
    sizes = F.create_map(*[F.lit(x) for label, names in FEATURE_SETS.items() for x in (label, len(names))])
    place = F.array_position(F.array(*map(F.lit, FEATURE_SETS)), F.col("model"))
    return result.orderBy(place).select(
        F.col("model").alias("feature_set"), sizes[F.col("model")].alias("n_features"), "pr_auc", "weighted_bce",
        "capacity_precision", "capacity_recall", "capacity_false_positives", "capacity_false_negatives")
