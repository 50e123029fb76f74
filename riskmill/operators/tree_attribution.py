"""Exact Shapley values of boosted trees, from the trees' node tables.

The value of a feature set is a tree's mean over its training rows where the other features are unknown: at a node that
splits on an unknown feature both sides count with their share of the rows. For one leaf this is its value times, for
each feature on its path, either whether the row goes along there (known) or the shares on the path (unknown). The
Shapley value sums over the orders in which features become known; for one leaf that is a weighted sum of the
coefficients of a polynomial with one factor (share + t * goes along) for each feature on the path.

Rows that go along at the same features of a path get the same numbers, so a leaf has one table of them with a line for
each combination, and a row looks its line up. Batches of rows meet the trees inside tasks; the trees are small, fitted
objects that travel with the tasks. The values add up to the margin minus the mean over the training rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from riskmill.functions.features import FEATURES
from riskmill.operators.attribution import PREFIX

# A leaf with at most so many features on its path has its whole table; of a longer one, the lines that a batch needs.
WHOLE_TABLE = 6
# Spark's boosted classifier gives the probability of twice its margin.
MARGIN_SCALE = 2.0


@dataclass(frozen=True)
class Tree:
    """Nodes in arrays, the root first; leaves have feature -1. Rows with a value up to the threshold go left."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    def goes_left(self, rows: np.ndarray) -> np.ndarray:
        """(row, node): whether the row would go left there."""
        return rows[:, np.maximum(self.feature, 0)] <= self.threshold

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        at = np.zeros(len(rows), np.int64)
        while (inner := self.feature[at] >= 0).any():
            node = at[inner]
            left = rows[inner, self.feature[node]] <= self.threshold[node]
            at[inner] = np.where(left, self.left[node], self.right[node])
        return at

    def mean(self) -> float:
        leaves = self.feature < 0
        return float(np.average(self.value[leaves], weights=self.cover[leaves]))


@dataclass
class _Leaf:
    """A leaf's path: nodes with the side taken, the features on it, and each feature's share of training rows."""

    value: float
    nodes: np.ndarray
    to_left: np.ndarray
    place: np.ndarray
    features: np.ndarray
    shares: np.ndarray
    table: np.ndarray | None = field(default=None, repr=False)

    def lines(self, along: np.ndarray) -> np.ndarray:
        """Shapley values of the path's features for combinations (line, feature) of going along."""
        many = len(self.features)
        weights = np.array([math.factorial(s) * math.factorial(many - 1 - s) / math.factorial(many) for s in range(many)])
        out = np.empty(along.shape)
        for feature in range(many):
            coefficients = np.zeros((len(along), many))
            coefficients[:, 0] = 1.0
            for other in range(many):
                if other != feature:
                    raised = np.zeros_like(coefficients)
                    raised[:, 1:] = coefficients[:, :-1] * along[:, [other]]
                    coefficients = coefficients * self.shares[other] + raised
            out[:, feature] = (along[:, feature] - self.shares[feature]) * (coefficients @ weights)
        return self.value * out


def _combinations(masks: np.ndarray, many: int) -> np.ndarray:
    return (masks[:, None] >> np.arange(many) & 1).astype(float)


def _leaves(tree: Tree) -> list[_Leaf]:
    out, stack = [], [(0, [])]
    while stack:
        node, path = stack.pop()
        if tree.feature[node] >= 0:
            stack.append((int(tree.right[node]), [*path, (node, False)]))
            stack.append((int(tree.left[node]), [*path, (node, True)]))
            continue
        if not path:
            continue
        used = sorted({int(tree.feature[n]) for n, _ in path})
        shares = np.ones(len(used))
        for n, left in path:
            child = tree.left[n] if left else tree.right[n]
            shares[used.index(int(tree.feature[n]))] *= tree.cover[child] / tree.cover[n]
        leaf = _Leaf(float(tree.value[node]), np.array([n for n, _ in path]), np.array([left for _, left in path]),
                     np.array([used.index(int(tree.feature[n])) for n, _ in path]), np.array(used), shares)
        if len(used) <= WHOLE_TABLE:
            leaf.table = leaf.lines(_combinations(np.arange(1 << len(used)), len(used)))
        out.append(leaf)
    return out


@dataclass
class Ensemble:
    """Trees with their weights. ``margins`` and ``contributions`` are on the scale of the log odds."""

    trees: list[Tree]
    weights: list[float]
    scale: float = MARGIN_SCALE
    paths: list[list[_Leaf]] | None = field(default=None, repr=False)

    def margins(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for tree, weight in zip(self.trees, self.weights):
            total += weight * tree.value[tree.leaf_of(rows)]
        return self.scale * total

    def base(self) -> float:
        return self.scale * sum(weight * tree.mean() for tree, weight in zip(self.trees, self.weights))

    def contributions(self, rows: np.ndarray) -> np.ndarray:
        """(row, feature): Shapley values."""
        if self.paths is None:
            self.paths = [_leaves(tree) for tree in self.trees]
        total = np.zeros(rows.shape)
        for tree, weight, leaves in zip(self.trees, self.weights, self.paths):
            left = tree.goes_left(rows)
            for leaf in leaves:
                along = left[:, leaf.nodes] == leaf.to_left
                masks = np.zeros(len(rows), np.int64)
                for place in range(len(leaf.features)):
                    masks |= along[:, leaf.place == place].all(axis=1).astype(np.int64) << place
                if leaf.table is not None:
                    found = leaf.table[masks]
                else:
                    seen, at = np.unique(masks, return_inverse=True)
                    found = leaf.lines(_combinations(seen, len(leaf.features)))[at]
                total[:, leaf.features] += weight * found
        return self.scale * total


def stored_ensemble(spark: SparkSession, path: str) -> Ensemble:
    """The trees of a boosted classifier saved under this path; its node table is as small as the model."""
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild",
        F.col("nodeData.split.featureIndex").alias("feature"), F.col("nodeData.impurityStats")[0].alias("cover"),
        F.try_element_at("nodeData.split.leftCategoriesOrThreshold", F.lit(1)).alias("threshold")).toPandas()
    # This file has no column names of its own: tree, its parameters, its weight.
    listed = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "parameters", "weight")
    weights = {r.tree: r.weight for r in listed.select("tree", "weight").collect()}
    trees = []
    for number in sorted(weights):
        part = nodes[nodes["treeID"] == number].sort_values("id")
        leaf = part["leftChild"].to_numpy() < 0
        trees.append(Tree(np.where(leaf, -1, part["feature"].to_numpy()), part["threshold"].fillna(0.0).to_numpy(float),
                          part["leftChild"].to_numpy(), part["rightChild"].to_numpy(), part["prediction"].to_numpy(float),
                          part["cover"].to_numpy(float)))
    return Ensemble(trees, [weights[number] for number in sorted(weights)])


def fitted_ensemble(model: GBTClassificationModel, spark: SparkSession, path: str) -> Ensemble:
    """Saves a model in shared storage and reads its trees."""
    model.write().overwrite().save(path)
    return stored_ensemble(spark, path)


def tree_contributions(rows: DataFrame, ensemble: Ensemble, names: Sequence[str] = FEATURES) -> DataFrame:
    """Adds one ``c_<feature>`` column per feature, and ``margin``; every table of ``attribution`` works on them."""

    @pandas_udf("array<double>")
    def explained(values: pd.Series) -> pd.Series:
        matrix = np.stack(values.to_list()).astype(float) if len(values) else np.zeros((0, len(names)))
        return pd.Series(list(np.c_[ensemble.contributions(matrix), ensemble.margins(matrix)]))

    made = rows.withColumn("_explained", explained(F.array(*[F.col(n).cast("double") for n in names])))
    return made.select(*rows.columns, *[F.col("_explained")[place].alias(PREFIX + name) for place, name in enumerate(names)],
                       F.col("_explained")[len(names)].alias("margin"))
