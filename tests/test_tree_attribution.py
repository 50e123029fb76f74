from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskmill.operators import attribution, models, tree_attribution
from riskmill.operators.tree_attribution import Ensemble, Tree

NAMES = ("a", "b", "c")


def random_tree(rng, depth, features):
    feature, threshold, left, right, value, cover = [], [], [], [], [], []

    def grow(level, rows):
        node = len(feature)
        for column in (feature, threshold, left, right, value, cover):
            column.append(0)
        cover[node], value[node] = rows, rng.normal()
        if level == depth or rows < 2 or rng.random() < 0.1:
            feature[node] = -1
            return node
        feature[node], threshold[node] = int(rng.integers(features)), rng.normal() * 0.5
        part = int(rng.integers(1, rows))
        left[node], right[node] = grow(level + 1, part), grow(level + 1, rows - part)
        return node
    grow(0, 1000)
    return Tree(*map(np.array, (feature, threshold, left, right)), np.array(value, float), np.array(cover, float))


def plain_value(tree, row, known, node=0):
    """A tree's mean where only some features are known, node by node."""
    feature = tree.feature[node]
    if feature < 0:
        return tree.value[node]
    left, right = tree.left[node], tree.right[node]
    if feature in known:
        return plain_value(tree, row, known, left if row[feature] <= tree.threshold[node] else right)
    return (tree.cover[left] * plain_value(tree, row, known, left)
            + tree.cover[right] * plain_value(tree, row, known, right)) / tree.cover[node]


def plain_shapley(tree, row, features):
    out = np.zeros(features)
    for feature in range(features):
        others = [f for f in range(features) if f != feature]
        for size in range(features):
            weight = math.factorial(size) * math.factorial(features - 1 - size) / math.factorial(features)
            for known in itertools.combinations(others, size):
                out[feature] += weight * (plain_value(tree, row, {*known, feature}) - plain_value(tree, row, set(known)))
    return out


@pytest.mark.parametrize("whole_table", [0, 6])
@pytest.mark.parametrize("depth, features", [(0, 3), (1, 3), (3, 4), (7, 5), (9, 8)])
def test_contributions_equal_subset_enumeration(monkeypatch, depth, features, whole_table):
    monkeypatch.setattr(tree_attribution, "WHOLE_TABLE", whole_table)
    rng = np.random.default_rng(depth)
    trees = [random_tree(rng, depth, features) for _ in range(3)]
    ensemble = Ensemble(trees, [1.0, 0.5, 0.25])
    rows = rng.normal(size=(6, features))
    found = ensemble.contributions(rows)
    wanted = [2 * sum(w * plain_shapley(t, row, features) for t, w in zip(trees, ensemble.weights)) for row in rows]
    assert np.allclose(found, wanted, atol=1e-12)
    assert np.allclose(found.sum(axis=1) + ensemble.base(), ensemble.margins(rows), atol=1e-12)
    assert ensemble.contributions(rows[:0]).shape == (0, features)


@pytest.fixture(scope="module")
def fitted(spark, tmp_path_factory):
    rows = spark.range(2000).select(
        F.col("id").alias("row_id"), (F.col("id") % 100).alias("step"), F.randn(1).alias("a"), F.randn(2).alias("b"),
        F.randn(3).alias("c"), F.randn(4).alias("e"))
    made = rows.withColumn("is_fraud", (F.col("a") * 2 + F.col("b") + F.col("e") > 2.0).cast("int")).drop("e").persist()
    fold = models.PreparedFold(made.where("row_id < 1500"), made.where("row_id >= 1500"), 5.0, 5.0)
    model = models.fit_trees(fold, NAMES, max_iter=8, max_depth=4)
    return fold, model, tree_attribution.fitted_ensemble(model, spark, str(tmp_path_factory.mktemp("model") / "m"))


def test_contributions_add_up_to_the_fitted_margin_on_every_row(fitted):
    fold, model, ensemble = fitted
    explained = tree_attribution.tree_contributions(fold.test, ensemble, NAMES)
    scores = models.score_with(model, fold.test, NAMES).select("row_id", "score")
    total = sum(F.col(f"c_{n}") for n in NAMES) + F.lit(ensemble.base())
    checked = explained.join(scores, "row_id").select(
        F.abs(total - F.col("margin")).alias("gap"), F.abs(F.col("score") - attribution.probability(F.col("margin"))).alias("off"))
    worst = checked.agg(F.count("*"), F.max("gap"), F.max("off")).first()
    assert worst[0] == 500 and worst[1] < 1e-9 and worst[2] < 1e-9


def test_tables_of_attribution_work_on_trees(fitted):
    fold, _, ensemble = fitted
    explained = tree_attribution.tree_contributions(fold.test, ensemble, NAMES).withColumn("score", F.col("margin"))
    importance = {r.feature: r["rank"] for r in attribution.global_importance(explained, NAMES).collect()}
    assert importance["a"] == 1 and importance["c"] == 3
    alerts = attribution.alert_queue(explained, F.col("margin") > 0, 5)
    reasons = attribution.explain_alerts(alerts, NAMES, 2).collect()
    assert len(reasons) == 10 and all(r.feature in NAMES for r in reasons)
    strongest = {r.row_id: r for r in reasons if r.reason_rank == 1}
    for row in alerts.collect():
        assert abs(strongest[row.row_id].contribution) == max(abs(row[f"c_{n}"]) for n in NAMES)


def test_empty_rows(fitted):
    fold, _, ensemble = fitted
    assert tree_attribution.tree_contributions(fold.test.limit(0), ensemble, NAMES).collect() == []
