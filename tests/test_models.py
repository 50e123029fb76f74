from __future__ import annotations

import math
import random

import numpy as np
import pytest
from ledger_cases import rows_of
from pyspark import StorageLevel
from pyspark.sql import Observation
from pyspark.sql import functions as F

from riskmill.functions.features import FEATURES
from riskmill.operators import bundle, models, newton
from riskmill.operators.scaling import apply_scaler
from riskmill.operators.search import Density, Range, Trial, propose, search
from riskmill.session import pin_settings

NAMES = ("a", "b", "c")


@pytest.fixture(scope="module")
def fold(spark):
    """``a`` decides the label, ``b`` helps a little, ``c`` is noise."""
    rows = spark.range(3000).select(
        F.col("id").alias("row_id"), (F.col("id") % 100).alias("step"), F.randn(1).alias("a"), F.randn(2).alias("b"),
        F.randn(3).alias("c"), F.randn(4).alias("e"))
    made = rows.withColumn("is_fraud", (F.col("a") * 2 + F.col("b") * 0.5 + F.col("e") > 3.0).cast("int")).drop("e")
    made.persist()
    return models.PreparedFold(made.where("row_id < 2000"), made.where("row_id >= 2000"), 10.0, 10.0)


def test_logistic_finds_the_signal_and_repeats(fold):
    model = models.fit_logistic(fold, NAMES)
    again = models.fit_logistic(fold, NAMES)
    assert list(model.coefficients) == list(again.coefficients)
    a, b, c = model.coefficients
    assert a > 1 and a > b > abs(c)
    assert models.held_out_average_precision(model, fold, NAMES) > 0.6


def test_scoring_works_in_a_session_with_observed_metrics(spark, fold):
    seen = Observation()
    spark.range(3).observe(seen, F.count("*").alias("n")).collect()
    assert seen.get == {"n": 3}
    model = models.fit_logistic(fold, NAMES)
    assert models.score_with(model, fold.test, NAMES).where("score between 0 and 1").count() == 1000


def test_penalties_shrink_and_select(fold):
    plain = models.fit_logistic(fold, NAMES)
    ridge = models.fit_logistic(fold, NAMES, strength=0.001)
    assert abs(ridge.coefficients[0]) < abs(plain.coefficients[0])
    lasso = models.fit_logistic(fold, NAMES, strength=0.005, l1=True)
    table = models.coefficient_table(fold, lasso, NAMES)
    kept = {r.feature for r in table.where("coefficient <> 0").collect()}
    assert "a" in kept and "c" not in kept and table.first().n_nonzero == len(kept)


def test_trees_and_search(fold):
    model = models.fit_trees(fold, NAMES, max_iter=5, max_depth=3)
    scored = models.score_with(model, fold.test, NAMES)
    assert scored.columns == ["row_id", "step", "is_fraud", "score"]
    assert scored.agg(F.min("score") >= 0, F.max("score") <= 1).first() == (True, True)
    space = (Range("max_depth", 1, 3, whole=True), Range("step_size", 0.05, 0.3, log=True), Range("row_share", 0.5, 1.0))
    tried = models.search_trees([fold], NAMES, space, n_trials=3, max_iter=3)
    assert tried == models.search_trees([fold], NAMES, space, n_trials=3, max_iter=3)
    assert [t.value for t in tried] == sorted((t.value for t in tried), reverse=True)
    best = models.refit_best([fold], tried, NAMES, max_iter=3)
    assert models.held_out_average_precision(best, fold, NAMES) == tried[0].value


def test_prepared_fold_keeps_two_weights(spark):
    from ledger_cases import SMALL

    from riskmill.plans import base

    folded = base.folded_features(spark, SMALL)
    part = models.prepare_fold(folded, 3, per_positive=3.0)
    fraud = part.train.where("is_fraud = 1").count()
    assert part.train.count() == fraud * 4 and part.train_weight == 3.0
    plain = folded.where("fold = 3 AND role = 'test'")
    assert part.test.count() == plain.count() and part.test_weight > 5
    means = part.train.agg(*[F.avg(n).alias(n) for n in FEATURES]).first()
    assert all(abs(means[n]) < 1e-6 for n in FEATURES)


def test_summary_agrees_with_preparation(spark):
    from ledger_cases import SMALL

    from riskmill.plans import base

    summary = models.prepared_fold_summary(base.folded(spark, SMALL), 3.0, 42)
    made = {r.fold: r for r in summary.collect()}
    part = models.prepare_fold(base.folded_features(spark, SMALL), 2, per_positive=3.0, seed=42)
    assert made[2].n_train == part.train.count() and made[2].train_pos_weight == part.train_weight
    assert made[2].n_test == part.test.count() and made[2].test_pos_weight == part.test_weight
    assert made[2].n_train_before > made[2].n_train
    assert rows_of(summary, "fold") == [(1,), (2,), (3,)]


SPACE = (Range("depth", 3, 10, whole=True), Range("rate", 0.01, 0.3, log=True), Range("share", 0.6, 1.0))


def bowl(params):
    return -((params["depth"] - 7) / 7) ** 2 - (math.log(params["rate"] / 0.1)) ** 2 - (params["share"] - 0.8) ** 2


def test_search_repeats_stays_inside_and_beats_chance():
    found = {seed: search(bowl, SPACE, 30, seed) for seed in range(12)}
    assert found[3] == search(bowl, SPACE, 30, 3) and found[3] != found[4]
    for trials in found.values():
        assert sorted(t.number for t in trials) == list(range(1, 31))
        assert all(p.low <= t.params[p.name] <= p.high for t in trials for p in SPACE)
        assert all(isinstance(t.params["depth"], int) for t in trials)
    chance = []
    for seed in found:
        rng = random.Random(seed)
        chance.append(max(bowl(propose(SPACE, [], rng)) for _ in range(30)))
    assert sum(t[0].value for t in found.values()) > sum(chance)


def test_densities_are_densities_and_proposals_follow_good_trials():
    density = Density([0.1, 0.12, 0.9])
    assert sum(density.at((k + 0.5) / 1000) for k in range(1000)) / 1000 == pytest.approx(1.0, abs=1e-6)
    assert density.at(0.11) > density.at(0.5)
    rng = random.Random(2)
    trials = [Trial(k, {"depth": 4 if k % 4 else 9, "rate": 0.02 if k % 4 else 0.2, "share": 0.7}, 0.0 if k % 4 else 1.0) for k in range(16)]
    drawn = [propose(SPACE, trials, rng) for _ in range(20)]
    assert sum(d["depth"] > 6 for d in drawn) > 15 and sum(d["rate"] > 0.07 for d in drawn) > 15


def test_whole_and_logarithmic_ranges():
    for p in SPACE:
        assert p.value(0.0) == pytest.approx(p.low) and p.value(1.0) == pytest.approx(p.high)
    assert [SPACE[0].value((k + 0.5) / 8) for k in range(8)] == list(range(3, 11))
    assert SPACE[1].value(SPACE[1].unit(0.05)) == pytest.approx(0.05)


def test_bundle_scores_like_the_model_after_a_reload(spark, fold, tmp_path):
    model = models.fit_logistic(fold, NAMES)
    scaler = {"a": {"mean": 0.5, "scale": 2.0}, "b": {"mean": -1.0, "scale": 0.25}, "c": {"mean": 0.0, "scale": 1.0}}
    made = bundle.assemble(model, scaler, 0.4, "v7", NAMES)
    bundle.save_bundle(made, spark, str(tmp_path / "b"))
    loaded = bundle.load_bundle(spark, str(tmp_path / "b"))
    assert (loaded.threshold, loaded.version, loaded.names) == (0.4, "v7", NAMES)
    rows = fold.test.withColumn("score", F.lit("a column of that name"))
    scored = loaded.score(rows)
    assert scored.columns == [*fold.test.columns, "score", "flagged"]
    wanted = {r.row_id: r.score for r in models.score_with(model, apply_scaler(fold.test, scaler, NAMES), NAMES).collect()}
    found = scored.collect()
    assert len(found) == len(wanted) and all(abs(r.score - wanted[r.row_id]) < 1e-12 and r.flagged == (r.score >= 0.4) for r in found)
    assert loaded.score(rows.limit(0)).collect() == []


@pytest.mark.parametrize("options", [{}, {"strength": 0.1}, {"strength": 0.1, "l1": True}], ids=["logistic", "ridge", "lasso"])
def test_fits_reach_the_minimum_in_few_jobs(spark, options):
    """One feature nearly repeats another, and rows of one kind are never fraud."""
    rng = np.random.default_rng(5)
    made = []
    for i in range(600):
        a, b, never = float(rng.normal()), float(rng.normal()), float(i % 3 == 0)
        made.append((i, i, int(never == 0 and rng.random() < 1 / (1 + np.exp(2 - a))), a, a + 1e-4 * b, b, never))
    names = ["a", "a_again", "b", "never"]
    train = spark.createDataFrame(made, "row_id long, step long, is_fraud int, " + ", ".join(f"{n} double" for n in names))
    fold = models.PreparedFold(train, train, 1.0, 1.0)
    spark.sparkContext.setJobGroup(f"fit {options}", "")
    model = models.fit_logistic(fold, names, **options)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit {options}")) < 50
    spark.sparkContext.setJobGroup("", "")

    x, y = np.array([r[3:] for r in made]), np.array([r[2] for r in made])
    b = np.array([float(v) for v in model.coefficients])
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    off = weight * (1 / (1 + np.exp(-(x @ b + model.intercept))) - y)
    strength = options.get("strength", 1.0)
    slope = strength * off @ x  # of the summed loss times C; the penalty's slope is the coefficient or its sign
    assert abs(off.sum()) < 1e-6
    if options.get("l1"):
        assert np.all(np.abs(slope) <= 1 + 1e-6) and np.allclose(slope[b != 0], -np.sign(b[b != 0]), atol=1e-6)
    else:
        assert np.allclose(slope, -b, atol=1e-6)
    scores = models.score_with(model, train, names).orderBy("row_id").collect()
    assert np.allclose([r.score for r in scores], 1 / (1 + np.exp(-(x @ b + model.intercept))), atol=1e-12)


def test_a_fold_of_one_label_fits_as_before(spark):
    train = spark.createDataFrame([(i, i, 0, float(i)) for i in range(5)], "row_id long, step long, is_fraud int, a double")
    model = models.fit_logistic(models.PreparedFold(train, train, 1.0, 1.0), ["a"])
    assert list(model.coefficients) == [0.0] and model.intercept == float("-inf")


def counted_fold(spark, seen):
    """Training rows that count in ``seen`` each time one of them is made."""
    def counted(value: float) -> float:
        seen.add(1)
        return value
    rows = spark.range(400).select(
        F.col("id").alias("row_id"), (F.col("id") % 100).alias("step"), (F.col("id") % 7 < 2).cast("int").alias("is_fraud"),
        F.udf(counted, "double")((F.col("id") % 7 + F.col("id") % 3).cast("double")).alias("a"),
        (F.col("id") % 11).cast("double").alias("b"))
    test = rows.withColumn("a", (F.col("row_id") % 7).cast("double"))
    return models.PreparedFold(rows.where("row_id < 300"), test.where("row_id >= 300"), 3.0, 3.0)


def test_a_search_makes_the_rows_of_a_fold_once(spark):
    seen = spark.sparkContext.accumulator(0)
    folds = [counted_fold(spark, seen) for _ in range(2)]
    tried = models.search_trees(folds, ("a", "b"), (Range("max_depth", 1, 3, whole=True),), n_trials=3, max_iter=2)
    assert seen.value == sum(fold.train.select("row_id").count() for fold in folds)
    areas = [models.held_out_average_precision(models.fit_trees(fold, ("a", "b"), 2, **tried[0].params), fold, ("a", "b")) for fold in folds]
    assert tried[0].value == sum(areas) / 2


def test_a_single_tree_fit_makes_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)
    models.fit_trees(counted_fold(spark, seen), ("a", "b"), max_iter=3, max_depth=2)
    assert seen.value == 300


def test_logistic_fits_on_kept_rows_make_them_once_and_equal_single_fits(spark):
    seen = spark.sparkContext.accumulator(0)
    fold, penalties = counted_fold(spark, seen), ({}, {"strength": 0.1}, {"strength": 0.1, "l1": True})
    with models.for_logistic(fold, ("a", "b")) as ready:
        kept = [models.fit_logistic(ready, ("a", "b"), **options) for options in penalties]
        assert seen.value == 300
        alone = models.fit_logistic(ready, ("b",))  # other features than the kept ones
    assert len(alone.coefficients) == 1
    for model, options in zip(kept, penalties):
        single = models.fit_logistic(fold, ("a", "b"), **options)
        assert list(single.coefficients) == list(model.coefficients) and single.intercept == model.intercept
    assert not ready.linear.blocks.is_cached


def test_kept_rows_of_many_batches_and_of_empty_partitions(spark):
    train = spark.range(0, 30000, 1, 2).union(spark.range(0)).select(
        F.col("id").alias("row_id"), F.col("id").alias("step"), (F.col("id") % 5 == 0).cast("int").alias("is_fraud"),
        (F.col("id") % 13).cast("double").alias("a"))
    with models.for_logistic(models.PreparedFold(train, train, 1.0, 1.0), ("a",)) as ready:
        sizes = ready.linear.blocks.map(lambda block: len(block[1])).collect()
        assert sum(sizes) == 30000 and max(sizes) <= 10000
        weights = ready.linear.blocks.map(lambda block: float(block[2].sum())).sum()
        assert weights == pytest.approx(30000)


def test_fits_of_one_fold_share_their_passes(spark):
    fold, wanted = counted_fold(spark, spark.sparkContext.accumulator(0)), [models.Logistic(c, l1) for c, l1 in ((1.0, False), (0.1, False), (0.1, True))]

    def jobs(name, fit):
        spark.sparkContext.setJobGroup(name, "")
        made = fit()
        spark.sparkContext.setJobGroup("", "")
        return made, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    with models.for_logistic(fold, ("a", "b")) as ready:
        together, shared = jobs("together", lambda: models.fit_logistics(ready, wanted, ("a", "b")))
        alone = [jobs(f"alone {i}", lambda: models.fit_logistics(ready, [one], ("a", "b"))[0]) for i, one in enumerate(wanted)]
    assert shared == max(n for _, n in alone) < sum(n for _, n in alone)
    for model, (single, _) in zip(together, alone):
        assert list(model.coefficients) == list(single.coefficients) and model.intercept == single.intercept


class Watched(np.ndarray):
    """Notes how much work a product of it is."""

    work: list = []

    def __array_ufunc__(self, ufunc, method, *inputs, **options):
        plain = [np.asarray(i) if isinstance(i, Watched) else i for i in inputs]
        if ufunc is np.matmul:
            first, second = plain
            self.work.append((first.ndim + second.ndim, first.size * (second.shape[1] if second.ndim == 2 and first.ndim == 2 else 1), second.size))
        made = getattr(ufunc, method)(*plain, **options)
        return made.view(Watched) if isinstance(made, np.ndarray) else made


def test_a_pass_leaves_no_product_to_threads_of_the_library(spark):
    rng = np.random.default_rng(3)
    x, label, weight, at = rng.normal(size=(10_000, 19)), (rng.random(10_000) < 0.3) * 1.0, rng.random(10_000), rng.normal(size=19) / 9
    Watched.work.clear()
    sums, = newton._adder([at])(iter([(x.view(Watched), label.view(Watched), weight.view(Watched))]))
    assert Watched.work and all(max(first, second) <= (newton.MATRIX_WORK if dims == 4 else newton.VECTOR_WORK) for dims, first, second in Watched.work)
    chance = 1 / (1 + np.exp(-(x @ at)))
    assert np.isclose(sums[0][0], weight.sum()) and np.allclose(sums[0][2:21], (weight * (chance - label)) @ x)
    assert np.allclose(sums[0][21:].reshape(19, 19), (x * (weight * chance * (1 - chance))[:, None]).T @ x)


def part_sizes(rows):
    return [r.n for r in rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).collect()]


def test_large_partitions_of_tree_rows_are_dealt_out(spark, fold):
    """Row ids that repeat or are null don't gather rows in one partition."""
    odd = fold.train.withColumn("row_id", F.when(F.col("row_id") < 1000, F.col("row_id") % 3))
    plain = models.PreparedFold(odd.coalesce(1), fold.test.coalesce(1), 10.0, 10.0)
    whole, dealt = models.tree_rows(plain, NAMES), models.tree_rows(plain, NAMES, part_rows=300)
    assert max(part_sizes(whole)) >= 2000 and len(part_sizes(dealt)) == 10 and max(part_sizes(dealt)) < 400

    def values(rows):
        return [(*r.vector, r.label, r.weight, r.held_out) for r in rows.collect()]
    assert values(dealt) == values(models.tree_rows(plain, NAMES, part_rows=300))
    assert sorted(values(dealt)) == sorted(values(whole))
    assert models.tree_rows(models.PreparedFold(odd.limit(0), odd.limit(0), 1.0, 1.0), NAMES, part_rows=300).count() == 0


def test_kept_rows_are_read_in_small_batches(spark):
    kept = pin_settings(spark).range(0, 5000, 1, 1).persist(StorageLevel.DISK_ONLY)
    kept.count()
    assert kept._jdf.queryExecution().withCachedData().cacheBuilder().cachedColumnBuffers().count() == 5
    kept.unpersist()
