"""One run on two folds: stored scores against plain Python, and the tables made from them."""

from __future__ import annotations

import threading

import pytest
from ledger_cases import SMALL
from pyspark.sql import functions as F

from riskmill.functions.features import FEATURES
from riskmill.lineage import side_by_side
from riskmill.operators import compare, errors, metrics, models, ranking, training
from riskmill.operators.models import Logistic, fit_logistic, fit_trees
from riskmill.plans import base, fitting, storage
from riskmill.sources import sinks

PER_DAY = 5
LEARNERS = {"logistic": fit_logistic, training.TREES: lambda fold: fit_trees(fold, max_iter=4)}


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("scores"))
    last = training.store_scores(base.folded_features(spark, SMALL), (2, 3), path, LEARNERS)
    return last, training.read_scores(spark, path).persist()


def plain_result(rows):
    """Average precision, K, threshold, rows flagged and hits of (score, label, step) rows."""
    fraud = sum(label for _, label, _ in rows)
    ranked = sorted(rows, key=lambda r: -r[0])
    area, seen, hits = 0.0, 0, 0
    for score in sorted({s for s, _, _ in rows}, reverse=True):
        here = [label for s, label, _ in rows if s == score]
        seen, hits = seen + len(here), hits + sum(here)
        area += sum(here) / fraud * hits / seen
    days = (max(s for *_, s in rows) - min(s for *_, s in rows) + 1) / 24
    k = min(max(round(PER_DAY * days), 1), len(rows))
    threshold = ranked[k - 1][0]
    queue = [label for s, label, _ in rows if s >= threshold]
    return area, k, threshold, len(queue), sum(queue)


def test_stored_scores_reach_evaluation_selection_and_missed_fraud(spark, run):
    last, scores = run
    wanted = base.folded(spark, SMALL).where("role = 'test' AND fold IN (2, 3)")
    assert {(r.model, r.fold, r.n) for r in scores.groupBy("model", "fold").agg(F.count("*").alias("n")).collect()} == {
        (m, r.fold, r.n) for m in LEARNERS for r in wanted.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    plain = {}
    for r in scores.collect():
        plain.setdefault((r.model, r.fold), []).append((r.score, r.is_fraud, r.step))
    results = metrics.evaluate(scores, PER_DAY)
    for r in results.collect():
        area, k, threshold, flagged, hits = plain_result(plain[r.model, r.fold])
        assert r.pr_auc == pytest.approx(area) and (r.capacity_k, r.capacity_threshold) == (k, threshold)
        assert r.capacity_precision == pytest.approx(hits / flagged)
        points = metrics.capacity_sweep(scores, (PER_DAY,), training.KEYS).select(*training.KEYS, "n_flagged")
        missed = errors.missed_fraud_ranking(scores.join(points, list(training.KEYS)), F.col("n_flagged"), training.KEYS)
        row = missed.where((F.col("model") == r.model) & (F.col("fold") == r.fold)).first()
        assert row.k == flagged and row.fraud_in_top_k + row.fraud_missed == sum(x for _, x, _ in plain[r.model, r.fold])
    means = {m: sum(plain_result(plain[m, f])[4] / plain_result(plain[m, f])[3] for f in (2, 3)) / 2 for m in LEARNERS}
    best = compare.select_model(results, metrics.k_curve(scores, training.KEYS)).first()
    assert best.best_model == min(means, key=lambda m: (-means[m], m))
    assert best.capacity_precision_mean == pytest.approx(means[best.best_model])


@pytest.mark.parametrize("name", sorted(LEARNERS))
def test_explanations_add_up_to_the_stored_score(run, tmp_path, name):
    last, scores = run
    explained = training.explained_rows(last, name, str(tmp_path / "model"))
    stored = scores.where((F.col("model") == name) & (F.col("fold") == 3)).select("row_id", F.col("score").alias("stored"))
    both = explained.join(stored, "row_id").agg(F.count("*").alias("n"), F.max(F.abs(F.col("score") - F.col("stored"))).alias("gap")).first()
    assert both.n == stored.count() and both.gap < 1e-9


def test_eleven_tables(spark, run, tmp_path):
    last, scores = run
    tables = training.result_tables(scores, last, base.ledger(spark, SMALL), str(tmp_path / "m"), PER_DAY, (2, 5, 10), 2.0, ablation_rounds=2)
    assert len(tables) == 11
    counts = {name: frame.count() for name, frame in tables.items()}
    assert counts["model_comparison_by_fold"] == 4 and counts["model_comparison"] == 2 and counts["feature_ablation"] == 4
    assert counts["capacity_sweep"] == counts["capacity_economics"] == 3 and counts["missed_fraud_summary"] == 1
    assert counts["global_importance"] == counts["error_analysis_profile"] == len(FEATURES)
    with pytest.raises(ValueError):
        training.store_scores(base.folded(spark, SMALL), (), str(tmp_path / "none"))


def test_folds_are_fitted_at_the_same_time(spark, tmp_path):
    both = threading.Barrier(2, timeout=60)

    def learn(fold):
        both.wait()
        return fit_logistic(fold)
    path = str(tmp_path / "scores")
    last = training.store_scores(base.folded_features(spark, SMALL), (2, 3), path, {"logistic": learn})
    assert last.number == 3 and list(last.models) == ["logistic"]
    assert {r.fold for r in training.read_scores(spark, path).select("fold").distinct().collect()} == {2, 3}


def test_side_by_side_keeps_the_order_and_raises(spark):
    assert side_by_side(lambda x: x * 2, range(7)) == [0, 2, 4, 6, 8, 10, 12] and side_by_side(str, []) == []
    with pytest.raises(ZeroDivisionError):
        side_by_side(lambda x: 1 // x, (2, 1, 0))


def test_logistic_learners_of_a_fold_are_fitted_together(monkeypatch):
    calls = []
    monkeypatch.setattr(models, "fit_logistics", lambda fold, wanted: calls.append(wanted) or [f"{one.strength}" for one in wanted])
    made = training.fit_learners("rows", {"one": Logistic(), "trees": lambda fold: fold, "two": Logistic(0.1, True)})
    assert list(made.items()) == [("one", "1.0"), ("trees", "rows"), ("two", "0.1")] and calls == [[Logistic(), Logistic(0.1, True)]]


def test_fitted_queries_read_ranks_from_one_order(spark, run, monkeypatch):
    """Missed fraud and selection equal those of separate orders, of which they used to make two."""
    _, scores = run
    orders, order = [], ranking.ordered_parts

    def counted(rows, *args):
        orders.append(rows)
        return order(rows, *args)
    keys = list(training.KEYS)
    points = metrics.capacity_sweep(scores, (base.REVIEWS_PER_DAY,), keys).select(*keys, "n_flagged")
    missed = errors.missed_fraud_ranking(scores.join(points, keys), F.col("n_flagged"), keys).orderBy(*keys).collect()
    chosen = compare.select_model(metrics.evaluate(scores, base.REVIEWS_PER_DAY), metrics.k_curve(scores, keys)).collect()
    monkeypatch.setattr(fitting, "_fitted_scores", lambda *_: scores)
    monkeypatch.setattr(ranking, "ordered_parts", counted)
    assert fitting.i2_fitted_missed(spark, SMALL).orderBy(*keys).collect() == missed and len(orders) == 1
    assert fitting.h3_fitted_selection(spark, SMALL).collect() == chosen and len(orders) == 2


def test_tables_are_written_at_the_same_time(spark, tmp_path):
    both = threading.Barrier(2, timeout=60)

    class Table:
        """Stands in for a frame and its writer."""

        write = property(lambda self: self)

        def mode(self, _):
            both.wait()
            return self
        format = mode

        def save(self, _):
            pass
    assert sinks.write_tables({"a": Table(), "b": Table()}, str(tmp_path)) == [f"{tmp_path}/a", f"{tmp_path}/b"]


def test_the_registered_run_gives_its_ablation_all_rounds(spark, run, monkeypatch):
    last, scores = run
    rounds = []

    def noted(fold, names, max_iter):
        rounds.append(max_iter)
        return fit_trees(fold, names, max_iter=1, max_depth=2)
    monkeypatch.setattr(training, "store_scores", lambda *_: last)
    monkeypatch.setattr(training, "read_scores", lambda *_: scores)
    monkeypatch.setattr(models, "fit_trees", noted)
    counts = {r.result: r.n_rows for r in storage.a5_result_tables(spark, SMALL).collect()}
    assert rounds == [models.TREE_ROUNDS] * 4 and len(counts) == 11 and counts["feature_ablation"] == 4
