from __future__ import annotations

import math

import pytest
from ledger_cases import SMALL, rows_of
from pyspark.sql import functions as F

from riskmill.operators import capacity, compare, errors, metrics, ranking
from riskmill.plans import base


def scored_frame(spark, labels, scores, steps=None):
    steps = steps or list(range(len(labels)))
    rows = [(i, s, y, float(p)) for i, (y, p, s) in enumerate(zip(labels, scores, steps))]
    return spark.createDataFrame(rows, "row_id long, step long, is_fraud int, score double")


def point_at(spark, labels, scores, k):
    histogram = ranking.cumulative_histogram(scored_frame(spark, labels, scores))
    return metrics.operating_points(histogram, metrics.fixed_ks([k])).first()


def test_operating_point(spark):
    p = point_at(spark, [1, 0, 1, 0, 0], [.9, .2, .8, .1, .05], 2)
    assert (p.n_flagged, p.true_positives, p.false_positives, p.precision, p.recall) == (2, 2, 0, 1.0, 1.0)


def test_ties_flag_more_than_k(spark):
    p = point_at(spark, [1, 0, 1, 0, 0], [.9, .9, .9, .5, .1], 2)
    assert (p.k, p.threshold, p.n_flagged, p.true_positives, p.false_positives) == (2, .9, 3, 2, 1)
    assert p.precision == pytest.approx(2 / 3) and p.recall == 1.0


def test_recall_without_fraud_is_null(spark):
    p = point_at(spark, [0, 0, 0], [.3, .2, .1], 1)
    assert p.recall is None and p.precision == 0.0


@pytest.mark.parametrize("k", [0, 4])
def test_k_out_of_range_fails(spark, k):
    with pytest.raises(Exception, match="k must be between 1 and 3"):
        point_at(spark, [0, 1, 0], [.3, .2, .1], k)
    with pytest.raises(Exception, match="k must be between 1 and 3"):
        metrics.precision_recall_at_k(scored_frame(spark, [0, 1, 0], [.3, .2, .1]), [k]).collect()


def test_sweep_ceiling_under_ties(spark):
    frame = scored_frame(spark, [1, 0, 1, 0, 0], [.9, .9, .9, .5, .1], [0, 5, 9, 12, 23])
    row = metrics.capacity_sweep(frame, [2]).first()
    assert row.window_days == 1.0 and row.k == 2 and row.n_flagged == 3
    assert row.precision_ceiling == pytest.approx(2 / 3) and row.at_ceiling


@pytest.mark.parametrize("wanted,expected", [(2.5, 2), (3.5, 4), (0.2, 1), (99.0, 10)])
def test_capacity_rounds_half_to_even_and_clamps(spark, wanted, expected):
    k = capacity.capacity_k(F.lit(1.0), F.lit(wanted), F.lit(10).cast("long"))
    assert spark.range(1).select(k.alias("k")).first().k == expected


def test_window_days(spark):
    frame = spark.createDataFrame([(100,), (123,)], "step long")
    assert capacity.window_length(frame).first().window_days == 1.0
    assert capacity.window_length(frame.limit(0)).first().window_days == 0.0


def test_precision_and_recall_at_k(spark):
    made = metrics.precision_recall_at_k(scored_frame(spark, [0, 0, 1, 0, 1], [.1, .4, .9, .2, .8]), [1, 2, 3])
    values = {r.k: (r.precision_at_k, r.recall_at_k) for r in made.collect()}
    assert values[2] == (1.0, 1.0) and values[1] == (1.0, .5) and values[3][0] == pytest.approx(2 / 3)


def test_average_precision_is_not_the_trapezoid(spark):
    frame = ranking.cumulative_histogram(scored_frame(spark, [1, 0, 1, 0, 1], [.9, .8, .7, .6, .1]))
    row = frame.agg(metrics.average_precision().alias("ap"), metrics.roc_auc().alias("auc")).first()
    assert row.ap == pytest.approx(0.755556, abs=1e-6)
    assert row.auc == pytest.approx(3 / 6)


def test_auc_counts_ties_half(spark):
    frame = ranking.cumulative_histogram(scored_frame(spark, [1, 0, 1, 0], [.5, .5, .5, .5]))
    assert frame.agg(metrics.roc_auc().alias("auc")).first().auc == 0.5


def test_weighted_loss_clips(spark):
    frame = scored_frame(spark, [1, 0, 1], [1.0, 0.0, 0.5])
    row = metrics.weighted_log_loss(frame, F.lit(2.0)).first()
    assert row.weighted_bce == pytest.approx(-(2 * math.log(0.5)) / 3, abs=1e-9)


@pytest.fixture(scope="module")
def crowded(spark):
    """Scores of the smallest table where two values are shared by a large part of the rows."""
    rows = base.scored(spark, SMALL)
    return rows.withColumn("score", F.when(F.col("row_id") % 3 == 0, 0.25).when(F.col("row_id") % 7 == 0, 0.6)
                           .otherwise(F.col("score"))).withColumn("g", (F.col("row_id") % 2).cast("int"))


@pytest.mark.parametrize("part_rows", [10**9, 100, 7])
def test_ranks_are_exact_whatever_the_parts(crowded, part_rows):
    made = ranking.global_rank(crowded, ("g",), part_rows=part_rows)
    plain = {}
    for row in sorted(crowded.collect(), key=lambda r: (r.g, -r.score, r.row_id)):
        plain.setdefault(row.g, []).append(row.row_id)
    ranks = {(r.g, r.rank): r.row_id for r in made.collect()}
    assert ranks == {(g, i + 1): row_id for g, ids in plain.items() for i, row_id in enumerate(ids)}
    totals = {r.g: (r.total_rows, r.total_positives) for r in made.collect()}
    assert all(totals[g][0] == len(ids) for g, ids in plain.items())


@pytest.mark.parametrize("part_rows", [10**9, 20])
def test_histogram_is_exact_whatever_the_parts(crowded, part_rows):
    made = {(r.g, r.score): (r.cum_rows, r.cum_positives)
            for r in ranking.cumulative_histogram(crowded, ("g",), part_rows=part_rows).collect()}
    rows = crowded.collect()
    for (g, score), (n, pos) in list(made.items())[::29]:
        above = [r for r in rows if r.g == g and r.score >= score]
        assert (n, pos) == (len(above), sum(r.is_fraud for r in above))


def test_crowded_score_is_split_into_bounded_parts(crowded):
    parts = ranking.ordered_parts(crowded, [F.desc("score"), F.asc("row_id")], 50).groupBy("_part").count()
    assert parts.agg(F.max("count")).first()[0] < 200 and parts.count() >= 10


def test_evaluation_matches_the_single_metrics(spark):
    scores = base.model_scores(spark, SMALL)
    made = {(r.model, r.fold): r for r in metrics.evaluate(scores, 10).collect()}
    assert len(made) == 9
    one = scores.where("model = 'alpha' AND fold = 3")
    row = metrics.evaluate(one, 10, by=()).first()
    assert row.pr_auc == pytest.approx(made["alpha", 3].pr_auc) and row.k == made["alpha", 3].k
    curve = metrics.k_curve(one).where("k_multiplier = 5").first()
    assert (curve.k, curve.precision_at_k) == (row.k, row.precision_at_k)


def test_selection_breaks_ties_by_name(spark):
    results = spark.createDataFrame(
        [("b", 1, .5, .9), ("a", 1, .5, .1), ("c", 1, .2, .95)], "model string, fold int, capacity_precision double, pr_auc double")
    curves = spark.createDataFrame([("b", 1, .1), ("a", 1, .3), ("c", 1, .3)], "model string, k_multiplier int, precision_at_k double")
    row = compare.select_model(results, curves).first()
    assert (row.best_model, row.pr_auc_leader, row.k1_leader, row.pr_auc_disagrees, row.k1_disagrees) == ("a", "c", "a", True, False)


# Error analysis

def test_segment_profile(spark):
    rows = spark.createDataFrame(
        list(zip([100., 200., 150., 50., 300., 80.], [1, 1, 0, 0, 1, 0], [1, 1, 0, 0, 1, 0], [.9, .8, .7, .2, .3, .1])),
        "amount double, flag_feat int, is_fraud int, score double")
    made = {r.feature: r for r in errors.segment_profile(rows, F.col("score") >= 0.5, ("amount", "flag_feat")).collect()}
    a = made["amount"]
    assert (a.true_positive_n, a.false_positive_n, a.false_negative_n) == (2, 1, 1)
    assert (a.true_positive_mean, a.false_positive_mean, a.false_negative_mean) == (150.0, 150.0, 300.0)
    assert a.fp_vs_tp_std_gap == 0.0
    none = {r.feature: r for r in errors.segment_profile(rows, F.col("score") >= 0.75, ("amount",)).collect()}["amount"]
    assert none.false_positive_mean is None and none.fp_vs_tp_std_gap is None
    flat = errors.segment_profile(rows.withColumn("amount", F.lit(1.0)), F.col("score") >= 0.5, ("amount",)).first()
    assert flat.fp_vs_tp_std_gap is None


def test_missed_fraud_ranks(spark):
    frame = scored_frame(spark, [1, 0, 1, 0, 1, 0, 1, 0], [.9, .8, .7, .6, .5, .4, .3, .2])
    row = errors.missed_fraud_ranking(frame, F.lit(4)).first()
    assert (row.fraud_in_top_k, row.fraud_missed, row.missed_rank_min, row.missed_rank_median, row.missed_rank_max,
            row.missed_within_2x_k, row.missed_in_bottom_half) == (2, 2, 5, 6.0, 7, 2, 2)
    assert row.k_to_catch_half_of_missed == 6 and row.k_to_catch_all_missed == 7


def test_missed_fraud_with_ties_and_without_fraud(spark):
    frame = scored_frame(spark, [1, 1, 0, 1, 0], [.9, .8, .8, .8, .5])
    assert errors.missed_fraud_ranking(frame, F.lit(4)).first().fraud_missed == 0
    assert errors.missed_fraud_ranking(frame, F.lit(4)).first().missed_rank_median is None
    assert errors.missed_fraud_ranking(frame, F.lit(2)).first().fraud_missed > 0
    assert errors.missed_fraud_ranking(scored_frame(spark, [0, 0], [.1, .2]), F.lit(1)).count() == 0


@pytest.mark.parametrize("slot_rows", [1, 3, 4096])
def test_median_of_ranks(spark, slot_rows):
    ranks = spark.createDataFrame([(r, 100) for r in (3, 8, 20, 21, 77, 99)], "rank long, total_rows long")
    assert ranking.exact_median_of_ranks(ranks, slot_rows=slot_rows).first().median_rank == 20.5
    assert ranking.exact_median_of_ranks(ranks.where("rank < 99"), slot_rows=slot_rows).first().median_rank == 20.0
