from __future__ import annotations

import pytest
from ledger_cases import rows_of
from pyspark.sql import functions as F

from riskmill.operators import folds, sampling, scaling
from riskmill.plans import evaluation


@pytest.fixture(scope="module")
def thousand(spark):
    return spark.range(1000).select(F.col("id").alias("row_id"), F.col("id").alias("step"),
                                    (F.col("id") % 10 == 0).cast("int").alias("isFraud"))


def test_quantiles_interpolate(spark):
    steps = spark.createDataFrame([(s,) for s in (0, 1, 2, 3, 3, 10)], "step long")
    assert folds.fitted_cuts(steps, [0.5, 0.9]) == [2.5, 6.5]


def test_folds_are_disjoint_chronological_expanding(thousand):
    made = folds.time_folds(thousand)
    spans = {(r.fold, r.role): r for r in made.groupBy("fold", "role").agg(
        F.count("*").alias("n"), F.min("step").alias("lo"), F.max("step").alias("hi")).collect()}
    assert {fold for fold, _ in spans} == {1, 2, 3}
    for fold in (1, 2, 3):
        assert spans[fold, "train"].hi < spans[fold, "test"].lo
        if fold > 1:
            assert spans[fold, "train"].n > spans[fold - 1, "train"].n
            assert spans[fold, "test"].lo > spans[fold - 1, "test"].hi
    single = folds.time_folds(thousand, [0.8, 1.0]).where("role = 'test'")
    assert rows_of(single, "row_id") == rows_of(made.where("fold = 3 AND role = 'test'"), "row_id")


def test_one_boundary_is_an_error(thousand):
    with pytest.raises(ValueError, match="at least two boundaries"):
        folds.time_folds(thousand, [1.0])


def test_class_weight_without_positives(thousand):
    row = folds.class_weight(thousand.where("isFraud = 0")).first()
    assert (row.n_negative, row.n_positive, row.pos_weight) == (900, 0, 900.0)


@pytest.mark.parametrize("size", [0, 1, 17, 999, 1000, 5000])
def test_row_sample_has_exact_size_and_repeats(thousand, size):
    first = rows_of(sampling.sample_rows(thousand, size, 42), "row_id")
    assert len(first) == min(size, 1000) == len(set(first))
    assert first == rows_of(sampling.sample_rows(thousand.repartition(7), size, 42), "row_id")


def test_seed_changes_the_sample(thousand):
    assert rows_of(sampling.sample_rows(thousand, 50, 1), "row_id") != rows_of(sampling.sample_rows(thousand, 50, 2), "row_id")


@pytest.mark.parametrize("ratio,expected", [(3.0, 300), (2.555, 255), (50.0, 900), (0.0, 0)])
def test_undersampling_keeps_all_positives(thousand, ratio, expected):
    kept = sampling.undersample_negatives(thousand, ratio, 42)
    assert kept.where("isFraud = 1").count() == 100 and kept.where("isFraud = 0").count() == expected


def test_stratified_sample_when_fraud_is_scarce(thousand):
    assert rows_of(sampling.stratified_sample(thousand, 60, 42).groupBy("isFraud").count(), "isFraud", "count") == [(0, 30), (1, 30)]
    assert rows_of(sampling.stratified_sample(thousand, 400, 42).groupBy("isFraud").count(), "isFraud", "count") == [(0, 300), (1, 100)]


def test_all_positives_filled_and_its_error(thousand):
    kept = sampling.all_positives_filled(thousand, 150, 42)
    assert rows_of(kept.groupBy("isFraud").count(), "isFraud", "count") == [(0, 50), (1, 100)]
    with pytest.raises(Exception, match="positives exceed the sample size 99"):
        sampling.all_positives_filled(thousand, 99, 42).collect()


def test_a_sample_that_may_grow_is_all_positives_when_they_exceed_it(thousand):
    wanted = {r.row_id for r in thousand.where("isFraud = 1").collect()}
    kept = sampling.all_positives_filled(thousand, 99, 42, grow=True).collect()
    assert len(wanted) > 99 and {r.row_id for r in kept} == wanted and len(kept) == len(wanted)
    assert sampling.all_positives_filled(thousand, 150, 42, grow=True).count() == 150


def test_the_filled_sample_query_keeps_more_positives_than_its_size(spark, tmp_path):
    kind = F.when(F.col("id") % 8 == 0, "view").otherwise("purchase")
    spark.range(6000).select((F.col("id") * 13).alias("event_id"), F.expr("TIMESTAMP_NTZ'2024-01-01 05:00:00'").alias("ts"),
                             F.col("id").alias("user_id"), kind.alias("event_type"), F.lit(1.5).alias("value")) \
        .write.parquet(str(tmp_path / "events.parquet"))
    kept = evaluation.f9_all_positives_filled(spark, str(tmp_path))
    assert rows_of(kept.groupBy("isFraud").agg(F.count("*"), F.countDistinct("row_id")), "isFraud", "count(1)", "count(DISTINCT row_id)") \
        == [(1, 5250, 5250)]



def test_scaler_round_trip_and_constant_column(spark):
    rows = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double")
    fitted = scaling.fitted_values(scaling.fit_scaler(rows, names=("a", "b")), ("a", "b"))
    there = scaling.apply_scaler(rows, fitted, ("a", "b"))
    assert [round(r.a, 6) for r in there.orderBy("a").collect()] == [-1.224745, 0.0, 1.224745]
    assert {r.b for r in there.collect()} == {0.0}
    assert rows_of(scaling.invert_scaler(there, fitted, ("a", "b")), "a", "b") == [(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)]


def test_scaler_per_group(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 10.0), (2, 30.0)], "fold int, a double")
    fitted = scaling.fit_scaler(rows, ("fold",), ("a",))
    made = scaling.apply_scaler_by(rows, fitted, ("fold",), ("a",))
    assert rows_of(made, "fold", "a") == [(1, -1.0), (1, 1.0), (2, -1.0), (2, 1.0)]
