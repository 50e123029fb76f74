from __future__ import annotations

import pytest
from ledger_cases import LEDGER_DDL, SIX_ROWS, rows_of
from pyspark.sql import functions as F

from riskmill.operators import history, state, validation
from riskmill.sources import ledger as ledger_source
from riskmill.sources import sinks


def test_valid_ledger_passes(six):
    validation.validate_ledger(six)
    assert validation.violations(six).count() == 0


@pytest.mark.parametrize("column,value,check", [
    ("type", "NOT_A_REAL_TYPE", "known_value"), ("amount", -5.0, "at_least_zero"), ("isFraud", 2, "zero_or_one"),
])
def test_each_violation_is_named(six, column, value, check):
    bad = six.withColumn(column, F.when(F.col("row_id") == 3, F.lit(value)).otherwise(F.col(column)))
    with pytest.raises(ValueError, match=f"{column}: {check} fails on 1 rows"):
        validation.validate_ledger(bad)
    assert rows_of(validation.violations(bad), "row_id", "column_name", "check_name") == [(3, column, check)]


def test_all_failures_are_listed(six):
    bad = six.withColumn("amount", F.lit(-1.0)).withColumn("type", F.lit("X"))
    with pytest.raises(ValueError) as caught:
        validation.validate_ledger(bad)
    assert "amount: at_least_zero fails on 6" in str(caught.value) and "type: known_value fails on 6" in str(caught.value)


def test_wrong_type_is_not_cast(six):
    with pytest.raises(ValueError, match="amount: string instead of double"):
        validation.validate_ledger(six.withColumn("amount", F.col("amount").cast("string")))


def test_one_bad_row_rejects_its_batch(six):
    rows = six.withColumn("batch_id", F.col("row_id") % 2).withColumn(
        "nameDest", F.when(F.col("row_id") == 2, "").otherwise(F.col("nameDest")))
    accepted, quarantined = validation.split_batches(rows)
    assert rows_of(accepted, "row_id") == [(1,), (3,), (5,)]
    assert rows_of(quarantined, "row_id") == [(2,), (4,), (6,)]


def test_oversized_batch_is_rejected(six):
    verdict = validation.admission(six.withColumn("batch_id", F.lit(1)), max_rows=5).first()
    assert verdict.n_rows == 6 and not verdict.accepted


def test_required_columns():
    ledger_source.require_columns(["a", "b"], ["a"])
    with pytest.raises(ValueError, match="missing required columns: b"):
        ledger_source.require_columns(["a"], ["a", "b"])
    with pytest.raises(ValueError, match="unexpected columns: c"):
        ledger_source.require_columns(["a", "c"], ["a"], allow_extra=False)


def test_csv_ingest_numbers_rows_once(spark, six, tmp_path):
    source, target = str(tmp_path / "csv"), str(tmp_path / "table")
    six.drop("row_id").coalesce(1).write.option("header", True).csv(source)
    table = ledger_source.ingest_ledger(spark, source, target)
    assert table.count() == 6 and table.select("row_id").distinct().count() == 6
    assert dict(table.dtypes)["amount"] == "double" and dict(table.dtypes)["step"] == "bigint"
    validation.validate_ledger(table)


def test_materialize_reuses_until_source_or_version_changes(spark, six, tmp_path):
    source, root = str(tmp_path / "src"), str(tmp_path / "out")
    six.write.parquet(source)

    def build():
        return history.build_features(spark.read.parquet(source))

    _, reused = sinks.materialize(spark, source, root, build)
    assert not reused
    table, reused = sinks.materialize(spark, source, root, build)
    assert reused and table.count() == 6
    assert not sinks.materialize(spark, source, root, build, version=99)[1]
    spark.createDataFrame(SIX_ROWS[:1], LEDGER_DDL).write.mode("append").parquet(source)
    assert not sinks.materialize(spark, source, root, build)[1]


def test_snapshot_and_result_sinks(spark, six, tmp_path):
    path = str(tmp_path / "state")
    sinks.write_snapshot(state.destination_snapshot(six), path)
    stored = sinks.read_snapshot(spark, path)
    assert {r.snapshot_step for r in stored.collect()} == {30}
    assert any(name.endswith(".zstd.parquet") for name in stored.inputFiles())
    written = sinks.write_tables({"a": six, "b": six.limit(1)}, str(tmp_path / "tables"), "csv")
    assert [spark.read.option("header", True).csv(p).count() for p in written] == [6, 1]


def test_audit_hides_values(spark, six, tmp_path):
    made = history.build_features(six).withColumns({
        "score": F.lit(0.5), "flagged": F.lit(True), "decision": F.lit("REVIEW"), "state_hit": F.lit(False)})
    records = sinks.audit_records(made, "m", "v1", 0.4)
    assert "amount" not in records.columns
    digests = {r.feature_hash for r in records.collect()}
    assert len(digests) == 6 and all(d.startswith("sha256:") and len(d) == 71 for d in digests)
    sinks.append_audit(records, str(tmp_path / "audit"))
    sinks.append_audit(records, str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).count() == 12
