"""Feature tables, components and snapshots that grow or are stored for later joins, and counts that come with a write."""

from __future__ import annotations

import random

import pytest
from ledger_cases import rows_of
from pyspark.sql import functions as F

from riskmill.functions.features import FEATURES
from riskmill.operators import graph, state, validation
from riskmill.operators.history import build_features
from riskmill.sources import incremental, sinks
from riskmill.sources.ledger import LEDGER_COLUMNS

NAMES = ("row_id", "step", *FEATURES, "isFraud")


@pytest.mark.parametrize("hot_rows", [10**9, 20])
def test_appends_equal_a_full_build(spark, ledger, tmp_path, hot_rows):
    root, edges = str(tmp_path), [0, 100, 130, 300, 301, 100_000]
    for low, high in zip(edges, edges[1:]):
        table = incremental.append_steps(ledger.where((F.col("step") >= low) & (F.col("step") < high)), root, hot_rows=hot_rows, row_block=16)
    assert incremental.last_append(spark, root)[0] == 5
    assert rows_of(table, *NAMES) == rows_of(build_features(ledger), *NAMES)
    last = max(r.step for r in ledger.select("step").collect())
    stored = spark.read.parquet(f"{root}/state/number=5")
    assert stored.agg(F.min("at_step")).first()[0] > last - 24
    assert stored.where("at_step is null").count() == ledger.select("nameDest").distinct().count()
    with pytest.raises(ValueError):
        incremental.append_steps(ledger.where(F.col("step") == last), root)
    assert incremental.append_steps(ledger.limit(0), root).count() == ledger.count()


def test_an_unfinished_append_is_written_anew(spark, six, tmp_path):
    root = str(tmp_path)
    incremental.append_steps(six.where("step = 0"), root)
    build_features(six.where("step = 30")).write.parquet(f"{root}/features/number=2")  # died before its marker
    table = incremental.append_steps(six.where("step > 0"), root)
    assert rows_of(table, *NAMES) == rows_of(build_features(six), *NAMES)
    with pytest.raises(ValueError):
        incremental.read_appended(spark, f"{root}/nothing")


def test_an_append_scans_its_rows_and_the_state_only(spark, six, tmp_path):
    root = str(tmp_path)
    incremental.append_steps(six.where("step <= 5"), root)
    number, last = incremental.last_append(spark, root)
    old = spark.read.schema(incremental.STATE_DDL).parquet(f"{root}/state/number={number}")
    rows = six.where("step > 5")
    plan = incremental._with_state(incremental.with_history(rows), rows, old, last)
    files = {name.split(root)[1].split("/")[1] for name in plan.inputFiles() if root in name}
    assert files == {"state"}


def test_grown_components_equal_a_full_run(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(60), 100 + rng.randrange(60)) for _ in range(90)]
    frame = spark.createDataFrame([(n, *p) for n, p in enumerate(pairs)], "n int, a long, b long")
    labels = graph.connected_components(frame.where("n < 30"), "a", "b")
    for low, high in ((30, 60), (60, 90), (90, 120)):
        labels = graph.grown_components(labels, frame.where((F.col("n") >= low) & (F.col("n") < high)), "a", "b").cache()
    assert rows_of(labels, "node", "component") == rows_of(graph.connected_components(frame, "a", "b"), "node", "component")


def test_joins_on_a_bucketed_snapshot_leave_it_where_it_is(spark, ledger, tmp_path):
    snapshot = state.destination_snapshot(ledger)
    stored = sinks.write_bucketed_snapshot(snapshot, "bucketed_snapshot", str(tmp_path / "b"), 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        looked = state.lookup_state(ledger, stored)
        audit = state.compare_states(stored, stored)
        plans = [f._jdf.queryExecution().executedPlan().toString() for f in (looked, audit)]
        assert plans[0].count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(name_dest" not in plans[0]
        assert "Exchange" not in plans[1]
        names = ("row_id", *state.STATE_COLUMNS, "state_hit")
        assert rows_of(looked, *names) == rows_of(state.lookup_state(ledger, snapshot), *names)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_snapshot")


def test_rule_counts_come_with_the_ingest(spark, ledger, tmp_path):
    bad = ledger.withColumns({"amount": F.when(F.col("row_id") % 7 == 0, -1.0).otherwise(F.col("amount")),
                              "type": F.when(F.col("row_id") % 11 == 0, "ODD").otherwise(F.col("type"))})
    bad.select("row_id", *LEDGER_COLUMNS).write.parquet(str(tmp_path / "in"))
    table, report = validation.validated_ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), "parquet")
    assert table.count() == ledger.count()
    names = ("column_name", "check_name", "failures")
    assert rows_of(report, *names) == rows_of(validation.validation_report(table), *names)
    assert {r.column_name for r in report.where("failures > 0").collect()} == {"amount", "type"}
