"""Queries over features read one stored table: no window over the ledger is left in their plans."""

from __future__ import annotations

import pytest
from ledger_cases import SMALL, rows_of

from riskmill.functions.features import FEATURES
from riskmill.plans import base, core, evaluation

READERS = ("e8_captured_fraud", "f10_explanation_sample", "i1_segment_profile", "i3_queue_composition", "j2_alert_queue", "j3_reason_codes",
           "j4_contributions", "l2_decision", "l4_score_rows", "l5_batch_summary", "m1_score_telemetry")


def test_stored_features_are_the_features(spark):
    stored = base.stored_features(spark, SMALL)
    names = ("row_id", "step", *FEATURES, "isFraud")
    assert rows_of(stored, *names) == rows_of(base.features(spark, SMALL), *names)
    assert stored.inputFiles() == base.stored_features(spark, SMALL).inputFiles()


@pytest.mark.parametrize("name", READERS)
def test_plans_hold_no_history_window(spark, name):
    query = {**core.QUERIES, **evaluation.QUERIES}[name]
    plan = query(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(nameDest" not in plan and "cell_step" not in plan
