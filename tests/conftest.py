from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ledger_cases import LEDGER_DDL, SIX_ROWS, SMALL  # noqa: E402

from riskmill.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
           "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
           "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def six(spark):
    return spark.createDataFrame(SIX_ROWS, LEDGER_DDL)


@pytest.fixture(scope="session")
def ledger(spark):
    """The adapted events table at the smallest scale, with one destination holding a third of the rows."""
    from pyspark.sql import functions as F

    from riskmill.sources.events import ledger_from_events

    rows = ledger_from_events(spark, SMALL)
    return rows.withColumn("nameDest", F.when(F.col("row_id") % 3 == 0, "C777").otherwise(F.col("nameDest"))) \
        .withColumn("step", F.when(F.col("row_id") % 5 == 0, 300).otherwise(F.col("step")))
