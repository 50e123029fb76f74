"""Ledger rows and helpers that several test modules share."""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from riskmill.sources.ledger import LEDGER_SCHEMA  # noqa: E402

SMALL = "/root/testdata/sf0.001"

LEDGER_DDL = "row_id long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LEDGER_SCHEMA)

# Hand-computed results exist for exactly these rows.
# (row_id, step, type, amount, nameOrig, oldbalanceOrg, newbalanceOrig, nameDest, oldbalanceDest, newbalanceDest, isFraud)
SIX_ROWS = [
    (1, 0, "TRANSFER", 100.0, "CORIG1", 1000.0, 900.0, "C1", 0.0, 100.0, 0, 0),
    (2, 0, "TRANSFER", 50.0, "CORIG2", 500.0, 450.0, "C1", 0.0, 50.0, 0, 0),
    (3, 10, "CASH_OUT", 200.0, "CORIG3", 300.0, 100.0, "C1", 0.0, 200.0, 0, 0),
    (4, 30, "CASH_OUT", 400.0, "CORIG4", 0.0, 0.0, "C1", 0.0, 400.0, 0, 0),
    (5, 5, "PAYMENT", 75.0, "CORIG5", 0.0, 0.0, "C2", 0.0, 75.0, 0, 0),
    (6, 5, "PAYMENT", 60.0, "CORIG6", 200.0, 140.0, "M999999999", 0.0, 60.0, 0, 0),
]


def rows_of(frame, *names):
    """Rows as a sorted list of tuples."""
    return sorted((tuple(row) for row in frame.select(*names).collect()), key=repr)
