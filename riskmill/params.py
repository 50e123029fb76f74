"""Default parameters. Fixed values that must equal the published ones stand here in plain form."""

from __future__ import annotations

# One step is one hour.
STEPS_PER_DAY = 24
VELOCITY_HOURS = 24

TRANSACTION_TYPES = ("CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER")

BATCH_MAX_ROWS = 10_000
VALIDATION_SAMPLE_ROWS = 50_000

# Training
SEED = 42
FOLD_BOUNDARIES = (0.4, 0.6, 0.8, 1.0)
NEGATIVES_PER_POSITIVE = 50

# Ranking
FRAUD_MULTIPLES = (1, 2, 5, 10)
HEADLINE_MULTIPLE = 5
MIN_REPORTED_K = 10
CEILING_TOLERANCE = 1e-9
PROBABILITY_FLOOR = 1e-12

# Review capacity and economics
REVIEWS_PER_DAY = 500
REVIEWS_GRID = (100, 250, 500, 1000, 2000, 5000)
COST_PER_REVIEW = 200.0
RECOVERY_RATE = 0.5
LIABILITY_RATE = 1.0
RECOVERY_GRID = (0.05, 0.1, 0.25, 0.5, 0.75, 1.0)
LOW_REVIEWS, HIGH_REVIEWS = 250, 500
TICKET_GRID = (
    100, 500, 1000, 2500, 5000, 10_000, 25_000, 50_000,
    100_000, 250_000, 500_000, 1_000_000, 2_000_000, 5_000_000,
)
SATURATED_RECALL = 0.9999

# Decisions and telemetry
HARD_BLOCK_AMOUNT = 1_000_000.0
REASONS_PER_ALERT = 4
MAX_EXPLAINED_ALERTS = 50
EXPLAIN_SAMPLE_ROWS = 20_000
SCORE_BUCKETS = ("[0.0-0.2)", "[0.2-0.4)", "[0.4-0.6)", "[0.6-0.8)", "[0.8-1.0]")
TRACKED_LATENCIES = 5_000
ZERO_ATTRIBUTION = 1e-9

# Drift flags
PSI_FEATURE_LIMIT = 0.25
PSI_SCORE_LIMIT = 0.10
