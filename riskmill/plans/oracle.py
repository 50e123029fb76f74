"""SQL twins of the registered queries, written against the same tables for an independent engine.

Each query states its result directly (plain windows, correlated subqueries), not the way the Spark job gets there.
"""

from __future__ import annotations

from riskmill.functions.features import FEATURES
from riskmill.operators.review import POISSON_ONE
from riskmill.params import FOLD_BOUNDARIES, FRAUD_MULTIPLES, NEGATIVES_PER_POSITIVE
from riskmill.plans import base
from riskmill.plans.storage import STREAM_PARTS, TELEMETRY_HOURS

DEC = "DECIMAL(28,6)"


def _list(values) -> str:
    return "[" + ", ".join(f"CAST({v} AS DOUBLE)" for v in values) + "]"


CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def _cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (sql, needs)


_cte("ledger0", """
    SELECT event_id AS row_id, CAST(date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) AS BIGINT) AS step,
        CASE event_type WHEN 'signup' THEN 'CASH_IN' WHEN 'purchase' THEN 'CASH_OUT' WHEN 'error' THEN 'DEBIT'
            WHEN 'view' THEN 'PAYMENT' WHEN 'click' THEN 'TRANSFER' END AS type,
        value AS amount,
        'C' || CAST(event_id + 100000 AS VARCHAR) AS nameOrig,
        CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN 0e0 ELSE value * 2e0 END AS oldbalanceOrg,
        (CASE WHEN user_id % 5 = 0 THEN 'M' ELSE 'C' END) || CAST(user_id AS VARCHAR) AS nameDest,
        user_id * 10e0 AS oldbalanceDest, user_id * 10e0 + value AS newbalanceDest
    FROM events""")
_cte("ledger", """
    SELECT row_id, step, type, amount, nameOrig, oldbalanceOrg, greatest(oldbalanceOrg - amount, 0e0) AS newbalanceOrig,
        nameDest, oldbalanceDest, newbalanceDest,
        CAST(CASE WHEN type IN ('TRANSFER', 'CASH_OUT') AND row_id % 13 = 0 THEN 1 ELSE 0 END AS INTEGER) AS isFraud,
        CAST(0 AS INTEGER) AS isFlaggedFraud
    FROM ledger0""", "ledger0")
_cte("faulty", """
    SELECT row_id, step, CASE WHEN row_id % 97 = 0 THEN 'UNKNOWN' ELSE type END AS type, amount - 1e0 AS amount,
        CASE WHEN row_id % 103 = 0 THEN '' ELSE nameOrig END AS nameOrig, oldbalanceOrg, newbalanceOrig,
        CASE WHEN row_id % 101 = 0 THEN NULL ELSE nameDest END AS nameDest, oldbalanceDest, newbalanceDest,
        CASE WHEN row_id % 89 = 0 THEN 2 ELSE isFraud END AS isFraud, isFlaggedFraud,
        CAST(floor(row_id / 100) AS BIGINT) AS batch_id
    FROM ledger""", "ledger")
_cte("past", f"""
    SELECT *, count(*) OVER prior AS prior_rows, sum(CAST(amount AS {DEC})) OVER prior AS prior_total,
        count(*) OVER recent AS recent_rows, sum(CAST(amount AS {DEC})) OVER recent AS recent_total
    FROM ledger
    WINDOW prior AS (PARTITION BY nameDest ORDER BY step, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        recent AS (PARTITION BY nameDest ORDER BY step RANGE BETWEEN 24 PRECEDING AND 1 PRECEDING)""", "ledger")


def _stateless_sql() -> dict[str, str]:
    kinds = {"is_transfer": "TRANSFER", "is_cash_out": "CASH_OUT", "is_cash_in": "CASH_IN", "is_debit": "DEBIT"}
    return {
        "amount": "amount",
        "hour_of_day": "CAST(step % 24 AS INTEGER)",
        "is_night": "CAST(step % 24 BETWEEN 0 AND 5 AS TINYINT)",
        "orig_balance_delta": "oldbalanceOrg - newbalanceOrig",
        "dest_balance_delta": "newbalanceDest - oldbalanceDest",
        "orig_balance_mismatch": "CAST(abs((oldbalanceOrg - newbalanceOrig) - amount) > 0.01e0 AS TINYINT)",
        "orig_emptied": "CAST(oldbalanceOrg > 0 AND newbalanceOrig = 0 AS TINYINT)",
        "amount_to_balance_ratio": "amount / (oldbalanceOrg + 1)",
        "dest_is_merchant": "CAST(nameDest LIKE 'M%' AS TINYINT)",
        **{name: f"CAST(type = '{kind}' AS TINYINT)" for name, kind in kinds.items()},
    }


_AVG = "coalesce(CAST(prior_total AS DOUBLE) / prior_rows, 0e0)"
_HISTORY_SQL = {
    "dest_prior_txn_count": "prior_rows",
    "dest_prior_avg_amount": _AVG,
    "dest_amount_to_prior_avg_ratio": f"amount / ({_AVG} + 1)",
    "dest_txn_count_24h": "recent_rows",
    "dest_amount_sum_24h": "coalesce(CAST(recent_total AS DOUBLE), 0e0)",
}
_ALL_SQL = {**_stateless_sql(), **_HISTORY_SQL}
_COLS = ", ".join(FEATURES)

_cte("features", "SELECT row_id, step, " + ", ".join(f"{_ALL_SQL[n]} AS {n}" for n in FEATURES) + ", isFraud FROM past",
     "past")
_cte("cuts", f"SELECT quantile_cont(step, {_list(FOLD_BOUNDARIES)}) AS cuts FROM ledger", "ledger")
_cte("folds", "SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS fold")
_FOLD = "CASE WHEN l.step <= cuts[fold] THEN 'train' ELSE 'test' END AS role"
_cte("folded", f"SELECT l.*, fold, {_FOLD} FROM ledger l, cuts, folds WHERE l.step <= cuts[fold + 1]",
     "ledger", "cuts", "folds")
_cte("folded_features", f"SELECT l.*, fold, {_FOLD} FROM features l, cuts, folds WHERE l.step <= cuts[fold + 1]",
     "features", "cuts", "folds")
_cte("scored", """
    SELECT row_id, step, amount, isFraud AS is_fraud,
        ((row_id * 48271) % 997 + CASE WHEN isFraud = 1 THEN 700 ELSE 0 END) / 1697e0 AS score FROM ledger""", "ledger")
_MODELS = ", ".join(f"('{name}', {mult}, {lift})" for name, mult, lift in base.MODELS)
_cte("ms", f"""
    SELECT model, fold, row_id, step, amount, isFraud AS is_fraud,
        ((row_id * mult) % 997 + CASE WHEN isFraud = 1 THEN lift ELSE 0 END) / (997e0 + lift) AS score
    FROM folded, (VALUES {_MODELS}) m(model, mult, lift) WHERE role = 'test'""", "folded")
_cte("mranked", """
    SELECT *, row_number() OVER (PARTITION BY model, fold ORDER BY score DESC, row_id) AS rank,
        count(*) OVER (PARTITION BY model, fold) AS total_rows,
        CAST(sum(is_fraud) OVER (PARTITION BY model, fold) AS BIGINT) AS total_positives FROM ms""", "ms")
_cte("mcum", """
    SELECT model, fold, score, n, pos, sum(n) OVER w AS cum_n, sum(pos) OVER w AS cum_pos,
        sum(n) OVER (PARTITION BY model, fold) AS all_n, sum(pos) OVER (PARTITION BY model, fold) AS all_pos
    FROM (SELECT model, fold, score, count(*) AS n, CAST(sum(is_fraud) AS BIGINT) AS pos FROM ms GROUP BY ALL)
    WINDOW w AS (PARTITION BY model, fold ORDER BY score DESC)""", "ms")
_cte("ranked", "SELECT *, row_number() OVER (ORDER BY score DESC, row_id) AS rank FROM scored", "scored")
_cte("totals", """
    SELECT (max(step) - min(step) + 1) / 24e0 AS days, count(*) AS n, CAST(sum(is_fraud) AS BIGINT) AS fraud
    FROM scored""", "scored")
_GRID = _list(base.REVIEWS_GRID)
_cte("grid", f"SELECT unnest({_GRID}) AS reviews_per_day")
_K = "least(greatest(CAST(round_even(reviews_per_day * days, 0) AS BIGINT), 1), n)"


def _points_sql(ks: str) -> str:
    """Confusion columns for rows (k, ...) of ``ks``: the k-th row's score decides, ties are flagged too."""
    return f"""
    SELECT p.*, n_flagged - true_positives AS false_positives, fraud - true_positives AS false_negatives,
        fraud AS total_fraud, n AS n_rows, true_positives / CAST(n_flagged AS DOUBLE) AS precision,
        true_positives / nullif(CAST(fraud AS DOUBLE), 0) AS recall, n_flagged / CAST(n AS DOUBLE) AS alert_rate
    FROM (SELECT ks.*, r.score AS threshold,
            (SELECT count(*) FROM scored s WHERE s.score >= r.score) AS n_flagged,
            (SELECT CAST(coalesce(sum(s.is_fraud), 0) AS BIGINT) FROM scored s WHERE s.score >= r.score) AS true_positives
        FROM {ks} ks JOIN ranked r ON r.rank = ks.k) p, totals"""


_cte("ks", f"SELECT reviews_per_day, days AS window_days, {_K} AS k FROM grid, totals", "grid", "totals")
_cte("points", _points_sql("ks"), "ks", "ranked", "scored", "totals")
_cte("sweep", """
    SELECT k, threshold, n_flagged, n_rows, true_positives, false_positives, false_negatives, total_fraud, precision,
        recall, alert_rate, reviews_per_day, window_days,
        least(1e0, total_fraud / CAST(n_flagged AS DOUBLE)) AS precision_ceiling,
        precision >= least(1e0, total_fraud / CAST(n_flagged AS DOUBLE)) - 1e-9 AS at_ceiling
    FROM points""", "points")
_cte("avgfraud", f"""
    SELECT CAST(sum(CAST(amount AS {DEC})) AS DOUBLE) / count(*) AS amt FROM scored WHERE is_fraud = 1""", "scored")

# Results per model and fold
_cte("mop", f"""
    SELECT t.model, t.fold, t.k AS capacity_k, r.score AS capacity_threshold, t.n, t.fraud,
        (SELECT count(*) FROM ms s WHERE s.model = t.model AND s.fold = t.fold AND s.score >= r.score) AS flagged,
        (SELECT CAST(coalesce(sum(s.is_fraud), 0) AS BIGINT) FROM ms s
            WHERE s.model = t.model AND s.fold = t.fold AND s.score >= r.score) AS caught
    FROM (SELECT model, fold, n, fraud, {_K.replace('reviews_per_day', f'{base.REVIEWS_PER_DAY}e0')} AS k FROM (
            SELECT model, fold, count(*) AS n, CAST(sum(is_fraud) AS BIGINT) AS fraud,
                (max(step) - min(step) + 1) / 24e0 AS days FROM ms GROUP BY ALL)) t
    JOIN mranked r ON r.model = t.model AND r.fold = t.fold AND r.rank = t.k""", "ms", "mranked")
_cte("mareas", """
    SELECT model, fold, sum(pos / CAST(all_pos AS DOUBLE) * (cum_pos / CAST(cum_n AS DOUBLE))) AS pr_auc,
        sum(pos * ((all_n - all_pos) - (cum_n - cum_pos) + (n - pos) / 2e0)) / max(all_pos * CAST(all_n - all_pos AS DOUBLE))
            AS roc_auc
    FROM mcum GROUP BY ALL""", "mcum")
_cte("mbce", """
    SELECT model, fold, count(*) AS n_rows, CAST(sum(is_fraud) AS BIGINT) AS n_positive,
        (count(*) - sum(is_fraud)) / CAST(greatest(sum(is_fraud), 1) AS DOUBLE) AS pos_weight,
        -avg(CASE WHEN is_fraud = 1 THEN w * ln(p) ELSE ln(1 - p) END) AS weighted_bce
    FROM (SELECT *, least(greatest(score, 1e-12), 1e0 - 1e-12) AS p,
            (count(*) OVER g - sum(is_fraud) OVER g) / CAST(greatest(sum(is_fraud) OVER g, 1) AS DOUBLE) AS w
        FROM ms WINDOW g AS (PARTITION BY model, fold)) GROUP BY ALL""", "ms")


def _curve_sql(multiples) -> str:
    values = ", ".join(f"({m})" for m in multiples)
    return f"""
    SELECT model, fold, CAST(m AS INTEGER) AS k_multiplier,
        max(least(greatest(total_positives * m, 10), total_rows)) AS k,
        count(*) FILTER (WHERE is_fraud = 1 AND rank <= least(greatest(total_positives * m, 10), total_rows)) AS hits,
        max(total_positives) AS fraud
    FROM mranked, (VALUES {values}) v(m) GROUP BY ALL"""


_cte("mcurve0", _curve_sql((1, 2, 5, 10)), "mranked")
_cte("mcurve", """
    SELECT model, fold, k_multiplier, k, hits / CAST(k AS DOUBLE) AS precision_at_k,
        hits / nullif(CAST(fraud AS DOUBLE), 0) AS recall_at_k FROM mcurve0""", "mcurve0")
_cte("results", """
    SELECT model, fold, pr_auc, roc_auc, weighted_bce, precision_at_k, recall_at_k, k, fraud AS n_test_fraud, capacity_k,
        capacity_threshold, caught / CAST(flagged AS DOUBLE) AS capacity_precision,
        caught / nullif(CAST(fraud AS DOUBLE), 0) AS capacity_recall, flagged / CAST(n AS DOUBLE) AS capacity_alert_rate,
        flagged - caught AS capacity_false_positives, fraud - caught AS capacity_false_negatives
    FROM mop JOIN mareas USING (model, fold) JOIN mbce USING (model, fold)
    JOIN (SELECT * FROM mcurve WHERE k_multiplier = 5) c USING (model, fold)""", "mop", "mareas", "mbce", "mcurve")

# The numeric model
_FIT = ", ".join(
    f"round(avg(CAST({n} AS DOUBLE)), {base.SCALER_DIGITS}) AS m_{n}, "
    f"CASE WHEN round(stddev_pop(CAST({n} AS DOUBLE)), {base.SCALER_DIGITS}) > 0 "
    f"THEN round(stddev_pop(CAST({n} AS DOUBLE)), {base.SCALER_DIGITS}) ELSE 1e0 END AS s_{n}" for n in FEATURES)
_cte("fit", f"SELECT {_FIT} FROM folded_features WHERE fold = {base.FOLDS} AND role = 'train'", "folded_features")
_CONTRIB = ", ".join(f"CAST({base.COEFFICIENTS[n]} AS DOUBLE) * (({n} - m_{n}) / s_{n}) AS c_{n}" for n in FEATURES)
_cte("contrib", f"SELECT row_id, step, {_COLS}, isFraud, {_CONTRIB} FROM features, fit", "features", "fit")
_MARGIN = f"CAST({base.INTERCEPT} AS DOUBLE)" + "".join(f" + c_{n}" for n in FEATURES)
_cte("explained0", f"""
    SELECT *, isFraud AS is_fraud, round(1e0 / (1e0 + exp(-({_MARGIN}))), {base.SCORE_DIGITS}) AS score
    FROM contrib""", "contrib")
_cte("explained", f"SELECT *, score >= {base.DECISION_THRESHOLD}e0 AS flagged FROM explained0", "explained0")
_LONG = " UNION ALL ".join(
    f"SELECT row_id, score, is_fraud, flagged, {i} AS place, '{n}' AS feature, c_{n} AS contribution, "
    f"CAST({n} AS DOUBLE) AS value FROM explained" for i, n in enumerate(FEATURES))
_cte("long", _LONG, "explained")
_RULE = (f"CASE WHEN (is_transfer = 1 OR is_cash_out = 1) AND orig_emptied = 1 AND amount >= {base.HARD_BLOCK_AMOUNT}e0 "
         "THEN 'full_balance_sweep_large_amount' END")
_cte("decided", f"""
    SELECT *, CASE WHEN rule IS NOT NULL THEN 'BLOCK' WHEN flagged THEN 'REVIEW' ELSE 'PASS' END AS decision
    FROM (SELECT *, {_RULE} AS rule FROM explained)""", "explained")
_cte("queue", f"""
    SELECT *, row_number() OVER (ORDER BY score DESC, row_id) AS alert_rank FROM (
        SELECT row_id, score, is_fraud FROM explained WHERE flagged ORDER BY score DESC, row_id LIMIT 50)""", "explained")
_cte("profile", """
    SELECT feature, avg(value) AS overall_mean, stddev_samp(value) AS sd,
        count(*) FILTER (WHERE flagged AND is_fraud = 1) AS true_positive_n,
        avg(value) FILTER (WHERE flagged AND is_fraud = 1) AS true_positive_mean,
        count(*) FILTER (WHERE flagged AND is_fraud <> 1) AS false_positive_n,
        avg(value) FILTER (WHERE flagged AND is_fraud <> 1) AS false_positive_mean,
        count(*) FILTER (WHERE NOT flagged AND is_fraud = 1) AS false_negative_n,
        avg(value) FILTER (WHERE NOT flagged AND is_fraud = 1) AS false_negative_mean
    FROM long GROUP BY feature""", "long")
_cte("importance", """
    SELECT feature, mean_abs, mean_signed, mean_abs / nullif(sum(mean_abs) OVER (), 0) AS share_of_total,
        row_number() OVER (ORDER BY mean_abs DESC, feature) AS rank
    FROM (SELECT feature, avg(abs(contribution)) AS mean_abs, avg(contribution) AS mean_signed FROM long GROUP BY feature)
    """, "long")

# State
_cte("snapshot", f"""
    SELECT nameDest AS name_dest, count(*) AS prior_txn_count,
        CAST(sum(CAST(amount AS {DEC})) AS DOUBLE) / count(*) AS prior_avg_amount,
        count(*) FILTER (WHERE step > last - 24) AS txn_count_24h,
        coalesce(CAST(sum(CAST(amount AS {DEC})) FILTER (WHERE step > last - 24) AS DOUBLE), 0e0) AS amount_sum_24h,
        max(last) AS snapshot_step
    FROM ledger, (SELECT max(step) AS last FROM ledger) WHERE nameDest NOT LIKE 'M%' GROUP BY nameDest""", "ledger")
_cte("found", """
    SELECT l.*, coalesce(prior_txn_count, 0) AS prior_txn_count, coalesce(prior_avg_amount, 0e0) AS prior_avg_amount,
        coalesce(txn_count_24h, 0) AS txn_count_24h, coalesce(amount_sum_24h, 0e0) AS amount_sum_24h,
        name_dest IS NOT NULL AS state_hit
    FROM ledger l LEFT JOIN snapshot ON nameDest = name_dest""", "ledger", "snapshot")
_cte("batched", f"""
    SELECT f.*, CAST(floor(row_id / {base.BATCH_ROWS}) AS BIGINT) AS batch_id FROM found f""", "found")
_cte("accumulated", f"""
    SELECT *, count(*) OVER w AS acc_rows, coalesce(CAST(sum(CAST(amount AS {DEC})) OVER w AS DOUBLE), 0e0) AS acc_total
    FROM batched
    WINDOW w AS (PARTITION BY batch_id, nameDest ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    """, "batched")

# Samples
_HASH = f"md5('{base.SAMPLE_SEED}-' || CAST(row_id AS VARCHAR))"


def _compose(body: str, *needs: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for other in CTES[name][1]:
            visit(other)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    return "WITH " + ",\n".join(f"{name} AS ({CTES[name][0]})" for name in ordered) + "\n" + body


ORACLE: dict[str, str] = {}


def _add(name: str, body: str, *needs: str) -> None:
    ORACLE[name] = _compose(body, *needs)


# A, B
_add("a1_ingest", "SELECT * EXCLUDE (row_id) FROM ledger", "ledger")
_add("a3_feature_scan", "SELECT * FROM features", "features")
_NONNEG = ("step", "amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest")
_LEDGER = ("step", "type", "amount", "nameOrig", "oldbalanceOrg", "newbalanceOrig", "nameDest", "oldbalanceDest",
           "newbalanceDest", "isFraud", "isFlaggedFraud")
_TYPES = "('CASH_IN', 'CASH_OUT', 'DEBIT', 'PAYMENT', 'TRANSFER')"
_CHECKS = [(c, "not_null", f"{c} IS NULL") for c in _LEDGER]
_CHECKS += [(c, "at_least_zero", f"{c} < 0") for c in _NONNEG]
_CHECKS += [("type", "known_value", f"type NOT IN {_TYPES}")]
_CHECKS += [(c, "zero_or_one", f"{c} NOT IN (0, 1)") for c in ("isFraud", "isFlaggedFraud")]
_add("b1_validation_report", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{r}' AS check_name, count(*) FILTER (WHERE {bad}) AS failures FROM faulty"
    for c, r, bad in _CHECKS), "faulty")
_add("b2_row_sample", f"SELECT row_id, step, amount FROM ledger ORDER BY {_HASH} LIMIT 500", "ledger")
_BAD = " OR ".join(f"coalesce({bad}, false)" for c, _, bad in _CHECKS if not c.startswith("is"))
_BAD += " OR coalesce(nameOrig = '', false) OR coalesce(nameDest = '', false)"
_add("b3_admission", f"""
    SELECT batch_id, count(*) AS n_rows, count(*) FILTER (WHERE {_BAD}) AS bad_rows,
        count(*) FILTER (WHERE {_BAD}) = 0 AND count(*) <= 10000 AS accepted FROM faulty GROUP BY batch_id""", "faulty")
_add("b4_exclude_merchants", "SELECT row_id, nameDest, amount FROM ledger WHERE nameDest NOT LIKE 'M%'", "ledger")
_add("b5_violations", " UNION ALL ".join(
    f"SELECT row_id, '{c}' AS column_name, '{r}' AS check_name FROM faulty WHERE {bad}" for c, r, bad in _CHECKS), "faulty")

# C, D
for _number, _name in enumerate([n for n in FEATURES if not n.startswith("dest_") or n in
                                 ("dest_balance_delta", "dest_is_merchant")], start=1):
    _add(f"c{_number}_{_name}", f"SELECT row_id, {_ALL_SQL[_name]} AS {_name} FROM ledger", "ledger")
_add("c14_feature_vector", f"SELECT row_id, CAST({len(FEATURES)} AS INTEGER) AS width, "
     + ", ".join(f"CAST({n} AS DOUBLE) AS v{i + 1:02d}" for i, n in enumerate(FEATURES)) + " FROM features", "features")
for _number, _name in enumerate(_HISTORY_SQL, start=1):
    _add(f"d{_number}_{_name}", f"SELECT row_id, {_name} FROM features", "features")
_add("d6_features", f"SELECT row_id, step, {_COLS}, isFraud FROM features", "features")
_add("d7_leakage_audit", f"""
    , pairs AS (
        SELECT a.row_id, a.nameDest,
            count(b.row_id) FILTER (WHERE b.step < a.step OR b.row_id < a.row_id) AS c,
            coalesce(sum(CAST(b.amount AS {DEC})) FILTER (WHERE b.step < a.step OR b.row_id < a.row_id), 0) AS s,
            count(b.row_id) FILTER (WHERE b.step BETWEEN a.step - 24 AND a.step - 1) AS c24,
            coalesce(sum(CAST(b.amount AS {DEC})) FILTER (WHERE b.step BETWEEN a.step - 24 AND a.step - 1), 0) AS s24
        FROM ledger a LEFT JOIN ledger b ON a.nameDest = b.nameDest AND b.step <= a.step AND b.row_id <> a.row_id
        GROUP BY ALL)
    SELECT count(*) AS rows_checked, count(DISTINCT p.nameDest) AS destinations,
        count(*) FILTER (WHERE c <> prior_rows) AS prior_count_mismatches,
        count(*) FILTER (WHERE s <> coalesce(prior_total, 0)) AS prior_sum_mismatches,
        count(*) FILTER (WHERE c24 <> recent_rows) AS recent_count_mismatches,
        count(*) FILTER (WHERE s24 <> coalesce(recent_total, 0)) AS recent_sum_mismatches,
        CAST(sum(c) AS BIGINT) AS prior_count_total, CAST(sum(c24) AS BIGINT) AS recent_count_total
    FROM pairs p JOIN past USING (row_id)""", "past")
_add("d8_structure_profile", """
    , o AS (SELECT nameOrig, count(*) AS n FROM ledger GROUP BY 1), d AS (SELECT nameDest, count(*) AS n FROM ledger GROUP BY 1)
    SELECT (SELECT count(*) FROM ledger) AS total_rows, (SELECT count(*) FROM o) AS distinct_origins,
        (SELECT count(*) FROM o WHERE n = 1) AS single_use_origins, count(*) AS distinct_destinations,
        count(*) FILTER (WHERE nameDest LIKE 'M%') AS merchants, count(*) FILTER (WHERE nameDest NOT LIKE 'M%') AS customers,
        max(n) FILTER (WHERE nameDest LIKE 'M%') AS merchant_max, max(n) FILTER (WHERE nameDest NOT LIKE 'M%') AS customer_max,
        avg(n) FILTER (WHERE nameDest LIKE 'M%') AS merchant_mean, avg(n) FILTER (WHERE nameDest NOT LIKE 'M%') AS customer_mean,
        (SELECT count(*) FILTER (WHERE prior_rows > 0) / CAST(count(*) AS DOUBLE) FROM past) AS share_with_history
    FROM d""", "past")
_add("d8_fraud_rate_by_type", """
    SELECT type, count(*) AS n_rows, CAST(sum(isFraud) AS BIGINT) AS n_fraud, avg(isFraud) AS fraud_rate
    FROM ledger GROUP BY type""", "ledger")

# E
_STATE = "prior_txn_count, prior_avg_amount, txn_count_24h, amount_sum_24h"
_add("e1_snapshot", "SELECT * FROM snapshot", "snapshot")
_add("e2_state_lookup", f"SELECT row_id, {_STATE}, state_hit FROM found", "found")
_SERVED = {
    "dest_prior_txn_count": "CAST(prior_txn_count AS BIGINT)", "dest_prior_avg_amount": "prior_avg_amount",
    "dest_amount_to_prior_avg_ratio": "amount / (prior_avg_amount + 1)",
    "dest_txn_count_24h": "CAST(txn_count_24h AS BIGINT)", "dest_amount_sum_24h": "amount_sum_24h",
}
_add("e3_state_features", "SELECT row_id, state_hit, " + ", ".join(
    f"{_SERVED.get(n, _ALL_SQL[n])} AS {n}" for n in FEATURES) + " FROM found", "found")
_add("e4_batch_accumulation", """
    SELECT row_id, batch_id, CAST(prior_txn_count + acc_rows AS BIGINT) AS prior_txn_count,
        CASE WHEN acc_rows = 0 THEN prior_avg_amount
            ELSE (prior_avg_amount * prior_txn_count + acc_total) / (prior_txn_count + acc_rows) END AS prior_avg_amount,
        CAST(txn_count_24h + acc_rows AS BIGINT) AS txn_count_24h,
        amount_sum_24h + acc_total AS amount_sum_24h, state_hit OR acc_rows > 0 AS state_hit
    FROM accumulated""", "accumulated")
_add("e5_batches", f"""
    SELECT CAST(floor(row_id / {base.BATCH_ROWS}) AS BIGINT) AS batch_id, count(*) AS n_rows, min(row_id) AS first_seq,
        max(row_id) AS last_seq FROM ledger GROUP BY 1""", "ledger")
_add("e6_state_audit", """
    , again AS (
        SELECT nameDest AS name_dest, count(*) AS c, avg(amount) AS a,
            count(*) FILTER (WHERE step >= last - 23) AS c24, coalesce(sum(amount) FILTER (WHERE step >= last - 23), 0) AS s24
        FROM ledger, (SELECT max(step) AS last FROM ledger) WHERE left(nameDest, 1) <> 'M' GROUP BY nameDest)
    SELECT count(*) AS keys,
        count(*) FILTER (WHERE s.name_dest IS NULL OR a.name_dest IS NULL OR c <> prior_txn_count OR c24 <> txn_count_24h
            OR abs(a - prior_avg_amount) > 1e-5 * greatest(abs(a), abs(prior_avg_amount))
            OR abs(s24 - amount_sum_24h) > 1e-5 * greatest(abs(s24), abs(amount_sum_24h))) AS mismatches,
        count(*) FILTER (WHERE a.name_dest IS NULL) AS unexpected_keys,
        count(*) FILTER (WHERE s.name_dest IS NULL) AS missing_keys,
        count(*) FILTER (WHERE s.name_dest LIKE 'M%') AS stored_merchants, CAST(sum(c) AS BIGINT) AS recomputed_rows
    FROM snapshot s FULL JOIN again a ON s.name_dest = a.name_dest""", "snapshot")
_add("e7_path_parity", """
    , cut AS (SELECT CAST(floor((min(step) + max(step)) / 2e0) AS BIGINT) AS cut FROM ledger),
    target AS (SELECT p.*, row_number() OVER (PARTITION BY nameDest ORDER BY row_id) = 1 AS first
        FROM past p, cut WHERE step = cut + 1 AND nameDest NOT LIKE 'M%'),
    served AS (SELECT t.row_id, count(l.row_id) AS c, coalesce(sum(l.amount), 0) AS s,
            count(l.row_id) FILTER (WHERE l.step > cut - 24) AS c24,
            coalesce(sum(l.amount) FILTER (WHERE l.step > cut - 24), 0) AS s24
        FROM target t CROSS JOIN cut LEFT JOIN ledger l ON l.nameDest = t.nameDest AND l.step <= cut GROUP BY t.row_id)
    SELECT count(*) AS rows_compared, count(*) FILTER (WHERE first) AS first_rows,
        count(*) FILTER (WHERE c24 <> recent_rows) AS count24_mismatches,
        count(*) FILTER (WHERE abs(s24 - coalesce(CAST(recent_total AS DOUBLE), 0)) > 1e-6) AS sum24_mismatches,
        count(*) FILTER (WHERE first AND c <> prior_rows) AS prior_count_mismatches,
        count(*) FILTER (WHERE first AND abs(s - coalesce(CAST(prior_total AS DOUBLE), 0)) > 1e-6) AS prior_avg_mismatches
    FROM target JOIN served USING (row_id)""", "past")
_add("e8_captured_fraud", f"""
    SELECT count(*) AS n_rows, count(*) FILTER (WHERE isFraud = 1) AS n_fraud,
        count(*) FILTER (WHERE isFraud = 1 AND decision <> 'PASS') AS n_caught,
        count(*) FILTER (WHERE isFraud = 1 AND decision <> 'PASS') / CAST(count(*) FILTER (WHERE isFraud = 1) AS DOUBLE)
            AS share_caught,
        coalesce(CAST(sum(CAST(amount AS {DEC})) FILTER (WHERE isFraud = 1 AND decision <> 'PASS') AS DOUBLE), 0e0)
            AS amount_caught
    FROM decided""", "decided")

# F
_add("f1_step_quantiles", "SELECT unnest(" + _list(FOLD_BOUNDARIES) + ") AS boundary, unnest(cuts) AS cut FROM cuts", "cuts")
_add("f2_time_folds", "SELECT row_id, step, fold, role FROM folded", "folded")
_DAYS = "(max(step) - min(step) + 1) / 24e0"
_RPD = base.REVIEWS_PER_DAY
_add("f3_fold_summary", f"""
    SELECT fold, role, count(*) AS n_rows, CAST(sum(isFraud) AS BIGINT) AS n_fraud, min(step) AS first_step,
        max(step) AS last_step, {_DAYS} AS window_days,
        least(greatest(CAST(round_even({_RPD}e0 * {_DAYS}, 0) AS BIGINT), 1), count(*)) AS capacity_k,
        CAST(count(*) - sum(isFraud) AS DOUBLE) / greatest(sum(isFraud), 1) AS pos_weight,
        CAST(sum(isFraud) AS DOUBLE) / count(*) AS fraud_rate
    FROM folded GROUP BY fold, role""", "folded")
_add("f4_class_weight", """
    SELECT fold, role, CAST(count(*) - sum(isFraud) AS BIGINT) AS n_negative, CAST(sum(isFraud) AS BIGINT) AS n_positive,
        CAST(count(*) - sum(isFraud) AS DOUBLE) / greatest(sum(isFraud), 1) AS pos_weight FROM folded GROUP BY fold, role""",
     "folded")
_cte("undersampled", f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold, isFraud ORDER BY {_HASH}) AS nth,
            sum(isFraud) OVER (PARTITION BY fold) AS fraud FROM folded WHERE role = 'train')
    WHERE isFraud = 1 OR nth <= CAST(floor(fraud * 5e0) AS BIGINT)""", "folded")
_add("f5_undersample", "SELECT fold, row_id, isFraud FROM undersampled", "undersampled")
_D = base.SCALER_DIGITS
_add("f6_scaler_fit", " UNION ALL ".join(
    f"SELECT fold, '{n}' AS feature, round(avg(CAST({n} AS DOUBLE)), {_D}) AS mean, "
    f"CASE WHEN round(stddev_pop(CAST({n} AS DOUBLE)), {_D}) > 0 "
    f"THEN round(stddev_pop(CAST({n} AS DOUBLE)), {_D}) "
    "ELSE 1e0 END AS scale FROM folded_features WHERE role = 'train' GROUP BY fold" for n in FEATURES), "folded_features")
_add("f7_scaler_apply", "SELECT row_id, step, " + ", ".join(
    f"({n} - m_{n}) / s_{n} AS {n}" for n in FEATURES) + " FROM features, fit", "features", "fit")
_add("f7_scaler_inverse", "SELECT row_id, step, " + ", ".join(
    f"(({n} - m_{n}) / s_{n}) * s_{n} + m_{n} AS {n}" for n in FEATURES) + " FROM features, fit", "features", "fit")
_add("f8_stratified_sample", f"""
    SELECT row_id, isFraud, amount FROM (
        SELECT *, row_number() OVER (PARTITION BY isFraud ORDER BY {_HASH}) AS nth,
            least(100, sum(isFraud) OVER ()) AS positives FROM folded WHERE role = 'test' AND fold = {base.FOLDS})
    WHERE nth <= CASE WHEN isFraud = 1 THEN positives ELSE 200 - positives END""", "folded")
_add("f9_all_positives_filled", f"""
    SELECT row_id, isFraud, amount FROM (
        SELECT *, row_number() OVER (PARTITION BY isFraud ORDER BY {_HASH}) AS nth, sum(isFraud) OVER () AS positives FROM ledger)
    WHERE isFraud = 1 OR nth <= 5000 - positives""", "ledger")
_add("f10_explanation_sample", f"SELECT row_id, score, is_fraud FROM explained ORDER BY {_HASH} LIMIT 300", "explained")

# G
_add("g1_window_days", f"SELECT fold, role, {_DAYS} AS window_days, count(*) AS n_rows FROM folded GROUP BY fold, role", "folded")
_add("g2_capacity_k", f"""
    SELECT fold, reviews_per_day, {_K} AS k
    FROM (SELECT fold, {_DAYS} AS days, count(*) AS n FROM folded WHERE role = 'test' GROUP BY fold), grid""", "folded", "grid")
_add("g3_threshold_at_k", "SELECT rank AS k, score AS threshold FROM ranked WHERE rank IN (1, 10, 50, 100, 500)", "ranked")
_add("g4_operating_point", f"""
    SELECT k, threshold, n_flagged, n_rows, true_positives, false_positives, false_negatives, total_fraud, precision, recall,
        alert_rate FROM points WHERE reviews_per_day = {base.REVIEWS_PER_DAY}""", "points")
_add("g5_capacity_sweep", "SELECT * FROM sweep", "sweep")
_add("g5_capacity_sweep_by_model", f"""
    , t AS (SELECT model, fold, count(*) AS n, CAST(sum(is_fraud) AS BIGINT) AS fraud, {_DAYS} AS days FROM ms GROUP BY ALL),
    wanted AS (SELECT *, {_K} AS k FROM t, grid),
    pts AS (SELECT w.*, r.score AS threshold, count(*) AS n_flagged, CAST(sum(s.is_fraud) AS BIGINT) AS tp
        FROM wanted w JOIN mranked r ON r.model = w.model AND r.fold = w.fold AND r.rank = w.k
        JOIN ms s ON s.model = w.model AND s.fold = w.fold AND s.score >= r.score GROUP BY ALL)
    SELECT model, fold, reviews_per_day, days AS window_days, k, threshold, n_flagged, n AS n_rows, tp AS true_positives,
        n_flagged - tp AS false_positives, fraud - tp AS false_negatives, fraud AS total_fraud,
        tp / CAST(n_flagged AS DOUBLE) AS precision, tp / CAST(fraud AS DOUBLE) AS recall,
        n_flagged / CAST(n AS DOUBLE) AS alert_rate, least(1e0, fraud / CAST(n_flagged AS DOUBLE)) AS precision_ceiling,
        tp / CAST(n_flagged AS DOUBLE) >= least(1e0, fraud / CAST(n_flagged AS DOUBLE)) - 1e-9 AS at_ceiling
    FROM pts""", "mranked", "grid")
_TOP = """
    SELECT CAST(k AS BIGINT) AS k, count(*) FILTER (WHERE rank <= k AND is_fraud = 1) AS hits, {value}
    FROM ranked, (VALUES (1), (10), (100), (500)) v(k) GROUP BY k"""
_add("g6_precision_at_k", _TOP.format(
    value="count(*) FILTER (WHERE rank <= k AND is_fraud = 1) / CAST(k AS DOUBLE) AS precision_at_k"), "ranked")
_add("g7_recall_at_k", _TOP.format(
    value="count(*) FILTER (WHERE rank <= k AND is_fraud = 1) / CAST(sum(is_fraud) AS DOUBLE) AS recall_at_k"), "ranked")
_add("g8_k_curve", "SELECT * FROM mcurve", "mcurve")
_add("g9_average_precision", "SELECT model, fold, round(pr_auc, 9) AS pr_auc FROM mareas", "mareas")
_add("g10_roc_auc", "SELECT model, fold, round(roc_auc, 9) AS roc_auc FROM mareas", "mareas")
_add("g11_weighted_bce", """
    SELECT model, fold, n_rows, n_positive, pos_weight, round(weighted_bce, 6) AS weighted_bce FROM mbce""", "mbce")
_add("g12_evaluation", """
    SELECT * REPLACE (round(pr_auc, 6) AS pr_auc, round(roc_auc, 6) AS roc_auc, round(weighted_bce, 6) AS weighted_bce)
    FROM results""", "results")
_add("g13_global_rank", "SELECT row_id, score, rank FROM ranked", "ranked")

# H
_SPREAD = ("pr_auc", "precision_at_k", "recall_at_k", "capacity_precision", "capacity_recall")
_add("h1_compare_models", "SELECT model, " + ", ".join(
    f"round(avg({m}), 6) AS {m}_mean, round(stddev_samp({m}), 6) AS {m}_std" for m in _SPREAD)
    + ", round(avg(roc_auc), 6) AS roc_auc_mean, round(avg(weighted_bce), 6) AS weighted_bce_mean, count(*) AS n_folds "
    "FROM results GROUP BY model", "results")
_add("h2_curve_summary", "SELECT model, k_multiplier, " + ", ".join(
    f"round(avg({m}), 6) AS {m}_mean, round(stddev_samp({m}), 6) AS {m}_std" for m in ("precision_at_k", "recall_at_k"))
    + " FROM mcurve GROUP BY model, k_multiplier", "mcurve")
_add("h3_select_model", """
    , r AS (SELECT model, avg(capacity_precision) AS c, stddev_samp(capacity_precision) AS sd, avg(pr_auc) AS p
        FROM results GROUP BY model),
    k AS (SELECT model, avg(precision_at_k) AS q FROM mcurve WHERE k_multiplier = 1 GROUP BY model),
    w AS (SELECT (SELECT model FROM r ORDER BY c DESC, model LIMIT 1) AS best_model,
        (SELECT model FROM r ORDER BY p DESC, model LIMIT 1) AS pr_auc_leader,
        (SELECT model FROM k ORDER BY q DESC, model LIMIT 1) AS k1_leader)
    SELECT best_model, round(c, 6) AS capacity_precision_mean, round(sd, 6) AS capacity_precision_std, pr_auc_leader, k1_leader,
        pr_auc_leader <> best_model AS pr_auc_disagrees, k1_leader <> best_model AS k1_disagrees
    FROM w JOIN r ON model = best_model""", "results")
_add("h5_mean_fraud_amount", f"""
    SELECT CAST(sum(CAST(amount AS {DEC})) AS DOUBLE) / count(*) AS avg_fraud_amount, count(*) AS n_fraud
    FROM folded WHERE role = 'test' AND fold = {base.FOLDS} AND isFraud = 1""", "folded")

# I, J
_GAPS = [f"round(({g}_mean - true_positive_mean) / nullif(sd, 0), 8) AS {a}_vs_tp_std_gap"
         for g, a in (("false_positive", "fp"), ("false_negative", "fn"))]
_add("i1_segment_profile", f"SELECT feature, round(overall_mean, 8) AS overall_mean, " + ", ".join(
    f"{g}_n, round({g}_mean, 8) AS {g}_mean" for g in ("true_positive", "false_positive", "false_negative"))
    + ", " + ", ".join(_GAPS) + " FROM profile", "profile")
_add("i2_missed_fraud", """
    , q AS (SELECT n_flagged AS k FROM points WHERE reviews_per_day = %d),
    f AS (SELECT rank, k, (SELECT count(*) FROM scored) AS n FROM ranked, q WHERE is_fraud = 1)
    SELECT count(*) AS total_fraud, count(*) FILTER (WHERE rank <= k) AS fraud_in_top_k,
        count(*) FILTER (WHERE rank > k) AS fraud_missed, max(n) AS n_rows, max(k) AS k,
        min(rank) FILTER (WHERE rank > k) AS missed_rank_min, median(rank) FILTER (WHERE rank > k) AS missed_rank_median,
        max(rank) FILTER (WHERE rank > k) AS missed_rank_max,
        CAST(floor(median(rank) FILTER (WHERE rank > k)) AS BIGINT) AS k_to_catch_half_of_missed,
        max(rank) FILTER (WHERE rank > k) AS k_to_catch_all_missed,
        CASE WHEN count(*) FILTER (WHERE rank > k) > 0 THEN count(*) FILTER (WHERE rank > k AND rank <= 2 * k) END AS missed_within_2x_k,
        CASE WHEN count(*) FILTER (WHERE rank > k) > 0 THEN count(*) FILTER (WHERE rank > k AND rank > n / 2e0) END AS missed_in_bottom_half
    FROM f""" % base.REVIEWS_PER_DAY, "ranked", "points")
_add("i3_queue_composition", "SELECT DISTINCT true_positive_n, false_positive_n, false_negative_n FROM profile", "profile")
_add("j1_global_importance", """
    SELECT feature, round(mean_abs, 6) AS mean_abs, round(mean_signed, 6) AS mean_signed,
        round(share_of_total, 6) AS share_of_total, rank FROM importance""", "importance")
_add("j2_alert_queue", "SELECT alert_rank, row_id, score, is_fraud FROM queue", "queue")
_add("j3_reason_codes", """
    SELECT alert_rank, row_id, q.score, q.is_fraud, reason_rank, feature, value, contribution
    FROM queue q JOIN (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(contribution) DESC, place) AS reason_rank
        FROM long) l USING (row_id) WHERE reason_rank <= 4""", "queue", "long")
_add("j4_contributions", """
    SELECT row_id, feature, contribution, value FROM long""", "long")
_add("j5_inert_features", "SELECT feature FROM importance WHERE mean_abs <= 1e-9", "importance")

# K
_NET = f"true_positives * amt * 0.5e0 - n_flagged * {base.COST_PER_REVIEW}e0 - false_negatives * amt * 1e0"
_add("k1_net_value", f"SELECT reviews_per_day, round({_NET}, 6) AS net_value FROM sweep, avgfraud", "sweep", "avgfraud")
_add("k2_net_value_curve", f"""
    SELECT reviews_per_day, k, n_flagged, true_positives, false_positives, false_negatives, precision, recall,
        round({_NET}, 6) AS net_value FROM sweep, avgfraud""", "sweep", "avgfraud")
_LOWHIGH = f"""
    , m AS (SELECT h.true_positives - l.true_positives AS frauds, h.n_flagged - l.n_flagged AS reviews FROM sweep l, sweep h
        WHERE l.reviews_per_day = {base.LOW_REVIEWS} AND h.reviews_per_day = {base.HIGH_REVIEWS})"""
_RECOVERY = _list((0.05, 0.1, 0.25, 0.5, 0.75, 1.0))
_add("k3_break_even_cost", _LOWHIGH + f"""
    SELECT recovery_rate, 1e0 AS liability_rate, frauds AS marginal_frauds, reviews AS marginal_reviews,
        round(frauds * amt * (recovery_rate + 1e0) / nullif(CAST(reviews AS DOUBLE), 0), 6) AS break_even_cost_per_review
    FROM m, avgfraud, (SELECT unnest({_RECOVERY}) AS recovery_rate)""", "sweep", "avgfraud")
_add("k4_constraint_cost", _LOWHIGH + f"""
    SELECT {base.LOW_REVIEWS}e0 AS low_reviews_per_day, {base.HIGH_REVIEWS}e0 AS high_reviews_per_day,
        frauds AS frauds_missed_by_constraint, round(amt, 6) AS avg_fraud_amount, round(frauds * amt, 6) AS exposure,
        {base.HIGH_REVIEWS - base.LOW_REVIEWS}e0 AS marginal_seats,
        round(frauds * amt / {base.HIGH_REVIEWS - base.LOW_REVIEWS}e0, 6) AS exposure_per_marginal_seat FROM m, avgfraud""",
     "sweep", "avgfraud")
_add("k5_ticket_crossover", f"""
    , v AS (SELECT amt, reviews_per_day, {_NET} AS net FROM sweep, (SELECT unnest({_list(base.TICKETS)}) AS amt)),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY amt ORDER BY net DESC, reviews_per_day) AS nth FROM v)
        WHERE nth = 1)
    SELECT amt AS avg_fraud_amount, reviews_per_day AS recommended_reviews_per_day,
        round(net, 6) AS net_value_at_recommendation,
        coalesce(reviews_per_day <> lag(reviews_per_day) OVER (ORDER BY amt), false) AS is_crossover FROM b""", "sweep")
_add("k6_saturation", f"""
    , v AS (SELECT recovery_rate, reviews_per_day,
            true_positives * amt * recovery_rate - n_flagged * {base.COST_PER_REVIEW}e0 - false_negatives * amt * 1e0 AS net
        FROM sweep, avgfraud, (SELECT unnest({_RECOVERY}) AS recovery_rate)),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recovery_rate ORDER BY net DESC, reviews_per_day) AS nth
            FROM v) WHERE nth = 1),
    s AS (SELECT min(reviews_per_day) FILTER (WHERE recall >= 0.9999e0) AS sat FROM sweep)
    SELECT recovery_rate, sat AS saturation_reviews_per_day, reviews_per_day AS optimal_reviews_per_day,
        bool_and(coalesce(reviews_per_day >= sat, false)) OVER () AS always_reaches_saturation FROM b, s""",
     "sweep", "avgfraud")

# L, M
_add("l1_hard_block", f"SELECT row_id, {_RULE} AS rule FROM features", "features")
_add("l2_decision", "SELECT row_id, flagged, rule, decision FROM decided", "decided")
_add("l3_rule_effectiveness", """
    SELECT count(*) AS n_rows, count(rule) AS n_fired, count(*) FILTER (WHERE rule IS NOT NULL AND isFraud = 1) AS n_fraud,
        count(rule) / CAST(count(*) AS DOUBLE) AS fire_rate,
        count(*) FILTER (WHERE rule IS NOT NULL AND isFraud = 1) / nullif(CAST(count(rule) AS DOUBLE), 0) AS rule_precision
    FROM decided""", "decided")
_add("l4_score_rows", """
    SELECT e.row_id, e.score, e.flagged, CAST(4 AS INTEGER) AS n_reasons, l.feature AS top_feature,
        l.contribution AS top_contribution
    FROM explained e JOIN (SELECT * FROM long
        QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY abs(contribution) DESC, place) = 1) l USING (row_id)""",
     "explained", "long")
_add("l5_batch_summary", f"""
    SELECT CAST(floor(row_id / {base.BATCH_ROWS}) AS BIGINT) AS batch_id, count(*) AS n_scored,
        count(*) FILTER (WHERE decision = 'BLOCK') AS n_blocked, count(*) FILTER (WHERE decision = 'REVIEW') AS n_flagged,
        count(*) FILTER (WHERE decision = 'PASS') AS n_passed,
        count(*) FILTER (WHERE decision <> 'PASS') / CAST(count(*) AS DOUBLE) AS alert_rate
    FROM decided GROUP BY 1""", "decided")
_add("m1_score_telemetry", """
    SELECT count(*) AS score_count, count(*) FILTER (WHERE flagged) AS flagged_count,
        count(*) FILTER (WHERE decision = 'BLOCK') AS blocked_count,
        count(*) FILTER (WHERE flagged) / CAST(count(*) AS DOUBLE) AS flag_rate FROM decided""", "decided")
_add("m2_score_histogram", """
    SELECT bucket, (SELECT count(*) FROM scored WHERE score >= lo AND (score < hi OR hi = 1e0)) AS n_scores
    FROM (VALUES ('[0.0-0.2)', 0e0, 0.2e0), ('[0.2-0.4)', 0.2e0, 0.4e0), ('[0.4-0.6)', 0.4e0, 0.6e0),
        ('[0.6-0.8)', 0.6e0, 0.8e0), ('[0.8-1.0]', 0.8e0, 1e0)) b(bucket, lo, hi)""", "scored")
_add("m3_latency_percentiles", """
    , v AS (SELECT (row_id * 7919) % 1000 / 10e0 AS x FROM ledger ORDER BY row_id DESC LIMIT 5000),
    s AS (SELECT list_sort(list(x)) AS v, count(*) AS n FROM v)
    SELECT n AS n_latencies, v[least(CAST(floor(n * 0.5e0) AS BIGINT), n - 1) + 1] AS latency_p50_ms,
        v[least(CAST(floor(n * 0.95e0) AS BIGINT), n - 1) + 1] AS latency_p95_ms,
        v[least(CAST(floor(n * 0.99e0) AS BIGINT), n - 1) + 1] AS latency_p99_ms FROM s""", "ledger")
_add("n6_prepare_fold", """
    , t AS (SELECT fold, count(*) AS n_test, CAST(sum(isFraud) AS BIGINT) AS n_test_fraud,
            CAST(count(*) - sum(isFraud) AS DOUBLE) / greatest(sum(isFraud), 1) AS test_pos_weight
        FROM folded WHERE role = 'test' GROUP BY fold),
    b AS (SELECT fold, count(*) AS n_train_before FROM folded WHERE role = 'train' GROUP BY fold),
    u AS (SELECT fold, count(*) AS n_train, CAST(sum(isFraud) AS BIGINT) AS n_train_fraud,
            CAST(count(*) - sum(isFraud) AS DOUBLE) / greatest(sum(isFraud), 1) AS train_pos_weight
        FROM undersampled GROUP BY fold)
    SELECT * FROM b JOIN u USING (fold) JOIN t USING (fold)""", "undersampled")

# P
_TENTHS = _list(i / 10 for i in range(1, 10))
_cte("dlong", " UNION ALL ".join(
    f"SELECT role, CAST(floor(step / 48) AS BIGINT) AS win, '{n}' AS feature, CAST({n} AS DOUBLE) AS x "
    f"FROM folded_features WHERE fold = {base.FOLDS}" for n in FEATURES)
    + f" UNION ALL SELECT role, CAST(floor(folded_features.step / 48) AS BIGINT), 'score', score "
      f"FROM folded_features JOIN scored USING (row_id) WHERE fold = {base.FOLDS}", "folded_features", "scored")
_add("p1_stability_index", f"""
    , edges AS (SELECT feature, unnest(list_distinct(quantile_disc(x, {_TENTHS}))) AS edge
        FROM dlong WHERE role = 'train' GROUP BY feature),
    placed AS (SELECT role, win, feature,
            (SELECT count(*) FROM edges e WHERE e.feature = d.feature AND d.x > e.edge) AS bin FROM dlong d),
    slots AS (SELECT feature, unnest(range(count(*) + 1)) AS bin FROM edges GROUP BY feature),
    wins AS (SELECT DISTINCT win, feature FROM placed WHERE role = 'test'),
    shares AS (SELECT w.win, w.feature, s.bin,
            (SELECT count(*) FROM placed p WHERE p.role = 'test' AND p.win = w.win AND p.feature = w.feature AND p.bin = s.bin)
                / CAST((SELECT count(*) FROM placed p WHERE p.role = 'test' AND p.win = w.win AND p.feature = w.feature) AS DOUBLE) AS a,
            (SELECT count(*) FROM placed p WHERE p.role = 'train' AND p.feature = w.feature AND p.bin = s.bin)
                / CAST((SELECT count(*) FROM placed p WHERE p.role = 'train' AND p.feature = w.feature) AS DOUBLE) AS e
        FROM wins w JOIN slots s USING (feature))
    SELECT win AS "window", feature, round(sum((greatest(a, 1e-4) - greatest(e, 1e-4)) * ln(greatest(a, 1e-4) / greatest(e, 1e-4))), 6) AS psi,
        sum((greatest(a, 1e-4) - greatest(e, 1e-4)) * ln(greatest(a, 1e-4) / greatest(e, 1e-4))) > CASE feature WHEN 'score' THEN 0.1e0 ELSE 0.25e0 END AS drifted
    FROM shares GROUP BY win, feature""", "dlong")
_TRAIN = f"(SELECT * FROM folded WHERE role = 'train' AND fold = {base.FOLDS})"
_cte("edges", f"""
    SELECT * REPLACE (CASE WHEN row_id % 7 = 0 THEN 'S' || (num // 2)
        WHEN row_id % 7 = 1 AND num % 10 <> 9 THEN 'T' || ((num + 1) // 2) ELSE nameOrig END AS nameOrig)
    FROM (SELECT *, CAST(regexp_extract(nameDest, '[0-9]+') AS BIGINT) AS num FROM {_TRAIN})""", "folded")
_add("p2_destination_degrees", f"""
    SELECT nameDest, count(DISTINCT nameOrig) AS dest_degree, count(*) AS n_transactions,
        CAST(sum(CAST(amount AS {DEC})) AS DOUBLE) AS dest_weighted_degree FROM edges GROUP BY nameDest""", "edges")
# Every destination that can be reached, over any number of shared origins.
_add("p3_component_statistics", """
    , linked AS (SELECT DISTINCT a.nameDest AS d, b.nameDest AS e
        FROM (SELECT DISTINCT nameDest, nameOrig FROM edges) a JOIN (SELECT DISTINCT nameDest, nameOrig FROM edges) b USING (nameOrig)),
    reached AS (SELECT d, e FROM linked UNION SELECT r.d, l.e FROM reached r JOIN linked l ON r.e = l.d),
    per AS (SELECT nameDest, count(*) AS n, CAST(sum(isFraud) AS BIGINT) AS fraud FROM edges GROUP BY nameDest),
    comp AS (SELECT d AS nameDest, min(e) AS component FROM reached GROUP BY d),
    sizes AS (SELECT component, count(DISTINCT nameOrig) + count(DISTINCT nameDest) AS size
        FROM comp JOIN edges USING (nameDest) GROUP BY component),
    agg AS (SELECT component, sum(fraud) / CAST(sum(n) AS DOUBLE) AS rate,
        count(*) FILTER (WHERE fraud > 0) AS marks FROM comp JOIN per USING (nameDest) GROUP BY component)
    SELECT nameDest, CAST(size AS BIGINT) AS dest_component_size,
        CAST(marks - CASE WHEN fraud > 0 THEN 1 ELSE 0 END AS BIGINT) AS dest_flagged_neighbours,
        rate AS dest_component_fraud_rate
    FROM comp JOIN per USING (nameDest) JOIN agg USING (component) JOIN sizes USING (component)""", "edges")
ORACLE["p3_component_statistics"] = ORACLE["p3_component_statistics"].replace("WITH ", "WITH RECURSIVE ", 1)
_add("p4_feedback", """
    SELECT row_id, score, CASE WHEN isFraud = 1 THEN 'CONFIRMED_FRAUD' ELSE 'FALSE_POSITIVE' END AS label,
        CAST(2 AS BIGINT) AS n_verdicts, CAST(isFraud AS INTEGER) AS confirmed
    FROM decided WHERE decision = 'REVIEW' AND row_id % 3 <> 0""", "decided")
_POISSON = " + ".join(f"CAST(u > {b!r}e0 AS INTEGER)" for b in POISSON_ONE)
_cte("boot", f"""
    SELECT replicate, threshold, CAST(n AS BIGINT) AS n_flagged, hits / CAST(nullif(n, 0) AS DOUBLE) AS precision FROM (
        SELECT replicate, max(score) FILTER (WHERE cw >= k) AS threshold,
            coalesce(min(cw) FILTER (WHERE cw >= k), max(cw)) AS n, coalesce(min(cp) FILTER (WHERE cw >= k), max(cp)) AS hits
        FROM (SELECT replicate, score, sum(sum(w)) OVER o AS cw, sum(sum(w * is_fraud)) OVER o AS cp
            FROM (SELECT score, is_fraud, replicate, {_POISSON} AS w FROM (
                SELECT score, is_fraud, CAST(replicate AS INTEGER) AS replicate,
                    CAST(('0x' || left(md5('{base.SAMPLE_SEED}-' || replicate || '-' || row_id), 8)) AS BIGINT) / 4294967296e0 AS u
                FROM scored, range(1, 51) r(replicate)))
            GROUP BY replicate, score WINDOW o AS (PARTITION BY replicate ORDER BY score DESC)),
            (SELECT k FROM points WHERE reviews_per_day = {base.REVIEWS_PER_DAY})
        GROUP BY replicate)""", "scored", "points")
_add("p5_bootstrap_precision", "SELECT replicate, threshold, n_flagged, precision FROM boot", "boot")
_add("p5_precision_interval", """
    SELECT round(avg(precision), 6) AS mean, round(quantile_cont(precision, 0.025), 6) AS low,
        round(quantile_cont(precision, 0.975), 6) AS high FROM boot""", "boot")
_add("p6_mcnemar", f"""
    , j AS (SELECT a.fold, a.row_id, (a.score >= 0.5e0) = (a.is_fraud = 1) AS a, (b.score >= 0.5e0) = (b.is_fraud = 1) AS b
        FROM ms a JOIN ms b USING (row_id, fold) WHERE a.model = 'alpha' AND b.model = 'beta'),
    c AS (SELECT fold, count(*) FILTER (WHERE a AND b) AS "both", count(*) FILTER (WHERE a AND NOT b) AS only_left,
        count(*) FILTER (WHERE b AND NOT a) AS only_right, count(*) FILTER (WHERE NOT a AND NOT b) AS neither FROM j GROUP BY fold)
    SELECT *, round(power(greatest(abs(only_left - only_right) - 1, 0), 2) / nullif(CAST(only_left + only_right AS DOUBLE), 0), 6)
        AS statistic FROM c""", "ms")
_CASES = [("base", 1.0, (1, 1, 1))] + [
    (name, f, tuple(f if i == j else 1 for j in range(3)))
    for i, name in enumerate(("cost", "recovery", "liability")) for f in (0.5, 1.5)]
_add("p7_rate_sensitivity", f"""
    , v AS (SELECT shifted_rate, factor, reviews_per_day,
            true_positives * amt * (0.5e0 * r) - n_flagged * ({base.COST_PER_REVIEW}e0 * c) - false_negatives * amt * (1e0 * l) AS net
        FROM sweep, avgfraud, (VALUES {", ".join(
            f"('{n}', {f}e0, {c}e0, {r}e0, {x}e0)" for n, f, (c, r, x) in _CASES)}) k(shifted_rate, factor, c, r, l))
    SELECT shifted_rate, factor, reviews_per_day AS recommended_reviews_per_day, round(net, 6) AS net_value
    FROM (SELECT *, row_number() OVER (PARTITION BY shifted_rate, factor ORDER BY net DESC, reviews_per_day) AS nth FROM v)
    WHERE nth = 1""", "sweep", "avgfraud")

_cte("fitted_rows", f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold, isFraud ORDER BY {_HASH}) AS nth,
            sum(isFraud) OVER (PARTITION BY fold) AS fraud FROM folded WHERE role = 'train')
    WHERE isFraud = 1 OR nth <= CAST(floor(fraud * {NEGATIVES_PER_POSITIVE}e0) AS BIGINT)""", "folded")
_add("n_fit_checks", """
    SELECT learner, CAST(fold AS INTEGER) AS fold, count(*) AS n_train, CAST(sum(isFraud) AS BIGINT) AS n_train_fraud,
        CAST(18 AS INTEGER) AS n_features, true AS repeats, true AS above_base_rate, true AS nonzero_counted
    FROM fitted_rows, (VALUES ('logistic'), ('ridge'), ('lasso')) l(learner) GROUP BY learner, fold""", "fitted_rows")
ORACLE["d6_features_split"] = ORACLE["d6_features"]
ORACLE["d7_leakage_audit_split"] = ORACLE["d7_leakage_audit"]
_add("a2_materialize", "SELECT count(*) AS n_rows, false AS first_reused, true AS second_reused FROM features", "features")
ORACLE["a4_snapshot_sink"] = ORACLE["e1_snapshot"]
_add("a5_result_tables", f"""
    , queue AS (SELECT least(50, {_K}) AS alerts FROM (SELECT count(*) AS n, (max(step) - min(step) + 1) / 24e0 AS days,
            {base.REVIEWS_PER_DAY} AS reviews_per_day FROM folded WHERE fold = {base.FOLDS} AND role = 'test'))
    SELECT result, CAST(n AS BIGINT) AS n_rows FROM (VALUES ('model_comparison_by_fold', 12), ('model_comparison', 4),
        ('precision_recall_at_k_by_fold', {12 * len(FRAUD_MULTIPLES)}), ('precision_recall_at_k', {4 * len(FRAUD_MULTIPLES)}),
        ('global_importance', 18), ('error_analysis_profile', 18), ('missed_fraud_summary', 1),
        ('capacity_sweep', {len(base.REVIEWS_GRID)}), ('feature_ablation', 4), ('capacity_economics', {len(base.REVIEWS_GRID)})) t(result, n)
    UNION ALL SELECT 'alert_reasons', CAST(4 * alerts AS BIGINT) FROM queue""", "folded")
_add("t1_stream_scoring", f"SELECT row_id, state_hit, {_SERVED['dest_prior_txn_count']} AS dest_prior_txn_count, "
     f"{_SERVED['dest_txn_count_24h']} AS dest_txn_count_24h FROM found", "found")
_add("t2_stream_history", "SELECT row_id, dest_prior_txn_count, dest_prior_avg_amount, dest_txn_count_24h, dest_amount_sum_24h "
     "FROM features", "features")
_add("a6_audit_sink", """
    , known AS (SELECT DISTINCT nameDest FROM ledger, cuts WHERE step <= cuts[%d] AND nameDest NOT LIKE 'M%%')
    SELECT 'prediction' AS event, 'row-' || row_id AS request_id, 'linear' AS model_version, 'v1' AS bundle_version,
        %se0 AS threshold, score, flagged, decision, k.nameDest IS NOT NULL AS state_hit, 'sha256:' || sha256(%s) AS feature_hash
    FROM decided JOIN (SELECT row_id, nameDest FROM ledger) l USING (row_id) LEFT JOIN known k ON k.nameDest = l.nameDest""" % (
    base.FOLDS, base.DECISION_THRESHOLD,
    " || '|' || ".join(f"CAST(CAST(floor(CAST({n} AS DOUBLE) * 1e6) AS BIGINT) AS VARCHAR)" for n in FEATURES)),
     "decided", "ledger", "cuts")
_add("a7_upload_columns", """
    SELECT upload, missing, unexpected, CASE WHEN upload = 'complete' THEN (SELECT count(*) FROM ledger) ELSE 0 END AS n_rows
    FROM (VALUES ('complete', '', ''), ('incomplete', 'amount,nameDest', ''), ('labelled', '', 'isFraud')) u(upload, missing, unexpected)
    """, "ledger")
# The watermark before a part is the latest time that arrived with earlier parts, less the delay.
_add("t3_rolling_telemetry", f"""
    , span AS (SELECT min(step) AS low, max(step) - min(step) + 1 AS hours FROM ledger),
    timed AS (SELECT *, (step - low) * {STREAM_PARTS} // hours AS part, 2 * (hours // {STREAM_PARTS} + 1) AS delay,
            step // {TELEMETRY_HOURS} * {TELEMETRY_HOURS} AS window_step FROM found, span),
    sent AS (SELECT *, CASE WHEN row_id % 50 = 7 AND part <= 2 THEN {STREAM_PARTS - 1}
            WHEN row_id % 10 = 3 AND part < {STREAM_PARTS - 1} THEN part + 1 ELSE part END AS arrival FROM timed),
    marks AS (SELECT arrival, max(max(step)) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
        FROM sent GROUP BY arrival),
    told AS (SELECT *, {_RULE} AS rule FROM (SELECT row_id, arrival, window_step, delay, txn_count_24h, {", ".join(
        f"{sql} AS {n}" for n, sql in _stateless_sql().items())} FROM sent)),
    counted AS (SELECT window_step, any_value(delay) AS delay, count(*) AS n_scored, count(rule) AS n_blocked,
            count(*) FILTER (WHERE rule IS NULL AND txn_count_24h > 3) AS n_flagged,
            count(*) FILTER (WHERE rule IS NULL AND txn_count_24h <= 3) AS n_passed
        FROM told JOIN marks USING (arrival) WHERE seen IS NULL OR window_step + {TELEMETRY_HOURS} > seen - delay
        GROUP BY window_step)
    SELECT window_step, n_scored, n_blocked, n_flagged, n_passed FROM counted
    WHERE window_step + {TELEMETRY_HOURS} <= (SELECT max(step) FROM ledger) - delay""", "found")
_LAST_TEST = f"FROM folded WHERE fold = {base.FOLDS} AND role = 'test'"
_add("j4_tree_additivity", f"""
    SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_not_additive, CAST(0 AS BIGINT) AS n_not_the_score {_LAST_TEST}""", "folded")
_add("l4_bundle_scores", f"""
    SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_batch_off, CAST(0 AS BIGINT) AS n_stream_off,
        CAST(0 AS BIGINT) AS n_flagged_off {_LAST_TEST}""", "folded")
ORACLE["a1_validated_ingest"] = ORACLE["b1_validation_report"]
ORACLE["a2_incremental"] = ORACLE["d6_features"]
ORACLE["e2_bucketed_lookup"] = ORACLE["e2_state_lookup"]
# Component names are smallest nodes; every destination is below the origins it is linked with.
_add("p3_grown_components", """
    , linked AS (SELECT DISTINCT a.nameDest AS d, b.nameDest AS e
        FROM (SELECT DISTINCT nameDest, nameOrig FROM edges) a JOIN (SELECT DISTINCT nameDest, nameOrig FROM edges) b USING (nameOrig)),
    reached AS (SELECT d, e FROM linked UNION SELECT r.d, l.e FROM reached r JOIN linked l ON r.e = l.d)
    SELECT d AS nameDest, 'd:' || min(e) AS component FROM reached GROUP BY d""", "edges")
ORACLE["p3_grown_components"] = ORACLE["p3_grown_components"].replace("WITH ", "WITH RECURSIVE ", 1)
