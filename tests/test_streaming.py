from __future__ import annotations

import random
from decimal import Decimal

import pandas as pd
import pytest
from ledger_cases import rows_of
from pyspark.sql import functions as F

from riskmill.functions.rules import default_rules
from riskmill.operators.decisions import decide
from riskmill.operators.history import build_features
from riskmill.operators.state import destination_snapshot, features_from_state, lookup_state
from riskmill.sources.ledger import LEDGER_COLUMNS
from riskmill.streaming import history, scoring


@pytest.fixture(scope="module")
def arriving(spark, ledger, tmp_path_factory):
    """The ledger as four files in step order, older files first."""
    import os
    import time

    path = str(tmp_path_factory.mktemp("arriving"))
    rows = ledger.select("row_id", *LEDGER_COLUMNS)
    bounds = [0, 200, 300, 500, 10_000]
    for i, (low, high) in enumerate(zip(bounds, bounds[1:])):
        rows.where((F.col("step") >= low) & (F.col("step") < high)).coalesce(1).write.parquet(f"{path}/part{i}")
        for name in os.listdir(f"{path}/part{i}"):
            stamp = time.time() - 1000 + i * 100
            os.utime(f"{path}/part{i}/{name}", (stamp, stamp))
    return f"{path}/*"


def test_stream_scores_like_the_batch(spark, ledger, arriving, tmp_path):
    snapshot = destination_snapshot(ledger.where("step <= 300"))
    flagged, rules = F.col("dest_txn_count_24h") > 3, default_rules(200.0)
    stream = scoring.score_transactions(scoring.read_transactions(spark, arriving), snapshot, flagged, rules)
    scoring.start_scoring(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    batch = decide(features_from_state(lookup_state(ledger, snapshot)), flagged, rules)
    names = ("row_id", "decision", "state_hit", "dest_prior_txn_count", "dest_amount_sum_24h")
    made = rows_of(spark.read.parquet(str(tmp_path / "out")), *names)
    assert made == rows_of(batch, *names) and len({row[1] for row in made}) == 3


CARRIED = ("row_id", "dest_prior_txn_count", "dest_prior_avg_amount", "dest_txn_count_24h", "dest_amount_sum_24h")


def test_history_across_batches_equals_one_batch(spark, ledger, arriving, tmp_path):
    transactions = scoring.read_transactions(spark, arriving, files_per_trigger=1)
    query = history.start_history(transactions, str(tmp_path))
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p.numInputRows]) == 4
    made = spark.read.parquet(str(tmp_path / "history"))
    assert rows_of(made, *CARRIED) == rows_of(build_features(ledger), *CARRIED)
    assert spark.conf.get(history.STORE_SETTING) != history.ROCKS_DB


def test_history_goes_on_after_a_restart_with_the_states_of_its_destinations(spark, ledger, tmp_path):
    """Twelve runs; a run touches the states of the destinations that arrive, whatever was there before."""
    rows = ledger.select("row_id", *LEDGER_COLUMNS).where("row_id % 4 = 0")
    steps = [0, *range(60, 660, 60), 100_000]
    touched, wanted = [], []
    for low, high in zip(steps, steps[1:]):
        part = rows.where((F.col("step") >= low) & (F.col("step") < high))
        part.write.mode("append").parquet(str(tmp_path / "in"))
        query = history.start_history(scoring.read_transactions(spark, str(tmp_path / "in")), str(tmp_path / "out"))
        query.awaitTermination()
        touched.append(sum(p.stateOperators[0].numRowsUpdated for p in query.recentProgress if p.stateOperators))
        wanted.append(part.select("nameDest").distinct().count())
    assert touched == wanted and len(touched) == 11
    made = spark.read.parquet(str(tmp_path / "out" / "history"))
    assert rows_of(made, *CARRIED) == rows_of(build_features(rows), *CARRIED)


def plain_past(rows):
    """Each row of one destination against all that were taken before it; rows of one step don't see each other."""
    out, seen = [], []
    for step, row_id, amount, value in rows:
        recent = [v for s, v in seen if step - 24 <= s < step]
        out.append((row_id, step, amount, len(seen), sum((v for _, v in seen), Decimal(0)), len(recent), sum(recent, Decimal(0))))
        seen.append((step, value))
    return out


def test_past_takes_late_rows_as_they_arrive():
    rng = random.Random(6)
    past, arrived = history.Past(), []
    for batch in range(8):
        rows = sorted((max(0, batch * 20 + rng.randrange(-30, 30)), batch * 100 + k, 1.0, Decimal(rng.randrange(900)) / 100) for k in range(25))
        arrived += rows
        found = list(past.take(rows))
        assert found == plain_past(arrived)[-25:]
        past = history.Past.stored(past.value())
        past.forget(history.LATE_HOURS)
    past.forget(0)
    assert min(past.steps) >= max(past.steps) - 24 and past.seen_rows == 200


def test_telemetry_equals_batch_counts(spark, ledger, tmp_path):
    source = str(tmp_path / "in")
    kinds = F.element_at(F.array(F.lit("BLOCK"), F.lit("REVIEW"), F.lit("PASS")), (F.col("row_id") % 3 + 1).cast("int"))
    decided = ledger.select("row_id", kinds.alias("decision"), F.timestamp_seconds(F.col("step") * 3600).alias("event_time"))
    decided.write.parquet(source)
    stream = spark.readStream.schema(decided.schema).parquet(source)
    query = scoring.decision_telemetry(stream).writeStream.format("memory").queryName("telemetry") \
        .outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    made = {r.window_start: (r.n_scored, r.n_blocked, r.n_flagged, r.n_passed) for r in spark.table("telemetry").collect()}
    plain = {}
    for row in decided.collect():
        plain.setdefault(row.event_time, []).append(row.decision)
    assert made == {t: (len(v), v.count("BLOCK"), v.count("REVIEW"), v.count("PASS")) for t, v in plain.items()}


def test_late_rows_beyond_the_watermark_are_dropped(spark, tmp_path):
    source = str(tmp_path / "in")
    ddl = "event_time timestamp, decision string"

    def arrive(hours):
        spark.range(1).select(F.explode(F.array(*[F.lit(h) for h in hours])).alias("h")).select(
            F.timestamp_seconds(F.col("h") * 3600).alias("event_time"), F.lit("PASS").alias("decision")) \
            .write.mode("append").parquet(source)

    arrive([1, 2, 10])
    query = None
    for hours in (None, [1], [30]):
        if hours:
            arrive(hours)
        stream = scoring.decision_telemetry(spark.readStream.schema(ddl).parquet(source))
        query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")) \
            .trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
    made = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.n_scored for r in made.collect()) == [1, 1, 1]


def test_one_call_serves_all_destinations_of_a_bucket_each_with_its_own_state():
    """Two batches of three destinations, one without a name, against one walk per destination."""
    class Pasts(dict):
        getValue, updateValue = dict.get, dict.__setitem__

    processor = history.DestinationHistory(history.LATE_HOURS)
    processor.state = Pasts()
    rng, wanted, made, pasts = random.Random(3), [], [], {}
    for batch in range(2):
        rows = [(100 * batch + i, 30 * batch + rng.randrange(30), rng.choice(["C1", "C2", None]), Decimal(rng.randrange(1, 90))) for i in range(40)]
        frame = pd.DataFrame(rows, columns=["row_id", "step", "nameDest", "value"])
        frame.insert(3, "amount", frame["value"].astype(float))
        answers = list(processor.handleInputRows((7,), iter([frame[:15], frame[15:]]), None))
        assert len(answers) == 1
        made += [(r.nameDest, r.row_id, r.prior_rows, r.prior_total, r.recent_rows, r.recent_total) for r in answers[0].itertuples()]
        for name in ("C1", "C2", None):
            past = pasts.setdefault(name, history.Past())
            its = sorted((step, row_id, float(value), value) for row_id, step, dest, value in rows if dest == name)
            wanted += [(name, row_id, *rest) for row_id, _, _, *rest in past.take(iter(its))]
            past.forget(history.LATE_HOURS)
    assert set(processor.state) == {("C1",), ("C2",), (None,)}
    assert sorted(map(repr, made)) == sorted(map(repr, wanted))
