from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from ledger_cases import rows_of
from pyspark.sql import functions as F

from riskmill.operators import drift, graph, review


def components_by_search(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("kind", ["random", "path", "hub", "loops"])
def test_components(spark, kind):
    rng = random.Random(3)
    pairs = {
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(180)],
        "path": [(i, i + 1) for i in rng.sample(range(60), 60)],
        "hub": [(7, i) for i in range(100, 200)] + [(i, i + 1000) for i in range(150, 210)],
        "loops": [(1, 1), (2, 2), (3, 2)],
    }[kind]
    made = graph.connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b")
    assert {r.node: r.component for r in made.collect()} == components_by_search(pairs)


def test_component_statistics_with_shared_senders(spark):
    edges = spark.createDataFrame(
        [("S1", "A", 1.0, 1), ("S1", "B", 2.0, 0), ("S2", "B", 3.0, 0), ("S3", "C", 4.0, 0)],
        "nameOrig string, nameDest string, amount double, isFraud int")
    made = graph.component_statistics(edges)
    assert rows_of(made, "nameDest", "dest_component_size", "dest_flagged_neighbours") == [
        ("A", 4, 0), ("B", 4, 1), ("C", 2, 0)]
    assert {r.nameDest: round(r.dest_component_fraud_rate, 6) for r in made.collect()} == {"A": 0.333333, "B": 0.333333, "C": 0.0}
    given = graph.component_statistics(edges, spark.createDataFrame([("B",)], "nameDest string"))
    assert rows_of(given, "nameDest", "dest_flagged_neighbours") == [("A", 1), ("B", 0), ("C", 0)]
    assert rows_of(graph.destination_degrees(edges), "nameDest", "dest_degree", "dest_weighted_degree") == [
        ("A", 1, 1.0), ("B", 2, 5.0), ("C", 1, 4.0)]


@pytest.mark.parametrize("change,fires", [
    (lambda x: x, False), (lambda x: x + 3.0, True), (lambda x: x * 6.0, True), (lambda x: F.when(x > 0, 5.0).otherwise(x), True),
])
def test_drift_fires_on_injected_shifts(spark, change, fires):
    reference = spark.range(4000).select(F.randn(1).alias("x"))
    compared = spark.range(3000).select(F.randn(2).alias("x"), F.lit(1).alias("w")).withColumn("x", change(F.col("x")))
    row = drift.stability_index(reference, compared, ["x"], ["w"]).first()
    assert row.drifted == fires and row.psi >= 0


def test_score_has_its_own_limit(spark):
    reference = spark.range(2000).select((F.col("id") / 2000).alias("s"))
    compared = reference.select((F.col("s") * 0.85).alias("s"), F.lit(1).alias("w"))
    as_feature = drift.stability_index(reference, compared, ["s"], ["w"]).first()
    as_score = drift.stability_index(reference, compared, ["s"], ["w"], score="s").first()
    assert 0.10 < as_feature.psi == as_score.psi
    assert as_score.drifted and as_feature.drifted == (as_feature.psi > 0.25)


def test_latest_feedback_wins(spark):
    predictions = spark.createDataFrame([(1, .9), (2, .8), (3, .7)], "row_id long, score double")
    feedback = spark.createDataFrame(
        [(1, 5, "FALSE_POSITIVE"), (1, 9, "CONFIRMED_FRAUD"), (2, 1, "FALSE_POSITIVE")], "row_id long, ts long, label string")
    assert rows_of(review.labelled_predictions(predictions, feedback), "row_id", "confirmed", "n_verdicts") == [(1, 1, 2), (2, 0, 1)]


def test_bootstrap_centres_on_the_precision(spark):
    flagged = spark.range(400).select(F.col("id").alias("row_id"), (F.col("id") % 4 == 0).cast("int").alias("is_fraud"))
    made = review.interval(review.bootstrap_precision(flagged, 200, 42)).first()
    assert made.mean == pytest.approx(0.25, abs=0.01) and made.low < 0.25 < made.high and made.high - made.low < 0.12
    drawn = review.bootstrap_precision(flagged, 200, 42).agg(F.avg("n_drawn")).first()[0]
    assert drawn == pytest.approx(400, rel=0.02)


@pytest.mark.parametrize("size", [8, 64, 4096])
def test_edges_are_exact_whatever_the_sketch(spark, size):
    """Small sketches need several passes; ties, one value, few values, nulls and wide ranges included."""
    rng = random.Random(size)
    rows = [(rng.gauss(0, 1), float(rng.randrange(3)), 7.5, rng.choice([0.0] * 9 + [rng.random()]), 10 ** rng.uniform(-300, 300),
             None if k % 3 else float(k), None, -0.0 if k % 2 else 0.0) for k in range(3000)]
    names = ("normal", "three", "one", "mostly", "wide", "gaps", "none", "zeros")
    frame = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(5)
    found = drift.bin_edges(frame, names, size=size)
    for place, name in enumerate(names):
        values = sorted(r[place] for r in rows if r[place] is not None)
        wanted = sorted({values[math.ceil(round(len(values) * (i / 10), 6)) - 1] for i in range(1, 10)}) if values else []
        assert found[name] == wanted, name
    assert drift.bin_edges(frame.limit(0), names) == {name: [] for name in names}


def plain_replicate(rows, k, seed, replicate):
    """Threshold, rows and hits of one replicate, row by row."""
    import hashlib

    total = Counter()
    hits = Counter()
    for row_id, score, label in rows:
        u = int(hashlib.md5(f"{seed}-{replicate}-{row_id}".encode()).hexdigest()[:8], 16) / 2 ** 32
        w = sum(u > bound for bound in review.POISSON_ONE)
        total[score] += w
        hits[score] += w * label
    n = c = 0
    for score in sorted(total, reverse=True):
        n, c = n + total[score], c + hits[score]
        if n >= k:
            return score, n, c
    return None, n, c


@pytest.mark.parametrize("k, spare", [(40, 10.0), (40, -30.0), (350, 10.0), (1, 10.0)])
def test_bootstrap_finds_each_replicates_threshold(spark, monkeypatch, k, spare):
    """Also when the first cut takes too few scores, and when a replicate draws fewer than k rows of all."""
    rows = [(i, (i * 7919 % 101) / 101, int(i % 6 == 0)) for i in range(360)]
    frame = spark.createDataFrame(rows, "row_id long, score double, is_fraud int")
    found = {r.replicate: r for r in review.bootstrap_at_capacity(frame, k, 12, 42, spare=spare).collect()}
    assert set(found) == set(range(1, 13))
    for replicate, r in found.items():
        threshold, n, hits = plain_replicate(rows, k, 42, replicate)
        assert (r.threshold, r.n_flagged) == (threshold, n) and r.precision == pytest.approx(hits / n)


def test_mcnemar(spark):
    left = spark.createDataFrame([(i, i < 30) for i in range(50)], "row_id long, correct boolean")
    right = spark.createDataFrame([(i, i < 10 or i >= 40) for i in range(50)], "row_id long, correct boolean")
    row = review.mcnemar(left, right).first()
    assert (row.both, row.only_left, row.only_right, row.neither) == (10, 20, 10, 10)
    assert row.statistic == pytest.approx(81 / 30)
    assert review.mcnemar(left, left).first().statistic is None
