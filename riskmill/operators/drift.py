"""Population stability of features and scores over successive step windows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmill.lineage import cut_lineage
from riskmill.params import PSI_FEATURE_LIMIT, PSI_SCORE_LIMIT

BINS = 10
# A sketch of size k is off by some SKETCH_ERROR / k^0.94 of the ranks; brackets are four times as wide.
SKETCH_SIZE = 4096
SKETCH_ERROR = 2.45
MOST_PASSES = 40
FLOOR = 1e-4


@dataclass
class _Bracket:
    """Where the value at a position of a column's order must lie, both ends included, and a guess at it."""

    position: int
    low: float
    high: float
    guess: float

    def narrowed(self, seen: _Seen, span: tuple[float, float], size: int) -> float | _Bracket:
        """The value itself once counts or the sketch of the inside give it, else a bracket without the guess."""
        if self.position <= seen.below:
            return self._replaced(span[0], math.nextafter(self.low, -math.inf))
        if self.position > seen.below + seen.inside:
            return self._replaced(math.nextafter(self.high, math.inf), span[1])
        if seen.under_guess < self.position <= seen.under_guess + seen.at_guess:
            return self.guess
        if seen.inside <= size:
            return seen.value
        if self.position <= seen.under_guess:
            low, high = self.low, math.nextafter(self.guess, -math.inf)
        else:
            low, high = math.nextafter(self.guess, math.inf), self.high
        nearer = max(low, seen.near_low), min(high, seen.near_high)
        low, high = nearer if nearer[0] <= nearer[1] else (low, high)
        return _Bracket(self.position, low, high, min(high, max(low, seen.value)))

    def _replaced(self, low: float, high: float) -> _Bracket:
        return _Bracket(self.position, low, high, low)


def bin_edges(reference: DataFrame, names: Sequence[str], bins: int = BINS, size: int = SKETCH_SIZE) -> dict[str, list[float]]:
    """Inner quantile edges per column, exact; at most ``bins - 1`` numbers per column reach the driver.

    A mergeable quantile sketch of each column brackets every edge. A pass over the rows then counts what lies below a
    bracket, inside, and at the guess, and sketches the inside: the counts are exact, so the guess is confirmed or left out,
    and the inside's sketch narrows the bracket. A sketch of no more values than its size holds them all and gives the
    value itself. Sketches and counts combine map-side: no pass shuffles values, and a bracket shrinks some hundredfold
    with each. Nulls are left out; a column of nulls has no edges.
    """
    margin = 4 * SKETCH_ERROR / size ** 0.94
    values = reference.select(F.inline(F.array(*[_value(name) for name in names]))).where("x is not null")
    whole = cut_lineage(values.groupBy("feature").agg(
        F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.kll_sketch_agg_double("x", F.lit(size)).alias("s")))
    spans = {row.feature: row for row in whole.drop("s").collect()}
    positions = {name: [math.ceil(round(row.n * (i / bins), 6)) for i in range(1, bins)] for name, row in spans.items()}
    told = _asked(whole, {(name, "s"): [r for p in positions[name] for r in _ranks(p, row.n, margin)] for name, row in spans.items()})
    found: dict[str, list[float]] = {name: [] for name in names}
    brackets = {}
    for name, row in spans.items():
        for i, position in enumerate(positions[name]):
            value, near_low, near_high = told[name, "s"][3 * i:3 * i + 3]
            if row.n <= size:
                found[name].append(value)
            else:
                brackets[name, i] = _Bracket(position, near_low, near_high, value)
    for _ in range(MOST_PASSES):
        if not brackets:
            return {name: sorted(set(edges)) for name, edges in found.items()}
        for key, seen in _counted(reference, brackets, size, margin).items():
            kept = brackets[key].narrowed(seen, (spans[key[0]].low, spans[key[0]].high), size)
            if isinstance(kept, _Bracket):
                brackets[key] = kept
            else:
                found[key[0]].append(kept)
                del brackets[key]
    raise RuntimeError(f"quantile edges did not settle in {MOST_PASSES} passes")


def _value(name: str) -> Column:
    return F.struct(F.lit(name).alias("feature"), F.col(name).cast("double").alias("x"))


def _ranks(position: int, count: int, margin: float) -> list[float]:
    """Shares of a sketch's order for a position, and a margin before and behind it."""
    # Half a position back: rounding can't reach the next one.
    return [(position - 0.5) / count, max(0.0, position / count - margin), min(1.0, position / count + margin)]


def _asked(stored: DataFrame, ranks: Mapping[tuple[str, str], Sequence[float]]) -> dict[tuple[str, str], list[float]]:
    """The values of stored sketches at ranks, by feature and sketch column."""
    if not ranks:
        return {}
    entries = []
    for sketch in sorted({sketch for _, sketch in ranks}):
        values = F.lit(None).cast("array<double>")
        for (feature, column), wanted in ranks.items():
            if column == sketch:
                values = F.when(F.col("feature") == feature, F.kll_sketch_get_quantile_double(
                    sketch, F.array(*[F.lit(float(r)) for r in wanted]))).otherwise(values)
        entries.append(F.struct(F.lit(sketch).alias("sketch"), values.alias("values")))
    rows = stored.select("feature", F.inline(F.array(*entries))).collect()
    return {(row.feature, row.sketch): row["values"] for row in rows if (row.feature, row.sketch) in ranks}


@dataclass(frozen=True)
class _Seen:
    """What a pass counted for a bracket, and what the sketch of its inside says of the position."""

    below: int
    inside: int
    under_guess: int
    at_guess: int
    value: float = math.nan
    near_low: float = math.nan
    near_high: float = math.nan


def _counted(reference: DataFrame, brackets: Mapping[tuple[str, int], _Bracket], size: int,
             margin: float) -> dict[tuple[str, int], _Seen]:
    """One pass over the rows: what lies below each bracket, inside, and below and at its guess."""
    features = sorted({feature for feature, _ in brackets})
    slots = 1 + max(i for _, i in brackets)
    unused = _Bracket(0, math.inf, -math.inf, math.inf)

    def numbers(feature: str, field: str) -> Column:
        return F.array(*[F.lit(float(getattr(brackets.get((feature, i), unused), field))) for i in range(slots)])
    placed = reference.select(F.inline(F.array(*[
        _value(f).withField("low", numbers(f, "low")).withField("high", numbers(f, "high")).withField("guess", numbers(f, "guess"))
        for f in features]))).where("x is not null")
    sums = []
    for i in range(slots):
        inside = (F.col("x") >= F.col("low")[i]) & (F.col("x") <= F.col("high")[i])
        sums += [F.count_if(F.col("x") < F.col("low")[i]).alias(f"below{i}"), F.count_if(inside).alias(f"inside{i}"),
                 F.count_if(F.col("x") < F.col("guess")[i]).alias(f"under{i}"), F.count_if(F.col("x") == F.col("guess")[i]).alias(f"equal{i}"),
                 F.kll_sketch_agg_double(F.when(inside, F.col("x")), F.lit(size)).alias(f"s{i}")]
    stored = cut_lineage(placed.groupBy("feature").agg(*sums))
    counts = {row.feature: row for row in stored.drop(*[f"s{i}" for i in range(slots)]).collect()}
    seen = {(f, i): _Seen(*[counts[f][f"{kind}{i}"] for kind in ("below", "inside", "under", "equal")]) for f, i in brackets}
    hits = {key: brackets[key].position - s.below for key, s in seen.items() if 0 < brackets[key].position - s.below <= s.inside}
    told = _asked(stored, {(f, f"s{i}"): _ranks(at, seen[f, i].inside, margin) for (f, i), at in hits.items()})
    return {(f, i): replace(s, **dict(zip(("value", "near_low", "near_high"), told[f, f"s{i}"]))) if (f, i) in hits else s
            for (f, i), s in seen.items()}


def _shares(rows: DataFrame, edges: dict[str, list[float]], by: Sequence[str]) -> DataFrame:
    """Share of rows per (group, column, bin); empty bins are kept as zero."""
    placed = []
    for name, inner in edges.items():
        at = F.lit(0)
        for edge in inner:
            at = at + (F.col(name) > edge).cast("int")
        placed.append(F.struct(F.lit(name).alias("feature"), at.alias("bin")))
    counts = rows.select(*by, F.inline(F.array(*placed))).groupBy(*by, "feature", "bin").agg(F.count("*").alias("n"))
    slots = F.create_map(*[part for name, inner in edges.items()
                           for part in (F.lit(name), F.sequence(F.lit(0), F.lit(len(inner))))])
    packed = counts.groupBy(*by, "feature").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("found"), F.sum("n").alias("total"))
    return packed.select(
        *by, "feature", F.explode(slots[F.col("feature")]).alias("bin"), "found", "total",
    ).select(*by, "feature", "bin", (F.coalesce(F.try_element_at("found", F.col("bin")), F.lit(0)) / F.col("total")).alias("share"))


def stability_index(reference: DataFrame, compared: DataFrame, names: Sequence[str], by: Sequence[str],
                    bins: int = BINS, score: str | None = None) -> DataFrame:
    """PSI of every column per group of ``compared`` rows, flagged above the limit for features or for the score."""
    edges = bin_edges(reference, names, bins)
    expected = _shares(reference, edges, ()).withColumnRenamed("share", "expected")
    joined = _shares(compared, edges, by).join(F.broadcast(expected), ["feature", "bin"])
    a, e = F.greatest("share", F.lit(FLOOR)), F.greatest("expected", F.lit(FLOOR))
    limit = F.when(F.col("feature") == (score or ""), PSI_SCORE_LIMIT).otherwise(PSI_FEATURE_LIMIT)
    psi = joined.groupBy(*by, "feature").agg(F.sum((a - e) * F.log(a / e)).alias("psi"))
    return psi.withColumn("drifted", F.col("psi") > limit)
