"""Toxicity by compression distance: two zstandard dictionaries, one trained on toxic text and one on ordinary text.

A text is cut into windows of four words. A window is compressed behind the ordinary dictionary, and behind the
ordinary dictionary with the toxic one added; how many bytes the toxic one saves is the window's distance. Ordinary
windows save nothing, as what they have in common with toxic documents is in both. Thresholds on the windows' savings,
weighed by a logistic fit that follows the share of toxic labels, turn them into a probability.

Toxic documents are mostly ordinary text, so the toxic dictionary is trained on the words that set them apart: words
with a run of ``RUN`` bytes that stands in many different contexts (words before and after) of toxic windows and in few
of ordinary ones. A passage that is copied through many documents is one context, however often it occurs.

Fitting is bounded: at most ``FIT_DOCS`` labelled documents of each label, chosen by a hash of their id, half for the
dictionaries (at most ``FIT_WINDOWS`` distinct windows of each label) and half for the thresholds. These numbers are
parameters. Scoring reads every text whole, window by window.

Null and empty texts have one empty window and get its score. Without labels of both kinds on documents that exist nothing
can be learnt, and every score is 0; without words in the ordinary ones every word of the toxic ones tells. A label is
learnt from once for each row of a repeated id, of which equal ones are counted together. Scores depend on the text alone; labels
and all other columns are no input.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from riskmill.lineage import cut_lineage
from riskmill.llm.common import whole_text

WINDOW = 4
FIT_WINDOW = 8
FIT_DOCS = 6000
FIT_WINDOWS = 40_000
RUN = 5
LEAST_CONTEXTS = 3
LEAST_SHARE = 2e-4
LEAST_LIFT = 6.0
ORDINARY_BYTES = 16384
TOXIC_BYTES = 4096
LEVEL = 3
SAVINGS = (2, 3, 4)
RIDGE = 0.1


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return [b" " + b" ".join(words[at:at + size]) + b" " for at in range(0, len(words), size)] or [b""]


def _runs(word: bytes) -> set[bytes]:
    framed = b" " + word + b" "
    return {framed[at:at + RUN] for at in range(len(framed) - RUN + 1)}


def _contexts(samples: Iterable[bytes]) -> tuple[Counter, int]:
    """In how many different contexts each run occurs, and the number of contexts."""
    seen = {context for sample in samples for words in [sample.split()]
            for context in zip([b"", *words], words, [*words[1:], b""])}
    counts: Counter = Counter()
    for _, word, _ in seen:
        counts.update(_runs(word))
    return counts, len(seen)


def telling_words(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The words of toxic samples that set them apart, each as often as it occurs."""
    bad, n_bad = _contexts(toxic)
    good, n_good = _contexts(ordinary)
    apart = {run for run, n in bad.items()
             if n >= max(LEAST_CONTEXTS, LEAST_SHARE * n_bad) and n / n_bad >= LEAST_LIFT * (good[run] + 1) / max(n_good, 1)}
    return [b" " + word + b" " for sample in toxic for word in sample.split() if not apart.isdisjoint(_runs(word))]


def dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """A trained dictionary; too few samples to train on are one themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Distances:
    """Bytes that the toxic dictionary saves in each window."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.contents = (ordinary, ordinary + toxic)
        self.made: tuple | None = None

    def __getstate__(self):
        return {"contents": self.contents, "made": None}

    def of(self, parts: list[bytes]) -> np.ndarray:
        if self.made is None:
            self.made = tuple(_compressor(content) for content in self.contents)
        plain, behind = (c.compress for c in self.made)
        return np.array([len(plain(part)) - len(behind(part)) for part in parts], float)

    def features(self, text: str) -> list[float]:
        """The largest saving, windows (three at most count) above each threshold, their share, and the length."""
        saved = self.of(windows(text))
        above = [float(min(3, (saved >= least).sum())) for least in SAVINGS]
        return [float(saved.max()), *above, float((saved >= SAVINGS[1]).mean() ** 0.5), float(np.log(len(saved)))]


def _compressor(content: bytes):
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=data, level=LEVEL, write_content_size=False, write_dict_id=False,
                                    write_checksum=False)


@dataclass
class ToxicityModel:
    distances: Distances
    means: np.ndarray
    scales: np.ndarray
    weights: np.ndarray

    def score(self, text: str) -> float:
        measured = (np.array(self.distances.features(text)) - self.means) / self.scales
        return float(1 / (1 + np.exp(-(measured @ self.weights[:-1] + self.weights[-1]))))


def logistic(measured: np.ndarray, labels: np.ndarray, importance: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the constant."""
    rows = np.c_[measured, np.ones(len(measured))]
    weights = np.zeros(rows.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        curve = (rows * (importance * p * (1 - p))[:, None]).T @ rows + RIDGE * np.eye(rows.shape[1])
        weights = weights - np.linalg.solve(curve, rows.T @ (importance * (p - labels)) + RIDGE * weights)
    return weights


def id_remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, fit_windows: int = FIT_WINDOWS) -> ToxicityModel | None:
    """Learn from ``labels`` (doc_id, toxic); the caller leaves out what is held out."""
    usable = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    totals = {row.toxic: row["count"] for row in usable.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return None
    order = F.xxhash64("doc_id")
    chosen = None
    for label in (0, 1):
        some = usable.where(F.col("toxic") == label).orderBy(order, "doc_id").limit(fit_docs)
        chosen = some if chosen is None else chosen.unionByName(some)
    chosen = chosen.withColumn("for_words", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)) == 0)
    # At most 2 * fit_docs ids, by the limits above.
    read = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id")

    samples: list[list[bytes]] = []
    cut = read.where("for_words").select("toxic", "text").mapInPandas(_sample_windows, "toxic int, window binary").distinct()
    for label in (0, 1):
        kept = cut.where(F.col("toxic") == label).orderBy(F.xxhash64("window"), "window").limit(fit_windows)
        samples.append([bytes(row.window) for row in kept.select("window").collect()])
    telling = telling_words(samples[1], samples[0])
    distances = Distances(dictionary(samples[0], ORDINARY_BYTES, 64), dictionary(telling, TOXIC_BYTES, 16))

    # Equal rows are counted where they are, so a repeated id takes no more room; of different ones at most fit_docs a label.
    alike = cut_lineage(read.where("not for_words").select("toxic", "text").mapInPandas(
        _Measure(distances), "toxic int, features array<double>").groupBy("toxic", "features").agg(F.count("*").alias("n")))
    measured = [row for label in (0, 1) for row in alike.where(F.col("toxic") == label)
                .orderBy(F.xxhash64("features"), "features").limit(fit_docs).collect()]
    if len({row.toxic for row in measured}) < 2:
        return None
    ordered = sorted((row.toxic, tuple(row.features), row.n) for row in measured)
    labels_seen = np.array([label for label, _, _ in ordered], float)
    features = np.array([f for _, f, _ in ordered])
    rows = np.array([n for _, _, n in ordered], float)
    means = np.average(features, axis=0, weights=rows)
    scales = np.average((features - means) ** 2, axis=0, weights=rows) ** 0.5 + 1e-9
    # Labels were sampled apart; each counts for those of its kind.
    part = {label: rows[labels_seen == label].sum() / totals[label] for label in (0, 1)}
    importance = rows * np.array([1 / part[int(label)] for label in labels_seen])
    importance *= rows.sum() / importance.sum()
    return ToxicityModel(distances, means, scales, logistic((features - means) / scales, labels_seen, importance))


def _sample_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for label, text in zip(batch["toxic"], batch["text"]):
            yield pd.DataFrame({"toxic": label, "window": windows(text, FIT_WINDOW)}).astype({"toxic": "int32"})


class _Measure:
    def __init__(self, distances: Distances):
        self.distances = distances

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "features": [self.distances.features(t) for t in batch["text"]]})


def score(docs: DataFrame, model: ToxicityModel | None, name: str = "score") -> DataFrame:
    """The rows with their probability of being toxic; a column of that name is replaced."""
    if model is None:
        return docs.withColumn(name, F.lit(0.0))

    @pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return docs.withColumn(name, scored(whole_text()))
