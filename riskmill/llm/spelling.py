"""Spelling variants: PartEnum signatures of letter multisets find words one edit apart.

Vectors: a word's letters are a multiset, taken as a binary vector with one dimension for each (letter, how many of it
came before). One replaced letter changes two dimensions at most, an inserted or deleted one a single one.

Signatures: dimensions are dealt to parts by hash. Words of one length within distance two agree on all parts but two,
so each is filed under every choice of parts less two; words whose lengths differ by one agree on all parts but one, so
each is filed under every choice less one, as the shorter and as the longer of a pair. The enumeration is exact: no
pair is missed. Words made of the same syllables share many multisets, which would make groups that grow with the
vocabulary. An edit leaves the first or the last half of the shorter word as it was, so a signature is filed once with
either half; that splits every large group and loses no pair either.

An equi-join of the signatures verifies each pair by its edit distance inside the join, so that only near pairs come out
of it. Pairs found under several signatures count once.

A word's form is its near word of largest n (ties: smallest in code-point order) if that n is ten times its own or
more. Forms gain a factor of ten with each step, so following them ends after eighteen at most; pointers are doubled.

Null and empty texts have no words; null ids count as an empty one where a word is altered by id. Texts of any length
are read in pieces. Repeated rows count each. Words of any length are compared whole. An empty table gives no rows.
Extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmill.lineage import cut_lineage
from riskmill.llm.common import small_side

RUN = "A-Za-zÀ-ÿ"
SHORTEST = 7
LEAST_COUNT = 2
FACTOR = 10
# Parts for distance two (one length) and for distance one (lengths apart by one).
PARTS_TWO, PARTS_ONE = 4, 2
KEPT_WORDS = 200_000
TEXT_AT_ONCE = 1 << 20
WORDS_AT_ONCE = 1 << 14

Alter = Callable[[bytes, str], str]


def drop_one_of_31(prefix: bytes, word: str) -> str:
    """The word without its code point crc32 % length if 31 divides the crc32 of prefix and word."""
    digest = zlib.crc32(word.encode(), zlib.crc32(prefix))
    if digest % 31:
        return word
    at = digest % len(word)
    return word[:at] + word[at + 1:]


class _Counts:
    """Counts per task, sent on whenever the distinct words are many."""

    def __init__(self, alter: Alter | None, shortest: int):
        self.alter, self.shortest = alter, shortest

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Words that are too short before an alteration are too short after it.
        runs = re.compile(f"[{RUN}]{{{self.shortest},}}")
        total: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                found: Counter[str] = Counter()
                lower = text.encode().lower().decode()  # bytes: A-Z only
                if len(lower) <= TEXT_AT_ONCE:
                    found.update(runs.findall(lower))
                else:
                    found.update(match.group() for match in runs.finditer(lower))
                if self.alter is None:
                    total.update(found)
                else:
                    doc_id = doc_id.as_py()
                    prefix = f"{'' if doc_id is None else doc_id}:".encode()
                    for word, n in found.items():
                        total[self.alter(prefix, word)] += n
                if len(total) > KEPT_WORDS:
                    yield self._rows(total)
                    total = Counter()
        yield self._rows(total)

    def _rows(self, total: Counter) -> pa.RecordBatch:
        kept = [(w, n) for w, n in total.items() if len(w) >= self.shortest]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()),
                                           pa.array([n for _, n in kept], pa.int64())], ["word", "n"])


def word_counts(docs: DataFrame, alter: Alter | None = None, shortest: int = SHORTEST, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the letter runs in all texts, with A-Z in lower case; ``alter`` may change a word by its doc_id."""
    parts = docs.select("doc_id", "text").mapInArrow(_Counts(alter, shortest), "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers over all bits."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return values ^ (values >> np.uint64(31))


def signatures(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of distinct words, one row a word: for words of one length, as the shorter and as the longer of a pair."""
    sizes = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(points)) - starts[owner]
    order = np.lexsort((points, owner))
    letters = points[order]
    begins = np.ones(len(letters), bool)
    begins[1:] = (letters[1:] != letters[:-1]) | (owner[1:] != owner[:-1])
    first = np.maximum.accumulate(np.where(begins, np.arange(len(letters)), 0))
    earlier = (np.arange(len(letters)) - first).astype(np.uint64)
    dimension = mixed((letters << np.uint64(32)) + earlier + np.uint64(1))

    def summed(values: np.ndarray, where: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.where(where, values, np.uint64(0)), starts)

    def chosen(parts: int, left_out: int) -> list[np.ndarray]:
        part = (dimension >> np.uint64(48)) % np.uint64(parts)
        sums = [summed(dimension, part == p) for p in range(parts)]
        keys = []
        for choice in combinations(range(parts), parts - left_out):
            key = np.full(len(words), parts << 8, np.uint64)
            for p in choice:
                key = mixed(key + np.uint64(p + 1) + sums[p])
            keys.append(key)
        return keys

    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([[1], np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64)]).astype(np.uint64))
        forward = mixed(points) * powers[at]
        backward = mixed(points) * powers[sizes[owner] - 1 - at]

        def halves(shorter: np.ndarray) -> list[np.ndarray]:
            """Hashes of both halves that a shorter word of this length would share."""
            head = shorter // 2
            tail = shorter - head
            extra = shorter.astype(np.uint64)
            return [mixed(summed(forward, at < head[owner]) + extra),
                    mixed(summed(backward, at >= (sizes - tail)[owner]) + extra * np.uint64(3) + np.uint64(1))]

        def joined(keys: list[np.ndarray], shorter: np.ndarray) -> np.ndarray:
            return np.stack([mixed(k ^ h) for k in keys for h in halves(shorter)], axis=1).view(np.int64)

        one = chosen(PARTS_ONE, 1)
        return joined(chosen(PARTS_TWO, 2), sizes), joined(one, sizes), joined(one, sizes - 1)


def _signature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, WORDS_AT_ONCE):
            some = batch.slice(at, WORDS_AT_ONCE)
            keys = []
            for table in signatures(some.column(0).to_pylist()):
                offsets = np.arange(0, table.size + 1, table.shape[1], dtype=np.int32)
                keys.append(pa.ListArray.from_arrays(offsets, np.ascontiguousarray(table).ravel()))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *keys], ["word", "n", "same", "short", "long"])


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n) for words one edit apart, once or more for each pair, in one direction."""
    filed = cut_lineage(words.select("word", "n").mapInArrow(
        _signature_rows, "word string, n bigint, same array<bigint>, short array<bigint>, long array<bigint>"))

    def side(keys: str, name: str, count: str) -> DataFrame:
        return filed.select(F.explode(keys).alias("key"), F.col("word").alias(name), F.col("n").alias(count))
    near = F.levenshtein("word", "near", 1) == 1
    equal = side("same", "word", "n").alias("a").join(
        side("same", "near", "near_n").alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("word") < F.col("near")) & near)
    unequal = side("short", "word", "n").alias("a").join(
        side("long", "near", "near_n").alias("b"), (F.col("a.key") == F.col("b.key")) & near)
    names = ["word", "n", "near", "near_n"]
    return equal.select(*names).unionByName(unequal.select(*names))


def followed(links: DataFrame) -> DataFrame:
    """(word, root) for stored links (word, form) without cycles: pointers are doubled until none moves."""
    ends = cut_lineage(links.select("word", F.col("form").alias("root")))
    while True:
        further = small_side(ends.join(ends.select(F.col("root").alias("via")).distinct(), F.col("word") == F.col("via"), "left_semi")
                             .select(F.col("word").alias("via"), F.col("root").alias("next")))
        moved = cut_lineage(ends.join(further, F.col("root") == F.col("via"), "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.isnotnull("next").alias("moving")))
        if moved.where("moving").isEmpty():
            return ends
        ends = moved.select("word", "root")


def spelling_groups(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """Each of the distinct words (word, n) with n_near, form, form_n and root."""
    words = cut_lineage(words)
    pairs = cut_lineage(near_pairs(words))
    both = pairs.select("word", "near", "near_n").unionByName(
        pairs.select(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    # Dealt by word once: equal pairs and equal words then lie together, and neither grouping moves rows again.
    single = both.repartition("word").groupBy("word", "near").agg(F.first("near_n").alias("near_n"))
    best = single.groupBy("word").agg(F.count("*").alias("n_near"),
                                      F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    larger = -F.col("best.less") >= F.col("n") * factor
    told = cut_lineage(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(larger, F.col("best.near")).alias("form"), F.when(larger, -F.col("best.less")).alias("form_n")))
    roots = followed(told.where("form is not null"))
    return told.where("form is null").withColumn("root", F.col("word")).unionByName(
        told.where("form is not null").join(roots, "word"))
