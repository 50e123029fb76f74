"""SimHash near-deduplication: bit-sliced comparison inside candidate blocks.

Fingerprints: 64 bits, each the majority of that bit in the XXH64 hashes of all 3-word shingles, repeats included.

Candidates: two fingerprints within 3 bits agree on at least two of five bit ranges, so each one is filed under ten
keys of two ranges (25 or 26 bits). Only distinct fingerprints are filed, whatever the number of documents behind them.

Comparison: the fingerprints of whole blocks lie in 64 bit planes, one integer a plane, one lane a fingerprint. A block
is compared with itself moved by 1, 2, ... lanes: a plane XOR itself moved gives one distance bit of all lanes at
once, which carry-save counters of two bits add up; they start so that the carry out of the top one says "over 3". The
planes that are left are skipped once all lanes are over, and further moves once every group hangs together.

Groups: each task links its lanes with as few pairs as hold them together, never all pairs. Star contraction joins
these links across tasks. A key with more than ``BLOCK`` fingerprints is dealt to blocks by hash, and each pair of
blocks becomes a group of its own, so that no task holds more than a block.

A null text is an empty one. Texts without words have the fingerprint 0 and are linked like any other; texts of one or
two words have one shingle, the whole sequence. Null ids count as larger than any other; a component of null ids only
has a null id. Rows that repeat an id are documents of their own. Texts of any length are read whole, their shingles hashed
in slices. Further columns are left alone. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from riskmill.lineage import cut_lineage
from riskmill.llm.common import match, small_side, whole_text
from riskmill.operators.graph import connected_components

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
BLOCK = 4096
LANES = 16384
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: str) -> bytes:
    """Eight bytes, the highest bit first. Splitting bytes at white space is exactly [\\x20\\x09-\\x0D]+."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(8)
    ones, total = np.zeros(BITS, np.int64), 0
    if len(words) < SHINGLE:
        words = [b" ".join(words)]
        parts: Iterable = [iter(words)]
    else:
        parts = (map(b" ".join, zip(*(words[at + k:at + k + SHINGLES_AT_ONCE] for k in range(SHINGLE - 1)),
                                    words[at + SHINGLE - 1:at + SHINGLE - 1 + SHINGLES_AT_ONCE]))
                 for at in range(0, len(words) - SHINGLE + 1, SHINGLES_AT_ONCE))
    for part in parts:
        hashes = np.frombuffer(b"".join([xxhash.xxh64_digest(s, SEED) for s in part]), np.uint8)
        ones += np.unpackbits(hashes.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        total += len(hashes) // 8
    return np.packbits(2 * ones > total).tobytes()


@pandas_udf(T.LongType())
def fingerprints_of(texts: pd.Series) -> pd.Series:
    return pd.Series(np.frombuffer(b"".join([fingerprint(t) for t in texts]), ">i8").astype(np.int64))


def fingerprint_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fingerprint as a signed 64-bit number) of every row."""
    text = whole_text()
    return docs.select("doc_id", F.xxhash64(text).alias("text_key"), fingerprints_of(text).alias("fingerprint"))


def hex_digits(number: Column) -> Column:
    return F.lower(F.lpad(F.hex(number), 16, "0"))


def block_keys(number: Column, radius: int = RADIUS) -> list[Column]:
    """Each choice of two out of radius + 2 bit ranges, with the number of the choice in front."""
    ranges = radius + 2
    edges = [round(k * BITS / ranges) for k in range(ranges + 1)]
    keys = []
    for choice, (first, second) in enumerate(combinations(range(ranges), 2)):
        part = [F.shiftrightunsigned(number, edges[r]).bitwiseAND(F.lit((1 << (edges[r + 1] - edges[r])) - 1))
                for r in (first, second)]
        width = edges[second + 1] - edges[second]
        keys.append(F.shiftleft(F.lit(choice).cast("bigint"), 48) + F.shiftleft(part[0], width) + part[1])
    return keys


def links(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints within the radius, enough of them to hold each component together."""
    keyed = prints.select("fingerprint", F.explode(F.array(*block_keys(F.col("fingerprint"), radius))).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") * 2 / block)
    own = F.pmod(F.xxhash64("fingerprint", F.lit(1)), F.col("blocks"))
    met = keyed.join(shared, "key").withColumn("blocks", F.when(F.col("n") > block, blocks).otherwise(1)) \
        .withColumn("own", own) \
        .withColumn("other", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("bigint")))
                                       .otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))) \
        .where("blocks = 1 or own <> other") \
        .select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fingerprint")
    dealt = met.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "fingerprint")
    return dealt.mapInPandas(_Linker(radius), "a bigint, b bigint")


class _Linker:
    """Cuts sorted rows at group borders into slabs of lanes; what a slab's last group lacks is in the next batch."""

    def __init__(self, radius: int):
        self.radius = radius

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        held = 0
        for batch in batches:
            waiting.append(batch)
            held += len(batch)
            if held < LANES:
                continue
            rows = pd.concat(waiting, ignore_index=True)
            starts = self._starts(rows)
            done = int(starts[-1])
            yield from self._slabs(rows.iloc[:done])
            waiting, held = [rows.iloc[done:]], len(rows) - done
        if held:
            yield from self._slabs(pd.concat(waiting, ignore_index=True))

    @staticmethod
    def _starts(rows: pd.DataFrame) -> np.ndarray:
        keys = rows[["key", "low", "high"]].to_numpy()
        return np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) if len(rows) else np.zeros(1, int)

    def _slabs(self, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(rows):
            return
        starts = self._starts(rows)
        groups = np.zeros(len(rows), np.int64)
        groups[starts[1:]] = 1
        groups = groups.cumsum()
        prints = rows["fingerprint"].to_numpy(np.int64)
        ends, at = np.append(starts[1:], len(rows)), 0
        while at < len(rows):
            fit = np.searchsorted(ends, at + LANES, "right")
            end = int(ends[fit - 1]) if fit and ends[fit - 1] > at else int(ends[np.searchsorted(ends, at, "right")])
            a, b = linked_lanes(prints[at:end], groups[at:end], self.radius)
            yield pd.DataFrame({"a": prints[at:end][a], "b": prints[at:end][b]})
            at = end


def _as_integer(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def linked_lanes(prints: np.ndarray, groups: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Lanes to join: two lists, enough pairs within the radius to connect whatever is connected inside a group.

    ``groups`` numbers the group of each lane in ascending order.
    """
    lanes = len(prints)
    bits = np.unpackbits(prints.astype(">i8").view(np.uint8).reshape(lanes, 8), axis=1)
    planes = [_as_integer(bits[:, k]) for k in range(BITS)]
    digits = radius.bit_length()
    everywhere = (1 << lanes) - 1
    spare = (1 << digits) - 1 - radius
    label = np.arange(lanes)
    pieces, whole = lanes, len(np.unique(groups))
    left: list[int] = []
    right: list[int] = []
    for move in range(1, lanes):
        near = _as_integer(groups[move:] == groups[:-move])
        if not near or pieces == whole:
            break
        # Counters start at what makes the top one carry at radius + 1.
        counters = [everywhere if spare >> d & 1 else 0 for d in range(digits)]
        for plane in planes:
            carry = plane ^ (plane >> move)
            for d in range(digits):
                counters[d], carry = counters[d] ^ carry, counters[d] & carry
            near &= ~carry
            if not near:
                break
        else:
            packed = np.frombuffer(near.to_bytes((lanes + 7) // 8, "little"), np.uint8)
            a = np.flatnonzero(np.unpackbits(packed, bitorder="little"))
            a = a[label[a] != label[a + move]]
            joined = _join(label, a, a + move)
            left += a[joined].tolist()
            right += (a[joined] + move).tolist()
            pieces -= len(joined)
    return left, right


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Merges the labels of the pairs in place; the positions of the pairs that merged two pieces."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    used = []
    for k, (x, y) in enumerate(zip(label[a].tolist(), label[b].tolist())):
        x, y = top(x), top(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            used.append(k)
    if used:
        old = np.array(sorted(parent))
        label[:] = _renamed(label, old, np.array([top(int(x)) for x in old]))
    return used


def _renamed(label: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(old, label), len(old) - 1)
    return np.where(old[at] == label, new[at], label)


def near_groups(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(fingerprint, component_id) for stored rows of ``fingerprint_rows``: the smallest id of its component."""
    distinct = cut_lineage(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")))
    found = connected_components(cut_lineage(links(distinct, radius, block)), "a", "b")
    named = distinct.join(found, F.col("fingerprint") == F.col("node"), "left") \
        .select("fingerprint", "first_id", F.coalesce("component", "fingerprint").alias("component"))
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return cut_lineage(named.join(smallest, "component").select("fingerprint", "component", "component_id"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    prints = cut_lineage(fingerprint_rows(docs))
    return prints.join(near_groups(prints, radius, block), "fingerprint").select(
        "doc_id", hex_digits(F.col("fingerprint")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """The documents without near copies: of each component the row with the smallest id, then text key, stays.

    Rows that repeat both id and text are one document and stay or go together.
    """
    prints = cut_lineage(fingerprint_rows(docs))
    placed = prints.join(near_groups(prints, radius, block), "fingerprint").select(
        "component", F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "text_key").alias("row"))
    first = placed.groupBy("component").agg(F.min("row").alias("first"))
    leaving = cut_lineage(placed.join(first, "component").where("row <> first").select("row.doc_id", "row.text_key").distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select(
        "row", F.col("row.doc_id").alias("doc_id"), F.xxhash64(whole_text("row.text")).alias("text_key"))
    return match(rows, small_side(leaving), ["doc_id", "text_key"], "left_anti").select("row.*")
