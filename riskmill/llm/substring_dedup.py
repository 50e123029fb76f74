"""Substring deduplication by content-defined chunking.

A text is read as its words with single spaces. A gear hash rolls over the bytes (each byte shifts it left and adds
its entry of a table; 16 bits, so it knows the last 16 bytes), and a word is followed by a cut when the top
``CUT_BITS`` bits of the hash at its end are zero. Cuts depend on nothing before those 16 bytes: inserting or deleting
text moves no other cut. A few words repeated over and over show the hash the same bytes, so it may cut nowhere: where
``CHUNK_WORDS`` words or more repeat the 1 to ``PERIODS`` words before them, cuts are made at the first and every
``CHUNK_WORDS`` words from there, which depends on the repeats alone. Where no cut comes for ``LONGEST`` words otherwise, one
is made.

A chunk starts at every cut and ends at the first cut that is ``CHUNK_WORDS`` words or more away, so that chunks overlap
and each is long enough to mean something: a short one would recur by chance in a large corpus. Chunks with equal
64-bit digests in different documents repeat. Repeated chunks that follow each other in a document become one run, and
runs of at least ``LEAST_WORDS`` words are reported with the smallest document that holds some of it. A repeated
passage loses the words before its first cut and after its last; of passages of 51 words one in a hundred is missed
for that, of longer ones far fewer.

Digests are counted with map-side combination and joined with the chunks from a stored table, so that a chunk that is
in a third of all documents is one row on one side and split by adaptive execution on the other.

Rows with the same id are one document. A null id counts as larger than any other. Null and empty texts have no
chunks and are in no result. Rows that repeat id and text report each span once. Further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from riskmill.lineage import cut_lineage
from riskmill.llm.common import match, whole_text

CUT_BITS = 2
LONGEST = 64
CHUNK_WORDS = 16
LEAST_WORDS = 24
PERIODS = 4
NO_ID = (1 << 63) - 1
GEAR = np.random.default_rng(2).integers(0, 1 << 16, 256).astype(np.uint16)
SPACE = 0x20


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: doubling spans of 1, 2, 4, 8 bytes give all 16 shifts at once."""
    state = GEAR[data]
    for span in (1, 2, 4, 8):
        moved = np.zeros_like(state)
        moved[span:] = state[:-span] << np.uint16(span)
        state = state + moved
    return state


def repeat_cuts(words: list[bytes]) -> list[np.ndarray]:
    """Cuts where words repeat those 1 to ``PERIODS`` before them, counted from the first of the repeated words."""
    if len(words) <= CHUNK_WORDS:
        return []
    known = np.fromiter(map(hash, words), np.int64, len(words))
    found = []
    for period in range(1, PERIODS + 1):
        again = np.concatenate([[False], known[period:] == known[:-period], [False]])
        edges = np.flatnonzero(again[1:] != again[:-1])
        starts, ends = edges[::2], edges[1::2] + period
        for start, end in zip(starts, ends):
            if end - start >= CHUNK_WORDS:
                found.append(np.arange(start, end, CHUNK_WORDS))
    return found


def chunks(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words, numbers of words and signed digests of the chunks of a whole text."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    state = rolling_hash(np.frombuffer(joined, np.uint8))[ends - 1]
    cut = np.flatnonzero(state >> np.uint16(16 - CUT_BITS) == 0) + 1
    borders = np.unique(np.concatenate([[0], cut, *repeat_cuts(words), [len(words)]]))
    sizes = np.diff(borders)
    if len(sizes) and sizes.max() > LONGEST:
        extra = [np.arange(start + LONGEST, start + size, LONGEST) for start, size in zip(borders, sizes) if size > LONGEST]
        borders = np.unique(np.concatenate([borders, *extra]))
    last = np.searchsorted(borders, borders + CHUNK_WORDS)
    first = borders[last < len(borders)]
    until = borders[last[last < len(borders)]]
    edges = np.concatenate([[0], ends + 1])
    digest = xxhash.xxh3_64_intdigest
    hashes = [digest(joined[a:b - 1]) for a, b in zip(edges[first].tolist(), edges[until].tolist())]
    return first, until - first, np.array(hashes, np.uint64).view(np.int64)


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        parts = [chunks(t) for t in batch.column(2).to_pylist()]
        many = np.array([len(p[0]) for p in parts], np.int64)
        if not many.sum():
            continue
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(keys, many)), pa.array(np.repeat(tags, many)),
            pa.array(np.concatenate([np.arange(n) for n in many]).astype(np.int32)),
            pa.array(np.concatenate([p[0] for p in parts]).astype(np.int32)),
            pa.array(np.concatenate([p[1] for p in parts]).astype(np.int32)),
            pa.array(np.concatenate([p[2] for p in parts if len(p[0])]).astype(np.int64))],
            names=["doc_key", "tag", "chunk", "first_word", "n_words", "digest"])


def chunk_table(docs: DataFrame) -> DataFrame:
    """One row per chunk: doc_key (the id), tag (of the text), chunk number, first word, words, digest."""
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_key"), F.hash(whole_text()).alias("tag"),
                       whole_text().alias("text")) \
        .mapInArrow(_chunk_rows, "doc_key bigint, tag int, chunk int, first_word int, n_words int, digest bigint")


def repeated_spans(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, first_word, n_words, first_doc_id (smallest document with the passage), copies (documents' chunks alike)."""
    table = chunk_table(docs)
    counts = table.groupBy("digest").agg(F.min("doc_key").alias("first_doc"), F.max("doc_key").alias("last_doc"),
                                         F.count("*").alias("copies"))
    repeated = cut_lineage(counts.where("first_doc <> last_doc").drop("last_doc"))
    found = table.join(repeated, "digest")
    order = Window.partitionBy("doc_key", "tag").orderBy("chunk")
    runs = found.withColumn("run", F.col("chunk") - F.dense_rank().over(order))
    spans = runs.groupBy("doc_key", "tag", "run").agg(
        F.min("first_word").alias("first_word"), F.max(F.col("first_word") + F.col("n_words")).alias("last_word"),
        F.min("first_doc").alias("first_doc"), F.max("copies").alias("copies"))
    return spans.withColumn("n_words", F.col("last_word") - F.col("first_word")).where(F.col("n_words") >= least_words) \
        .select(_id("doc_key").alias("doc_id"), F.col("first_word").cast("bigint").alias("first_word"),
                F.col("n_words").cast("bigint").alias("n_words"), _id("first_doc").alias("first_doc_id"), "copies", "tag")


def _id(key: str) -> Column:
    return F.when(F.col(key) != NO_ID, F.col(key))


@pandas_udf(T.StringType())
def _cut_out(texts: pd.Series, spans: pd.Series) -> pd.Series:
    import re

    word = re.compile(r"[^\x20\x09-\x0d]+")
    out = []
    for text, cuts in zip(texts, spans):
        if cuts is None or not len(cuts):
            out.append(text)
            continue
        borders = [m.span() for m in word.finditer(text)]
        at, kept = 0, []
        for cut in sorted((c["first_word"], c["n_words"]) for c in cuts):
            kept.append(text[at:borders[cut[0]][0]])
            last = cut[0] + cut[1]
            at = borders[last][0] if last < len(borders) else len(text)
        out.append("".join(kept) + text[at:])
    return pd.Series(out, dtype="object")


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents with each repeated passage left in its smallest document only; all columns stay."""
    spans = repeated_spans(docs, least_words).where(~F.col("doc_id").eqNullSafe(F.col("first_doc_id")))
    cuts = spans.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("first_word", "n_words")).alias("cuts"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select(
        "row", F.col("row.doc_id").alias("doc_id"), F.hash(whole_text("row.text")).alias("tag"))
    met = match(rows, cuts, ["doc_id", "tag"], "left")
    text = F.when(F.col("cuts").isNull(), F.col("row.text")).otherwise(_cut_out(whole_text("row.text"), F.col("cuts")))
    return met.select(F.col("row").withField("text", text).alias("row")).select("row.*")
