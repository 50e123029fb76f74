"""Exact deduplication: 128-bit content hash, smallest id kept, bytes compared inside every group. DataFrame only.

Texts are equal when they are identical after each run of white space became one space; a null text is an empty one.

* The bytes are compared by grouping on (hash, text): copies combine before the shuffle, so a text that fills a third
  of the table sends one row per task. Texts that share a hash without being equal become different groups.
* Rows find their group by the hash alone. Only where a hash turned out to belong to several texts, which a 128-bit
  hash practically never does, rows are matched by the text as well.
* Ids: null ids count as larger than any other. Rows that repeat id and text are one document several times over:
  one of them is kept. An empty table gives an empty result; further columns are ignored or carried along untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmill.lineage import cut_lineage
from riskmill.llm.common import SPACE, match, repeat_rows, small_side, whole_text


def normal_text(column: str = "text") -> Column:
    return F.regexp_replace(whole_text(column), SPACE, " ")


def content_hash(text: Column) -> Column:
    """128 bits of the text."""
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    keyed = _keyed(docs, hash_of)
    texts = keyed.groupBy("content", "normal").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = _groups(texts)
    rows = keyed.select("doc_id", "content", "normal", F.sha2("normal", 256).alias("text_sha256"))
    found = _members(rows, "text_sha256").join(groups.where("n_texts = 1").drop("n_texts"), "content")
    shared = groups.where("n_texts > 1").select("content")
    if not shared.isEmpty():
        clashing = _members(rows.join(shared, "content", "left_semi"), "text_sha256", "normal") \
            .join(texts, ["content", "normal"])
        found = found.unionByName(clashing.drop("normal"))
    return repeat_rows(found, "copies", "copy").select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 0)).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The documents with each text once, under its smallest id, with the columns they came with.

    Rows that repeat id and text but differ in another column leave the smallest of them in column order.
    """
    keyed = _keyed(docs, hash_of)
    texts = keyed.groupBy("content", "normal").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = _groups(texts)
    shared = groups.where("n_texts > 1").select("content")
    clash = not shared.isEmpty()
    names = ["doc_id", "content", *(["normal"] if clash else [])]
    kept = texts if clash else groups
    # Only what goes is looked up: ids that are not the smallest of their text, and ids that hold a text twice.
    members = _members(keyed, *names[2:]).join(kept, names[1:])
    leaving = cut_lineage(members.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(*names))
    twice = cut_lineage(members.where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copies") > 1)).select(*names))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select(
        "row", F.col("row.doc_id").alias("doc_id"), normal_text("row.text").alias("normal")) \
        .withColumn("content", hash_of(F.col("normal"))).select("row", *names)
    staying = _without(rows, leaving, names)
    if not twice.isEmpty():
        again = _with(staying, twice, names).groupBy(*names).agg(F.min("row").alias("row"))
        staying = _without(staying, twice, names).select("row").unionByName(again.select("row"))
    return staying.select("row.*")


def _keyed(docs: DataFrame, hash_of: Callable[[Column], Column]) -> DataFrame:
    return docs.select("doc_id", normal_text().alias("normal")).withColumn("content", hash_of(F.col("normal")))


def _groups(texts: DataFrame) -> DataFrame:
    """Per hash: how many texts have it, and the figures of its text; written, as it is read by several plans."""
    return cut_lineage(texts.groupBy("content").agg(
        F.count("*").alias("n_texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")))


def _members(rows: DataFrame, *more: str) -> DataFrame:
    """Rows that repeat id and text as one row with their number."""
    return rows.groupBy("doc_id", "content", *more).agg(F.count("*").alias("copies"))


def _without(rows: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    return match(rows, small_side(keys) if "normal" not in names else keys, names, "left_anti")


def _with(rows: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    return match(rows, small_side(keys) if "normal" not in names else keys, names, "left_semi")
