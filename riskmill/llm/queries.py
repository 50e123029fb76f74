"""The registered query of each operator: its whole table, production parameters, the columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmill.lineage import cut_lineage
from riskmill.llm import (chat_format, exact_dedup, mixing, prefix_trie, quality, sentencepiece_codec, simhash, spelling,
                          substring_dedup, token_counts, toxicity, urls, warc)
from riskmill.llm.common import table, whole_text

TOXIC_FROM = 0.3


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per repeated passage in a document; documents without any have none."""
    return substring_dedup.repeated_spans(table(spark, sf_dir, "documents")).select(
        "doc_id", "first_word", "n_words", "first_doc_id", "copies")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = cut_lineage(quality.measures(table(spark, sf_dir, "documents")))
    return quality.judge(measured, quality.fit_trust(measured)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = toxicity.id_remainder(F.col("doc_id")) == 2
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs).select("doc_id", "n_tokens")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of each document's piece ids, and whether they decode to its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = sentencepiece_codec.encode_and_decode(docs)
    return both.select("doc_id", F.coalesce(F.size("piece_ids"), F.lit(0)).cast("bigint").alias("n_pieces"),
                       F.xxhash64("piece_ids").alias("ids_digest"), F.octet_length(whole_text()).cast("bigint").alias("n_bytes"),
                       F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "position")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.new_folder(spark)
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.archived_pages(spark, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of conversations that begin with some turns of the first conversation of their block of five."""
    own = cut_lineage(prefix_trie.token_sequences(table(spark, sf_dir, "conversations")))
    return prefix_trie.trie_nodes(with_shared_turns(own))


def with_shared_turns(own: DataFrame, block: int = 5, most: int = 9) -> DataFrame:
    """The first crc32(conv_id) % ``most`` turns are those of the block's first conversation, if there is one."""
    lead = own.where(F.col("conv_id") % block == 0).select(
        F.col("conv_id").alias("lead_id"), F.slice("tokens", 1, most).alias("lead"))
    replaced = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    rebuilt = F.concat(F.slice(F.coalesce("lead", F.array().cast("array<string>")), F.lit(1), F.col("replaced")),
                       F.slice("tokens", F.col("replaced") + 1, F.greatest(F.size("tokens") - F.col("replaced"), F.lit(0))))
    return own.join(lead, F.col("lead_id") == F.col("conv_id") - F.col("conv_id") % block, "left") \
        .withColumn("replaced", replaced).select("conv_id", rebuilt.alias("tokens"))


# Fixed value: a conversation that looks like a template and its escapes.
TRICKY = [(-7, turn, role, "\\### Assistant: </turn> ok") for turn, role in enumerate(["user", "assistant"])]


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that holds control strings, formatted and read back from ids and masks."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame(TRICKY, "conv_id bigint, turn bigint, role string, text string")
    return chat_format.read_back(chat_format.format_conversations(rows.unionByName(tricky)))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the documents, one in 31 of a document's words without one letter."""
    words = spelling.word_counts(table(spark, sf_dir, "documents"), spelling.drop_one_of_31)
    return spelling.spelling_groups(words).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_quality": op3_quality,
    "op4_urls": op4_urls,
    "op5_toxicity": op5_toxicity,
    "op6_token_counts": op6_token_counts,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_mixing": op9_mixing,
    "op10_warc": op10_warc,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_chat_format": op12_chat_format,
    "op13_spelling": op13_spelling,
}
