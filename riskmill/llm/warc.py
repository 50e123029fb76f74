"""WARC archives: written with segmented, chunk-framed records, and read back by segment reassembly.

Writing. Of records with equal payloads of at least ``LEAST_REVISIT`` bytes, the one with the smallest page id is a
response and the others revisit it. A response's block is an HTTP head and the payload in chunked transfer framing; a
block of more than ``SEGMENT_BYTES`` is cut into a response record and continuation records. Records are packed into
archives of about ``ARCHIVE_BYTES``, each one row of Spark's text writer (which adds the blank lines after the last
record), compressed, in any file system that Spark writes. A record that crosses the size goes to the next archive, so
continuations may lie in other archives than their origin.

Reading. Each archive is one bounded row; records are told apart by their Content-Length alone. Whole responses are
decoded where they are read. Segments are grouped by the id of their origin, put in order of their segment number,
and the sum of their lengths is held against the total length in the last one; then the chunk framing is decoded.
Only segments are shuffled, and a group holds one page. A missing or surplus segment, a wrong length and a digest that
does not fit are reported in ``intact``, with what could be decoded.

Null payloads are empty, null urls leave out the target uri, and control characters and spaces in a url are
percent-encoded. A null page id counts as larger than any other, and each row with one has a
record id of its own, so that no two share their segments. Very long payloads are cut into segments. Rows that repeat id and payload are one page several
times: all are responses when they are the smallest, and reading returns as many. Further columns are not archived.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmill.lineage import cut_lineage, ensure_checkpoint_dir
from riskmill.llm.common import small_side

LEAST_REVISIT = 100
CHUNK_BYTES = 4096
SEGMENT_BYTES = 16384
ARCHIVE_BYTES = 8 << 20
CAPTURED = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARSED = ("record_type string, record_id string, refers_to string, uri string, digest string, segment int, "
          "total_length bigint, origin string, block binary, payload binary, intact boolean")


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, record_type, refers_to_page: which page is a response and which revisits it."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload")) \
        .withColumn("digest", F.sha2("payload", 256))
    shared = cut_lineage(rows.where(F.length("payload") >= LEAST_REVISIT).groupBy("digest").agg(
        F.min("page_id").alias("first_page"), F.count("*").alias("n")).where("n > 1").drop("n"))
    met = rows.join(small_side(shared.withColumn("shared", F.lit(True))), "digest", "left")
    again = F.coalesce("shared", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    return met.select("page_id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"),
                      F.when(again, F.col("first_page")).alias("refers_to_page"))


def record_id(page_id: int | None, digest: str, unnamed: int | None = None) -> str:
    """``unnamed`` tells rows without a page id apart; nothing refers to those."""
    return f"<urn:page:{f'n{unnamed}' if page_id is None else page_id}:{digest[:32]}>"


def framed(payload: bytes) -> bytes:
    """Chunked transfer framing, closed by an empty chunk."""
    parts = [payload[at:at + CHUNK_BYTES] for at in range(0, len(payload), CHUNK_BYTES)]
    return b"".join([b"%x\r\n%b\r\n" % (len(part), part) for part in parts]) + b"0\r\n\r\n"


def unframed(body: bytes) -> tuple[bytes, bool]:
    """The payload of chunked framing, and whether the framing was whole."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = re.fullmatch(rb"\s*([0-9A-Fa-f]+)\s*(?:;.*)?", body[at:end], re.S) if end >= 0 else None
        if size is None:
            return b"".join(out), False
        length, at = int(size[1], 16), end + 2
        if not length:
            return b"".join(out), True
        out.append(body[at:at + length])
        if body[at + length:at + length + 2] != b"\r\n":
            return b"".join(out), False
        at += length + 2


def _record(kind: str, name: str, block: bytes, *more: str) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {CAPTURED}", *more,
             f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block


def records_of(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, first: int | None,
               unnamed: int | None = None) -> Iterator[bytes]:
    """The records of one page, without the blank lines after them."""
    name = record_id(page_id, digest, unnamed)
    about = [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        about.insert(0, "WARC-Target-URI: " + re.sub(
            r"[\x00-\x20\x7f-\x9f  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url))
    if kind == "revisit":
        yield _record(kind, name, HEAD, *about, f"WARC-Refers-To: {record_id(first, digest)}", f"WARC-Profile: {PROFILE}")
        return
    block = HEAD + framed(payload)
    if len(block) <= SEGMENT_BYTES:
        yield _record(kind, name, block, *about)
        return
    parts = [block[at:at + SEGMENT_BYTES] for at in range(0, len(block), SEGMENT_BYTES)]
    yield _record(kind, name, parts[0], *about, "WARC-Segment-Number: 1")
    for number, part in enumerate(parts[1:], 2):
        last = [f"WARC-Segment-Total-Length: {len(block)}"] if number == len(parts) else []
        yield _record("continuation", f"{name[:-1]}:{number}>", part, f"WARC-Segment-Origin-ID: {name}",
                      f"WARC-Segment-Number: {number}", *last)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row an archive."""
    waiting: list[bytes] = []
    held = 0
    for batch in batches:
        for row in zip(*[column.to_pylist() for column in batch.columns]):
            for record in records_of(*row):
                waiting.append(record)
                held += len(record)
                if held >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([END.join(waiting)], pa.binary())], ["archive"])
                    waiting, held = [], 0
    if waiting:
        yield pa.RecordBatch.from_arrays([pa.array([END.join(waiting)], pa.binary())], ["archive"])


def write_archives(pages: DataFrame, path: str) -> None:
    """Archives under ``path``, a folder that all executors share and that does not exist yet."""
    unnamed = F.when(F.isnull("page_id"), F.monotonically_increasing_id())
    packed = plan_records(pages).withColumn("unnamed", unnamed).mapInArrow(_pack, "archive binary")
    packed.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", END.decode()) \
        .option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def new_folder(spark: SparkSession) -> str:
    """A path for archives next to the session's checkpoints."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4()}"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive, compressed as a whole, record by record, or not at all."""
    if data[:2] == b"\x1f\x8b":
        parts = []
        while data[:2] == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            parts.append(member.decompress(data) + member.flush())
            data = member.unused_data
        data = b"".join(parts)
    at = 0
    while (start := data.find(b"WARC/1.", at)) >= 0:
        end = data.find(END, start)
        if end < 0:
            return
        headers = {}
        for line in data[start:end].decode("utf-8", "replace").split("\r\n")[1:]:
            key, _, value = line.partition(":")
            headers[key.strip().lower()] = value.strip()
        at = end + len(END) + int(headers.get("content-length", 0))
        yield headers, data[end + len(END):at]


def decoded(block: bytes, digest: str | None) -> tuple[bytes, bool]:
    """The payload of an HTTP block, and whether framing and digest fit."""
    head, _, body = block.partition(END)
    whole = True
    if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r", b"")):
        body, whole = unframed(body)
    return body, whole and (digest is None or hashlib.sha256(body).hexdigest() == digest.removeprefix("sha256:"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in PARSED.split(", ")]
    kinds = [pa.string()] * 5 + [pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.bool_()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for batch in batches:
        for data in batch.column(0):
            rows, held = [], 0
            for headers, block in parse(data.as_py()):
                get, payload, intact = headers.get, None, None
                kind, segment = get("warc-type"), get("warc-segment-number")
                digest, total = get("warc-payload-digest"), get("warc-segment-total-length")
                if kind == "response" and segment is None:
                    payload, intact = decoded(block, digest)
                origin = get("warc-segment-origin-id") or (get("warc-record-id") if segment else None)
                rows.append((kind, get("warc-record-id"), get("warc-refers-to"), get("warc-target-uri"), digest,
                             segment and int(segment), total and int(total), origin, block if segment else None, payload, intact))
                held += len(block)
                if held >= ARCHIVE_BYTES // 4:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)


def _assemble(parts: pd.DataFrame) -> pd.DataFrame:
    """The segments of one origin as one row, as often as its first segment occurs."""
    first = parts[parts["segment"] == 1]
    ordered = parts.drop_duplicates("segment").sort_values("segment")
    block = b"".join(ordered["block"])
    totals = ordered["total_length"].dropna()
    gapless = ordered["segment"].tolist() == list(range(1, len(ordered) + 1))
    digest = first["digest"].iloc[0] if len(first) else None
    payload, fits = decoded(block, digest)
    whole = bool(len(first) and gapless and len(totals) == 1 and int(totals.iloc[0]) == len(block) and fits)
    one = {"record_type": "response", "record_id": parts["origin"].iloc[0], "refers_to": None,
           "uri": first["uri"].iloc[0] if len(first) else None, "digest": digest, "payload": payload, "intact": whole}
    return pd.DataFrame([one] * max(1, len(first)))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per page: record_type, record_id, refers_to, uri, digest, payload (null for revisits), intact."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    records = files.mapInArrow(_rows, PARSED)
    columns = ["record_type", "record_id", "refers_to", "uri", "digest", "payload", "intact"]
    whole = records.where("segment is null and record_type in ('response', 'revisit')").select(*columns)
    parts = records.where("segment is not null").select("origin", "segment", "total_length", "uri", "digest", "block")
    joined = parts.groupBy("origin").applyInPandas(
        _assemble, "record_type string, record_id string, refers_to string, uri string, digest string, payload binary, intact boolean")
    return whole.unionByName(joined)


def page_of(name: str) -> Column:
    """The page id in a record id of ``write_archives``."""
    digits = F.regexp_extract(F.col(name), "^<urn:page:(-?[0-9]+):", 1)
    return F.when(digits != "", digits).cast("bigint")


def archived_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per archived page: page_id, payload_bytes, payload_digest, record_type, refers_to, intact.

    A revisit has the length of the response that it refers to; without one its length is null and it isn't intact.
    """
    read = read_archives(spark, path).select(
        "record_type", "record_id", "refers_to", "digest", "intact", F.length("payload").cast("bigint").alias("payload_bytes"),
        F.when(F.col("payload").isNotNull(), F.sha2("payload", 256)).alias("own_digest"))
    read = cut_lineage(read)
    told = read.where("record_type = 'revisit'").select("record_id", "refers_to", F.substring_index("digest", ":", -1).alias("digest"))
    seen = cut_lineage(read.where("record_type = 'response'").groupBy("record_id").agg(
        F.max("payload_bytes").alias("payload_bytes"), F.max("own_digest").alias("own_digest"))) \
        .withColumnRenamed("record_id", "refers_to")
    revisits = told.join(seen, "refers_to", "left").select(
        page_of("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
        F.lit("revisit").alias("record_type"), page_of("refers_to").alias("refers_to"),
        F.coalesce(F.col("own_digest") == F.col("digest"), F.lit(False)).alias("intact"))
    responses = read.where("record_type = 'response'").select(
        page_of("record_id").alias("page_id"), "payload_bytes", F.col("own_digest").alias("payload_digest"),
        "record_type", F.lit(None).cast("bigint").alias("refers_to"), "intact")
    return responses.unionByName(revisits)
