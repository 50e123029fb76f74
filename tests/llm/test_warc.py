"""WARC: written archives read back, foreign archives, and damaged ones."""

from __future__ import annotations

import gzip
import hashlib
import random

import pytest

from riskmill.llm import warc


@pytest.fixture
def pages(spark):
    rng = random.Random(13)
    long = "".join(rng.choices("abc é\r\nWARC/1.1 ", k=60_000)) + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"
    rows = [(5, "http://a/", "x" * 200), (3, "http://b/ c\r\nInjected: 1", "x" * 200), (9, None, "x" * 200), (None, "http://n/", "x" * 200),
            (1, "http://s/", "short"), (2, "http://s2/", "short"), (7, "http://e/", None), (8, "http://e2/", ""), (10, "http://l/", long),
            (11, "http://l2/", long), (10, "http://l/", long), (12, "http://h/", "HTTP/1.1 200 OK\r\n\r\n0\r\n\r\n" * 30)]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, payload string, digest string")


def plain(pages):
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    out = []
    for page, payload in rows:
        alike = [i for i, p in rows if p == payload and i is not None]
        again = len(payload) >= 100 and bool(alike) and page != min(alike)
        out.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response",
                    min(alike) if again else None, True))
    return sorted(out, key=repr)


@pytest.mark.parametrize("archive_bytes", [4000, 8 << 20])
def test_pages_come_back(spark, pages, tmp_path, monkeypatch, archive_bytes):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", archive_bytes)
    folder = str(tmp_path / "archives")
    warc.write_archives(pages, folder)
    assert sorted((tuple(r) for r in warc.archived_pages(spark, folder).collect()), key=repr) == plain(pages)
    read = warc.read_archives(spark, folder)
    texts = {bytes(r.payload) for r in read.collect() if r.payload is not None}
    assert texts == {(r.html or "").encode() for r in pages.collect()}


def test_rows_without_id_keep_their_own_segments(spark, tmp_path):
    folder, text = str(tmp_path / "unnamed"), "long text " * 5000
    rows = [(None, f"http://n/{i}", text) for i in range(40)] + [(None, None, "short")] * 3
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    read = warc.read_archives(spark, folder).collect()
    assert len(read) == 43 and all(r.intact for r in read) and len({r.record_id for r in read}) == 43
    assert sorted(r.uri for r in read if len(r.payload) > 100) == sorted(f"http://n/{i}" for i in range(40))
    pages = warc.archived_pages(spark, folder).collect()
    assert [(r.page_id, r.record_type, r.refers_to) for r in pages] == [(None, "response", None)] * 43


def test_empty_table(spark, pages, tmp_path):
    folder = str(tmp_path / "none")
    warc.write_archives(pages.limit(0), folder)
    assert warc.archived_pages(spark, folder).collect() == []


def test_framing():
    for payload in (b"", b"a", b"x" * 4096, b"y" * 10_000):
        assert warc.unframed(warc.framed(payload)) == (payload, True)
    assert warc.unframed(b"3;ext=1\r\nabc\r\n0\r\n\r\n") == (b"abc", True)
    assert warc.unframed(b"5\r\nabc") == (b"abc", False)
    assert warc.unframed(b"") == (b"", False)


def test_members_compressed_one_by_one_and_other_records():
    records = [warc._record("warcinfo", "<i>", b"software: x"), *warc.records_of(1, "u", b"p" * 50_000, "d" * 64, "response", None)]
    data = b"".join(gzip.compress(r + warc.END) for r in records)
    parsed = list(warc.parse(data))
    assert [h["warc-type"] for h, _ in parsed] == ["warcinfo", "response", "continuation", "continuation", "continuation"]
    assert b"".join(block for _, block in parsed[1:]) == warc.HEAD + warc.framed(b"p" * 50_000)


def test_segments_that_are_missing_or_wrong_are_reported(spark, tmp_path):
    whole = hashlib.sha256(b"q" * 50_000).hexdigest()
    good = list(warc.records_of(1, "u", b"q" * 50_000, whole, "response", None))
    gap = [r for k, r in enumerate(warc.records_of(2, "u", b"q" * 50_000, whole, "response", None)) if k != 1]
    false = list(warc.records_of(3, "u", b"small", "0" * 64, "response", None))
    orphan = list(warc.records_of(4, "u", b"q" * 50_000, whole, "response", None))[1:]
    # Segments out of order and in two archives.
    (tmp_path / "a.warc").write_bytes(b"".join(r + warc.END for r in [good[2], *gap, good[0], *orphan]))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(r + warc.END for r in [good[3], *false, good[1]])))
    found = {warc_id.split(":")[2]: (intact, size) for warc_id, intact, size in (
        (r.record_id, r.intact, len(r.payload)) for r in warc.read_archives(spark, str(tmp_path)).collect())}
    assert found["1"] == (True, 50_000) and found["3"] == (False, 5)
    assert not found["2"][0] and not found["4"][0]
