"""Seeded, engine-independent pseudo-random order keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(seed: int, row_id: Column | str) -> Column:
    """Hex digest of ``seed-row_id``; sorting by it is a repeatable shuffle of the rows."""
    key = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.md5(F.concat(F.lit(f"{seed}-"), key.cast("string")))


def hash_bucket(digest: Column, hex_digits: int = 5) -> Column:
    """Leading digits of the digest as a number; increasing buckets follow the digest's own order."""
    return F.conv(F.substring(digest, 1, hex_digits), 16, 10).cast("bigint")
