from __future__ import annotations

import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside; tables may have columns of these names.
CLASHING = "row string, content string, size string, tag string, copies string, n_tokens string, score string, _row string"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table from (doc_id, text, source) with further columns whose names clash."""
    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t), *(["x"] * 8)) for i, t, s in rows]
        return spark.createDataFrame(full, f"{DOCUMENT}, {CLASHING}")
    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, null ids and sources, a long text, ties and repeated rows."""
    long = " ".join(f"word{i % 997}" for i in range(60_000))
    return [(1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, "one", "b"), (5, "one two", "b"), (6, long, "c"),
            (7, "same text here", "a"), (8, "same  text\there", None), (8, "same  text\there", None),
            (None, "same text here", "b"), (None, None, None), (9, "Ünï çödé ▁ mark 漢字 \U0001f600", "é")]
