"""Spelling groups against all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskmill.llm import queries, spelling


def plain_words(rows):
    """Counts of altered runs for rows (doc_id, text)."""
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1:] == short for k in range(len(long)))


def plain_groups(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    forms = {}
    for w, some in near.items():
        best = min(some, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 10 * words[w] else None
    rows = []
    for w in words:
        root = w
        while forms[root] is not None:
            root = forms[root]
        rows.append((w, forms[w], root, words[w], len(near[w]), words[forms[w]] if forms[w] else None))
    return sorted(rows)


def found_rows(frame):
    return sorted(tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect())


def edited(rng, word, letters):
    at, kind = rng.randrange(len(word) + 1), rng.randrange(3)
    if kind == 0:
        return word[:at] + rng.choice(letters) + word[at:]
    at = min(at, len(word) - 1)
    return word[:at] + (rng.choice(letters) if kind == 1 else "") + word[at + 1:]


@pytest.mark.parametrize("letters, size", [("ab", 9), ("aeinrst", 8), ("abcdéïzÿ×", 13)])
def test_groups_equal_all_pairs(spark, letters, size):
    rng = random.Random(size)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(7, size))) for _ in range(60)]
    for _ in range(240):
        words.append(edited(rng, rng.choice(words), letters))
    counts = {w: rng.choice([2, 3, 19, 20, 30, 200, 2000, 30_000]) for w in words if len(w) >= 7}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found_rows(spelling.spelling_groups(frame)) == plain_groups(counts)


def test_chain_of_forms_ends_at_the_last(spark):
    chain = ["aaaaaaa" + "b" * k for k in range(8)]
    counts = {w: 2 * 10 ** k for k, w in enumerate(chain)} | {"zzzzzzzz": 5, "q" * 3000: 2, "q" * 3001: 20}
    found = found_rows(spelling.spelling_groups(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert found == plain_groups(counts)
    assert {r[2] for r in found if r[0] in chain} == {chain[-1]}


def test_query_equals_plain_words_and_pairs(spark, tmp_path):
    rng = random.Random(8)
    syllables = ["ein", "ver", "lich", "keit", "und", "ÉA", "ü", "sch", "EN", "ge"]
    vocabulary = ["".join(rng.choices(syllables, k=rng.randint(2, 4))) for _ in range(80)]
    rows = [(i, " ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(80)], k=120)) + ", x1y!")
            for i in range(100)]
    rows += [(7, None), (8, ""), (None, "Versch Verschlich Verschlich Ångström Ångström"), (9, "a" * 50 + " " + "a" * 50), rows[0], rows[0]]
    spark.createDataFrame([(i, t, "word", 1) for i, t in rows], "doc_id long, text string, word string, n int") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    found = found_rows(queries.op13_spelling(spark, str(tmp_path)))
    assert len(found) > 50 and any(r[1] for r in found)
    assert found == plain_groups(plain_words(rows))


def test_long_texts_are_read_whole(spark, monkeypatch):
    text = "Languages " * 30 + "language languages"
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    whole = spelling.word_counts(frame).collect()
    monkeypatch.setattr(spelling, "TEXT_AT_ONCE", 3)
    assert [tuple(r) for r in whole] == [tuple(r) for r in spelling.word_counts(frame).collect()] == [("languages", 31)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_groups(spelling.word_counts(empty, spelling.drop_one_of_31)).collect() == []


def test_pairs_are_verified_inside_the_join(spark):
    frame = spark.range(3).select(F.concat(F.lit("wordwor"), F.col("id").cast("string")).alias("word"), F.lit(2).cast("bigint").alias("n"))
    plan = spelling.near_pairs(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (((" in plan and "levenshtein" in plan and "Join Cross" not in plan
