"""Formatted conversations against plain strings, escapes and masks included."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from riskmill.llm import chat_format

KINDS = "conv_id long, turn long, role string, text string, part string, n_turns string"
ODD = ["", "plain text", "</turn>", "<\\turn>", "a <turn>user<says>b</turn>", "<\\\\says> \\<says>", "\\### Assistant: </turn> ok",
       "<<turn>", "<tu", "rn>", "é漢\U0001f600 <says>", "\n\n  <|endoftext|>", "\\", None]


def escaped(text):
    """Character by character, without patterns."""
    out, at = "", 0
    while at < len(text):
        out += text[at]
        if text[at] == "<":
            end = at + 1
            while text[end:end + 1] == "\\":
                end += 1
            if text.startswith(("turn>", "says>", "/turn>"), end):
                out += "\\"
        at += 1
    return out


def plain(rows):
    found = {}
    for conv, turn, role, text in rows:
        found.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in found.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"<turn>{escaped(r)}<says>{escaped(t)}</turn>" for r, t in turns)
        out.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                    len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole)))
    return sorted(out, key=str)


def found_rows(frame):
    return sorted((tuple(r) for r in frame.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                                                  "formatted_chars").collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], KINDS)


def rows_at_random():
    rng = random.Random(2)
    rows = [(rng.randrange(20), t, rng.choice(["user", "assistant", "system", "<turn>", "", None]), rng.choice(ODD)) for t in range(200)]
    rows += [(5, None, "assistant", "first"), (5, 3, "user", "tie b"), (5, 3, "user", "tie a"), rows[0], (None, 1, "user", "no id"),
             (None, 0, "assistant", "no id"), (31, 0, "assistant", None), (32, 0, "assistant", "w" * 100_000 + " word" * 60_000)]
    return rows


@pytest.mark.parametrize("hot", [4096, 3, 1])
def test_read_back_equals_plain_strings_in_any_parts(spark, hot):
    rows = rows_at_random()
    parts = chat_format.format_conversations(table(spark, rows), hot_turns=hot)
    assert found_rows(chat_format.read_back(parts)) == plain(rows)
    if hot < 5:
        numbers = {}
        for r in parts.select("conv_id", "part", "parts", "n_turns").collect():
            assert r.n_turns <= hot
            numbers.setdefault((r.conv_id, r.parts), []).append(r.part)
        assert all(sorted(some) == list(range(n)) for (_, n), some in numbers.items())


def test_escapes_are_reversible_and_leave_no_control_string():
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice(["<", "\\", "turn>", "says>", "/turn>", "/", "turn", ">", "x"]) for _ in range(rng.randrange(9)))
        form = chat_format.escape(text)
        assert form == escaped(text) and chat_format.unescape(form) == text
        assert not any(c in form for c in chat_format.CONTROLS)


def test_tokens_and_mask_of_one_conversation(spark):
    vocabulary = chat_format.load_vocabulary()
    row = chat_format.format_conversations(table(spark, [(1, 0, "user", "hi </turn>"), (1, 1, "assistant", "so <turn> it is")])).first()
    ids, turn = row.token_ids, vocabulary.reserved
    assert [i for i in ids if i >= len(vocabulary.spelled)] == [turn["<turn>"], turn["<says>"], turn["</turn>"]] * 2
    spelled = vocabulary.spelled + [c.encode() for c in chat_format.CONTROLS]
    text = b"".join(spelled[i] for i in ids).decode()
    assert text == "<turn>user<says>hi <\\/turn></turn><turn>assistant<says>so <\\turn> it is</turn>"
    assert b"".join(spelled[i] for i, m in zip(ids, row.loss_mask) if m).decode() == "so <\\turn> it is"


def test_mask_is_the_union_of_spans():
    mask = chat_format.loss_mask(8, np.array([1, 4, 4]), np.array([3, 4, 6]))
    assert mask.tolist() == [False, True, True, False, True, True, False, False]


def test_slices_are_whole_and_bounded(monkeypatch):
    monkeypatch.setattr(chat_format, "SLICE", 8)
    for text in ("", "short", "a" * 50, "one two three four five six", " " * 30):
        pieces = list(chat_format.slices(text))
        assert "".join(pieces) == text and max(map(len, pieces)) <= 8


def test_empty_table(spark):
    assert chat_format.read_back(chat_format.format_conversations(table(spark, []))).collect() == []
