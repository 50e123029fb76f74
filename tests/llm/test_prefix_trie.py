"""The conversation trie against a plain dictionary of prefixes, with shards of every size."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from riskmill.llm import prefix_trie, queries

NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_nodes(sequences):
    """Rows of all nodes for {conv_id: list of (role, text)}."""
    members, ends = {}, {}
    for conv, turns in sequences.items():
        ends.setdefault(tuple(turns), []).append(conv)
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def below(node):
        return [node] + [n for c in children.get(node, []) for n in below(c)]
    rows = []
    for node, convs in members.items():
        tree = below(node)
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in tree if n)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        rows.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs),
                     len(children.get(node, [])), sum(n not in children for n in tree), saved, digest))
    return sorted(rows, key=lambda r: (r[0], r[1]))


def sequences_of(rows):
    """Turns in order, null turns first, null role and text empty."""
    found = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            found.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in found.items()}


def rebuilt(sequences):
    out = {}
    for c, turns in sequences.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = sequences.get(c - c % 5, [])[:h] + turns[h:]
    return out


def found_rows(frame):
    return sorted((tuple(r) for r in frame.select(*NODE).collect()), key=lambda r: (r[0], r[1]))


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows],
                                 "conv_id long, turn long, role string, text string, path string, kind int")


def branching(seed, n, turns, words):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), f"text {rng.randrange(words)} é") for c in range(n)
            for t in range(rng.randrange(1, turns))]


@pytest.mark.parametrize("nodes, ids", [(1 << 18, 1 << 20), (1, 1 << 20), (7, 5), (1 << 18, 2)])
def test_equals_plain_prefixes_whatever_the_shards(spark, nodes, ids):
    rows = branching(3, 150, 7, 2) + [(1000 + c, t, "user", "common") for c in range(60) for t in range(4)]
    found = prefix_trie.trie_nodes(prefix_trie.token_sequences(conversations(spark, rows)), nodes, ids)
    assert found_rows(found) == plain_nodes(sequences_of(rows))


def test_query_rebuilds_conversations(spark, tmp_path):
    rows = branching(4, 120, 12, 3)
    rows = [r for r in rows if r[0] not in (35, 40)]  # blocks without their first conversation
    conversations(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    assert found_rows(queries.op11_prefix_trie(spark, str(tmp_path))) == plain_nodes(rebuilt(sequences_of(rows)))


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", "a"), (2, None, "", ""), (2, 0, "user", "a"), (2, 0, "user", "a"),
            (3, 5, "user", "ü" * 70_000), (None, 0, "user", "lost"), (4, 1, "system", "\U0001f600"), (-9, 1, "user", "a")]
    frame = prefix_trie.trie_nodes(prefix_trie.token_sequences(conversations(spark, rows)))
    assert found_rows(frame) == plain_nodes(sequences_of(rows))


def test_turnless_conversations_end_at_the_root(spark):
    sequences = spark.createDataFrame([(4, []), (9, []), (7, ["0" * 38 + "0a"])], "conv_id long, tokens array<string>")
    top, leaf = found_rows(prefix_trie.trie_nodes(sequences))
    assert top[:7] == (4, 0, None, 3, 1, 1, 0) and leaf[:7] == (7, 1, 4, 1, 0, 1, 0)
    assert top[7] == hashlib.sha256(b"4,9").hexdigest()
    alone = found_rows(prefix_trie.trie_nodes(sequences.where("conv_id < 5")))
    assert alone == [(4, 0, None, 1, 0, 1, 0, hashlib.sha256(b"4").hexdigest())]


def test_empty_table(spark):
    assert prefix_trie.trie_nodes(prefix_trie.token_sequences(conversations(spark, []))).collect() == []


def test_find_close_meets_the_partner():
    rng = random.Random(5)
    for size in (1, 2, 63, 64, 65, 3000):
        depths = [0]
        while len(depths) < size:
            depths.append(rng.randint(1, depths[-1] + 1))
        tree = prefix_trie.Parentheses(np.array(depths))
        stack, partner = [], {}
        for at, bit in enumerate(tree.bits):
            if bit:
                stack.append(at)
            else:
                partner[stack.pop()] = at
        assert tree.find_close().tolist() == [partner[p] for p in tree.opens.tolist()]
    deep = prefix_trie.Parentheses(np.arange(5000))
    assert deep.find_close().tolist() == list(range(9999, 4999, -1))
