"""Exact, near and substring deduplication against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from riskmill.llm import exact_dedup, simhash, substring_dedup


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest id reachable over fingerprints that differ in three bits or fewer; ids may be null."""
    values = sorted({p for _, p in prints})
    parent = {v: v for v in values}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(values):
        for b in values[:i]:
            if bin(a ^ b).count("1") <= 3:
                parent[top(a)] = top(b)
    smallest = {}
    for i, p in prints:
        if i is not None:
            smallest[top(p)] = min(i, smallest.get(top(p), i))
    return [smallest.get(top(p)) for _, p in prints]


def near_texts(seed, families=12, copies=6):
    rng = random.Random(seed)
    words = [f"w{rng.randrange(5000)}" for _ in range(3000)]
    rows, at = [], 0
    for _ in range(families):
        base = rng.sample(words, 150)
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(3)):
                text[rng.randrange(150)] = rng.choice(words)
            rows.append((at, " ".join(text), "s"))
            at += 1
    return rows


def test_simhash_equals_brute_force(spark, documents, odd_rows):
    rows = near_texts(1) + [(i and i + 1000, t, s) for i, t, s in odd_rows]
    prints = [(i, plain_fingerprint(t)) for i, t, _ in rows]
    expected = sorted(((i, f"{p:016x}", c) for (i, p), c in zip(prints, plain_components(prints))), key=repr)
    found = simhash.near_duplicates(documents(rows))
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected


@pytest.mark.parametrize("block", [4, 16, 4096])
def test_links_hold_components_together_whatever_the_block(spark, block):
    rng = random.Random(block)
    values = [0]
    for _ in range(120):  # a chain of near values in one hot bucket, and values at random
        values.append(values[-1] ^ (1 << rng.randrange(20)) ^ (1 << rng.randrange(20)))
    values += [rng.getrandbits(64) for _ in range(80)]
    values += [v ^ (1 << rng.randrange(64)) for v in values[-20:]]
    prints = [(k, v) for k, v in enumerate(dict.fromkeys(values))]
    signed = [(k, v - (1 << 64) if v >> 63 else v) for k, v in prints]
    rows = spark.createDataFrame(signed, "doc_id long, fingerprint long")
    found = simhash.near_groups(rows, block=block)
    by_print = {r.fingerprint: r.component_id for r in found.collect()}
    assert [by_print[v] for _, v in signed] == plain_components(prints)


def test_bit_sliced_distances_equal_popcounts():
    rng = np.random.default_rng(3)
    prints = rng.integers(-2**63, 2**63 - 1, 200)
    prints[100:] = prints[:100] ^ (1 << rng.integers(0, 62, 100)) ^ (1 << rng.integers(0, 62, 100))
    groups = np.sort(rng.integers(0, 3, 200))
    for radius in (0, 1, 3, 5):
        a, b = simhash.linked_lanes(prints, groups, radius)
        parent = list(range(200))

        def top(x):
            while parent[x] != x:
                x = parent[x]
            return x
        for x, y in zip(a, b):
            assert groups[x] == groups[y] and bin(int(prints[x] ^ prints[y]) & (2**64 - 1)).count("1") <= radius
            parent[top(x)] = top(y)
        for x in range(200):
            for y in range(x):
                if groups[x] == groups[y] and bin(int(prints[x] ^ prints[y]) & (2**64 - 1)).count("1") <= radius:
                    assert top(x) == top(y)


def test_one_of_each_group_stays(spark, documents):
    rows = near_texts(2, 5, 4)
    kept = simhash.keep_one_of_each(documents(rows))
    components = plain_components([(i, plain_fingerprint(t)) for i, t, _ in rows])
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(components))
    assert kept.columns == documents(rows).columns


def test_near_and_substring_of_empty_tables(documents):
    assert simhash.near_duplicates(documents([])).collect() == []
    assert simhash.keep_one_of_each(documents([])).collect() == []
    assert substring_dedup.repeated_spans(documents([])).collect() == []
    assert exact_dedup.exact_groups(documents([])).collect() == []
    assert exact_dedup.keep_first(documents([])).collect() == []


def plain_groups(rows):
    normal = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, _ in rows]
    out, used = [], set()
    for (i, _, _), n in zip(rows, normal):
        ids = [j for (j, _, _), m in zip(rows, normal) if m == n]
        keep = min((j for j in ids if j is not None), default=None)
        kept = i == keep and n not in used
        used |= {n} if kept else set()
        out.append((i, keep, len(ids), kept))
    return out


def weak_hash(text):
    """All texts collide."""
    return F.unhex(F.substring(F.md5(text), 1, 0))


@pytest.mark.parametrize("hash_of", [exact_dedup.content_hash, weak_hash])
def test_exact_groups_equal_brute_force_also_when_hashes_collide(documents, odd_rows, hash_of):
    found = exact_dedup.exact_groups(documents(odd_rows), hash_of)
    mine = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found.collect()), key=repr)
    assert mine == sorted(plain_groups(odd_rows), key=repr)


@pytest.mark.parametrize("hash_of", [exact_dedup.content_hash, weak_hash])
def test_keep_first_leaves_each_text_once(documents, odd_rows, hash_of):
    docs = documents(odd_rows)
    kept = exact_dedup.keep_first(docs, hash_of)
    assert kept.columns == docs.columns
    mine = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    wanted = sorted(((i, t) for (i, t, _), g in zip(odd_rows, plain_groups(odd_rows)) if g[3]), key=repr)
    # Null ids have no smallest id of their own when another row has the text.
    assert mine == wanted


def test_repeated_passages_are_found_and_clean_texts_are_not(documents):
    rng = random.Random(5)

    def prose(n):
        return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(n))
    passages = [prose(55) for _ in range(40)]
    rows, where = [], {}
    for k, passage in enumerate(passages):
        for copy in range(2):
            doc = 3 * k + copy
            rows.append((doc, prose(40 + copy * 7) + "\n" + passage + " " + prose(30), "s"))
            where[doc] = 3 * k
        rows.append((3 * k + 2, prose(120), "s"))
    rows += [(1000, None, "s"), (1001, "", "s"), (1002, "short", "s"), (1003, "short", "s")]
    found = substring_dedup.repeated_spans(documents(rows)).collect()
    assert {r.doc_id for r in found} <= set(where)
    assert len({r.doc_id for r in found}) >= 0.97 * len(where)
    assert all(r.first_doc_id == where[r.doc_id] and r.n_words <= 56 for r in found)
    cleaned = {r.doc_id: r.text for r in substring_dedup.without_repeats(documents(rows)).collect()}
    assert len(cleaned) == len(rows)
    for doc, text, _ in rows:
        if doc not in where or where[doc] == doc:
            assert cleaned[doc] == text
    cut = [d for d in where if where[d] != d and cleaned[d] != rows[d][1]]
    assert len(cut) >= 38


def test_chunks_cover_the_text_and_resist_insertions():
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(2000)]
    first, sizes, digests = substring_dedup.chunks(" ".join(words))
    assert first[0] == 0 and sizes.min() >= substring_dedup.CHUNK_WORDS
    assert (np.diff(first) <= sizes[:-1]).all() and first[-1] + sizes[-1] > 1950  # overlapping, to the end
    _, _, moved = substring_dedup.chunks(" ".join(words[:700] + ["inserted"] + words[700:]))
    assert len(set(digests.tolist()) - set(moved.tolist())) <= 20
    _, sizes, _ = substring_dedup.chunks("x " * 5000)
    assert sizes.max() <= substring_dedup.LONGEST + substring_dedup.CHUNK_WORDS


def plain_spans(rows, chunk=16, least=24, longest=64):
    """Spans from chunks compared as words: the gear hash byte by byte, periods word by word. Ids are distinct."""
    tables = {}
    for doc, text, _ in rows:
        words = (text or "").encode().split()
        state, at, cuts = 0, 0, {0, len(words)}
        for byte in b" ".join(words) + b" ":
            if byte == 0x20:
                at += 1
                if state >> 14 == 0:
                    cuts.add(at)
            state = (2 * state + int(substring_dedup.GEAR[byte])) & 0xFFFF
        for period in (1, 2, 3, 4):
            k = period
            while k < len(words):
                start = k - period
                while k < len(words) and words[k] == words[k - period]:
                    k += 1
                if k - start >= chunk and k - start > period:
                    cuts.update(range(start, k, chunk))
                k += 1
        borders = sorted(cuts)
        for a, b in zip(borders, borders[1:]):
            cuts.update(range(a + longest, b, longest))
        borders = sorted(cuts)
        table = []
        for a in borders[:-1] if words else []:
            b = next((c for c in borders if c >= a + chunk), None)
            if b is not None:
                table.append((a, b, tuple(words[a:b])))
        tables[doc] = table
    holders = {}
    for doc, table in tables.items():
        for _, _, part in table:
            holders.setdefault(part, set()).add(doc)
    spans = set()
    for doc, table in tables.items():
        run = []
        for k, (a, b, part) in enumerate(table + [(0, 0, None)]):
            if part is not None and len(holders[part]) > 1:
                run.append((a, b, min(holders[part])))
                continue
            if run and max(b for _, b, _ in run) - run[0][0] >= least:
                spans.add((doc, run[0][0], max(b for _, b, _ in run) - run[0][0], min(f for _, _, f in run)))
            run = []
    return spans


def test_spans_equal_chunks_compared_as_words(documents):
    rng = random.Random(15)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randrange(1, 7))) for _ in range(30)]
    passages = [" ".join(rng.choices(vocabulary, k=n)) for n in (20, 30, 51, 60, 200)] + ["m " * 60, "ab cd " * 40, "x y z " * 30]
    rows = [(k, " ".join(" ".join(rng.choices(vocabulary, k=rng.randrange(40))) + " " + rng.choice(passages) for _ in range(3)), "s")
            for k in range(60)] + [(90, None, "s"), (91, " ", "s"), (92, "q " * 400, "s"), (93, "q " * 300, "s")]
    found = substring_dedup.repeated_spans(documents(rows)).collect()
    assert {(r.doc_id, r.first_word, r.n_words, r.first_doc_id) for r in found} == plain_spans(rows)


def test_passages_of_one_to_four_repeated_words_are_found(documents):
    rng = random.Random(16)

    def prose(n):
        return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9))) for _ in range(n))
    units = [prose(n) for n in (1, 2, 3, 4) for _ in range(25)]
    passages = [" ".join((unit.split() * 60)[:60]) for unit in units]
    rows = [(2 * k + copy, prose(33 + 20 * copy) + " " + passage + " " + prose(30), "s")
            for k, passage in enumerate(passages) for copy in range(2)]
    found = {r.doc_id for r in substring_dedup.repeated_spans(documents(rows)).collect()}
    assert len(found) >= 0.98 * len(rows)
