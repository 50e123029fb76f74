"""Quality rules, mixing, URL filters and toxicity: small cases with known results."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskmill.llm import mixing, quality, toxicity, urls


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeated = {i + d for i, w in enumerate(windows) if often[w] > 1 for d in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))


def test_measures_equal_plain_python(documents, odd_rows):
    rng = random.Random(8)
    few = [" ".join(rng.choices(["a", "b", "c", "\n", "d", "|", "#x"], k=n)) for n in (2, 3, 4, 5, 60, 400)]
    rows = odd_rows + [(50 + k, t, "s") for k, t in enumerate(few)] + [(70, "a b c a b c", "s"), (71, "l\n\nl\n l\nl", "s")]
    found = quality.measures(documents(rows)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert sorted((tuple(r) for r in found), key=repr) == sorted(((i, *plain_measures(t)) for i, t, _ in rows), key=repr)


def test_windows_whose_hashes_collide_are_compared_by_words(documents, monkeypatch):
    """With positions taking all but two bits, hashes of different windows agree all the time."""
    monkeypatch.setattr(quality, "POSITION_BITS", 62)
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choices("abcdef", k=40)), "s") for k in range(10)]
    found = quality.measures(documents(rows)).select("doc_id", "n_repeat_words").collect()
    assert sorted(map(tuple, found)) == [(i, plain_measures(t)[4]) for i, t, _ in rows]


def test_estimation_finds_rules_that_can_be_trusted():
    rng = random.Random(10)
    votes = Counter()
    for _ in range(5000):
        kind = rng.choices([0, 1, 2], [0.8, 0.12, 0.08])[0]
        votes[tuple((-1 if rng.random() < (0.9 if kind == k + 1 else 0.01) else 1) for k in range(2))] += 1
    trust = quality.fit(sorted(votes.items()), 2)
    assert trust.shares[0] == pytest.approx(0.8, abs=0.05)
    good = lambda v: 1 / sum(trust.odds(v))
    assert good((1, 1)) > 0.95 and good((-1, 1)) < 0.2 and good((1, -1)) < 0.2 and good((0, 0)) == pytest.approx(trust.shares[0])


def test_quality_of_odd_and_empty_tables(documents, odd_rows):
    prose = [(200 + k, " ".join(f"plain{(k * 7 + j) % 301} text{j}" for j in range(60)) + ".", "s") for k in range(30)]
    junk = [(300 + k, " ".join(f"ju{k}{j}###" for j in range(80)), "s") for k in range(4)]
    docs = documents(odd_rows + prose + junk)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} - {6} == {i for i, _, _ in prose}
    assert quality.keep_good(documents([])).collect() == []


def test_word_variety_does_not_fall_with_length(documents):
    """Prose that is clean at a thousand words is clean at 400,000; a text that repeats itself is not."""
    rng = random.Random(13)
    vocabulary = ["".join(rng.choices("aeinrst", k=6)) for _ in range(5000)]
    weights = [1 / (k + 3) for k in range(5000)]
    long = " ".join(rng.choices(vocabulary, weights, k=400_000))
    rows = [(k, " ".join(rng.choices(vocabulary, weights, k=300)), "s") for k in range(40)]
    rows += [(100, long, "s"), (101, " ".join(["w1 w2 w3 w4 w5"] * 400), "s")]
    measured = quality.measures(documents(rows))
    same = {r.doc_id: (r.n_same_words, r.n_words) for r in measured.where("doc_id >= 100").collect()}
    words = long.split()
    assert same[100] == (sum(1000 - len(set(words[at:at + 1000])) for at in range(0, 400_000, 1000)), 400_000)
    kept = {r.doc_id for r in quality.keep_good(documents(rows)).collect()}
    assert kept == {*range(40), 100}


def plain_targets(sizes, weights=(1, 2, 3)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        held = sum(3 * sizes[s] for s in full)
        wide = sum(weight[s] for s in sizes if s not in full)
        level = (total - held) / wide if wide else 0
        above = {s for s in sizes if s not in full and level * weight[s] > 3 * sizes[s]}
        if not above:
            return {s: 3.0 * sizes[s] if s in full else level * weight[s] for s in sizes}
        full |= above


@pytest.mark.parametrize("range_rows", [3, 1024])
def test_mixing_meets_targets(documents, odd_rows, range_rows):
    rng = random.Random(11)
    rows = odd_rows + [(500 + k, " ".join(["w"] * rng.randrange(1, 90)), rng.choice(["a", "b", "b", "b", "tiny"] if k else ["tiny"]))
                       for k in range(300)]
    found = mixing.assign(documents(rows), range_rows=range_rows).collect()
    assert len(found) == len(rows)
    sizes = Counter()
    for i, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    targets = plain_targets(sizes)
    taken = Counter()
    for r in found:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source])
        assert (r.position is None) == (r.taken == 0) and (r.position is None or 0 <= r.position <= 1)
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 1
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, mixing.assign(documents(rows), range_rows=range_rows).collect()), key=repr)


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_words_before_do_not_depend_on_blocks(documents, monkeypatch, bits):
    rows = [(i, f"s{0 if i % 3 else i % 5}", " ".join(["w"] * (i % 17))) for i in range(400)]
    docs = documents(rows)
    wanted = sorted(map(tuple, mixing.assign(docs, range_rows=1000).collect()))
    monkeypatch.setattr(mixing, "BLOCK_BITS", bits)
    assert sorted(map(tuple, mixing.assign(docs, range_rows=7).collect())) == wanted


def test_positions_follow_the_schedule(spark):
    schedule = mixing.Schedule(((0.0, 0.0), (0.4, 2.0), (1.0, 0.5)))
    whole = 0.4 * 1.0 + 0.6 * 1.25
    rows = spark.range(0, 101).select((F.col("id") / 100).alias("d"))
    for r in rows.select("d", schedule.time_of(F.col("d")).alias("t")).collect():
        first = min(r.t, 0.4)
        demand = first * first * 2.5
        if r.t > 0.4:
            demand += (r.t - 0.4) * (2.0 + (2.0 - 2.5 * (r.t - 0.4))) / 2
        assert demand / whole == pytest.approx(r.d, abs=1e-9)
    for bad in (((0.0, 1.0),), ((0.0, 0.0), (1.0, 0.0)), ((0.1, 1.0), (1.0, 1.0)), ((0.0, -1.0), (1.0, 2.0))):
        with pytest.raises(ValueError):
            mixing.Schedule(bad)


def test_training_rows_repeat_whole_documents(documents):
    rows = [(k, "w " * 10, "big") for k in range(60)] + [(100 + k, "w " * 10, "small") for k in range(3)]
    docs = documents(rows)
    times = Counter(r.doc_id for r in mixing.training_rows(docs).collect())
    assert mixing.training_rows(docs).columns == docs.columns
    plan = {r.doc_id: math.ceil(r.taken / r.size) for r in mixing.assign(docs).collect() if r.taken}
    assert times == plan and all(times[100 + k] == 3 for k in range(3))
    assert mixing.training_rows(documents([])).collect() == [] and mixing.mixed(documents([])).collect() == []


URLS = [(1, "http://Sub.Example.com/en/x?a=1"), (2, "https://www.example.com/en/"), (3, "http://a.net/es/1#t"), (4, "http://a.net/es"),
        (5, "http://notexample.com/en/1"), (6, None), (7, "no scheme"), (8, "http://a.org/list?page=2&ref=x"), (9, "http://a.org/login"),
        (10, ""), (11, "://"), (12, "http://net/fr/?x"), (13, "http://m.www.example.com/en/1"), (13, "http://m.www.example.com/en/1"),
        (None, "http://a.com/"), (14, "http://a.org/p?utm_source=feed"), (15, "http://example.com/EN/1"), (16, "http://planet/es/1"),
        (17, "ftp://x.net/fr/é?q"), (18, "http://a.org/x?PHPSESSID=1"), (19, "http://a.com")]
VERDICTS = {1: ("sub.example.com", "/en/x", "example.com/en/", "block"), 2: ("www.example.com", "/en/", "www.example.com/en/", "allow"),
            3: ("a.net", "/es/1", "net/es/", "block"), 4: ("a.net", "/es", None, "allow"), 5: ("notexample.com", "/en/1", "com/", "allow"),
            6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("a.org", "/list", None, "block"), 9: ("a.org", "/login", None, "block"),
            10: ("", "", None, "allow"), 11: ("", "", None, "allow"), 12: ("net", "/fr/", "net/fr/", "block"),
            13: ("m.www.example.com", "/en/1", "www.example.com/en/", "allow"), None: ("a.com", "/", "com/", "allow"),
            14: ("a.org", "/p", None, "allow"), 15: ("example.com", "/EN/1", "com/", "allow"), 16: ("planet", "/es/1", None, "allow"),
            17: ("x.net", "/fr/é", "net/fr/", "block"), 18: ("a.org", "/x", None, "block"), 19: ("a.com", "", None, "allow")}


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in URLS], "page_id long, url string, html string, token string")
    found = urls.judge_urls(pages).collect()
    assert len(found) == len(URLS)
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found} == VERDICTS
    assert urls.judge_urls(pages.limit(0)).collect() == []


def test_every_rule_is_fetched_by_a_token():
    rules = urls.SITE_RULES + urls.PATTERN_RULES
    assert all(rule.tokens for rule in rules) and len({rule.name for rule in rules}) == len(rules)
    assert len({len(rule.regex) for rule in urls.PATTERN_RULES}) == len(urls.PATTERN_RULES)  # the longest pattern is one


def test_rules_are_filed_under_their_rarest_token(spark):
    pages = spark.createDataFrame([(k, f"http://common.org/rare{k}") for k in range(5)], "page_id long, url string")
    rule = urls.UrlRule("one", "common.*rare3", ("common", "rare3"), "block")
    found = {r.page_id: (r.verdict, r.pattern) for r in urls.judge_urls(pages, [rule]).collect()}
    assert found[3] == ("block", "one") and [found[k] for k in (0, 1, 2, 4)] == [("allow", None)] * 4


def test_toxicity_learns_words_and_ranks_held_out_texts(spark):
    rng = random.Random(12)
    syllables = ["th", "er", "in", "on", "re", "ha", "nd", "ou"]
    bad = ["vilequx", "grotzkin", "zapfjut"]

    def text(toxic):
        words = ["".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(60)]
        for _ in range(3 if toxic else 0):
            words[rng.randrange(60)] = rng.choice(bad)
        return " ".join(words)
    rows = [(k, text(k % 5 == 0), int(k % 5 == 0)) for k in range(600)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(1000, None, "x"), (1001, "", "x"), (None, "word", "x")],
                                 "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (2, None)], "doc_id long, toxic int") \
        .where(toxicity.id_remainder(F.col("doc_id")) != 2)
    model = toxicity.fit(docs, labels)
    scored = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(scored) == 603 and all(0 <= s <= 1 for s in scored.values())
    assert scored[1000] == scored[1001]
    learnt = {r.doc_id for r in labels.select("doc_id").collect()}
    held = [(scored[i], y) for i, _, y in rows if i not in learnt]
    pairs = [(a > b) + (a == b) / 2 for a, x in held for b, y in held if x == 1 and y == 0]
    assert sum(pairs) / len(pairs) > 0.95
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}


def tiny_docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string"), \
        spark.createDataFrame([(i, int(i % 2 == 1)) for i, _ in rows if i is not None], "doc_id long, toxic int")


def test_toxicity_without_ordinary_words_or_documents(spark):
    assert toxicity.telling_words([b" a b c d "], []) == [] and toxicity.telling_words([], [b" a "]) == []
    docs, labels = tiny_docs(spark, [(i, "vile words here" if i % 2 else None) for i in range(40)])
    model = toxicity.fit(docs, labels)
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, model).collect())
    gone = labels.unionByName(labels.where("toxic = 1").selectExpr("doc_id + 1000 as doc_id", "0 as toxic"))
    assert toxicity.fit(docs.where("doc_id % 2 = 1"), gone) is None
    assert toxicity.fit(docs.limit(0), labels) is None and toxicity.fit(docs, labels.limit(0)) is None
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_a_repeated_id_is_one_row_for_the_fit(spark):
    rows = [(i, f"plain text number {i} " + ("grotzkin vilequx" if i % 2 else "quiet")) for i in range(60)]
    docs, labels = tiny_docs(spark, rows)
    hot = docs.unionByName(docs.where("doc_id = 6").crossJoin(spark.range(300)).select("doc_id", "text"))
    one, many, few = toxicity.fit(docs, labels), toxicity.fit(hot, labels), toxicity.fit(hot, labels, fit_docs=9, fit_windows=50)
    assert (toxicity.fit(docs, labels).weights == one.weights).all()
    for model in (many, few):
        assert all(0 <= r.score <= 1 for r in toxicity.score(docs, model).collect())


def plain_features(model, text):
    """Windows one by one, compressed afresh behind each dictionary."""
    import zstandard

    words = (text or "").encode().lower().split()
    parts = [b" " + b" ".join(words[at:at + 4]) + b" " for at in range(0, len(words), 4)] or [b""]
    saved = []
    for part in parts:
        sizes = []
        for content in model.distances.contents:
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes.append(len(zstandard.ZstdCompressor(level=3, dict_data=data, write_content_size=False, write_dict_id=False,
                                                      write_checksum=False).compress(part)))
        saved.append(sizes[0] - sizes[1])
    return [max(saved)] + [min(3, sum(s >= k for s in saved)) for k in (2, 3, 4)] \
        + [(sum(s >= 3 for s in saved) / len(saved)) ** 0.5, math.log(len(saved))]


def test_scores_equal_plain_compression(spark):
    rows = [(i, f"text {i} of plain words " * (1 + i % 4) + ("zapfjut grotzkin" if i % 2 else "")) for i in range(50)] + [(77, None), (78, "")]
    docs, labels = tiny_docs(spark, rows)
    model = toxicity.fit(docs, labels)
    for r in toxicity.score(docs, model).collect():
        measured = (plain_features(model, r.text) - model.means) / model.scales
        assert r.score == pytest.approx(1 / (1 + math.exp(-(sum(measured * model.weights[:-1]) + model.weights[-1]))), rel=1e-9)
