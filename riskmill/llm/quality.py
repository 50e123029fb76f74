"""Quality rules by weak supervision. DataFrame only.

Each rule looks at one measure of a whole text and votes good (1), bad (-1) or abstains (0). A document is good or bad
in the way that one of the rules looks for. Nobody says how far a rule can be trusted: expectation-maximisation
estimates the shares of good documents and of each kind of badness, and how accurate every rule is on each of them,
from how the rules agree over all documents. The posterior probability of being good replaces all-must-pass filtering.

The documents enter the estimation as counts of vote patterns, at most 3 to the number of rules, which are aggregated
on the cluster. The fitted weights become literals of one expression, so the votes need no second pass in Python.

Null and blank texts have no words; every rule abstains on them, and ``base_failed`` rejects them. Repeated rows
count as often as they occur. An empty table fits nothing and returns nothing. Further columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmill.llm.common import SPACE, WORD, whole_text

SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
ROUNDS = 15
START_GOOD = 0.8
# How often a rule votes bad: on good documents, on the kind of badness that it looks for, on other kinds.
START_RATES = (0.02, 0.8, 0.2)
LIMITS_GOOD, LIMITS_OWN, LIMITS_OTHER = (0.001, 0.02), (0.6, 0.99), (0.01, 0.99)
LEAST_SHARE = 0.001
# Repeated words are counted inside consecutive windows of so many words, as their share over a whole text grows with it.
SAME_WINDOW = 1000
POSITION_BITS = 28


@dataclass(frozen=True)
class Rule:
    """Bad when the measure reaches ``bad``, good when it is at most ``good``; both are per hundred."""

    name: str
    measure: str
    good: int
    bad: int


# Measures are ratios of two counts, compared without division: 100 * part against limit * whole.
MEASURES = {
    "symbols": ("n_symbols", "n_words"),
    "repeats": ("n_repeat_words", "n_words"),
    "duplicate_lines": ("n_dup_lines", "n_lines"),
    "capitals": ("n_capitals", "word_chars"),
    "marks": ("n_marks", "n_words"),
    "word_length": ("word_chars", "n_words"),
    "sameness": ("n_same_words", "n_words"),
}
RULES = (
    Rule("few_symbols", "symbols", 5, 25),
    Rule("few_repeated_windows", "repeats", 10, 30),
    Rule("lines_differ", "duplicate_lines", 20, 50),
    Rule("few_capitals", "capitals", 10, 30),
    Rule("few_marks", "marks", 10, 30),
    Rule("plausible_words", "word_length", 800, 1100),
    Rule("words_vary", "sameness", 65, 80),
)


def measures(docs: DataFrame, with_row: bool = False) -> DataFrame:
    """One row per document with its counts over the whole text, and on demand the whole row as ``row``.

    n_repeat_words covers the words of 3-word windows that occur twice or more. Windows are compared as numbers made of
    a hash and the position, sorted; neighbours with equal hashes are checked word by word, and a text in which a hash
    deceives is compared by the words themselves. n_same_words are the words that occurred before in their window of
    ``SAME_WINDOW`` words; the windows follow each other through the whole text, so long texts fare like short ones.
    """
    text = whole_text()
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if with_row else []
    split = docs.select(
        *row, "doc_id", text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)).alias("lines"))
    windows = F.expr(
        f"transform(sequence(0, size(words) - 3), i -> "
        f"((xxhash64(words[i], words[i + 1], words[i + 2]) >> {POSITION_BITS}) << {POSITION_BITS}) | i)")
    sorted_windows = split.withColumn("n_words", F.size("words").cast("bigint")).withColumn(
        "windows", F.when(F.col("n_words") >= 4, F.sort_array(windows)).otherwise(F.expr("cast(array() as array<bigint>)")))
    mask = (1 << POSITION_BITS) - 1
    alike = F.expr(f"filter(transform(sequence(1, size(windows) - 1), k -> if((windows[k] >> {POSITION_BITS}) = "
                   f"(windows[k - 1] >> {POSITION_BITS}), k, null)), k -> k is not null)")
    found = sorted_windows.withColumn("alike", F.when(F.size("windows") >= 2, alike).otherwise(F.expr("cast(array() as array<int>)")))
    pairs = found.withColumn("pairs", F.expr(
        f"transform(alike, k -> named_struct('a', cast(windows[k - 1] & {mask}L as int), 'b', cast(windows[k] & {mask}L as int)))"))
    same = "words[p.a] = words[p.b] and words[p.a + 1] = words[p.b + 1] and words[p.a + 2] = words[p.b + 2]"
    deceived = F.expr(f"exists(pairs, p -> not ({same}))") | (F.col("n_words") > mask)
    from_hashes = F.expr("flatten(transform(pairs, p -> array(p.a, p.a + 1, p.a + 2, p.b, p.b + 1, p.b + 2)))")
    by_words = F.expr(
        "transform(array_sort(transform(sequence(0, size(words) - 3), i -> "
        "named_struct('w', array(words[i], words[i + 1], words[i + 2]), 'i', i))), x -> x)")
    from_words = F.expr(
        "flatten(transform(filter(sequence(1, size(ordered) - 1), k -> ordered[k].w = ordered[k - 1].w), k -> "
        "array(ordered[k].i, ordered[k].i + 1, ordered[k].i + 2, ordered[k - 1].i, ordered[k - 1].i + 1, ordered[k - 1].i + 2)))")
    covered = pairs.withColumn("ordered", F.when(deceived, by_words)).withColumn(
        "covered", F.when(F.col("ordered").isNotNull(), from_words).otherwise(from_hashes))
    return covered.select(
        *(["row"] if with_row else []), "doc_id", "n_words",
        F.char_length(F.regexp_replace("text", SPACE, "")).cast("bigint").alias("word_chars"),
        _removed(F.translate("text", SYMBOLS, "")).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.array_distinct("covered")).cast("bigint").alias("n_repeat_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        _removed(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")).alias("n_capitals"),
        _removed(F.translate("text", "!?", "")).alias("n_marks"),
        F.expr(f"aggregate(sequence(0, size(words) div {SAME_WINDOW}), 0L, (n, k) -> n + size(slice(words, k * {SAME_WINDOW} + 1, "
               f"{SAME_WINDOW})) - size(array_distinct(slice(words, k * {SAME_WINDOW} + 1, {SAME_WINDOW}))))").alias("n_same_words"))


def _removed(rest: Column) -> Column:
    return (F.char_length("text") - F.char_length(rest)).cast("bigint")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED_PERCENT)


def vote(rule: Rule) -> Column:
    part, whole = MEASURES[rule.measure]
    return F.when(F.col(whole) <= 0, 0).when(F.col(part) * 100 >= F.col(whole) * rule.bad, -1) \
        .when(F.col(part) * 100 <= F.col(whole) * rule.good, 1).otherwise(0)


@dataclass(frozen=True)
class Trust:
    """Shares of the kinds (good first, then what each rule looks for); ``rates[kind][rule]``: how often it votes bad."""

    shares: tuple[float, ...]
    rates: tuple[tuple[float, ...], ...]

    def evidence(self, kind: int, rule: int) -> tuple[float, float]:
        """What a good and a bad vote of the rule add to the log odds of this kind against good."""
        own, good = self.rates[kind][rule], self.rates[0][rule]
        return math.log((1 - own) / (1 - good)), math.log(own / good)

    def odds(self, votes: Sequence[int]) -> list[float]:
        """Each kind's odds against good."""
        out = []
        for kind, share in enumerate(self.shares):
            total = math.log(share / self.shares[0])
            for rule, value in enumerate(votes):
                if value:
                    total += self.evidence(kind, rule)[value < 0]
            out.append(math.exp(total))
        return out

    def good_probability(self, votes: Sequence[Column]) -> Column:
        whole = F.lit(1.0)
        for kind in range(1, len(self.shares)):
            total = F.lit(math.log(self.shares[kind] / self.shares[0]))
            for rule, value in enumerate(votes):
                for_good, for_bad = self.evidence(kind, rule)
                total = total + F.when(value > 0, for_good).when(value < 0, for_bad).otherwise(0.0)
            whole = whole + F.exp(total)
        return 1 / whole


def _within(value: float, limits: tuple[float, float]) -> float:
    return min(limits[1], max(limits[0], value))


def rate_limits(kind: int, rule: int) -> tuple[float, float]:
    return LIMITS_GOOD if kind == 0 else LIMITS_OWN if kind == rule + 1 else LIMITS_OTHER


def start_rate(kind: int, rule: int) -> float:
    return START_RATES[0] if kind == 0 else START_RATES[1] if kind == rule + 1 else START_RATES[2]


def fit(patterns: Sequence[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = ROUNDS) -> Trust:
    """Expectation-maximisation over (votes, number of documents), starting from fairly good rules."""
    kinds = range(n_rules + 1)
    trust = Trust((START_GOOD,) + ((1 - START_GOOD) / n_rules,) * n_rules,
                  tuple(tuple(start_rate(kind, rule) for rule in range(n_rules)) for kind in kinds))
    total = sum(n for _, n in patterns)
    if not total:
        return trust
    for _ in range(rounds):
        expected = []
        for votes, n in patterns:
            odds = trust.odds(votes)
            expected.append((votes, [n * part / sum(odds) for part in odds]))
        rates = []
        for kind in kinds:
            row = []
            for rule in range(n_rules):
                cast = sum(parts[kind] for votes, parts in expected if votes[rule])
                bad = sum(parts[kind] for votes, parts in expected if votes[rule] < 0)
                row.append(_within(bad / cast if cast else start_rate(kind, rule), rate_limits(kind, rule)))
            rates.append(tuple(row))
        shares = [max(LEAST_SHARE, sum(parts[kind] for _, parts in expected) / total) for kind in kinds]
        trust = Trust(tuple(share / sum(shares) for share in shares), tuple(rates))
    return trust


def fit_trust(measured: DataFrame, rules: Sequence[Rule] = RULES, rounds: int = ROUNDS) -> Trust:
    """What the agreement of the rules over all rows says about them."""
    counts = measured.groupBy(*[vote(rule).alias(f"vote_{k}") for k, rule in enumerate(rules)]).count().collect()
    return fit([(tuple(row[:-1]), row[-1]) for row in sorted(tuple(r) for r in counts)], len(rules), rounds)


def judge(measured: DataFrame, trust: Trust, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Adds base_failed, good_probability and kept. Filter a stored result: see ``keep_good`` for the reason."""
    probability = trust.good_probability([vote(rule) for rule in rules])
    return measured.withColumn("base_failed", base_failed()).withColumn("good_probability", probability) \
        .withColumn("kept", ~F.col("base_failed") & (F.col("good_probability") >= 0.5))


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents that are kept, with all their columns. Measures twice instead of moving any text."""
    trust = fit_trust(measures(docs), rules)
    # A row number that the filter needs keeps the optimizer from copying all measures into the filter, where each
    # use of an array would compute it again.
    numbered = measures(docs, with_row=True).withColumn("_row", F.monotonically_increasing_id())
    return judge(numbered, trust, rules).where(F.col("kept") & (F.col("_row") >= 0)).select("row.*")
