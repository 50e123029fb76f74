"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from riskmill.llm.mixing import CURRICULUM, MOST_REPEATS, SEED, WEIGHTS
from riskmill.llm.quality import LEAST_SHARE, MEASURES, ROUNDS, RULES, SAME_WINDOW, START_GOOD, rate_limits, start_rate

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def quality_sql() -> str:
    """The measures, then the same rounds of estimation over vote patterns, one CTE a round."""
    votes = ", ".join(
        f"CASE WHEN {w} <= 0 THEN 0 WHEN {p} * 100 >= {w} * {r.bad} THEN -1 WHEN {p} * 100 <= {w} * {r.good} THEN 1 ELSE 0 END AS v{k}"
        for k, r in enumerate(RULES) for p, w in [MEASURES[r.measure]])
    names = ", ".join(f"v{k}" for k in range(len(RULES)))
    rules, kinds = range(len(RULES)), range(len(RULES) + 1)
    odds = ["1.0::DOUBLE"] + [
        f"exp(ln(s{j} / s0) + " + " + ".join(
            f"CASE WHEN v{k} > 0 THEN ln((1 - r{j}_{k}) / (1 - r0_{k})) WHEN v{k} < 0 THEN ln(r{j}_{k} / r0_{k}) ELSE 0.0 END" for k in rules) + ")"
        for j in kinds if j]
    whole = " + ".join(f"o{j}" for j in kinds)
    given = ", ".join(f"{o} AS o{j}" for j, o in enumerate(odds))
    rounds = [f"t0 AS (SELECT {START_GOOD}::DOUBLE AS s0, " + ", ".join(
        [f"{(1 - START_GOOD) / len(RULES)!r}::DOUBLE AS s{j}" for j in kinds if j]
        + [f"{start_rate(j, k)}::DOUBLE AS r{j}_{k}" for j in kinds for k in rules]) + ")"]
    for n in range(ROUNDS):
        sums = ", ".join([f"greatest({LEAST_SHARE}, sum(n * o{j} / ({whole})) / sum(n)) AS q{j}" for j in kinds] + [
            f"least({high}, greatest({low}, coalesce(coalesce(sum(n * o{j} / ({whole})) FILTER (v{k} < 0), 0) / "
            f"nullif(sum(n * o{j} / ({whole})) FILTER (v{k} <> 0), 0), {start_rate(j, k)}))) AS r{j}_{k}"
            for j in kinds for k in rules for low, high in [rate_limits(j, k)]])
        parts = " + ".join(f"q{j}" for j in kinds)
        rounds.append(f"t{n + 1} AS MATERIALIZED (SELECT *, " + ", ".join(f"q{j} / ({parts}) AS s{j}" for j in kinds)
                      + f" FROM (SELECT {sums} FROM (SELECT {names}, n, {given} FROM patterns, t{n})))")
    return rf"""
WITH split AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS} AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents),
windows AS (SELECT r, i, list_slice(words, i, i + 2) AS w FROM split, unnest(range(1, len(words) - 1)) AS u(i)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS c FROM windows) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + d) AS n FROM again, (VALUES (0), (1), (2)) AS o(d) GROUP BY r),
measured AS (
    SELECT split.r, doc_id, len(words)::BIGINT AS n_words,
           length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
           (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
           len(lines)::BIGINT AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals,
           length(regexp_replace(text, '[^!?]', '', 'g'))::BIGINT AS n_marks,
           list_sum(list_transform(range(0, len(words) // {SAME_WINDOW} + 1), lambda k: len(words[k * {SAME_WINDOW} + 1:(k + 1) * {SAME_WINDOW}])
               - len(list_distinct(words[k * {SAME_WINDOW} + 1:(k + 1) * {SAME_WINDOW}]))))::BIGINT AS n_same_words
    FROM split LEFT JOIN covered USING (r)),
voted AS MATERIALIZED (SELECT *, {votes} FROM measured),
patterns AS MATERIALIZED (SELECT {names}, count(*) AS n FROM voted GROUP BY ALL),
{", ".join(rounds)},
judged AS (SELECT voted.*, 1.0 / ({" + ".join(odds)}) AS p, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed
           FROM voted, t{ROUNDS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND p >= 0.5 AS kept
FROM judged"""


URLS_SQL = r"""
WITH parts AS (
    SELECT page_id, coalesce(url, '') AS url,
           translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
    FROM pages),
ruled AS (
    SELECT *, CASE
        WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
        WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
        WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
        WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule,
        CASE WHEN regexp_matches(lower(url), '[?&]utm_source=feed(?:[&#]|$)') THEN 'feed-article'
             WHEN regexp_matches(lower(url), '[?&]page=[0-9]+&ref=') THEN 'paged-referral'
             WHEN regexp_matches(lower(url), '/signin(?:[/?#.]|$)') THEN 'sign-in'
             WHEN regexp_matches(lower(url), '/login(?:[/?#.]|$)') THEN 'log-in'
             WHEN regexp_matches(lower(url), '/cart(?:[/?#.]|$)') THEN 'shopping-cart'
             WHEN regexp_matches(lower(url), '[?&;]jsessionid=') THEN 'java-session'
             WHEN regexp_matches(lower(url), '[?&;]phpsessid=') THEN 'php-session'
             WHEN regexp_matches(lower(url), '[?&;]sid=') THEN 'session' END AS fitting
    FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN fitting IS NULL OR fitting = 'feed-article' THEN 'allow' ELSE 'block' END AS verdict,
       CASE WHEN rule IS NULL THEN fitting END AS pattern
FROM ruled"""

EXACT_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST, r) AS k, count(*) OVER (PARTITION BY t) AS n,
                    min(doc_id) OVER (PARTITION BY t) AS keep_id FROM texts)
SELECT doc_id, keep_id, n AS group_size, k = 1 AS kept, sha256(t) AS text_sha256 FROM numbered"""


def mixing_sql() -> str:
    """Words, targets by rounds of resharing, the seeded order, and the inverse of each schedule's demand."""
    weight = "CASE no % {n} ".format(n=len(WEIGHTS)) + " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(WEIGHTS)) + " END"
    levels = ["l0 AS (SELECT 0.0::DOUBLE AS level)"]
    for n in range(12):
        full = f"level * weight > {MOST_REPEATS} * source_size"
        levels.append(
            f"l{n + 1} AS MATERIALIZED (SELECT coalesce((sum(source_size) - coalesce(sum({MOST_REPEATS} * source_size) FILTER ({full}), 0))::DOUBLE "
            f"/ nullif(sum(weight) FILTER (NOT {full}), 0)::DOUBLE, max(level)) AS level FROM numbered, l{n})")
    times = []
    for number, schedule in enumerate(CURRICULUM):
        cases = ""
        segments = schedule.segments()
        for k, (start, w, slope, before, after) in enumerate(segments):
            root = (f"CASE WHEN x - {before!r}::DOUBLE <= 0 THEN {start!r}::DOUBLE ELSE {start!r}::DOUBLE + 2.0::DOUBLE * (x - {before!r}::DOUBLE) / ({w!r}::DOUBLE + "
                    f"sqrt({w * w!r}::DOUBLE + {2.0 * slope!r}::DOUBLE * (x - {before!r}::DOUBLE))) END")
            cases += f" WHEN x < {after!r} THEN {root}" if k + 1 < len(segments) else f" ELSE {root}"
        body = f"CASE {cases} END" if len(segments) > 1 else cases.removeprefix(" ELSE ")
        times.append(f"WHEN (no % {len(WEIGHTS)}) = {number} THEN {body}")
    return rf"""
WITH docs AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM documents),
numbered AS MATERIALIZED (SELECT *, {weight} AS weight FROM (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM docs GROUP BY source)),
{", ".join(levels)},
targets AS (SELECT numbered.*, least(level * weight, ({MOST_REPEATS} * source_size)::DOUBLE) AS target FROM numbered, l12),
placed AS (
    SELECT doc_id, size, source_size, no, target, floor(target + 0.5)::BIGINT AS need,
           coalesce(sum(size) OVER (PARTITION BY docs.source ORDER BY md5('{SEED}-' || coalesce(doc_id::VARCHAR, ''))[1:8], doc_id NULLS FIRST, size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
    FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source),
counted AS (
    SELECT *, before::DOUBLE / greatest(need, 1)::DOUBLE AS x, CASE WHEN source_size > 0 THEN need // greatest(source_size, 1) ELSE 0 END AS rounds FROM placed),
taking AS (SELECT *, (rounds * size + greatest(0, least(need - rounds * source_size - before, size)))::BIGINT AS taken FROM counted)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN CASE {" ".join(times)} END END AS position FROM taking"""


ORACLE = {"op3_quality": quality_sql(), "op4_urls": URLS_SQL, "op8_exact_dedup": EXACT_SQL, "op9_mixing": mixing_sql()}

ORACLE["op10_warc"] = """
WITH payloads AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
hashed AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM payloads),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM hashed),
told AS (SELECT *, payload_bytes >= 100 AND page_id IS DISTINCT FROM first_page AS again FROM firsts)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first_page END AS refers_to FROM told"""


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit: each byte enters with the first of its eight shifts."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda s: [ascii(s)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    return (f"xor(list_reduce([4294967295::BIGINT] || {steps}, lambda a, b: CASE WHEN xor(a, b) & 1 = 1 "
            "THEN xor(xor(a, b) >> 1, 3988292384) ELSE xor(a, b) >> 1 END), 4294967295)")


# Nodes by grouping all prefixes; subtree sums by giving each node's leaf and savings to all its prefixes.
ORACLE["op11_prefix_trie"] = f"""
WITH turns AS (
    SELECT conv_id, turn, sha256(coalesce(role, '')) || sha256(coalesce(text, '')) AS token,
           octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM conversations WHERE conv_id IS NOT NULL),
own AS MATERIALIZED (
    SELECT conv_id, list(token ORDER BY turn NULLS FIRST, token) AS t, list(n ORDER BY turn NULLS FIRST, token) AS b
    FROM turns GROUP BY conv_id),
drawn AS (SELECT *, {crc32_sql("conv_id::VARCHAR")} % 9 AS h FROM own),
rebuilt AS MATERIALIZED (
    SELECT drawn.conv_id, coalesce(own.t, [])[1:h] || drawn.t[h + 1:] AS t, coalesce(own.b, [])[1:h] || drawn.b[h + 1:] AS b
    FROM drawn LEFT JOIN own ON own.conv_id = drawn.conv_id - drawn.conv_id % 5),
steps AS (
    SELECT conv_id, d, array_to_string(t[1:d], '') AS k, len(t) = d AS ending, CASE WHEN d = 0 THEN 0 ELSE b[d] END AS n
    FROM rebuilt, unnest(range(0, len(t) + 1)) AS u(d)),
nodes AS MATERIALIZED (
    SELECT k, d, min(conv_id) AS conv_id, count(*)::BIGINT AS n_convs, any_value(n) AS n,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ending), '')) AS ends_sha256
    FROM steps GROUP BY k, d),
children AS (SELECT substr(k, 1, (128 * (d - 1))::BIGINT) AS k, count(*)::BIGINT AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
told AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (k)),
sums AS (
    SELECT substr(k, 1, (128 * a)::BIGINT) AS k, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((n_convs - 1) * n)::BIGINT AS saved_tokens
    FROM told, unnest(range(0, d + 1)) AS u(a) GROUP BY 1)
SELECT told.conv_id, told.d AS depth, parents.conv_id AS parent_conv_id, told.n_convs, told.n_children, n_leaves,
       saved_tokens, told.ends_sha256
FROM told JOIN sums USING (k) LEFT JOIN nodes AS parents
    ON told.d > 0 AND parents.d = told.d - 1 AND parents.k = substr(told.k, 1, (128 * (told.d - 1))::BIGINT)"""

_CONTROL = r"<(\\*)(turn>|says>|/turn>)"
ORACLE["op12_chat_format"] = rf"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, turn, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(turn, role)),
told AS (
    SELECT *, role || chr(10) || text || chr(10) AS whole, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
           length('<turn><says></turn>') + length(regexp_replace(role, '{_CONTROL}', '<\\\1\2', 'g'))
           + length(regexp_replace(text, '{_CONTROL}', '<\\\1\2', 'g')) AS chars FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(whole, '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       sum(length(loss))::BIGINT AS loss_chars, sha256(string_agg(loss, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM told GROUP BY conv_id"""
