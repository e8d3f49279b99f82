"""Longer SQL of the corpus queries, as DuckDB runs it."""

from __future__ import annotations

#: crc32 of the bytes of a text, from a table that the polynomial gives.
CRC = """
crc_table AS MATERIALIZED (SELECT list(list_reduce(list_prepend(k, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY k) AS crc FROM range(256) AS t(k))"""


def crc32(code_points: str) -> str:
    """crc32 of bytes given as a list; the table is crc_table's."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {code_points}), lambda c, x: xor(c >> 8, crc[xor(c & 255, x) + 1])), 4294967295)"


def supervision(rounds: int = 30) -> str:
    """Counts, votes, the rounds over the patterns of votes, and the verdict."""
    from .supervision import RULES

    n = len(RULES)
    vote = ", ".join(f"CASE WHEN {r.good} THEN 1 WHEN {r.bad} THEN -1 ELSE 0 END" for r in RULES)
    odds = f"ln(good / (1 - good)) + list_sum(list_transform(range(1, {n + 1}), lambda i: CASE v[i] WHEN 1 THEN ln(g[i] / (1 - b[i])) WHEN -1 THEN ln((1 - g[i]) / b[i]) ELSE 0.0 END))"
    of = lambda i, sign, q: f"sum(CASE WHEN v[{i}] = {sign} THEN {q} ELSE 0 END)"
    share = lambda i, sign, q, right, wrong, low, high: f"greatest({low}, least({high}, ({of(i, sign, q)} + {right}) / ({of(i, 1, q)} + {of(i, -1, q)} + {right + wrong})))"
    g = ", ".join(share(i, 1, "q", 9.9, 0.1, 0.98, 0.995) for i in range(1, n + 1))
    b = ", ".join(share(i, -1, "(n - q)", 2.0, 8.0, 0.2, 0.95) for i in range(1, n + 1))
    return rf"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
x AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, unnest(list_transform(range(1, len(words) - 3), lambda k: array_to_string(words[k:k + 4], ' '))) AS h FROM w WHERE len(words) >= 5),
y AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS n FROM x),
r AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + unnest(range(5)) FROM y WHERE n > 1) GROUP BY doc_id),
c AS MATERIALIZED (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    len(lines) AS n_lines, len(list_filter(lines, lambda x: regexp_matches(x, '[.!?:;"''\)][\x20\x09-\x0D]*$'))) AS n_ended_lines,
    length(regexp_replace(text, '[^A-Z\x{{00C0}}-\x{{00DE}}]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^!?]', '', 'g')) AS n_marks,
    len(list_filter(words, lambda x: regexp_matches(x, '[#*$%&|<>]') OR NOT regexp_matches(x, '[A-Za-z\x{{80}}-\x{{10FFFF}}]'))) AS n_odd_words
  FROM w LEFT JOIN r USING (doc_id)
), v AS MATERIALIZED (SELECT *, [{vote}] AS v, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
p AS MATERIALIZED (SELECT v, count(*)::DOUBLE AS n FROM v GROUP BY v),
m AS (
  SELECT 0 AS round, 0.5::DOUBLE AS good, list_transform(range({n}), lambda i: 0.99::DOUBLE) AS g, list_transform(range({n}), lambda i: 0.2::DOUBLE) AS b
  UNION ALL
  SELECT round + 1, (sum(q) + 1) / (sum(n) + 2), [{g}], [{b}] FROM (SELECT round, v, n, n / (1 + exp(-({odds}))) AS q FROM m, p WHERE round < {rounds}) GROUP BY round
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 1 / (1 + exp(-({odds}))) >= 0.5 AS kept FROM v, (SELECT good, g, b FROM m WHERE round = {rounds})
"""


def periodic() -> str:
    """Runs as islands of equal stretches of 16 words at one distance; of the runs of one stretch, that of the least distance."""
    crc = crc32("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))")
    return rf"""
WITH {CRC.strip()},
r AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, CASE WHEN doc_id IS NOT NULL THEN {crc} END AS h FROM documents, crc_table),
k AS (SELECT *, h // 10 AS g, len(words) AS n FROM r),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM k),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
t AS MATERIALIZED (SELECT doc_id, CASE WHEN a IS NULL THEN words ELSE list_transform(range(n), lambda i: words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS words FROM p),
s AS MATERIALIZED (SELECT doc_id, unnest(range(len(words) - 15)) AS i, unnest(list_transform(range(len(words) - 15), lambda i: md5(array_to_string(words[i + 1:i + 16], ' ')))) AS h FROM t WHERE len(words) >= 24),
q AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.h = y.h AND y.i > x.i),
d AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM q),
e AS (SELECT doc_id, min(i) AS start, count(*) + 15 + q AS length, q FROM d GROUP BY doc_id, q, island HAVING count(*) + 15 + q >= greatest(24, 3 * q)),
f AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM e GROUP BY doc_id, start, length),
b AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    arg_min(struct_pack(start, length, period), struct_pack(e := -length::DOUBLE / period, s := start, p := period)) AS best FROM f GROUP BY doc_id
), gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM f),
w AS (SELECT doc_id, unnest(range(len(words))) AS i, unnest(words) AS word FROM t),
c AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.start AS BIGINT) AS start, CAST(best.length AS BIGINT) AS length, CAST(best.period AS BIGINT) AS period,
  CAST(1000 * best.length // best.period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def variants() -> str:
    """Near words by what is left when one letter goes: at the same place of both (replaced), or one of them itself (added)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    utf8 = "flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END))"
    return rf"""
WITH RECURSIVE {CRC.strip()},
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')), '{upper}', '{upper.lower()}') AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS c FROM r WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT run, c, {crc32(utf8)} AS h FROM d, crc_table),
k AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, c FROM h),
w AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM k WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
x AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (
  SELECT a.word, b.word AS other, b.n AS m FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT x.word, w.word, w.n FROM x JOIN w ON x.rest = w.word
  UNION SELECT w.word, x.word, x.n FROM x JOIN w ON x.rest = w.word
), o AS (SELECT word, count(*) AS n_near, arg_min(struct_pack(m, other), struct_pack(a := -m, b := other)) AS best FROM p GROUP BY word),
f AS MATERIALIZED (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best.m >= 5 * n THEN best.other END AS form, CASE WHEN best.m >= 5 * n THEN best.m END AS form_n FROM w LEFT JOIN o USING (word)),
t AS (SELECT word, form AS root, 1 AS step FROM f WHERE form IS NOT NULL UNION ALL SELECT t.word, f.form, step + 1 FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL),
l AS (SELECT word, arg_max(root, step) AS root FROM t GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM f LEFT JOIN l USING (word)
"""
