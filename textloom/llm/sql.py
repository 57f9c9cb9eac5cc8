"""SQL of the operators whose oracles need more than a few lines."""

from __future__ import annotations

WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"


def crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    step = "list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b))"
    codes = f"list_transform(list_filter(string_split({text}, ''), lambda x: x <> ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda c, b: {step}, 4294967295), 4294967295)"


OP13_SQL = f"""
WITH raw AS (SELECT doc_id, {WORDS} AS w, {crc32("doc_id::VARCHAR")} AS h FROM documents),
shaped AS (SELECT *, len(w)::BIGINT AS n, h // 10 AS g FROM raw),
tails AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM shaped),
periods AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM tails),
firsts AS (SELECT doc_id, n, a, p, unnest(w) AS x, unnest(range(n)) AS i FROM periods),
tok AS (
  SELECT doc_id, i, x FROM firsts WHERE a IS NULL OR i < a
  UNION ALL
  SELECT t.doc_id, t.i, f.x FROM firsts t JOIN firsts f ON f.doc_id = t.doc_id AND f.i = t.a + (t.i - t.a) % t.p WHERE t.i >= t.a),
grid AS (SELECT doc_id, q, unnest(range((n - 1) // q)) AS j FROM (SELECT doc_id, n, unnest(range(1, n // 4 + 1)) AS q FROM shaped)),
hits AS (
  SELECT g.doc_id, g.q, g.j FROM grid g JOIN tok l ON l.doc_id = g.doc_id AND l.i = g.j * g.q
  JOIN tok r ON r.doc_id = g.doc_id AND r.i = (g.j + 1) * g.q WHERE l.x = r.x),
hopeful AS (SELECT DISTINCT doc_id, q FROM (SELECT *, lead(j, 2) OVER (PARTITION BY doc_id, q ORDER BY j) AS later FROM hits) WHERE later = j + 2),
equals AS (
  SELECT c.doc_id, c.q, l.i, l.i - row_number() OVER (PARTITION BY c.doc_id, c.q ORDER BY l.i) AS island
  FROM hopeful c JOIN tok l ON l.doc_id = c.doc_id JOIN tok r ON r.doc_id = c.doc_id AND r.i = l.i + c.q WHERE l.x = r.x),
stretches AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS m FROM equals GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, s, m, min(q) AS q FROM stretches WHERE m >= 6 AND m >= 4 * q GROUP BY doc_id, s, m),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY (m::DECIMAL(38, 18) / q) DESC, s, q) AS k FROM runs),
sums AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + m)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS words FROM tok ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, m::BIGINT AS length, q::BIGINT AS period, (1000 * m // q)::BIGINT AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM documents d LEFT JOIN sums USING (doc_id) LEFT JOIN best ON best.doc_id = d.doc_id AND best.k = 1 LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


def _op11_sql() -> str:
    code = lambda branch, name: f"{crc32(f'''concat('{branch}:', doc_id, ':', {name})''')} % 17"
    state = lambda column, c: f"CASE {c} WHEN 0 THEN '' WHEN 1 THEN {column} || '!' WHEN 2 THEN {column} || '?' ELSE {column} END"
    rows = ", ".join(f"""{code(b, f"'{c}'")} AS {b.lower()}_{c}""" for b in "LR" for c in ("row", "lang", "source"))
    return f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
coded AS (SELECT *, {rows} FROM base),
lines AS (SELECT doc_id, l_row, r_row, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM (SELECT *, string_split(text, chr(10)) AS ls FROM coded)),
codes AS (SELECT *, CASE WHEN l_row <> 0 THEN {code("L", "pos")} ELSE 9 END AS l, CASE WHEN r_row <> 0 THEN {code("R", "pos")} ELSE 9 END AS r FROM lines),
units AS (
  SELECT doc_id, pos, 0 AS part, CASE WHEN l <= 2 THEN l ELSE 9 END AS l, CASE WHEN r <= 2 THEN r ELSE 9 END AS r, line FROM codes
  UNION ALL SELECT doc_id, pos, 1, CASE WHEN l IN (3, 4) THEN l ELSE 9 END, CASE WHEN r IN (3, 4) THEN r ELSE 9 END, NULL FROM codes),
states AS (
  SELECT *, CASE WHEN l < 9 THEN l ELSE r END AS s, l < 9 AND r < 9 AND l <> r AS clash FROM units),
texts AS (
  SELECT doc_id, string_agg(CASE s WHEN 0 THEN NULL WHEN 1 THEN line || '!' WHEN 2 THEN line || '?' WHEN 3 THEN '!' WHEN 4 THEN '?' ELSE line END, chr(10) ORDER BY pos, part) AS merged,
         count(*) FILTER (s < 9 AND NOT clash) AS clean, count(*) FILTER (clash AND part = 1) AS ii,
         count(*) FILTER (clash AND part = 0 AND (l = 0 OR r = 0)) AS ed, count(*) FILTER (clash AND part = 0 AND l > 0 AND r > 0) AS ee
  FROM states GROUP BY doc_id),
cols AS (
  SELECT doc_id, l_row, r_row, 'lang' AS name, lang AS was, CASE WHEN l_row = 0 THEN lang ELSE {state("lang", "l_lang")} END AS l, CASE WHEN r_row = 0 THEN lang ELSE {state("lang", "r_lang")} END AS r FROM coded
  UNION ALL
  SELECT doc_id, l_row, r_row, 'source', source, CASE WHEN l_row = 0 THEN source ELSE {state("source", "l_source")} END, CASE WHEN r_row = 0 THEN source ELSE {state("source", "r_source")} END FROM coded),
settled AS (
  SELECT doc_id, l_row, r_row, max(CASE WHEN l <> was THEN l ELSE r END) FILTER (name = 'lang') AS lang, max(CASE WHEN l <> was THEN l ELSE r END) FILTER (name = 'source') AS source,
         count(*) FILTER ((l <> was OR r <> was) AND NOT (l <> was AND r <> was AND l <> r)) AS clean, count(*) FILTER (l <> was AND r <> was AND l <> r) AS ee
  FROM cols GROUP BY doc_id, l_row, r_row),
whole AS (
  SELECT doc_id, l_row, r_row, lang, source, coalesce(merged, '') AS merged, s.clean + t.clean AS clean, s.ee + t.ee AS ee, ed, ii, CASE
    WHEN l_row = 0 AND r_row = 0 THEN 'gone' WHEN l_row = 0 AND s.clean + t.clean > 0 THEN 'lost' WHEN r_row = 0 AND s.clean + t.clean > 0 THEN 'saved' WHEN l_row = 0 OR r_row = 0 THEN 'gone' ELSE 'there' END AS fate
  FROM settled s JOIN texts t USING (doc_id)),
made AS (
  SELECT -1 - doc_id AS doc_id, 'L' AS b, CASE l_row WHEN 3 THEN '!' ELSE '?' END AS t, lang, source FROM coded WHERE l_row IN (3, 4)
  UNION ALL SELECT -5 - doc_id, 'R', CASE r_row WHEN 3 THEN '!' ELSE '?' END, lang, source FROM coded WHERE r_row IN (3, 4)),
added AS (SELECT doc_id, arg_min(lang, b) AS lang, arg_min(source, b) AS source, arg_min(t, b) AS t, count(DISTINCT (lang, source, t)) AS n FROM made GROUP BY doc_id)
SELECT doc_id, CASE WHEN fate IN ('there', 'saved') THEN lang END AS lang, CASE WHEN fate IN ('there', 'saved') THEN source END AS source, CASE WHEN fate IN ('there', 'saved') THEN sha256(merged) END AS text_sha256,
       CASE fate WHEN 'there' THEN clean WHEN 'gone' THEN 1 ELSE 0 END::BIGINT AS n_clean, CASE WHEN fate = 'there' THEN ee ELSE 0 END::BIGINT AS n_edit_edit,
       CASE WHEN fate = 'there' THEN ed WHEN fate = 'gone' THEN 0 ELSE 1 END::BIGINT AS n_edit_delete, CASE WHEN fate = 'there' THEN ii ELSE 0 END::BIGINT AS n_insert_insert
FROM whole
UNION ALL
SELECT doc_id, lang, source, sha256(t), (n = 1)::BIGINT, 0, 0, (n > 1)::BIGINT FROM added
"""


OP11_SQL = _op11_sql()
