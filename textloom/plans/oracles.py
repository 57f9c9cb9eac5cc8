"""SQL of the building blocks, which the oracles of several modules share."""

from __future__ import annotations

from textloom.functions import html

# The tables hold no white space beyond what \s means in that dialect.


def strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"


def newlines(x: str) -> str:
    return rf"regexp_replace({x}, '\r\n?', chr(10), 'g')"


def spaces(x: str) -> str:
    return rf"regexp_replace({x}, '[ \t]+', ' ', 'g')"


def blank_lines(x: str) -> str:
    return rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')"


def clean(x: str) -> str:
    return strip(blank_lines(spaces(newlines(x))))


def parts(split: str) -> str:
    return f"list_filter(list_transform(string_split({split}, chr(1)), lambda x: {strip('x')}), lambda x: x <> '')"


def sentences(clean: str) -> str:
    return parts(rf"""regexp_replace({clean}, '([.!?])\s+(["''“”‘’]?[A-Z0-9])', '\1' || chr(1) || '\2', 'g')""")


def paragraphs(clean: str) -> str:
    return parts(rf"""regexp_replace({clean}, '\n\s*\n|\n([A-Z0-9"''])', chr(1) || '\1', 'g')""")


def article(clean: str) -> str:
    return f"CASE WHEN {clean} <> '' THEN [{clean}] ELSE [] END"


SEGMENTS = {"article": article, "sentence": sentences, "paragraph": paragraphs}
DIRTY = r"concat(' ', chr(9), ' ', replace(replace(text, '. ', '.  ' || chr(9)), chr(10), chr(13) || chr(10) || chr(13) || chr(13) || ' ' || chr(10) || chr(13) || chr(10)), ' ', chr(10), ' ')"
LINES = f"list_transform(string_split(text, chr(10)), lambda x: {strip('x')})"


#: CTEs from cleaned(request_id, c) to seg(request_id, segment_index, text), by mode.
FROM_CLEANED = {
    mode: f"""lists AS (SELECT request_id, {parts('c')} AS s FROM cleaned),
seg AS (SELECT request_id, unnest(s) AS text, unnest(range(len(s)))::INTEGER AS segment_index FROM lists)"""
    for mode, parts in SEGMENTS.items()
}


def segmented(mode: str) -> str:
    """CTEs up to seg(request_id, segment_index, text)."""
    return f"""
cleaned AS (SELECT doc_id AS request_id, {clean('text')} AS c FROM documents),
{FROM_CLEANED[mode]}"""


LOGITS = r"""
z AS (
  SELECT *, list_sum(list_transform(w, lambda x: ('0x' || substr(md5(x), 1, 2))::INTEGER - 128))::DOUBLE / (16.0::DOUBLE * greatest(len(w), 1)) AS z0,
         list_sum(list_transform(w, lambda x: ('0x' || substr(md5(x), 3, 2))::INTEGER - 128))::DOUBLE / (16.0::DOUBLE * greatest(len(w), 1)) AS z1,
         list_sum(list_transform(w, lambda x: ('0x' || substr(md5(x), 5, 2))::INTEGER - 128))::DOUBLE / (16.0::DOUBLE * greatest(len(w), 1)) AS z2
  FROM (SELECT *, regexp_extract_all(text, '\S+') AS w FROM seg)),
e AS (SELECT *, exp(z0 - greatest(z0, z1, z2)) AS e0, exp(z1 - greatest(z0, z1, z2)) AS e1, exp(z2 - greatest(z0, z1, z2)) AS e2 FROM z),
pred AS (
  SELECT request_id, segment_index, text,
         CASE WHEN z0 >= z1 AND z0 >= z2 THEN 'LEFT' WHEN z1 >= z2 THEN 'RIGHT' ELSE 'CENTER' END AS label,
         CASE WHEN z0 >= z1 AND z0 >= z2 THEN 0 WHEN z1 >= z2 THEN 1 ELSE 2 END AS label_id,
         round(e0 / (e0 + e1 + e2), 6) AS p_left, round(e1 / (e0 + e1 + e2), 6) AS p_right, round(e2 / (e0 + e1 + e2), 6) AS p_center
  FROM e)"""


def predicted(mode: str, rest: str) -> str:
    return f"WITH {segmented(mode)}, {LOGITS} {rest}"


def pages() -> str:
    """Recursive CTEs up to pieces(page_id, j, stack, piece), blocks(page_id, block_index, text) and lines(page_id, line_index, text).

    ``walk`` keeps the open elements before each token; text belongs to every block that is open there.
    """
    names, ends = "list_transform(stack, lambda x: split_part(x, '#', 1))", "'^</?([a-zA-Z][a-zA-Z0-9]*)'"
    listed = lambda tags: ", ".join(f"'{t}'" for t in sorted(tags))
    gone = f"list_has_any({names}, [{listed(html.DROPPED | html.SILENT)}])"
    plain = "tok"
    for entity, character in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        plain = f"replace({plain}, '{entity}', '{character}')"
    return rf"""
toks AS (
  SELECT page_id, regexp_extract_all(regexp_replace(html, '(?is)<(script|style|noscript)\b.*?</(script|style|noscript)\s*>', '<!---->', 'g'), '(?s)<!--.*?-->|<[^>]*>|[^<]+') AS t FROM pages),
walk AS (
  SELECT page_id, 0 AS i, []::VARCHAR[] AS stack FROM toks
  UNION ALL
  SELECT page_id, i + 1, CASE
      WHEN tok LIKE '</%' THEN CASE WHEN list_contains({names}, name) THEN stack[1:len(stack) - list_position(list_reverse({names}), name)] ELSE stack END
      WHEN name <> '' AND NOT tok LIKE '%/>' AND name NOT IN ({listed(html.VOID)}) THEN list_append(stack, name || '#' || i) ELSE stack END
  FROM (SELECT w.page_id, i, stack, t[i + 1] AS tok, lower(regexp_extract(t[i + 1], {ends}, 1)) AS name FROM walk w JOIN toks USING (page_id) WHERE i < len(t))),
seen AS (SELECT w.page_id, w.i, w.stack, t[w.i + 1] AS tok, lower(regexp_extract(t[w.i + 1], {ends}, 1)) AS name, {gone} AS gone FROM walk w JOIN toks USING (page_id) WHERE w.i < len(t)),
pieces AS (SELECT page_id, i AS j, stack, {strip(plain)} AS piece FROM seen WHERE tok NOT LIKE '<%' AND NOT gone AND {strip(plain)} <> ''),
opened AS (SELECT page_id, i, name || '#' || i AS block FROM seen WHERE name IN ({listed(html.BLOCKS)}) AND tok NOT LIKE '</%' AND NOT gone),
blocks AS (
  SELECT o.page_id, (row_number() OVER (PARTITION BY o.page_id ORDER BY o.i) - 1)::INTEGER AS block_index, coalesce(string_agg(piece, ' ' ORDER BY j), '') AS text
  FROM opened o LEFT JOIN pieces p ON p.page_id = o.page_id AND list_contains(p.stack, o.block) GROUP BY o.page_id, o.i),
whole AS (SELECT page_id, string_split(string_agg(piece, chr(10) ORDER BY j), chr(10)) AS ls FROM pieces GROUP BY page_id),
lines AS (SELECT page_id, unnest(range(len(ls)))::INTEGER AS line_index, {strip("unnest(ls)")} AS text FROM whole),
enough AS (
  SELECT page_id, block_index AS nr, text, 0 AS kind FROM blocks WHERE len(regexp_extract_all(text, '\S+')) >= 8
  UNION ALL SELECT page_id, line_index, text, 1 FROM lines WHERE len(regexp_extract_all(text, '\S+')) >= 8),
chosen AS (SELECT page_id, text, min(nr) AS nr FROM enough e WHERE kind = (SELECT min(kind) FROM enough k WHERE k.page_id = e.page_id) GROUP BY page_id, text),
texts AS (SELECT page_id, {clean("string_agg(text, chr(10) || chr(10) ORDER BY nr)")} AS page_text FROM chosen GROUP BY page_id)"""
