"""Operator 11, three-way merge of two branches of a table of documents, in SQL only.

Each branch edits rows, columns, lines and the gaps after lines of the base as codes say: the CRC-32 of
``branch:id:name`` modulo ``MODULUS``. Lines are exploded with their position; CASE rules merge the line and the gap after
it, which are units of their own; pieces are gathered again by row, ordered by position, with the sums
of conflicts. Rows that branches add meet by id.

A unit that one branch changes, or both alike, counts one clean change; else it counts one conflict and takes the
first branch's state. Where a branch drops a row, only that counts: a conflict if the other branch changes
anything in the row, else a clean drop.

A row's lines leave a task as one list, so a row is gathered from one partial list, whatever ids are frequent. Rows are
numbered where they are read: give a table that is read from files, as a frame that a shuffle makes may number its rows anew
when an executor is lost.

Defined results: nulls in text, lang and source are empty, an empty text is one empty line; rows that share an id are merged
each by itself; of several rows that one branch adds under an id, the least by lang, source and text counts; a null id has
codes of the empty id and, as an id that is no whole number, adds no row; an added row stands beside a base row with the same id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODULUS = 17
BRANCHES = ("L", "R")
#: What is taken off an added row's id, by branch.
SHIFTS = (1, 5)

_CODED = """
SELECT *, {codes} FROM (
  SELECT monotonically_increasing_id() AS rid, doc_id, coalesce(CAST(doc_id AS STRING), '') AS name,
         coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM {{docs}})
"""

# l and r: codes of a line in both branches; one whose row is dropped there changes nothing else.
_LINES = """
WITH lines AS (
  SELECT rid, doc_id, lang, source, l_row, r_row, l_lang, r_lang, l_source, r_source, pos, line,
         CASE WHEN l_row <> 0 THEN {l_line} END AS l, CASE WHEN r_row <> 0 THEN {r_line} END AS r
  FROM {{coded}} LATERAL VIEW OUTER posexplode(split(text, '\n', -1)) AS pos, line),
units AS (
  SELECT *, coalesce(l IN (0, 1, 2), false) AS l_edit, coalesce(r IN (0, 1, 2), false) AS r_edit,
         coalesce(l IN (3, 4), false) AS l_add, coalesce(r IN (3, 4), false) AS r_add FROM lines),
ruled AS (
  SELECT *, CASE WHEN l_edit THEN l WHEN r_edit THEN r END AS edit, CASE WHEN l_add THEN l WHEN r_add THEN r END AS added,
         l_edit AND r_edit AND l <> r AS clash, l_add AND r_add AND l <> r AS gap_clash FROM units),
merged AS (
  SELECT *, CASE edit WHEN 0 THEN NULL WHEN 1 THEN concat(line, '!') WHEN 2 THEN concat(line, '?') ELSE line END AS kept,
         CASE added WHEN 3 THEN '!' WHEN 4 THEN '?' END AS gap FROM ruled)
SELECT rid, doc_id, lang, source, l_row, r_row, l_lang, r_lang, l_source, r_source,
       array_join(transform(array_sort(collect_list(
         CASE WHEN kept IS NOT NULL OR gap IS NOT NULL THEN struct(pos, concat_ws('\n', kept, gap) AS piece) END)), x -> x.piece), '\n') AS text,
       count_if((l_edit OR r_edit) AND NOT clash) + count_if((l_add OR r_add) AND NOT gap_clash) AS clean,
       count_if(clash AND l <> 0 AND r <> 0) AS edit_edit, count_if(clash AND (l = 0 OR r = 0)) AS edit_delete, count_if(gap_clash) AS insert_insert
FROM merged GROUP BY ALL
"""

# Columns are compared by value; then whole rows are settled.
_ROWS = """
WITH states AS (
  SELECT *, {l_lang} AS lang_l, {r_lang} AS lang_r, {l_source} AS source_l, {r_source} AS source_r FROM {{gathered}}),
columns AS (
  SELECT *, CASE WHEN lang_l <> lang THEN lang_l ELSE lang_r END AS new_lang, CASE WHEN source_l <> source THEN source_l ELSE source_r END AS new_source,
         lang_l <> lang AND lang_r <> lang AND lang_l <> lang_r AS lang_clash, source_l <> source AND source_r <> source AND source_l <> source_r AS source_clash,
         CAST(lang_l <> lang OR lang_r <> lang AS INT) + CAST(source_l <> source OR source_r <> source AS INT) AS edited FROM states),
summed AS (
  SELECT *, clean + edited - CAST(lang_clash AS INT) - CAST(source_clash AS INT) AS all_clean, edit_edit + CAST(lang_clash AS INT) + CAST(source_clash AS INT) AS all_edit_edit,
         l_row = 0 OR r_row = 0 AS dropped FROM columns),
-- Of a row that one branch drops, all changes are the other's and so clean.
settled AS (SELECT *, dropped AND NOT (l_row = 0 AND r_row = 0) AND all_clean > 0 AS fought FROM summed)
SELECT doc_id, CASE WHEN there THEN new_lang END AS lang, CASE WHEN there THEN new_source END AS source, CASE WHEN there THEN text END AS text,
       CASE WHEN dropped THEN CAST(NOT fought AS BIGINT) ELSE all_clean END AS n_clean, CASE WHEN dropped THEN 0L ELSE all_edit_edit END AS n_edit_edit,
       CASE WHEN dropped THEN CAST(fought AS BIGINT) ELSE edit_delete END AS n_edit_delete, CASE WHEN dropped THEN 0L ELSE insert_insert END AS n_insert_insert
FROM (SELECT *, NOT dropped OR (fought AND l_row <> 0) AS there FROM settled)
"""

_ADDED = """
WITH whole AS (SELECT try_cast(doc_id AS BIGINT) AS k, lang, source, l_row, r_row FROM {{coded}}),
given AS (
  SELECT try_subtract({l_shift}, k) AS id, true AS first, struct(lang, source, CASE l_row WHEN 3 THEN '!' ELSE '?' END AS text) AS made FROM whole WHERE l_row IN (3, 4)
  UNION ALL SELECT try_subtract({r_shift}, k), false, struct(lang, source, CASE r_row WHEN 3 THEN '!' ELSE '?' END AS text) FROM whole WHERE r_row IN (3, 4)),
met AS (SELECT id, min(CASE WHEN first THEN made END) AS l, min(CASE WHEN NOT first THEN made END) AS r FROM given WHERE id IS NOT NULL GROUP BY id),
ruled AS (SELECT id, coalesce(l, r) AS made, coalesce(l <> r, false) AS clash FROM met)
SELECT CAST(id AS {id_type}) AS doc_id, made.lang, made.source, made.text, CAST(NOT clash AS BIGINT) AS n_clean, 0L AS n_edit_edit, 0L AS n_edit_delete, CAST(clash AS BIGINT) AS n_insert_insert
FROM ruled
"""


def _code(branch: str, name: str) -> str:
    return f"crc32(CAST(concat({branch}, ':', name, ':', {name}) AS BINARY)) % {MODULUS}"


def _edited(column: str, code: str) -> str:
    """A column's value in a branch."""
    return f"CASE {code} WHEN 0 THEN '' WHEN 1 THEN concat({column}, '!') WHEN 2 THEN concat({column}, '?') ELSE {column} END"


def merge_branches(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", branches: tuple[str, str] = BRANCHES, shifts: tuple[int, int] = SHIFTS
) -> DataFrame:
    """doc_id, lang, source and text (null where the row is gone), n_clean, n_edit_edit, n_edit_delete, n_insert_insert of every id ever present."""
    spark = docs.sparkSession
    named = docs.select(docs[id_col].alias("doc_id"), *(docs[c].cast("string").alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    sides = dict(zip("lr", (f"'{b}'" for b in branches), strict=True))
    codes = ", ".join(f"{_code(b, repr(c))} AS {s}_{c}" for s, b in sides.items() for c in ("row", "lang", "source"))
    coded = spark.sql(_CODED.format(codes=codes), docs=named)
    # The id's text travels with the lines, as codes of lines need it.
    lines = {f"{s}_line": _code(b, "CAST(pos AS STRING)") for s, b in sides.items()}
    gathered = spark.sql(_LINES.format(**lines), coded=coded)
    states = {f"{s}_{c}": _edited(c, f"CASE WHEN {s}_row <> 0 THEN {s}_{c} END") for s in sides for c in ("lang", "source")}
    merged = spark.sql(_ROWS.format(**states), gathered=gathered)
    added = spark.sql(_ADDED.format(l_shift=f"-{shifts[0]}L", r_shift=f"-{shifts[1]}L", id_type=docs.schema[id_col].dataType.simpleString()), coded=coded)
    return merged.unionByName(added)


def digest(merged: DataFrame) -> DataFrame:
    """The rows with their texts as checksums."""
    return merged.select("doc_id", "lang", "source", F.sha2("text", 256).alias("text_sha256"), "n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert")
