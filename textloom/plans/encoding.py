"""Queries of the byte-level BPE encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import bpe, tokens
from textloom.sources.tables import read_table, spread

from .registry import Plans

plans = Plans()

#: A public byte-level vocabulary; its end sign stands for start and end, as it has no others.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
BOUNDARY = 50256


def _sql_letters() -> str:
    """Rows of a byte in hexadecimal and its letter."""
    return ", ".join(f"('{b:02X}', chr({ord(c)}))" for b, c in enumerate(bpe.byte_letters()))


# A symbol stands between chr(2) and chr(3), so replacing a pair of them merges all its places from the left.
# White space before a word is cut before its last character, which chr(1) marks: this dialect has no look-ahead.
_SQL_BPE = rf"""
WITH RECURSIVE model AS MATERIALIZED (SELECT json->'model' AS m FROM read_json_objects('{TOKENIZER}', format = 'unstructured', maximum_object_size = 100000000)),
entries AS MATERIALIZED (SELECT unnest(map_entries(from_json(m->'vocab', '"MAP(VARCHAR, INTEGER)"'))) AS e FROM model),
vocab AS MATERIALIZED (SELECT e.key AS piece, e.value AS id FROM entries),
ranked AS MATERIALIZED (
  SELECT unnest(list) AS pair, unnest(range(len(list))) AS rank FROM (SELECT from_json(m->'merges', '[["VARCHAR"]]') AS list FROM model)),
merges AS MATERIALIZED (SELECT pair[1] AS a, pair[2] AS b, rank FROM ranked),
letters(hex, letter) AS (VALUES {_sql_letters()}),
cut AS (
  SELECT doc_id, list_filter(regexp_extract_all(regexp_replace(text, '(\s)(\S)', chr(1) || '\1\2', 'g'),
    '''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}' || chr(1) || ']+|\s+|' || chr(1)), lambda w: w <> chr(1)) AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM cut),
bytes AS (SELECT w, unnest(range(strlen(w))) AS k, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM words)),
state AS (
  SELECT w, string_agg(chr(2) || letter || chr(3), '' ORDER BY k) AS s, 0 AS step FROM bytes JOIN letters ON hex = substr(h, 2 * k::INTEGER + 1, 2) GROUP BY w
  UNION ALL
  SELECT w, replace(any_value(s), chr(2) || arg_min(a, rank) || chr(3) || chr(2) || arg_min(b, rank) || chr(3), chr(2) || arg_min(a || b, rank) || chr(3)), any_value(step) + 1
  FROM (SELECT w, s, step, y[j] AS x1, y[j + 1] AS x2
        FROM (SELECT *, unnest(range(1, len(y))) AS j FROM (SELECT *, string_split(replace(s[2:-2], chr(3) || chr(2), chr(2)), chr(2)) AS y FROM state)))
  JOIN merges ON a = x1 AND b = x2 GROUP BY w),
final AS (SELECT w, arg_max(s, step) AS s FROM state GROUP BY w),
pieces AS (SELECT w, unnest(y) AS piece, unnest(range(len(y))) AS k FROM (SELECT w, string_split(replace(s[2:-2], chr(3) || chr(2), chr(2)), chr(2)) AS y FROM final)),
coded AS (SELECT w, list(id ORDER BY k) AS ids FROM pieces JOIN vocab USING (piece) GROUP BY w),
encoded AS (SELECT doc_id, flatten(list(ids ORDER BY i)) AS ids FROM words JOIN coded USING (w) GROUP BY doc_id),
whole AS (SELECT doc_id, coalesce(ids, []) AS ids FROM documents LEFT JOIN encoded USING (doc_id)),
input AS (SELECT *, list_concat([{BOUNDARY}], ids[1:510], [{BOUNDARY}]) AS x FROM whole)
"""


def _encoded(spark: SparkSession, sf_dir: str, most: int | None = None) -> DataFrame:
    ids = bpe.byte_pair_ids(spark, bpe.Merges.read(TOKENIZER), most)
    return spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", ids(F.col("text")).alias("ids"))


def _checksum(ids: Column) -> Column:
    return F.sha2(F.array_join(ids, ","), 256)


@plans.query(_SQL_BPE + "SELECT doc_id, len(ids)::INTEGER AS n_tokens, sha256(array_to_string(ids, ',')) AS ids_sha256 FROM whole")
def encode_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tokens of the whole text."""
    return _encoded(spark, sf_dir).select("doc_id", F.size("ids").alias("n_tokens"), _checksum(F.col("ids")).alias("ids_sha256"))


@plans.query(
    _SQL_BPE
    + """SELECT doc_id, len(x)::INTEGER AS n_ids, len(ids) > 510 AS is_cut,
sha256(array_to_string(list_concat(x, list_transform(range(512 - len(x)), lambda k: 1)), ',')) AS input_sha256 FROM input"""
)
def encode_bpe_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the model reads: signs around the text, cut to 512 ids and padded to them, with the number of ids under the mask."""
    # One id more than fits tells whether the text is cut.
    inputs = _encoded(spark, sf_dir, tokens.MAX_LENGTH - 1).select("doc_id", "ids", bpe.model_ids(F.col("ids"), (BOUNDARY,), (BOUNDARY,)).alias("x"))
    under = F.aggregate(tokens.attention_mask(F.col("x")), F.lit(0), lambda s, m: s + m)
    return inputs.select("doc_id", under.alias("n_ids"), (F.size("ids") > tokens.MAX_LENGTH - 2).alias("is_cut"), _checksum(tokens.pad(F.col("x"))).alias("input_sha256"))
