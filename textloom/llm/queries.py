"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .branch_merge import digest as merge_digest
from .branch_merge import merge_branches
from .decontamination import contaminated
from .fingerprints import near_texts
from .mixing import mix
from .periodic_runs import digest as run_digest
from .periodic_runs import periodic_runs, repeat_tails
from .pii import digest as pii_digest
from .pii import personal_data
from .quality_model import quality_classifier
from .quality_rules import quality_rules
from .secret_scan import digest as secret_digest
from .secret_scan import secret_scan
from .simhash import near_duplicates
from .sql import OP11_SQL, OP13_SQL
from .substrings import substring_digest
from .token_counts import token_counts
from .toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(secret_scan(_table(spark, sf_dir, "documents")))


def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(personal_data(_table(spark, sf_dir, "documents")))


def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digest(_table(spark, sf_dir, "documents"))


def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"))


def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_digest(merge_branches(_table(spark, sf_dir, "documents")))


def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_texts(_table(spark, sf_dir, "documents"))


def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digest(periodic_runs(repeat_tails(_table(spark, sf_dir, "documents"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": _op1,
        "op2_secret_scan": _op2,
        "op3_quality_classifier": _op3,
        "op4_personal_data": _op4,
        "op5_decontamination": _op5,
        "op6_toxicity": _op6,
        "op7_mix_sources": _op7,
        "op8_near_duplicates": _op8,
        "op9_substring_dedup": _op9,
        "op10_token_counts": _op10,
        "op11_branch_merge": _op11,
        "op12_fingerprints": _op12,
        "op13_periodic_runs": _op13,
    }


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || coalesce(text, '')), 1, 12))::BIGINT AS h FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w,
         sum(source_size) OVER () AS total FROM sums),
ordered AS (
  SELECT *, sum(source_size) OVER o - source_size AS capped, sum(w) OVER () - (sum(w) OVER o - w) AS light,
         row_number() OVER o AS k
  FROM weighed WINDOW o AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
stop AS (
  SELECT min(k) AS k FROM ordered WHERE (3 * total - 4 * capped) * w < 4 * source_size * light),
level AS (SELECT o.k, 3 * o.total - 4 * o.capped AS up, 2 * o.light AS down FROM ordered o JOIN stop USING (k)),
targets AS (
  SELECT o.source, o.source_size, CASE WHEN l.k IS NULL OR o.k < l.k THEN (2 * o.source_size)::DOUBLE ELSE (l.up * o.w)::DOUBLE / l.down::DOUBLE END AS target
  FROM ordered o LEFT JOIN level l ON true),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM targets),
running AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.passes, b.target - b.passes * b.source_size AS budget,
         sum(s.size) OVER o AS upto, sum(s.size) OVER (PARTITION BY s.source, s.h) AS own
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
  WINDOW o AS (PARTITION BY s.source ORDER BY s.h RANGE UNBOUNDED PRECEDING))
SELECT doc_id, size, source_size, target,
       (size * (passes + CASE WHEN passes < 2 AND upto::DOUBLE + (upto - own)::DOUBLE <= 2 * budget THEN 1 ELSE 0 END))::BIGINT AS taken
FROM running
"""


OP5_SQL = r"""
WITH words AS (
  SELECT doc_id AS id, true AS is_doc, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT item_id, false, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') FROM benchmark WHERE item_id IS NOT NULL),
grams AS (
  SELECT DISTINCT id, is_doc, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT id, is_doc, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)),
items AS (SELECT id AS item_id, g, count(*) OVER (PARTITION BY id) AS n_item FROM grams WHERE NOT is_doc)
SELECT d.id AS doc_id, item_id, n_item::BIGINT AS n_item, count(*)::BIGINT AS n_shared, count(*)::DOUBLE / n_item AS containment
FROM grams d JOIN items USING (g) WHERE d.is_doc
GROUP BY d.id, item_id, n_item HAVING 5 * count(*) >= 4 * n_item
"""

OP9_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM windows) WHERE doc_id > least),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, range(50) AS t(k)),
cut AS (SELECT doc_id, list(i) AS cuts FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(coalesce(cuts, []))::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN cuts IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(cuts, i)) END, ' ')) AS kept_sha256
FROM words LEFT JOIN cut USING (doc_id)
"""


def _op2_sql() -> str:
    """All kinds but those with an embedded check (CRC-32, encoded header), which SQL can't test and the fixtures don't hold."""
    letters = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    words = "|".join(letters(w) for w in ("password", "passwd", "secret", "token")) + f"|{letters('api')}_?{letters('key')}"
    kinds = [
        ("assign", rf"({words})[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16), ("chat", "xox[bpars]-[0-9A-Za-z-]{20,}", 0, 0),
        ("maps", "AIza[0-9A-Za-z_-]+", 0, 39), ("pay", "[sr]k_live_[0-9A-Za-z]{16,}", 0, 0), ("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[^-]*-----END [A-Z ]{0,30}PRIVATE KEY-----)?", 0, 0),
    ]
    found = " UNION ALL ".join(
        f"SELECT rid, '{kind}' AS kind, {i} AS ord, {least} AS least, string_split_regex(x, '{pattern}') AS p, regexp_extract_all(x, '{pattern}') AS h, regexp_extract_all(x, '{pattern}', {group}) AS g FROM t"
        for i, (kind, pattern, group, least) in enumerate(kinds)
    )
    text = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, ord)"
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x FROM documents),
hits AS (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM ({found}) WHERE len(h) > 0),
spans AS (
  SELECT rid, kind, ord, (list_sum(list_transform(p[1:i], lambda y: len(y))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda y: len(y))), 0))::BIGINT AS a, len(h[i]) AS n
  FROM hits WHERE len(g[i]) >= least),
placed AS (SELECT *, a + n AS b FROM spans),
sums AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         {text} FILTER (ord < 3) AS base, {text} AS spans FROM placed GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN sums USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_secret_scan": _op2_sql(), "op5_decontamination": OP5_SQL, "op7_mix_sources": OP7_SQL, "op9_substring_dedup": OP9_SQL, "op11_branch_merge": OP11_SQL, "op13_periodic_runs": OP13_SQL}
