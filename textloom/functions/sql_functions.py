"""The columns of this package as SQL functions, so that a query in SQL gives the rows that the DataFrame form gives.

They are SQL functions with parameters: the analyzer puts their bodies into the query, so plans are those of built-in functions and
nothing runs in Python. Names are temporary, in the session. Segments become rows by ``LATERAL VIEW posexplode_outer`` of a column with ``segment_text(c, mode)``: a
table function of SQL would do the same by a join, with a shuffle of all texts.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .scores import LABELS
from .segments import PARAGRAPH_BREAK, SENTENCE_BREAK
from .text import GAP, MIN_BLOCK_WORDS, NOT_WS, SPACES, WS


def _raw(pattern: str) -> str:
    """A pattern as a raw string of SQL, quotes by their codes."""
    return "r'" + pattern.replace("'", r"\x27").replace('"', r"\x22") + "'"


def _strip(c: str) -> str:
    return f"btrim({c}, '{SPACES}')"


def _parts(pattern: str) -> str:
    """Stripped pieces between matches; a lambda can't call SQL functions."""
    return f"filter(transform(split(clean, {_raw(pattern)}, -1), x -> {_strip('x')}), x -> x <> '')"


_LABELS = ", ".join(f"'{x}'" for x in LABELS)
_LEAST = f"({NOT_WS}++{WS}++)"

#: Name, parameters, result and body, each after those that it uses.
FUNCTIONS = [
    ("strip", "c STRING", "STRING", _strip("c")),
    ("normalize_newlines", "c STRING", "STRING", r"replace(replace(c, '\r\n', '\n'), '\r', '\n')"),
    ("collapse_spaces", "c STRING", "STRING", r"regexp_replace(c, r'[ \t]{2,}|\t', ' ')"),
    ("collapse_blank_lines", "c STRING", "STRING", r"regexp_replace(c, r'\n{3,}', '\n\n')"),
    ("clean_text", "c STRING", "STRING", "strip(collapse_blank_lines(collapse_spaces(normalize_newlines(c))))"),
    ("words_of", "c STRING", "ARRAY<STRING>", f"array_remove(split(c, {_raw(GAP)}, -1), '')"),
    ("word_count", "c STRING", "INT", "CASE WHEN c IS NOT NULL THEN size(words_of(c)) END"),
    ("enough_words", f"c STRING, least INT DEFAULT {MIN_BLOCK_WORDS}", "BOOLEAN", f"c RLIKE concat({_raw(rf'\A{WS}*+{_LEAST}')}, '{{', least - 1, '}}', {_raw(NOT_WS)})"),
    ("looks_like_url", "c STRING", "BOOLEAN", "strip(c) RLIKE r'(?i)^https?://[^/?#]+'"),
    ("articles_of", "clean STRING", "ARRAY<STRING>", "filter(array(clean), x -> x <> '')"),
    ("sentences_of", "clean STRING", "ARRAY<STRING>", _parts(SENTENCE_BREAK)),
    ("paragraphs_of", "clean STRING", "ARRAY<STRING>", _parts(PARAGRAPH_BREAK)),
    (
        "segment_text", "c STRING, mode STRING", "ARRAY<STRING>",
        "CASE mode WHEN 'article' THEN articles_of(clean_text(c)) WHEN 'sentence' THEN sentences_of(clean_text(c)) WHEN 'paragraph' THEN paragraphs_of(clean_text(c)) END",
    ),
    # Sums of whole numbers over words, as in the stand-in scorer.
    (
        "logits_of_words", "words ARRAY<STRING>", "ARRAY<DOUBLE>",
        "transform(array(1, 3, 5), k -> aggregate(words, 0L, (a, w) -> a + CAST(conv(substring(md5(w), k, 2), 16, 10) AS BIGINT) - 128) / (16.0D * greatest(size(words), 1)))",
    ),
    ("stand_in_logits", "c STRING", "ARRAY<DOUBLE>", "logits_of_words(words_of(c))"),
    ("softmax", "z ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "transform(z, x -> exp(x - array_max(z)) / aggregate(z, 0.0D, (a, y) -> a + exp(y - array_max(z))))"),
    ("argmax_of", "z ARRAY<DOUBLE>", "INT", "CAST(array_position(z, array_max(z)) - 1 AS INT)"),
    ("label_of", "label_id INT", "STRING", f"try_element_at(array({_LABELS}), label_id + 1)"),
    ("probability_map", "z ARRAY<DOUBLE>", "MAP<STRING, DOUBLE>", f"map_from_arrays(array({_LABELS}), transform(softmax(z), p -> round(p, 6)))"),
    ("whole_percent", "p DOUBLE", "INT", "CAST(floor(p * 100 + 0.5D) AS INT)"),
]


def register(spark: SparkSession) -> None:
    """Makes all functions known to the session; those registered before are replaced."""
    for name, given, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS {result} RETURN {body}")
