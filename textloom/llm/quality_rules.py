"""Operator 1, quality rules: distribution divergence against language references.

Every document gives a histogram of character classes and one of common words. The reference of a
language is the sum of its documents' histograms as shares (all documents of ``TRIM_WORDS`` words or more, as the shares of
shorter ones are noise; no sample), estimated twice, the second time without those far from the first estimate of their own language. A document fails if its
Jensen-Shannon distance to the nearest reference exceeds ``base + slope / sqrt(n_words)`` in
either histogram; the slope allows for the noise of short texts, and texts under ``min_words``
words are left to the base rules alone.

Defined results: a null or empty text has zero counts and fails the base rules (under 20 words);
a null language takes part in no reference and is judged by the nearest; one without a list of
common words is judged by the nearest reference's characters alone; without any
reference (no known language) only the base rules decide; repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .textstats import CHAR_CLASSES, COMMON, COMMON_WORDS, profile

MIN_BASE_WORDS, MAX_REPEAT_PERCENT = 20, 30
MIN_WORDS = 20
#: Base and slope of both bounds, measured on labelled documents: the README gives what other bases keep.
CHAR_LIMIT, WORD_LIMIT = (0.05, 1.2), (0.2, 2.5)
#: Documents of at least so many words take part in a reference; in the second estimate, this share of each language's, nearest to its first.
TRIM_WORDS, TRIM_SHARE, BINS = 50, 0.7, 10_000
PARTS = 10**9

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_LANGS = list(COMMON_WORDS)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """doc_id, lang, the base counts and both histograms of each document."""
    schema = C.arrow_schema(
        C.id_type(docs, id_col), lang=pa.string(), **dict.fromkeys(_COUNTS, pa.int64()), chars=pa.list_(pa.int64()), common=pa.list_(pa.int64())
    )

    def row(text: bytes, lang: str | None) -> tuple:
        p = profile(text)
        return (lang, *(p[c] for c in _COUNTS), p["chars"].tolist(), _with_rest(p))

    lang = docs[lang_col].cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    narrow = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"), lang.alias("lang"))
    return narrow.mapInArrow(C.map_rows(row, schema, ("lang",), as_bytes=True), C.spark_schema(schema))


def _with_rest(p: dict) -> list[int]:
    """Counts of the common words, and of all other words."""
    return [*p["common"], p["n_plain"] - sum(p["common"])]


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_BASE_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of each row to the reference; 1 for rows without counts."""
    total = counts.sum(1, keepdims=True)
    p, q = counts / np.maximum(total, 1), reference / reference.sum()
    mid = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        bits = np.where(p > 0, p * np.log2(p / mid), 0).sum(1) + np.where(q > 0, q * np.log2(q / mid), 0).sum(1)
    return np.where(total[:, 0] > 0, np.sqrt(np.maximum(bits / 2, 0)), 1.0)


def _nearest(chars: list, words: list, references: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Both distances of each row to the reference with the least sum of them; infinite without a reference."""
    best = np.full((len(chars), 2), np.inf)
    a, b = (np.array(x, dtype=float).reshape(len(chars), -1) for x in (chars, words))
    for char_sums, word_sums in references if len(chars) else ():
        got = np.stack([_distance(a, char_sums), _distance(b, word_sums)], 1)
        nearer = got.sum(1) < best.sum(1)
        best[nearer] = got[nearer]
    return best


def _references(feats: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Sums of the documents' shares by language: at most as many rows as there are languages with a word list.

    Each document has the same weight, however long. Shares are whole parts of ``PARTS``, so sums don't depend on their order.
    """
    parts = []
    for name in ("chars", "common"):
        total = F.aggregate(name, F.lit(0).cast("long"), lambda a, n: a + n)
        share = F.floor(F.col("n") * F.lit(float(PARTS)) / F.col("total") + F.lit(0.5))
        long = feats.select("lang", total.alias("total"), F.posexplode(name).alias("pos", "n")).filter("n > 0")
        long = long.groupBy("lang", "pos").agg(F.sum(share).alias("n"))
        parts.append(long.select("lang", F.lit(name).alias("part"), "pos", "n"))
    sizes = {"chars": len(CHAR_CLASSES), "common": len(COMMON) + 1}
    sums = {(lang, part): np.zeros(sizes[part]) for lang in _LANGS for part in sizes}
    for r in parts[0].unionAll(parts[1]).collect():
        sums[r.lang, r.part][r.pos] = r.n
    both = {lang: (sums[lang, "chars"], sums[lang, "common"]) for lang in _LANGS}
    return {lang: (a, b) for lang, (a, b) in both.items() if a.sum() and b.sum()}


def _nearer_share(feats: DataFrame, references: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """The rows of each language whose characters are nearest to that language's own reference."""
    schema = pa.schema([("lang", pa.string()), ("chars", pa.list_(pa.int64())), ("common", pa.list_(pa.int64())), ("own", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            langs = np.array(part.column("lang").to_pylist(), dtype=object)
            chars = np.array(part.column("chars").to_pylist(), dtype=float).reshape(-1, len(CHAR_CLASSES))
            own = np.zeros(len(langs))
            for lang, (char_sums, _) in references.items():
                own[langs == lang] = _distance(chars[langs == lang], char_sums)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("lang", "chars", "common")), pa.array(own)], schema=schema)

    near = feats.select("lang", "chars", "common").mapInArrow(run, C.spark_schema(schema))
    # An exact quantile of distances in steps of 1 / BINS: at most BINS + 1 counts for each language, whatever the partitions.
    step = F.floor(F.col("own") * BINS).cast("int")
    counts = sorted((r.lang, r.step, r.n) for r in near.groupBy("lang", step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect())
    limits: dict[str, int] = {}
    for lang in {c[0] for c in counts}:
        own = [(s, n) for name, s, n in counts if name == lang]
        upto = np.cumsum([n for _, n in own])
        limits[lang] = own[int(np.searchsorted(upto, TRIM_SHARE * upto[-1]))][0]
    limit = F.coalesce(*(F.when(F.col("lang") == lang, F.lit(at)) for lang, at in sorted(limits.items())), F.lit(BINS))
    return near.filter(step <= limit)


def _distances(feats: DataFrame, references: list[tuple[np.ndarray, np.ndarray]], keep: tuple[str, ...]) -> DataFrame:
    """Adds char_distance and word_distance to the reference with the least sum of both."""
    fields = [*(f for f in feats.schema.fields if f.name in keep)]
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType([*fields, T.StructField("char_distance", T.DoubleType()), T.StructField("word_distance", T.DoubleType())])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            best = _nearest(part.column("chars").to_pylist(), part.column("common").to_pylist(), references)
            columns = [part.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(best[:, 0]), pa.array(best[:, 1])], schema=schema)

    return feats.mapInArrow(run, out)


def _learned(feats: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """The references, estimated twice from the features of all documents; a language without a second one keeps its first."""
    known = feats.filter(F.col("lang").isin(_LANGS) & ~base_failed() & (F.col("n_words") >= TRIM_WORDS))
    references = _references(known)
    if references:
        references |= _references(_nearer_share(known, references))
    return list(references.values())


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """doc_id, base counts, base_failed, both distances (null without a reference) and kept, one row per input row."""
    scratch = C.Scratch(docs.sparkSession)
    feats = scratch.keep(features(docs, id_col, text_col, lang_col), "quality")
    return _judged(feats, _learned(feats))


def _judged(feats: DataFrame, references: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    nothing = (F.lit(None).cast("double").alias(c) for c in ("char_distance", "word_distance"))
    out = _distances(feats, references, ("doc_id", "lang", *_COUNTS)) if references else feats.select("doc_id", "lang", *_COUNTS, *nothing)
    root = F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    beyond = lambda name, limit: F.col(name) > F.lit(limit[0]) + F.lit(limit[1]) / root
    listed = F.col("lang").isNull() | F.col("lang").isin(_LANGS)
    far = beyond("char_distance", CHAR_LIMIT) | (listed & beyond("word_distance", WORD_LIMIT))
    judged = (F.col("n_words") >= MIN_WORDS) & F.coalesce(far, F.lit(False))
    return out.select("doc_id", *_COUNTS, base_failed().alias("base_failed"), (~base_failed() & ~judged).alias("kept"), "char_distance", "word_distance")


def good_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """All columns of the rows that :func:`quality_rules` keeps.

    The rows are judged where they are read, once the references are known, so texts aren't shuffled.
    """
    with C.Scratch(docs.sparkSession) as scratch:
        references = _learned(scratch.save(features(docs, id_col, text_col, lang_col), "quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.arrow_steps(batches):
            found = [profile(t or b"") for t in part.column(text_col).cast(pa.string()).cast(pa.binary()).to_pylist()]
            langs = part.column(lang_col).to_pylist() if lang_col in part.schema.names else [None] * part.num_rows
            listed = np.array([x is None or str(x) in COMMON_WORDS for x in langs], dtype=bool)
            n, repeats = (np.array([p[c] for p in found], dtype=np.int64) for c in ("n_words", "n_repeat_words"))
            best = _nearest([p["chars"] for p in found], [_with_rest(p) for p in found], references)
            limits = [at + slope / np.sqrt(np.maximum(n, 1)) for at, slope in (CHAR_LIMIT, WORD_LIMIT)]
            far = ((best[:, 0] > limits[0]) | (listed & (best[:, 1] > limits[1]))) & (n >= MIN_WORDS) & bool(references)
            failed = (n < MIN_BASE_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)
            yield part.filter(pa.array(~failed & ~far))

    return docs.mapInArrow(run, docs.schema)
