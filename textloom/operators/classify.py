"""Classification of segments by an exchangeable scorer.

A scorer maps a table with a text column to the same table with logits z0, z1, z2. The one here by
default is a STAND-IN without any political meaning: it derives logits from hashes of words, so that
the whole dataflow gives exact results without the model's weights, which aren't published.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from pathlib import Path
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.scores import argmax, label_of, probability_map, rounded, softmax
from textloom.functions.text import words
from textloom.functions.tokens import MAX_LENGTH, PAD_ID

log = logging.getLogger("textloom")

LOGITS = ("z0", "z1", "z2")
#: Files that a model folder must have; in place of the weights it may have an export, which then counts.
MODEL_FILES = ("config.json", "model.safetensors", "tokenizer.json")
EXPORT = "model.onnx"
# Fixed value: the message for missing files.
NOT_READY = "Model directory not ready at '{folder}'. Missing: {missing}."


#: Column of scorers that can fail on a text: why, else null. Logits are null then.
SCORE_ERROR = "scorer_error"


class Scorer(Protocol):
    """Adds z0, z1 and z2 to a table with a text column, and ``SCORE_ERROR`` if it can fail."""

    def logits(self, df: DataFrame, text_col: str) -> DataFrame: ...


def hashed_logits(text: Column) -> Column:
    """struct<z0, z1, z2> from whole-number sums over words, so the order of words doesn't matter."""

    zero = F.struct(*(F.lit(0).cast("long").alias(z) for z in LOGITS), F.lit(0).cast("long").alias("n"))
    scale = lambda a: F.struct(*((a[z] / (16.0 * F.greatest(a["n"], F.lit(1)))).alias(z) for z in LOGITS))
    # The hash of a word takes three bytes; binding it to an element computes it once.
    hashed = F.transform(words(text), lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 6), 16, 10).cast("long"))

    def step(acc: Column, bits: Column) -> Column:
        parts = (F.shiftright(bits, 8 * (2 - k)).bitwiseAND(F.lit(255)) - 128 for k in range(3))
        return F.struct(*((acc[z] + p).alias(z) for z, p in zip(LOGITS, parts, strict=True)), (acc["n"] + 1).alias("n"))

    return F.aggregate(hashed, zero, step, scale)


class StandIn:
    """The stand-in scorer: JVM only, no shuffle."""

    def column(self, text: Column) -> Column:
        return hashed_logits(text)

    def logits(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        kept = df.columns
        return df.withColumn("z__", hashed_logits(F.col(text_col))).select(*kept, *(F.col(f"z__.{z}").alias(z) for z in LOGITS))


class ModelFolder:
    """A sequence classifier with its tokenizer, in a folder that every executor can read under the same path.

    The folder holds ``config.json``, ``tokenizer.json`` (the fast tokenizer's own file) and the weights of a
    RoBERTa classifier as ``model.safetensors``, as its training saves them. Instead of the weights it may hold
    any classifier as ``model.onnx`` with two inputs, ``input_ids`` and ``attention_mask``, int64 of shape (batch,
    length), and logits as first output, float of shape (batch, 3) in the order of ``scores.LABELS``.

    Tokenizer and session are loaded once in each Python worker; batches are padded to their longest
    member, which the attention mask makes equal to a fixed length. A text that tokenizer or model
    refuses has no logits and says why in ``SCORE_ERROR``; the other texts of its batch are scored.
    """

    def __init__(self, folder: str):
        self.folder = str(Path(folder).expanduser().resolve())
        there = lambda f: (Path(self.folder) / f).exists()
        missing = [f for f in MODEL_FILES if not there(f) and not (f == "model.safetensors" and there(EXPORT))]
        if missing:
            raise FileNotFoundError(NOT_READY.format(folder=self.folder, missing=", ".join(missing)))

    def logits(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        folder = self.folder

        @F.pandas_udf(f"struct<z0:double,z1:double,z2:double,{SCORE_ERROR}:string>")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            encode, run = _loaded(folder)

            def of(texts: list[str]) -> list[tuple]:
                try:
                    return [(*map(float, row), None) for row in run(*encode(texts))]
                except Exception as e:  # noqa: BLE001 - whatever a tokenizer or session raises fails its own text only
                    if len(texts) > 1:
                        return [row for t in texts for row in of([t])]
                    log.warning("a text was not scored: %s", e)
                    return [(None, None, None, str(e) or type(e).__name__)]

            for texts in batches:
                yield pd.DataFrame(of(texts.fillna("").tolist()), columns=[*LOGITS, SCORE_ERROR])

        kept = df.columns
        return df.withColumn("z__", score(F.col(text_col))).select(*kept, *(F.col(f"z__.{z}").alias(z) for z in (*LOGITS, SCORE_ERROR)))


_workers: dict[str, tuple] = {}


def _loaded(folder: str) -> tuple:
    """encode: texts to ids and masks; run: those to logits."""
    if folder not in _workers:
        import numpy as np
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(f"{folder}/tokenizer.json")
        tokenizer.no_padding()
        tokenizer.enable_truncation(max_length=MAX_LENGTH)

        def encode(texts: list[str]) -> tuple:
            return ([(e.ids, e.attention_mask) for e in tokenizer.encode_batch(texts)],)

        if (Path(folder) / EXPORT).exists():
            import onnxruntime

            session = onnxruntime.InferenceSession(f"{folder}/{EXPORT}", providers=["CPUExecutionProvider"])

            def run(encoded: list[tuple]):
                longest = max((len(ids) for ids, _ in encoded), default=0)
                padded = lambda values, fill: np.array([[*v, *[fill] * (longest - len(v))] for v in values], dtype=np.int64)
                inputs = {"input_ids": padded([e[0] for e in encoded], PAD_ID), "attention_mask": padded([e[1] for e in encoded], 0)}
                return session.run(None, inputs)[0] if encoded else np.zeros((0, 3))
        else:
            from .roberta import Roberta

            run = Roberta(folder).in_parts
        _workers[folder] = (encode, run)
    return _workers[folder]


def result_of(text: Column, index: Column, z: Column) -> Column:
    """struct<segment_index, text, label, label_id, probabilities> from the logits of one segment, which are computed once."""

    def build(z: Column) -> Column:
        logits = [z[c] for c in LOGITS]
        label_id = argmax(logits)
        return F.struct(
            index.alias("segment_index"), text.alias("text"), label_of(label_id).alias("label"), label_id.alias("label_id"),
            probability_map([rounded(p) for p in softmax(logits)]).alias("probabilities"),
        )

    return F.get(F.transform(F.array(z), build), 0)


def warm(spark: SparkSession, scorer: Scorer) -> None:
    """Loads the scorer in the Python workers ahead of the first query: one short text for each core."""
    cores = spark.sparkContext.defaultParallelism
    texts = spark.range(0, cores, 1, cores).select(F.lit("warm").alias("text"))
    done = scorer.logits(texts, "text")
    why = F.max(SCORE_ERROR) if SCORE_ERROR in done.columns else F.lit(None)
    n, error = done.agg(F.count("z0"), why).first()
    if n < cores:
        raise RuntimeError(f"the scorer can't score: {error}")
    log.info("scorer ready on %d cores", n)


def scored(segments: DataFrame, scorer: Scorer | None = None, text_col: str = "text") -> DataFrame:
    """Adds label, label_id, p_left, p_right, p_center: rounded probabilities, and the argmax of the unrounded logits.

    Scorers that can fail also add ``SCORE_ERROR``; the other columns are null for a failed text.
    """
    z = (scorer or StandIn()).logits(segments, text_col)
    kept = [*segments.columns, *(c for c in (SCORE_ERROR,) if c in z.columns)]
    logits = [F.col(c) for c in LOGITS]
    p_left, p_right, p_center = map(rounded, softmax(logits))
    label_id = argmax(logits)
    return z.select(*kept, label_of(label_id).alias("label"), label_id.alias("label_id"), p_left.alias("p_left"), p_right.alias("p_right"), p_center.alias("p_center"))


def scored_distinct(segments: DataFrame, scorer: Scorer | None = None, text_col: str = "text") -> DataFrame:
    """As :func:`scored`, with each distinct text scored once (an extension for costly scorers)."""
    once = scored(segments.select(F.col(text_col).alias("text__")).distinct(), scorer, "text__")
    return segments.join(once, F.col(text_col).eqNullSafe(F.col("text__")), "left").drop("text__")
