"""Bounded samples of labelled documents, for the two classifiers of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(id_column.cast("string").cast("binary")) % folds


def training_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, bound: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and label (0 or 1) of at most ``bound`` labelled rows outside the held-out fold.

    Rows are taken by a hash of the id, so the choice is the same each time. Null labels and ids
    are left out; of an id labelled both ways, both rows stay. Only the ids of the sample travel
    to the documents: ``bound`` rows, so that side can be broadcast.
    """
    marked = labels.select(labels[id_col].alias("doc_id"), labels[label].cast("int").alias("label"))
    marked = marked.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    few = marked.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(bound)
    texts = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(few), "doc_id")
