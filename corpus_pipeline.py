"""A corpus cleaned and mixed by stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession

from textloom.llm.common import Scratch, arrow_rows
from textloom.llm.decontamination import clean_documents
from textloom.llm.mixing import mixed_documents
from textloom.llm.quality_rules import good_documents
from textloom.llm.near_copies import one_of_each
from textloom.llm.secret_scan import redact_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: those that fail the base rules (null and empty texts among them) or lie far from every language.

    Each of several equal rows is judged alike; null ids and a null language don't matter.
    """
    return good_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard similarity of five-word shingles 0.8 or more) the document with the least id stays.

    Null ids come last; of one id the least hash of the text stays, and of rows equal in both one. Texts
    without words, null or not, are copies of each other.
    """
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go: 0.8 or more of its distinct five-word shingles.

    Rows that share an id count as one document; rows with a null id, and texts under five words, stay.
    """
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced; all documents stay, repeated rows and null texts too."""
    return redact_documents(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the times and words taken.

    A null text has no words; null ids share one place in the order of the hash; equal rows fare alike.
    """
    return mixed_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("secret_scan", secrets),
    ("mixing", mixture),
]

#: Rows of an Arrow batch; a batch of 10,000 long texts takes tens of MB several times over in every task.
BATCH_ROWS = 2048

#: The stages hash and compare in ways that SQL doesn't share; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the table of a stage goes when the next is written, or when one fails."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with arrow_rows(spark, BATCH_ROWS), contextlib.ExitStack() as before:
        for name, stage in STAGES[:-1]:
            scratch = Scratch(spark)
            with contextlib.ExitStack() as now:
                now.callback(scratch.drop)
                docs = scratch.save(stage(spark, docs, sf_dir), name)
                before.close()
                before.push(now.pop_all())
        name, stage = STAGES[-1]
        return Scratch(spark).keep(stage(spark, docs, sf_dir), name)
