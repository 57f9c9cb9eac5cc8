"""What changed between two runs, as multisets of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def multiset_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """The rows whose number differs, with n_before and n_after; columns of the two must have the same names.

    One shuffle, after rows of a task are counted, so a row that comes very often is one row for each task. Nulls equal nulls.
    """
    names = before.columns
    if set(names) != set(after.columns):
        raise ValueError(f"columns differ: {sorted(set(names) ^ set(after.columns))}")
    if taken := {"n_before", "n_after"} & set(names):
        raise ValueError(f"rename these columns: {sorted(taken)}")
    both = before.select("*", F.lit(1).alias("n_before"), F.lit(0).alias("n_after")).unionByName(after.select("*", F.lit(0).alias("n_before"), F.lit(1).alias("n_after")))
    sums = both.groupBy(*names).agg(F.sum("n_before").alias("n_before"), F.sum("n_after").alias("n_after"))
    return sums.filter("n_before <> n_after")


def kept_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """The rows of both, each as often as in the one that has fewer."""
    return before.select(*before.columns).intersectAll(after.select(*before.columns))
