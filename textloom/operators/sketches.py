"""Distinct counts and quantiles by sketches that are stored by day and merged later.

A sketch has a bounded size however many rows it has seen, so groups are merged map-side and a month is thirty rows, not its
data. The errors are those of HyperLogLog and KLL sketches: :data:`DISTINCT_ERROR` is one standard error, :data:`RANK_ERROR` bounds ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG_K, KLL_K = 12, 200
DISTINCT_ERROR, RANK_ERROR = 1.04 / 2 ** (LOG_K / 2), 0.0133


def sketches(df: DataFrame, by: list[str | Column], distinct: str, value: str) -> DataFrame:
    """by, n, distinct_sketch and value_sketch: sketches of each group, to be stored. Null and NaN values count in n alone."""
    number = F.col(value).cast("double")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(distinct, LOG_K).alias("distinct_sketch"), F.kll_sketch_agg_double(F.when(~F.isnan(number), number), KLL_K).alias("value_sketch")
    )


def merged(stored: DataFrame, by: list[str | Column]) -> DataFrame:
    """Sketches of coarser groups, from stored ones."""
    return stored.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("value_sketch").alias("value_sketch"))


def estimates(stored: DataFrame, quantiles: list[float]) -> DataFrame:
    """The sketches' groups with n_distinct and quantiles, an array in the order asked for; null for a group without values."""
    rest = [c for c in stored.columns if c not in ("distinct_sketch", "value_sketch")]
    some = F.kll_sketch_get_n_double("value_sketch") > 0
    values = F.array(*(F.when(some, F.kll_sketch_get_quantile_double("value_sketch", F.lit(q))) for q in quantiles))
    return stored.select(*rest, F.hll_sketch_estimate("distinct_sketch").alias("n_distinct"), values.alias("quantiles"))
