"""Properties in JSON text, parsed once to a variant and read by typed paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MALFORMED = "malformed JSON"


def parsed(df: DataFrame, column: str, fail_fast: bool = False) -> DataFrame:
    """Adds ``variant``, the parsed text, and ``error``, why it isn't: null text has neither. With ``fail_fast`` the first malformed text ends the query."""
    variant = F.try_parse_json(column)
    bad = F.col(column).isNotNull() & F.col("variant").isNull()
    why = F.raise_error(F.concat(F.lit(f"{MALFORMED}: "), F.left(column, F.lit(100)))) if fail_fast else F.lit(MALFORMED)
    return df.withColumn("variant", variant).withColumn("error", F.when(bad, why).cast("string"))


def typed(paths: dict[str, tuple[str, str]]) -> list[Column]:
    """Columns of ``variant``: name to path and type, cast where the value has another; null where the path is missing or the cast isn't possible."""
    return [F.try_variant_get("variant", path, kind).alias(name) for name, (path, kind) in paths.items()]


def schema_of(df: DataFrame) -> DataFrame:
    """One row: the merged schema of all variants, as found in the data."""
    return df.agg(F.schema_of_variant_agg("variant").alias("schema"))
