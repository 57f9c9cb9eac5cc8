"""Tables in and out: requests, pages, predictions, responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUESTS = "request_id bigint, input string, mode string"
PAGES = "page_id bigint, url string, html string"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Tables up to this many bytes are dealt out to all cores: their files often have a single row group, which one task reads.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """The same rows over all cores if the table is small; larger ones are split well enough by their files and aren't shuffled."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if int(str(size)) <= SPREAD_BYTES and cores > 1 else df


def read_requests(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Requests as Parquet or as one JSON object a line; the schema is declared, not inferred."""
    return spark.read.schema(REQUESTS).format(form).load(path)


def requests_of(df: DataFrame, id_col: str, text_col: str, mode: str = "article") -> DataFrame:
    """Requests made of a table of texts."""
    return df.select(F.col(id_col).alias("request_id"), F.col(text_col).alias("input"), F.lit(mode).alias("mode"))


def ordered(predictions: DataFrame) -> DataFrame:
    """In document order: a range sort, for a sink that is read from front to back; nothing before it needs order."""
    return predictions.orderBy("request_id", "segment_index")


def write_predictions(predictions: DataFrame, path: str, form: str = "parquet", in_order: bool = False) -> None:
    (ordered(predictions) if in_order else predictions).write.format(form).save(path)


def write_responses(responses: DataFrame, path: str) -> None:
    """Nested responses as JSON lines."""
    responses.write.json(path)
