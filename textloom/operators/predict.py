"""The dataflow from requests to predictions and nested responses."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.scores import probability_map

from .classify import SCORE_ERROR, Scorer, StandIn, result_of, scored
from .requests import FAILED, FINE, MAX_BODY, enumerate_segments, resolve, validate, with_segments

log = logging.getLogger("textloom")


def prepared(requests: DataFrame, pages: DataFrame | None = None, max_body: int | None = MAX_BODY) -> DataFrame:
    """Validated, resolved and segmented requests, one row each, failed ones with status and error."""
    return with_segments(resolve(validate(requests, max_body), pages))


def predictions(requests: DataFrame, pages: DataFrame | None = None, scorer: Scorer | None = None) -> DataFrame:
    """One row for each segment of the requests that didn't fail; one segment that can't be scored fails its whole request."""
    rows = scored(enumerate_segments(prepared(requests, pages), "request_id", "mode"), scorer)
    if SCORE_ERROR not in rows.columns:
        return rows
    failed = F.count(SCORE_ERROR).over(Window.partitionBy("request_id"))
    return rows.withColumn(SCORE_ERROR, failed).filter(F.col(SCORE_ERROR) == 0).drop(SCORE_ERROR)


def responses(requests: DataFrame, pages: DataFrame | None = None, scorer: Scorer | None = None, fail_fast: bool = False) -> DataFrame:
    """request_id, source_type, resolved_text, mode, status, error and results in order; failed requests have null results.

    A scorer that is a column is applied to the list of segments where it stands, without a shuffle. For others the
    rows are scored and gathered again by request. With ``fail_fast`` the first failed request ends the query.
    """
    scorer = scorer or StandIn()
    base = prepared(requests, pages)
    if fail_fast:
        checked = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.col("status"))
        base = base.withColumn("status", checked)
    if hasattr(scorer, "column"):
        results = F.when(F.col("status") == FINE, F.transform("segments", lambda t, i: result_of(t, i, scorer.column(t))))
        return base.withColumn("results", results).drop("segments")
    rows = scored(enumerate_segments(base.filter(F.col("status") == FINE), "request_id"), scorer)
    result = F.struct(
        "segment_index", "text", "label", "label_id", probability_map([F.col("p_left"), F.col("p_right"), F.col("p_center")]).alias("probabilities")
    )
    sums = [F.array_sort(F.collect_list(result), lambda a, b: a["segment_index"] - b["segment_index"]).alias("results")]
    if SCORE_ERROR in rows.columns:
        sums.append(F.min_by(SCORE_ERROR, F.when(F.col(SCORE_ERROR).isNotNull(), F.col("segment_index"))).alias(SCORE_ERROR))
    done = base.drop("segments").join(rows.groupBy("request_id").agg(*sums), "request_id", "left")
    if SCORE_ERROR not in rows.columns:
        return done
    failed = F.col(SCORE_ERROR).isNotNull()
    return done.select(
        *(c for c in base.columns if c not in ("status", "error", "segments")),
        F.when(failed, FAILED).otherwise(F.col("status")).alias("status"), F.coalesce(SCORE_ERROR, "error").alias("error"), F.when(~failed, F.col("results")).alias("results"),
    )


def response_json(done: DataFrame) -> DataFrame:
    """request_id and the response as JSON text, for requests that didn't fail."""
    body = F.when(F.col("status") == FINE, F.to_json(F.struct("source_type", "resolved_text", "mode", "results")))
    # A filter on the status would be pushed below the segments and compute them, and the text, once more.
    return done.select("request_id", F.explode_outer(F.array(body)).alias("body")).filter(F.col("body").isNotNull())


def log_failures(done: DataFrame, most: int = 100) -> int:
    """Logs the failed requests, ``most`` of them in full with the least ids, and gives their number."""
    failed = done.filter(F.col("status") != FINE).select("request_id", "status", "error")
    n = failed.count()
    for r in failed.orderBy("request_id").limit(most).collect() if n else ():
        log.warning("request %s failed with status %s: %s", r.request_id, r.status, r.error)
    return n


def health(spark) -> DataFrame:
    return spark.range(1).select(F.lit("ok").alias("status"))
