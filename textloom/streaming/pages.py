"""Requests for web pages on a stream: each waits a bounded time for its page, which arrives on a stream of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import clean_text, strip
from textloom.functions.urls import looks_like_url, malformed_authority
from textloom.operators.requests import BAD_URL, FAILED, FINE, INVALID, LARGE_BODY, NO_INPUT, NO_PAGE, NO_TEXT_ON_PAGE, TOO_LARGE, text_of_page, wire_error


def resolve_stream(requests: DataFrame, pages: DataFrame, wait: str = "10 minutes", keep: str = "1 hour", late: str = "5 minutes", max_body: int | None = None) -> DataFrame:
    """request_id, source_type, resolved_text, mode, status and error of streamed requests.

    ``requests`` has request_id, input, mode and asked_at, ``pages`` has url, html and fetched_at. A request that comes again counts once, as
    does a page. A page counts for a request if it was fetched from ``keep`` before it to ``wait`` after it; a request without such a page
    fails once the watermarks have passed that time. Rows more than ``late`` behind the latest of their stream are dropped.

    Texts don't wait: only requests for pages go into the join. Its state holds texts of pages, no HTML, of ``wait`` and ``keep`` back.
    """
    mode = F.coalesce("mode", F.lit("article"))
    timed = requests.select("request_id", "input", mode.alias("mode"), "asked_at").withWatermark("asked_at", late).dropDuplicatesWithinWatermark(["request_id"])
    given = timed.withColumn("error", wire_error(max_body))
    status = F.when(F.col("error").isNull(), FINE).when(F.col("error") == LARGE_BODY, TOO_LARGE).otherwise(INVALID)
    typed = given.withColumn("status", status).withColumn("is_url", (F.col("status") == FINE) & looks_like_url(F.col("input")))

    text = F.when(F.col("status") == FINE, clean_text(F.col("input")))
    empty = (F.col("status") == FINE) & (text == "")
    plain = typed.filter(~F.col("is_url")).select(
        "request_id", F.lit("text").alias("source_type"), text.alias("resolved_text"), "mode", F.when(empty, FAILED).otherwise(F.col("status")).alias("status"), F.when(empty, NO_INPUT).otherwise(F.col("error")).alias("error")
    )

    saved = pages.select(F.col("url").alias("page_url"), "html", "fetched_at").withWatermark("fetched_at", late).dropDuplicatesWithinWatermark(["page_url"])
    saved = saved.select("page_url", "fetched_at", text_of_page(F.col("html")).alias("page_text"))
    asked = typed.filter("is_url").select("request_id", strip(F.col("input")).alias("asked"), "mode", "asked_at", malformed_authority(F.col("input")).alias("malformed"))
    in_time = (F.col("fetched_at") >= F.col("asked_at") - F.expr(f"INTERVAL {keep}")) & (F.col("fetched_at") <= F.col("asked_at") + F.expr(f"INTERVAL {wait}"))
    met = asked.join(saved, (F.col("asked") == F.col("page_url")) & in_time, "leftOuter")
    error = F.when(F.col("malformed"), BAD_URL).when(F.col("page_url").isNull(), NO_PAGE).when(F.col("page_text").isNull(), NO_TEXT_ON_PAGE)
    linked = met.select(
        "request_id", F.lit("url").alias("source_type"), F.when(error.isNull(), F.col("page_text")).alias("resolved_text"), "mode", F.when(error.isNull(), FINE).otherwise(FAILED).alias("status"), error.alias("error")
    )
    return plain.unionByName(linked)
