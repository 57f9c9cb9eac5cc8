"""Requests: validation, resolution to text, segmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.html import page_parts
from textloom.functions.segments import MODES, segments_of_clean
from textloom.functions.text import clean_text, enough_words, join_blocks, ordered_distinct, strip
from textloom.functions.urls import looks_like_url, malformed_authority
from textloom.sources.fetch import fetch_pages

# Messages and statuses of failed requests.
NO_INPUT = "Please provide article text or a valid article URL."
NO_SEGMENTS = "No analyzable content was found after preprocessing."
NO_TEXT_ON_PAGE = "Could not extract readable article text from the provided URL."
NO_PAGE = "The page could not be fetched."
BAD_URL = "Invalid IPv6 URL"
LARGE_BODY = "request body is too large"
INVALID, TOO_LARGE, FAILED, FINE = 422, 413, 400, 200
#: Largest body in bytes that the proxy in front of the service lets through.
MAX_BODY = 10 * 1024 * 1024


def with_defaults(requests: DataFrame) -> DataFrame:
    """request_id, input, mode; a missing mode is article."""
    mode = F.coalesce("mode", F.lit("article")) if "mode" in requests.columns else F.lit("article")
    return requests.select("request_id", "input", mode.alias("mode"))


def wire_error(max_body: int | None = None) -> Column:
    """Why a request is refused before anything is done with it, else null."""
    large = F.octet_length("input") > max_body if max_body else F.lit(False)
    short = F.coalesce(F.length("input"), F.lit(0)) < 1
    return F.when(large, LARGE_BODY).when(short, "input must have at least 1 character").when(~F.col("mode").isin(*MODES), "mode must be article, sentence or paragraph")


def validate(requests: DataFrame, max_body: int | None = None) -> DataFrame:
    """Adds status and error; status 200 goes on."""
    error = wire_error(max_body)
    status = F.when(F.col("error").isNull(), FINE).when(F.col("error") == LARGE_BODY, TOO_LARGE).otherwise(INVALID)
    return with_defaults(requests).withColumn("error", error).withColumn("status", status)


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def text_of_page(html: Column) -> Column:
    """Text of a page: blocks of enough words, else lines of enough words, without repeats; null if there are none."""
    enough = lambda texts: F.filter(texts, lambda t: enough_words(t))

    def text(parts: Column) -> Column:
        chosen = _bound(enough(parts["blocks"]), lambda blocks: F.when(F.size(blocks) > 0, blocks).otherwise(enough(parts["lines"])))
        return _bound(join_blocks(ordered_distinct(chosen)), lambda joined: F.when(strip(joined) != "", clean_text(joined)))

    return _bound(page_parts(html), text)


def page_text(pages: DataFrame) -> DataFrame:
    """url and text of each page.

    Of pages with one URL the least by (no text, hash of the HTML) counts, so that the lookup gives one row. Pages are parsed
    where they are read; only their texts travel. A column ``error`` of the pages, if there is one, goes along.
    """
    error = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
    found = pages.select("url", F.xxhash64("html").alias("h"), text_of_page(F.col("html")).alias("page_text"), error.alias("page_error"))
    one = found.groupBy("url").agg(F.min(F.struct(F.col("page_text").isNull().alias("none"), "h", "page_text", "page_error")).alias("least"))
    return one.select("url", "least.page_text", "least.page_error")


def resolve(valid: DataFrame, pages: DataFrame | None) -> DataFrame:
    """request_id, source_type, resolved_text, mode, status, error of validated requests.

    Rows that are plain text never travel: only ids and URLs of the others are joined to pages, and
    only pages that are asked for are parsed.
    """
    typed = valid.withColumn("is_url", (F.col("status") == FINE) & looks_like_url(F.col("input")))
    if pages is None:
        failed = F.when(F.col("is_url"), F.when(malformed_authority(F.col("input")), BAD_URL).otherwise(NO_PAGE)).otherwise(F.col("error"))
        text = F.when((F.col("status") == FINE) & ~F.col("is_url"), clean_text(F.col("input")))
        kind = F.when(F.col("is_url"), "url").otherwise("text")
        return _checked(typed.select("request_id", kind.alias("source_type"), text.alias("resolved_text"), "mode", F.when(F.col("is_url"), FAILED).otherwise(F.col("status")).alias("status"), failed.alias("error")))
    plain = typed.filter(~F.col("is_url")).select(
        "request_id", F.lit("text").alias("source_type"), F.when(F.col("status") == FINE, clean_text(F.col("input"))).alias("resolved_text"), "mode", "status", "error"
    )
    urls = typed.filter("is_url").select("request_id", strip(F.col("input")).alias("asked"), "mode", malformed_authority(F.col("input")).alias("malformed"))
    wanted = urls.select(F.col("asked").alias("url")).distinct()
    texts = page_text(pages.select("url", "html", *(c for c in pages.columns if c == "error")).join(wanted, "url", "left_semi"))
    found = urls.join(texts, urls["asked"] == texts["url"], "left")
    error = F.when(F.col("malformed"), BAD_URL).when(F.col("url").isNull(), NO_PAGE).when(F.col("page_error").isNotNull(), F.col("page_error")).when(F.col("page_text").isNull(), NO_TEXT_ON_PAGE)
    linked = found.select(
        "request_id", F.lit("url").alias("source_type"), F.when(error.isNull(), F.col("page_text")).alias("resolved_text"), "mode",
        F.when(error.isNull(), FINE).otherwise(FAILED).alias("status"), error.alias("error"),
    )
    return _checked(plain.unionByName(linked))


def asked_urls(valid: DataFrame) -> DataFrame:
    """url: the distinct addresses that validated requests ask for, in the form of the table of pages."""
    urls = valid.filter((F.col("status") == FINE) & looks_like_url(F.col("input")) & ~F.coalesce(malformed_authority(F.col("input")), F.lit(False)))
    return urls.select(strip(F.col("input")).alias("url")).distinct()


def resolve_online(valid: DataFrame, hosts: frozenset[str], **how) -> DataFrame:
    """As :func:`resolve`, with pages fetched from the web; a failed fetch fails its request with the reason."""
    return resolve(valid, fetch_pages(asked_urls(valid), hosts, **how))


def _checked(out: DataFrame) -> DataFrame:
    """Requests whose text is empty fail."""
    empty = (F.col("status") == FINE) & (F.col("resolved_text") == "")
    return out.select(
        "request_id", "source_type", "resolved_text", "mode",
        F.when(empty, FAILED).otherwise(F.col("status")).alias("status"), F.when(empty, NO_INPUT).otherwise(F.col("error")).alias("error"),
    )


def with_segments(resolved: DataFrame) -> DataFrame:
    """Adds segments, null for failed requests; a request without segments fails. Resolved text is clean already."""
    out = resolved.withColumn("segments", F.when(F.col("status") == FINE, segments_of_clean(F.col("resolved_text"), F.col("mode"))))
    none = (F.col("status") == FINE) & (F.size("segments") == 0)
    return out.withColumn("error", F.when(none, NO_SEGMENTS).otherwise(F.col("error"))).withColumn("status", F.when(none, FAILED).otherwise(F.col("status")))


def enumerate_segments(segmented: DataFrame, *keep: str) -> DataFrame:
    """One row for each segment, numbered from 0 in order; none for null or empty lists.

    The plain form of the generator would add a filter on the list, which computes all segments once more.
    """
    return enumerate_segments_outer(segmented, *keep).filter(F.col("segment_index").isNotNull())


def enumerate_segments_outer(segmented: DataFrame, *keep: str) -> DataFrame:
    """As :func:`enumerate_segments`, with one row of nulls for a failed request (an extension)."""
    return segmented.select(*keep, F.posexplode_outer("segments").alias("segment_index", "text"))
