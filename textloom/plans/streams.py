"""Queries that run streams over the tables (extensions): assembly of responses, requests that wait for pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.classify import scored
from textloom.operators.predict import prepared
from textloom.operators.requests import BAD_URL, NO_INPUT, NO_PAGE, enumerate_segments
from textloom.sources import page_source
from textloom.sources.tables import read_table, requests_of, spread
from textloom.streaming.assembly import assemble
from textloom.streaming.pages import resolve_stream
from textloom.streaming.run import arrivals, files_for, finish, shared_folder

from . import oracles
from .registry import Plans

plans = Plans()

NOT_SCORED = "the segment could not be scored"


def _at(seconds: str) -> F.Column:
    return F.timestamp_seconds(F.expr(f"1704067200 + {seconds}"))


@plans.query(
    oracles.predicted(
        "paragraph",
        f"""SELECT request_id, count(*)::INTEGER AS n_segments, CASE WHEN request_id % 10 <= 1 AND (request_id % 10 = 1 OR count(*) > 1) THEN 400 ELSE 200 END AS status,
CASE WHEN request_id % 10 = 0 AND count(*) > 1 THEN (count(*) - 1) || ' of ' || count(*) || ' segments arrived' WHEN request_id % 10 = 1 THEN '{NOT_SCORED}' END AS error,
CASE WHEN request_id % 10 > 1 OR (request_id % 10 = 0 AND count(*) = 1) THEN string_agg(segment_index || label, ',' ORDER BY segment_index) END AS labels,
CASE WHEN request_id % 10 > 1 OR (request_id % 10 = 0 AND count(*) = 1) THEN sha256(string_agg(text, chr(10) ORDER BY segment_index)) END AS texts_sha256
FROM pred GROUP BY request_id""",
    )
)
def ext_stream_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored paragraphs arrive in three parts, some twice; ids divisible by 10 lack their last one, ids before 2 of 10 have one that wasn't scored."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = prepared(requests_of(docs, "doc_id", "text", "paragraph")).withColumn("n_segments", F.size("segments"))
    rows = scored(enumerate_segments(base.filter("status = 200"), "request_id", "mode", "n_segments"))
    failed = F.when((F.col("request_id") % 10 == 1) & (F.col("segment_index") == 0), NOT_SCORED)
    rows = rows.withColumn("error", failed).withColumn("at", _at("request_id % 60"))
    rows = rows.filter((F.col("request_id") % 10 != 0) | (F.col("n_segments") == 1) | (F.col("segment_index") < F.col("n_segments") - 1))
    folder = shared_folder(spark, "assembly")
    saved = f"{folder}/scored"
    rows.write.parquet(saved)
    rows = spark.read.parquet(saved)
    # The last part moves the clock beyond all timers.
    last = rows.select("request_id").limit(1).select(*(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns)).withColumns(
        {"request_id": F.lit(-1).cast("long"), "mode": F.lit("article"), "n_segments": F.lit(1), "segment_index": F.lit(0), "at": _at("86400")}
    )
    stream = arrivals([rows.filter("segment_index % 2 = 1"), rows.filter("segment_index % 4 IN (0, 1)"), rows.filter("segment_index % 2 = 0"), last], folder, "in", files_for(rows))
    done = finish(assemble(stream.withWatermark("at", "1 minute"), 600, "at"), folder).filter("request_id >= 0")
    listed = F.array_join(F.transform("results", lambda r: F.concat(r["segment_index"].cast("string"), r["label"])), ",")
    texts = F.array_join(F.transform("results", lambda r: r["text"]), "\n")
    return done.select("request_id", "n_segments", "status", "error", listed.alias("labels"), F.sha2(texts, 256).alias("texts_sha256"))


@plans.query(f"""
WITH RECURSIVE {oracles.pages()},
asked AS (
  SELECT page_id, 1 AS copy, url AS input FROM pages
  UNION ALL SELECT page_id, 2, CASE page_id % 3 WHEN 0 THEN ' ' || chr(9) WHEN 1 THEN 'http://[bad' ELSE 'Plain words. ' || page_id END FROM pages),
found AS (
  SELECT a.page_id, copy, input, p.url IS NOT NULL AS has_page, t.page_text FROM asked a
  LEFT JOIN pages p ON a.copy = 1 AND p.page_id = a.page_id AND a.page_id % 7 <> 0 AND a.page_id % 7 <> 1 LEFT JOIN texts t ON t.page_id = p.page_id)
SELECT page_id * 2 + copy AS request_id, CASE WHEN copy = 1 OR page_id % 3 = 1 THEN 'url' ELSE 'text' END AS source_type,
       CASE WHEN copy = 1 AND has_page AND page_text IS NOT NULL OR copy = 2 AND page_id % 3 = 2 THEN 200 ELSE 400 END AS status,
       CASE WHEN copy = 1 AND NOT has_page THEN '{NO_PAGE}' WHEN copy = 2 AND page_id % 3 = 0 THEN '{NO_INPUT}' WHEN copy = 2 AND page_id % 3 = 1 THEN '{BAD_URL}'
         WHEN copy = 1 AND page_text IS NULL THEN 'Could not extract readable article text from the provided URL.' END AS error,
       sha256(CASE WHEN copy = 1 AND has_page THEN page_text WHEN copy = 2 AND page_id % 3 = 2 THEN 'Plain words. ' || page_id WHEN copy = 2 AND page_id % 3 = 0 THEN '' END) AS text_sha256
FROM found""")
def ext_stream_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page is asked for; of 7 pages one never comes and one comes too late. Texts, blanks and bad addresses are asked beside them, some requests twice."""
    pages = read_table(spark, sf_dir, "pages")
    folder = shared_folder(spark, "pages")
    asked_at = _at("page_id % 600").alias("asked_at")
    other = F.when(F.col("page_id") % 3 == 0, " \t").when(F.col("page_id") % 3 == 1, "http://[bad").otherwise(F.concat(F.lit("Plain words. "), F.col("page_id").cast("string")))
    asked = pages.select((F.col("page_id") * 2 + 1).alias("request_id"), F.col("url").alias("input"), F.lit("article").alias("mode"), asked_at)
    asked = asked.unionAll(pages.select((F.col("page_id") * 2 + 2).alias("request_id"), other.alias("input"), F.lit(None).cast("string").alias("mode"), asked_at))
    delay = F.when(F.col("page_id") % 7 == 1, 3600).otherwise(F.col("page_id") % 300)
    came = pages.filter("page_id % 7 <> 0").select("page_id", "url", "html", F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") % 600 + delay).alias("fetched_at"))
    closing = spark.range(1)
    last_asked = closing.select(F.lit(-1).cast("long").alias("request_id"), F.lit("the end").alias("input"), F.lit("article").alias("mode"), _at("864000").alias("asked_at"))
    last_page = closing.select(F.lit(-1).cast("long").alias("page_id"), F.lit("http://end.example/").alias("url"), F.lit("").alias("html"), _at("864000").alias("fetched_at"))
    requests = arrivals([asked.filter("request_id % 4 < 2"), asked.filter("request_id % 4 > 0"), last_asked], folder, "requests", files_for(pages.select("page_id", "url")))
    fetched = arrivals([came.filter("fetched_at < timestamp_seconds(1704067200 + 1200)"), came.filter("fetched_at >= timestamp_seconds(1704067200 + 1200)"), last_page], folder, "pages", files_for(pages))
    done = finish(resolve_stream(requests, fetched, "10 minutes", "1 hour", "30 minutes"), folder)
    return done.filter("request_id > 0").select("request_id", "source_type", "status", "error", F.sha2("resolved_text", 256).alias("text_sha256"))


@plans.query("""
WITH kept AS (SELECT url, min(html) AS html FROM pages WHERE page_id % 9 <> 0 GROUP BY url)
SELECT page_id % 3 = 0 AS is_third, p.url, CASE WHEN k.html IS NULL THEN 404 ELSE 200 END AS status, CASE WHEN k.html IS NULL THEN 'HTTP 404' END AS error, sha256(k.html) AS html_sha256
FROM (SELECT page_id, url FROM pages) p LEFT JOIN kept k ON k.url = p.url""")
def ext_saved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed URLs by the page source, from an archive that lacks every ninth page; one list for every third page, one for the others."""
    pages = read_table(spark, sf_dir, "pages")
    folder = shared_folder(spark, "archive")
    page_source.write_archive(pages.filter("page_id % 9 <> 0"), f"{folder}/archive", max(1, pages.count() // 200))
    found = []
    for third in (True, False):
        pages.filter((F.col("page_id") % 3 == 0) == third).select("url").write.mode("append").text(f"{folder}/list-{third}")
        saved = page_source.saved_pages(spark, f"{folder}/{third}", list=f"{folder}/list-{third}", archive=f"{folder}/archive")
        found.append(saved.select(F.lit(third).alias("is_third"), "url", "status", "error", F.sha2("html", 256).alias("html_sha256")))
    return found[0].unionAll(found[1])
