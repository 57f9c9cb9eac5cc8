"""Queries of table functions, SQL functions, sketches, variants, layouts, windows and diffs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import sql_functions, table_functions
from textloom.operators import diff, properties, sketches
from textloom.operators.predict import predictions
from textloom.sources.layout import write_layout
from textloom.sources.tables import read_table, requests_of, spread
from textloom.streaming import windows
from textloom.streaming.run import at_exit, shared_folder

from . import oracles
from .registry import Plans

plans = Plans()


@plans.query(f"WITH RECURSIVE {oracles.pages()} SELECT page_id, block_index, text FROM blocks")
def sql_page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of pages by the table function, in a lateral join."""
    table_functions.register(spark)
    pages = spread(read_table(spark, sf_dir, "pages").select("page_id", "html"))
    return spark.sql("SELECT p.page_id, b.block_index, b.text FROM {pages} p, LATERAL page_blocks(p.html) b", pages=pages)


@plans.query(f"""WITH RECURSIVE {oracles.pages()}, firsts AS (SELECT url, min(page_id) AS page_id FROM pages GROUP BY url)
SELECT url, page_id, block_index, text FROM blocks JOIN firsts USING (page_id)""")
def sql_blocks_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the first page of each URL; ids and URLs are compared before, so that no task reads all pages of a frequent URL."""
    table_functions.register(spark)
    pages = read_table(spark, sf_dir, "pages")
    first = "SELECT p.url, p.page_id, p.html FROM {pages} p JOIN (SELECT url, min(page_id) AS page_id FROM {pages} GROUP BY url) f ON p.url = f.url AND p.page_id = f.page_id"
    return spark.sql(f"SELECT * FROM blocks_by_url(TABLE({first}))", pages=pages)


@plans.query(oracles.predicted("sentence", "SELECT request_id, segment_index, text, label, label_id, p_left, p_right, p_center FROM pred"))
def sql_predict_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole flow in SQL."""
    sql_functions.register(spark)
    return spark.sql(
        """
        WITH lists AS (SELECT doc_id AS request_id, segment_text(text, 'sentence') AS segments FROM {documents}),
        parts AS (SELECT request_id, segment_index, part AS text FROM lists LATERAL VIEW posexplode_outer(segments) AS segment_index, part),
        scored AS (SELECT *, stand_in_logits(text) AS z FROM parts WHERE segment_index IS NOT NULL),
        named AS (SELECT *, probability_map(z) AS p, argmax_of(z) AS label_id FROM scored)
        SELECT request_id, segment_index, text, label_of(label_id) AS label, label_id, p['LEFT'] AS p_left, p['RIGHT'] AS p_right, p['CENTER'] AS p_center FROM named""",
        documents=spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")),
    )


@plans.query(f"""
WITH given AS (SELECT doc_id, {oracles.DIRTY} AS text FROM documents)
SELECT doc_id, {oracles.clean('text')} AS clean, len(regexp_extract_all(text, '\\S+'))::INTEGER AS n_words, len(regexp_extract_all(text, '\\S+')) >= 8 AS enough, len(regexp_extract_all(text, '\\S+')) >= 100 AS many FROM given""")
def sql_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaning and counting in SQL, on texts with tabs, carriage returns and blank lines put into them."""
    sql_functions.register(spark)
    dirty = r"concat(' \t ', replace(replace(text, '. ', '.  \t'), '\n', '\r\n\r\r \n\r\n'), ' \n ')"
    return spark.sql(
        f"SELECT doc_id, clean_text(dirty) AS clean, word_count(dirty) AS n_words, enough_words(dirty) AS enough, enough_words(dirty, 100) AS many FROM (SELECT doc_id, {dirty} AS dirty FROM {{documents}})",
        documents=spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")),
    )


@plans.query("SELECT kind, count(*) AS n, count(DISTINCT client_id) AS n_clients, true AS distinct_near, true AS quantiles_near FROM clicks GROUP BY kind")
def ext_click_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients and values by kind, from sketches stored by day; beside the exact counts, whether the estimates are within four standard errors."""
    clicks = read_table(spark, sf_dir, "clicks").select("kind", F.to_date("ts").alias("day"), "client_id", "value")
    folder = shared_folder(spark, "sketches")
    sketches.sketches(clicks, ["kind", "day"], "client_id", "value").write.parquet(f"{folder}/daily")
    quantiles = [0.1, 0.5, 0.9, 0.99]
    found = sketches.estimates(sketches.merged(spark.read.parquet(f"{folder}/daily"), ["kind"]), quantiles)
    found = found.select(F.col("kind").alias("of"), "n", "n_distinct", "quantiles")
    # Exact ranks of the quantiles: shares of values below and up to each.
    ranks = clicks.join(F.broadcast(found), F.col("kind").eqNullSafe(F.col("of"))).groupBy("kind").agg(
        F.first("n").alias("n"), F.first("n_distinct").alias("n_distinct"), F.count_distinct("client_id").alias("n_clients"), F.count("value").alias("n_values"),
        *(F.count_if(F.col("value") < F.col("quantiles")[i]).alias(f"below{i}") for i in range(4)), *(F.count_if(F.col("value") <= F.col("quantiles")[i]).alias(f"upto{i}") for i in range(4)),
    )
    near = lambda i, q: (F.col(f"below{i}") / F.col("n_values") - 2 * sketches.RANK_ERROR <= q) & (F.col(f"upto{i}") / F.col("n_values") + 2 * sketches.RANK_ERROR >= q)
    every = (F.col("n_values") == 0) | near(0, quantiles[0]) & near(1, quantiles[1]) & near(2, quantiles[2]) & near(3, quantiles[3])
    distinct = F.abs(F.col("n_distinct") - F.col("n_clients")) <= F.greatest(F.lit(1.0), 4 * sketches.DISTINCT_ERROR * F.col("n_clients"))
    return ranks.select("kind", "n", "n_clients", distinct.alias("distinct_near"), every.alias("quantiles_near"))


@plans.query("""
WITH j AS (SELECT *, CASE WHEN json_valid(props) THEN props::JSON END AS v FROM clicks)
SELECT click_id, ts, TRY_CAST(v->>'$.k' AS BIGINT) AS k, v->>'$.device.os' AS os, v->>'$.device.ver' AS ver,
       (v->>'$.items[0].sku')::BIGINT AS first_sku, CASE WHEN props IS NOT NULL AND v IS NULL THEN 'malformed JSON' END AS error FROM j""")
def ext_click_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of clicks by typed paths, with malformed ones as errors."""
    clicks = properties.parsed(read_table(spark, sf_dir, "clicks").select("click_id", "ts", "props"), "props")
    paths = {"k": ("$.k", "bigint"), "os": ("$.device.os", "string"), "ver": ("$.device.ver", "string"), "first_sku": ("$.items[0].sku", "bigint")}
    return clicks.select("click_id", "ts", *properties.typed(paths), "error")


@plans.query(
    oracles.predicted(
        "article",
        """, joined AS (SELECT d.doc_id, d.lang, l.quality, p.label FROM documents d JOIN pred p ON p.request_id = d.doc_id JOIN labels l ON l.doc_id = d.doc_id)
SELECT lang, quality, label, count(*) AS n FROM joined GROUP BY ALL""",
    )
)
def ext_layout_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions in partitions by language and labels, both in buckets by document, joined without a shuffle; one language was loaded twice."""
    name = f"textloom_{uuid.uuid4().hex[:12]}"
    docs = spread(read_table(spark, sf_dir, "documents"))
    made = predictions(requests_of(docs, "doc_id", "text")).select(F.col("request_id").alias("doc_id"), "label")
    made = made.join(docs.select("doc_id", "lang"), "doc_id").select("doc_id", "label", "lang")
    labels = read_table(spark, sf_dir, "labels").join(docs.select("doc_id", "source"), "doc_id").select(F.col("doc_id").alias("labelled"), "quality", "source")
    for table in (f"{name}_predictions", f"{name}_labels"):
        at_exit(lambda t=table: spark.sql(f"DROP TABLE IF EXISTS {t}"))
    folder = shared_folder(spark, "layout")
    write_layout(made, f"{name}_predictions", "lang", "doc_id", 8, f"{folder}/predictions")
    left = write_layout(made.filter("lang = 'fr'"), f"{name}_predictions", "lang", "doc_id", 8)
    right = write_layout(labels, f"{name}_labels", "source", "labelled", 8, f"{folder}/labels")
    return left.join(right, F.col("doc_id") == F.col("labelled")).groupBy("lang", "quality", "label").agg(F.count(F.lit(1)).alias("n"))


@plans.query("""
WITH starts AS (
  SELECT time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * k) AS window_start, kind, value FROM clicks, range(4) AS t(k) WHERE ts IS NOT NULL)
SELECT epoch_us(window_start) AS start_micros, kind, count(*) AS n, sum(value::DECIMAL(18, 6))::DOUBLE AS total FROM starts GROUP BY ALL""")
def ext_sliding_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks of an hour, every quarter of an hour."""
    clicks = read_table(spark, sf_dir, "clicks").select("ts", "kind", "value")
    found = windows.sliding_counts(clicks, ["kind"], 3600, 900)
    return found.select(F.unix_micros("window_start").alias("start_micros"), "kind", "n", F.col("total").cast("double").alias("total"))


@plans.query("""
WITH marked AS (
  SELECT client_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM clicks WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY client_id ORDER BY ts)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY client_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked)
SELECT client_id, epoch_us(min(ts)) AS start_micros, epoch_us(max(ts)) AS end_micros, count(*) AS n FROM numbered GROUP BY client_id, s""")
def ext_click_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a client: clicks at most half an hour apart."""
    found = windows.sessions(read_table(spark, sf_dir, "clicks").select("ts", "client_id"), ["client_id"], 1800)
    return found.select("client_id", F.unix_micros("session_start").alias("start_micros"), F.unix_micros("session_end").alias("end_micros"), "n")


_SQL_RUNS = f"""
WITH cleaned AS (SELECT doc_id AS request_id, {oracles.clean('text')} AS c FROM documents
  UNION ALL SELECT -1 - doc_id, {oracles.clean("replace(text, ' of ', ' in ')")} FROM documents),
{oracles.FROM_CLEANED["sentence"]}, {oracles.LOGITS},
before AS (SELECT label, text FROM pred WHERE request_id >= 0), after AS (SELECT label, text FROM pred WHERE request_id < 0)"""


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Predictions of all sentences, and those with one word exchanged."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    run = lambda d: predictions(requests_of(d, "doc_id", "text", "sentence")).select("label", "text")
    return run(docs), run(docs.withColumn("text", F.replace("text", F.lit(" of "), F.lit(" in "))))


@plans.query(_SQL_RUNS + """, gone AS (SELECT label, text, count(*) AS g FROM (FROM before EXCEPT ALL FROM after) GROUP BY ALL), come AS (SELECT label, text, count(*) AS c FROM (FROM after EXCEPT ALL FROM before) GROUP BY ALL)
SELECT label, sha256(text) AS text_sha256, (coalesce(c, 0) - coalesce(g, 0))::BIGINT AS change FROM gone FULL JOIN come USING (label, text)""")
def ext_run_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences whose number or label differs between two runs, and by how many."""
    found = diff.multiset_diff(*_runs(spark, sf_dir))
    return found.select("label", F.sha2("text", 256).alias("text_sha256"), (F.col("n_after") - F.col("n_before")).alias("change"))


@plans.query(_SQL_RUNS + " SELECT label, count(*) AS n FROM (FROM before INTERSECT ALL FROM after) GROUP BY label")
def ext_run_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences by label that two runs share, as often as both have them."""
    return diff.kept_rows(*_runs(spark, sf_dir)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
