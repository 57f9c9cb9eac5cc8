"""Queries that join tables over time (extensions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators.time_joins import asof_join, interval_join
from textloom.sources.tables import read_table

from .registry import Plans

plans = Plans()


@plans.query("""
SELECT e.event_id, e.user_id, arg_max(p.event_id, (p.ts, p.event_id)) AS previous_id, arg_max(p.event_type, (p.ts, p.event_id)) AS previous_type
FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.ts < e.ts GROUP BY e.event_id, e.user_id""")
def ext_previous_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the user's last earlier one."""
    events = read_table(spark, sf_dir, "events")
    before = events.select("user_id", F.col("ts").alias("previous_ts"), F.col("event_id").alias("previous_id"), F.col("event_type").alias("previous_type"))
    return asof_join(events.select("event_id", "user_id", "ts"), before, "user_id", "ts", "previous_ts", ["previous_id", "previous_type"], "previous_id").drop("ts")


@plans.query("""
WITH once AS (SELECT DISTINCT ON (click_id) * FROM clicks WHERE ts IS NOT NULL AND client_id IS NOT NULL ORDER BY click_id, ts, kind NULLS FIRST, arrived_at),
asked AS (SELECT row_number() OVER () AS row, sale_id, client_id, sold_at FROM sales),
met AS (
  SELECT row, arg_max(c.click_id, (c.ts, c.click_id)) AS click_id, max(c.ts) AS ts
  FROM asked s JOIN once c ON c.client_id = s.client_id AND c.ts <= s.sold_at AND c.ts >= s.sold_at - INTERVAL 1 DAY GROUP BY row)
SELECT sale_id, client_id, click_id, epoch_us(sold_at) - epoch_us(ts) AS micros_before FROM asked LEFT JOIN met USING (row)""")
def ext_sale_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sale with the client's last click at or before it, at most a day old; of a click that came twice the first time counts."""
    clicks = read_table(spark, sf_dir, "clicks").filter("ts IS NOT NULL AND client_id IS NOT NULL").select("click_id", "client_id", "ts", "kind", "arrived_at")
    first = Window.partitionBy("click_id").orderBy("ts", F.asc_nulls_first("kind"), "arrived_at")
    once = clicks.withColumn("k", F.row_number().over(first)).filter("k = 1").select("client_id", "click_id", F.col("ts").alias("clicked_at"))
    sales = read_table(spark, sf_dir, "sales").select("sale_id", "client_id", "sold_at")
    met = asof_join(sales, once, "client_id", "sold_at", "clicked_at", ["click_id", "clicked_at"], "click_id", strict=False, within="1 day")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return met.select("sale_id", "client_id", "click_id", (micros("sold_at") - micros("clicked_at")).alias("micros_before"))


@plans.query("""
WITH shipping AS (
  SELECT o_custkey, o_orderkey AS shipped_order, min(l_shipdate) AS first_at, max(l_shipdate) AS last_at FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT o.o_orderkey, o.o_custkey, s.shipped_order FROM orders o JOIN shipping s ON s.o_custkey = o.o_custkey AND s.first_at <= o.o_orderdate AND o.o_orderdate < s.last_at""")
def ext_orders_while_shipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders placed while another order of the customer, or the order itself, was being shipped."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    spans = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_at"), F.max("l_shipdate").alias("last_at"))
    owners = orders.select(F.col("o_orderkey").alias("shipped_order"), "o_custkey")
    shipping = owners.join(spans.hint("merge"), F.col("shipped_order") == F.col("l_orderkey")).select("o_custkey", "shipped_order", "first_at", "last_at")
    return interval_join(orders, shipping, "o_orderdate", "first_at", "last_at", ["o_custkey"]).select("o_orderkey", "o_custkey", "shipped_order")


@plans.query("""
WITH marks AS (SELECT client_id, valid_at, max(seq) AS seq FROM client_changes WHERE client_id IS NOT NULL AND valid_at IS NOT NULL GROUP BY client_id, valid_at),
versions AS (SELECT *, coalesce(lead(valid_at) OVER (PARTITION BY client_id ORDER BY valid_at), TIMESTAMP '2100-01-01') AS until FROM marks)
SELECT s.sale_id, s.client_id, v.seq FROM sales s JOIN versions v ON v.client_id = s.client_id AND v.valid_at <= s.sold_at AND s.sold_at < v.until""")
def ext_sale_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sale with the version of its client that was valid then; sales without one have no row."""
    changes = read_table(spark, sf_dir, "client_changes").filter("client_id IS NOT NULL AND valid_at IS NOT NULL")
    marks = changes.groupBy("client_id", "valid_at").agg(F.max("seq").alias("seq"))
    until = F.lead("valid_at").over(Window.partitionBy("client_id").orderBy("valid_at"))
    versions = marks.withColumn("until", F.coalesce(until, F.lit("2100-01-01").cast("timestamp_ntz")))
    sales = read_table(spark, sf_dir, "sales").select("sale_id", "client_id", "sold_at")
    return interval_join(sales, versions, "sold_at", "valid_at", "until", ["client_id"]).select("sale_id", "client_id", "seq")
