"""Sliding and session windows over event time, in batch and on streams.

A sliding window is a union of panes as long as the slide: each event is counted in one pane, and panes, not events, are
copied to the windows that they lie in. Copies are size / slide for each pane however many events it has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sliding_counts(events: DataFrame, by: list[str], size_seconds: int, slide_seconds: int, late: str | None = None) -> DataFrame:
    """window_start, by, n and total (of column value) of windows that hold events; ``size_seconds`` must be a multiple of ``slide_seconds``.

    On a stream give ``late``, the watermark: panes close first, and windows when all their panes have.
    """
    if size_seconds % slide_seconds:
        raise ValueError("the size must be a multiple of the slide")
    timed = events.filter("ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if late else timed
    value = F.col("value").cast("decimal(18,6)")
    panes = timed.groupBy(F.window("ts", f"{slide_seconds} seconds"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    # The time of a pane is a tick before its end, so the windows around it are those that it lies in.
    spread = panes.select(F.window(F.window_time("window"), f"{size_seconds} seconds", f"{slide_seconds} seconds").alias("around"), *by, "n", "total")
    sums = spread.groupBy("around", *by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return sums.select(F.col("around.start").alias("window_start"), *by, "n", "total")


def sessions(events: DataFrame, by: list[str], gap_seconds: int) -> DataFrame:
    """session_start, session_end (of the last event), by and n, in batch: events of a key at most the gap apart.

    Events of one pane as long as the gap are in one session whatever lies between them, so each task sends a row for each pane it has
    events of, and a key has at most as many rows to sort as its time has panes.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = F.lit(gap_seconds * 1_000_000).cast("long")
    timed = events.filter("ts IS NOT NULL").select(*by, at.alias("at"), F.floor(at / gap).alias("pane"))
    panes = timed.groupBy(*by, "pane").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*by).orderBy("pane")
    fresh = panes.withColumn("fresh", F.when(F.col("first") - F.lag("last").over(order) <= gap, 0).otherwise(1))
    numbered = fresh.withColumn("session", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = numbered.groupBy(*by, "session").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    return found.select(F.timestamp_micros("first").alias("session_start"), F.timestamp_micros("last").alias("session_end"), *by, "n")


def stream_sessions(events: DataFrame, by: list[str], gap_seconds: int, late: str) -> DataFrame:
    """As :func:`sessions`, on a stream: a session is given once the watermark has passed its gap."""
    timed = events.filter("ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    found = timed.groupBy(F.session_window("ts", f"{gap_seconds} seconds").alias("session"), *by).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    return found.select(F.col("session.start").alias("session_start"), F.col("last").alias("session_end"), *by, "n")
