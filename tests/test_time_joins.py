"""Joins over time against loops over all rows."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from textloom.operators.time_joins import SLICE_ROWS, asof_join, interval_join, length_classes
from textloom.plans import catalogue

DAY = datetime(2024, 1, 1)
SEC = timedelta(seconds=1)


def asof_rows(seed: int, n: int = 300) -> tuple[list, list]:
    rng = random.Random(seed)
    key = lambda: rng.choice([1, 1, 1, 2, 3, 4, None])
    when = lambda: None if rng.random() < 0.03 else DAY + rng.randint(0, 400) * SEC
    left = [(i, key(), when()) for i in range(n)]
    right = [(key(), when(), i, rng.choice(["a", None, "b"])) for i in range(n)]
    return left, right


def plain_asof(left: list, right: list, strict: bool, within: int | None) -> Counter:
    out = Counter()
    for i, k, t in left:
        fit = [r for r in right if k is not None and t is not None and r[0] == k and r[1] is not None and (r[1] < t if strict else r[1] <= t)]
        best = max(fit, key=lambda r: (r[1], r[2]), default=None)
        if best and within is not None and best[1] < t - within * SEC:
            best = None
        out[(i, k, t, *(best[2:] if best else (None, None)))] += 1
    return out


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("slice_rows", [SLICE_ROWS, 40, 3])
@pytest.mark.parametrize("within", [None, 20])
def test_asof(spark, strict, slice_rows, within):
    left, right = asof_rows(7)
    a = spark.createDataFrame(left + left[:5], "id int, k int, t timestamp_ntz").repartition(3)
    b = spark.createDataFrame(right, "k int, at timestamp_ntz, n int, what string").repartition(3)
    got = asof_join(a, b, "k", "t", "at", ["n", "what"], "n", strict, f"{within} seconds" if within else None, slice_rows)
    assert got.columns == ["id", "k", "t", "n", "what"]
    assert Counter(map(tuple, got.collect())) == plain_asof(left + left[:5], right, strict, within)


def test_asof_of_one_frequent_key_at_one_time(spark):
    """A key whose rows all have one time, empty sides, and clashing names."""
    a = spark.range(2000).select(F.lit(1).alias("k"), F.lit(DAY).alias("t"), "id")
    b = spark.range(2000).select(F.lit(1).alias("k"), F.lit(DAY - SEC).alias("at"), F.col("id").alias("n"))
    assert asof_join(a, b, "k", "t", "at", ["n"], "n", slice_rows=10).filter("n = 1999").count() == 2000
    assert asof_join(a, b.limit(0), "k", "t", "at", ["n"], "n").filter("n IS NULL").count() == 2000
    assert asof_join(a.limit(0), b, "k", "t", "at", ["n"], "n").count() == 0
    with pytest.raises(ValueError, match="rename"):
        asof_join(a.withColumn("n", F.lit(1)), b, "k", "t", "at", ["n"], "n")
    with pytest.raises(ValueError, match="rename"):
        asof_join(a.withColumn("__slice", F.lit(1)), b, "k", "t", "at", ["n"], "n")


@pytest.mark.parametrize("on", [None, ["k"]])
def test_intervals(spark, on):
    """Lengths of a microsecond to years, ends before starts, nulls."""
    rng = random.Random(11)
    when = lambda: None if rng.random() < 0.03 else DAY + timedelta(microseconds=rng.randint(-(10**9), 10**9))
    points = [(i, rng.choice([1, 2, None]), when()) for i in range(200)]
    intervals = []
    for i in range(150):
        start = when()
        length = timedelta(microseconds=rng.choice([-5, 0, 1, 2, 3, 1000, 10**6, 2**20, 2**20 + 1, 10**8, 10**9, 10**14]))
        intervals.append((rng.choice([1, 2, None]), i, start, None if start is None or rng.random() < 0.03 else start + length))
    intervals += [(1, 900, points[0][2], points[0][2] + timedelta(microseconds=1) if points[0][2] else None), (1, 901, DAY, DAY + SEC)]
    p = spark.createDataFrame(points, "id int, k int, t timestamp_ntz")
    v = spark.createDataFrame(intervals, "k int, n int, a timestamp_ntz, b timestamp_ntz")
    if not on:
        v = v.drop("k")
    got = Counter((r.id, r.n) for r in interval_join(p, v, "t", "a", "b", on).collect())
    want = Counter((i, n) for i, k, t in points for kk, n, a, b in intervals if t and a and b and a <= t < b and (not on or (k is not None and k == kk)))
    assert got == want and len(want) > 200
    assert len(length_classes(v, "a", "b")) <= 63


def test_plans_have_no_loop_over_pairs(spark):
    a = spark.range(10).select(F.col("id").alias("k"), F.lit(DAY).alias("t"))
    b = spark.range(10).select(F.col("id").alias("k"), F.lit(DAY).alias("at"), F.col("id").alias("n"))
    iv = spark.range(10).select(F.lit(DAY).alias("x"), F.lit(DAY + SEC).alias("y"), F.col("id").alias("m"))
    for df in (asof_join(a, b, "k", "t", "at", ["n"], "n"), interval_join(a, iv, "t", "x", "y")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_an_interval_has_two_bins_at_most(spark):
    rng = random.Random(2)
    rows = [(DAY + timedelta(microseconds=rng.randint(0, 10**12)),) for _ in range(300)]
    v = spark.createDataFrame([(a, a + timedelta(microseconds=rng.choice([1, 7, 10**5, 10**9, 10**13]))) for (a,) in rows], "a timestamp, b timestamp")
    from textloom.operators import time_joins as J

    binned = v.select(J._length_class(J._micros(F.col("b")) - J._micros(F.col("a"))).alias("c"), J._micros(F.col("a")).alias("x"), (J._micros(F.col("b")) - 1).alias("y"))
    counts = binned.selectExpr("shiftright(y, c) - shiftright(x, c) + 1 AS n").groupBy("n").count().collect()
    assert {r.n for r in counts} <= {1, 2}


def test_intervals_are_not_broadcast(spark, sf):
    """Sizes guessed from files lack the copies of rows; a broadcast by such a guess exceeded the driver's memory."""
    points = spark.range(10).select("id", F.timestamp_seconds("id").alias("t"))
    spans = spark.range(10).select(F.col("id").alias("n"), F.timestamp_seconds("id").alias("a"), F.timestamp_seconds(F.col("id") + 3).alias("b"))
    for met in (interval_join(points, spans, "t", "a", "b"), catalogue.queries()["ext_orders_while_shipping"](spark, sf)):
        assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
