"""Windows over event time against loops, in batch and on streams; sketches, variants, diffs and layouts."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from textloom.operators import diff, properties, sketches
from textloom.sources.layout import counts_by_file, write_layout
from textloom.streaming import windows
from textloom.streaming.run import arrivals, finish

DAY = datetime(2024, 1, 1)
SCHEMA = "ts timestamp_ntz, kind string, value double"


def events(seed: int, n: int = 400) -> list[tuple]:
    rng = random.Random(seed)
    return [(None if rng.random() < 0.02 else DAY + timedelta(seconds=rng.randint(0, 9000)), rng.choice(["a", "b", None]), rng.choice([None, 1.5, 2.25])) for _ in range(n)]


def plain_sliding(rows: list[tuple], size: int, slide: int) -> Counter:
    sums = defaultdict(lambda: [0, None])
    for ts, kind, value in rows:
        if ts is None:
            continue
        at = int((ts - DAY).total_seconds())
        for start in range(at - at % slide - size + slide, at + 1, slide):
            cell = sums[start, kind]
            cell[0] += 1
            if value is not None:
                cell[1] = (cell[1] or 0) + value
    return Counter((s, k, n, t) for (s, k), (n, t) in sums.items())


def seen(df) -> Counter:
    return Counter((int((r.window_start - DAY).total_seconds()), r.kind, r.n, None if r.total is None else float(r.total)) for r in df.collect())


@pytest.mark.parametrize("size, slide", [(600, 600), (600, 200), (3600, 60)])
def test_sliding(spark, size, slide):
    rows = events(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert seen(windows.sliding_counts(df, ["kind"], size, slide)) == plain_sliding(rows, size, slide)
    with pytest.raises(ValueError):
        windows.sliding_counts(df, ["kind"], 600, 400)


def test_panes_are_shared(spark):
    """Events are counted once, before rows are copied to windows."""
    df = spark.createDataFrame(events(1), SCHEMA)
    plan = windows.sliding_counts(df, ["kind"], 3600, 60)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Expand") < plan.rindex("HashAggregate")


def test_sliding_on_a_stream(spark, tmp_path):
    rows = sorted((r for r in events(2) if r[0]), key=lambda r: r[0])
    last = [(DAY + timedelta(days=3), "end", 0.0)]
    parts = [spark.createDataFrame(x, SCHEMA) for x in (rows[:150], rows[150:300], rows[300:], last)]
    stream = arrivals(parts, str(tmp_path), "in")
    got = finish(windows.sliding_counts(stream, ["kind"], 1200, 300, "10 minutes"), str(tmp_path)).filter("kind IS NULL OR kind <> 'end'")
    assert seen(got) == plain_sliding(rows, 1200, 300)


def plain_sessions(rows: list[tuple], gap: int) -> Counter:
    out, by = Counter(), defaultdict(list)
    for ts, kind, _ in rows:
        if ts is not None:
            by[kind].append(ts)
    for kind, times in by.items():
        open_ = []
        for t in [*sorted(times), None]:
            if open_ and (t is None or t - open_[-1] > timedelta(seconds=gap)):
                out[(open_[0], open_[-1], kind, len(open_))] += 1
                open_ = []
            open_.append(t)
    return out


@pytest.mark.parametrize("gap", [1, 7, 30, 600])
def test_sessions(spark, gap):
    rows = events(3)
    found = windows.sessions(spark.createDataFrame(rows, SCHEMA).repartition(3), ["kind"], gap)
    assert Counter((r.session_start, r.session_end, r.kind, r.n) for r in found.collect()) == plain_sessions(rows, gap)


def test_sessions_on_a_stream(spark, tmp_path):
    rows = sorted((r for r in events(4, 120) if r[0]), key=lambda r: r[0])
    parts = [spark.createDataFrame(x, SCHEMA) for x in (rows[::2], rows[1::2], [(DAY + timedelta(days=3), "end", 0.0)])]
    got = finish(windows.stream_sessions(arrivals(parts, str(tmp_path), "in"), ["kind"], 60, "4 hours"), str(tmp_path)).filter("kind IS NULL OR kind <> 'end'")
    assert Counter((r.session_start, r.session_end, r.kind, r.n) for r in got.collect()) == plain_sessions(rows, 60)


def test_sketches_merge_and_err_within_bounds(spark):
    df = spark.range(60_000).select((F.col("id") % 7).alias("day"), (F.col("id") % 9000).alias("who"), F.when(F.col("id") % 50 != 0, F.col("id") * 0.25).alias("x"), F.lit("k").alias("kind"))
    daily = sketches.sketches(df, ["kind", "day"], "who", "x")
    r = sketches.estimates(sketches.merged(daily, ["kind"]), [0.0, 0.25, 0.5, 1.0]).first()
    assert r.n == 60_000 and abs(r.n_distinct - 9000) <= 4 * sketches.DISTINCT_ERROR * 9000
    for q, value in zip([0.25, 0.5], r.quantiles[1:3], strict=True):
        assert abs(value / 15_000 - q) <= 2 * sketches.RANK_ERROR
    assert r.quantiles[0] == 0.25 and r.quantiles[3] == 59_999 * 0.25
    none = sketches.estimates(sketches.sketches(df.filter("x IS NULL"), ["kind"], "who", "x"), [0.5]).first()
    assert none.quantiles == [None] and none.n == 1200


def test_properties(spark):
    given = ['{"k": 5, "d": {"os": "ios"}}', '{"k": "6"}', '{"k": "six"}', "{broken", None, "[1, 2]", '"text"', "", '{"k": 1.0, "k2": [{"a": 1}]}']
    df = spark.createDataFrame(list(enumerate(given)), "i int, props string")
    found = properties.parsed(df, "props")
    got = {r.i: (r.k, r.os, r.error) for r in found.select("i", *properties.typed({"k": ("$.k", "int"), "os": ("$.d.os", "string")}), "error").collect()}
    bad = properties.MALFORMED
    assert got == {0: (5, "ios", None), 1: (6, None, None), 2: (None, None, None), 3: (None, None, bad), 4: (None, None, None), 5: (None, None, None), 6: (None, None, None), 7: (None, None, bad), 8: (1, None, None)}
    assert "k2" in properties.schema_of(found.filter("i IN (0, 1, 8)")).first().schema
    with pytest.raises(Exception, match="malformed JSON: "):
        properties.parsed(df, "props", fail_fast=True).select("error").collect()


def test_diff_and_kept_rows(spark):
    rng = random.Random(8)
    before = [(rng.choice("abc"), rng.choice([1, None])) for _ in range(60)]
    after = [(rng.choice("abcd"), rng.choice([1, None])) for _ in range(50)]
    a, b = (spark.createDataFrame(x, "x string, y int") for x in (before, after))
    x, y = Counter(before), Counter(after)
    got = Counter({(r.x, r.y): (r.n_before, r.n_after) for r in diff.multiset_diff(a, b.select("y", "x")).collect()})
    assert got == {k: (x[k], y[k]) for k in x | y if x[k] != y[k]}
    assert Counter(map(tuple, diff.kept_rows(a, b).collect())) == x & y
    assert diff.multiset_diff(a, a).count() == 0
    with pytest.raises(ValueError):
        diff.multiset_diff(a, b.drop("y"))


@pytest.fixture
def tables(spark):
    names = [f"layout_{uuid4().hex[:10]}" for _ in range(2)]
    yield names
    for n in names:
        spark.sql(f"DROP TABLE IF EXISTS {n}")


def test_layout(spark, tables, tmp_path):
    """Rerunning a partition changes nothing, other partitions stay, reads are pruned, and bucket joins don't shuffle."""
    df = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("part"), (F.col("id") * 2).alias("v"))
    write_layout(df, tables[0], "part", "id", 4, f"{tmp_path}/a")
    files = counts_by_file(spark.table(tables[0])).count()
    again = write_layout(df.filter("part = 'x'"), tables[0], "part", "id", 4)
    assert again.exceptAll(df.select(*again.columns)).count() == 0 and again.count() == 2000
    assert counts_by_file(again).count() == files <= 8
    changed = write_layout(df.filter("part = 'x'").withColumn("v", F.lit(-1).cast("long")), tables[0], "part", "id", 4)
    assert changed.filter("v = -1").count() == 667 and changed.count() == 2000
    assert "PartitionFilters: [isnotnull(part" in changed.filter("part = 'y'")._jdf.queryExecution().executedPlan().toString()
    other = write_layout(df.select(F.col("id").alias("other"), "part", F.lit(1).alias("w")).drop("part").withColumn("p", F.lit(0)), tables[1], "p", "other", 4, f"{tmp_path}/b")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = changed.join(other, changed["id"] == other["other"])
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 2000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    with pytest.raises(ValueError, match="buckets"):
        write_layout(df, tables[0], "part", "id", 8)
