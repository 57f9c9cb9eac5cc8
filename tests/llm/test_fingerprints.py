"""Operator 12 against votes counted one by one, and its search against all pairs."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from textloom.llm import fingerprints as P

from .data import rows, table, words

COLUMNS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def chained(*parts) -> int:
    """The hash that SQL gives for several values: each is the seed of the next."""
    h = 42
    for p in parts:
        h = xxh64_intdigest(p if isinstance(p, bytes) else p.to_bytes(4, "little"), seed=h)
    return h


def plain_print(text: str, lower) -> str:
    w = words(lower[text])
    pairs = list(zip(w, w[1:])) or [(x, "") for x in w]
    ones, total = [0] * 128, 0
    for a, b in pairs:
        weight = max(1, min(7, (len(a) + len(b)) // 2))
        total += weight
        hashes = [chained(a.encode(), b.encode())]
        hashes.append(chained(a.encode(), b.encode(), 1))
        for k in range(128):
            ones[k] += weight * (hashes[k // 64] >> (k % 64) & 1)
    halves = [sum(1 << k for k in range(64) if 2 * ones[64 * i + k] > total) for i in range(2)]
    return "".join(f"{h:016x}" for h in halves)


def plain_rows(spark, given: list[tuple]) -> Counter:
    """Rows by plain loops; lower case by Spark, whose rules for single letters may differ from Python's."""
    texts = [(r[0], r[1] or "") for r in given]
    hashed = {r.t: r.h for r in spark.createDataFrame(sorted({(t,) for _, t in texts}), "t string").withColumn("h", F.xxhash64("t")).collect()}
    firsts = {}
    for i, t in texts:
        if i is not None:
            firsts[i] = min(firsts.get(i, t), t, key=hashed.__getitem__)
    ids = sorted(firsts)
    after = dict(zip(ids, ids[1:] + ids[:1]))
    made = []
    for i, t in texts:
        m = len(t) // 4
        start = firsts[after[i]] if i is not None else ""
        made.append((i, t, t[: len(t) - m] + start[:m], start if i is not None else None))
    every = sorted({x for _, t, e, s in made for x in (t, e, s or "")})
    lower = {r.t: r.l for r in spark.createDataFrame([(t,) for t in every], "t string").withColumn("l", F.lower("t")).collect()}
    memo = {t: plain_print(t, lower) for t in every}
    near = lambda a, b: round(max(0.0, math.cos(math.pi * (int(a, 16) ^ int(b, 16)).bit_count() / 128)), 9)
    return Counter(
        (i, len(t), hashlib.sha256(e.encode()).hexdigest(), memo[t], memo[e], near(memo[t], memo[e]), None if s is None else near(memo[t], memo[s])) for i, t, e, s in made
    )


def found_rows(df) -> Counter:
    return Counter((*r[:5], round(r[5], 9), None if r[6] is None else round(r[6], 9)) for r in df.select(*COLUMNS).collect())


def test_rows_against_plain_votes(spark):
    given = [r for r in rows() if len(r[1] or "") < 9000]
    assert found_rows(P.near_texts(table(spark, given))) == plain_rows(spark, given)


@pytest.mark.parametrize("change", [{"CHUNK": 7}, {"RANGE": 5}, {"HOT_LEAST": 2, "HOT_SHARE": 0.0, "SALTS": 3}])
def test_other_bounds_give_the_same_rows(spark, monkeypatch, change):
    """Many chunks, many ranges of ids, and hot ids."""
    given = [r for r in rows(2, 40) if len(r[1] or "") < 3000]
    given += [(5, given[0][1], "en", "a", 1, ""), (5, given[3][1], "en", "a", 1, "")] * 4 + [(None, "no id here at all", "en", "a", 1, "")] * 5
    want = found_rows(P.near_texts(table(spark, given)))
    for name, value in change.items():
        monkeypatch.setattr(P, name, value)
    assert found_rows(P.near_texts(table(spark, given))) == want == plain_rows(spark, given)


def test_long_text_and_empty_table(spark):
    """Sums of 300,000 terms: far more than one long integer's lanes hold."""
    long = "seven letters " * 150_000
    got = {r.doc_id: r for r in P.near_texts(table(spark, [(1, long, "en", "a", 1, ""), (2, "seven letters " * 9, "en", "a", 1, "")])).collect()}
    assert got[1].n_chars == len(long) and got[1].near_edited == 1.0
    assert (int(got[1].fingerprint, 16) ^ int(got[2].fingerprint, 16)).bit_count() < 40
    assert P.near_texts(table(spark, [])).count() == 0
    one = P.near_texts(table(spark, [(1, "a b c d e f g h", "en", "a", 1, "")])).first()
    assert one.near_next == 1.0


def test_edits_are_nearer_than_other_texts(spark, sf):
    rows_ = P.near_texts(spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) > 400")).collect()
    edited, after = sorted(r.near_edited for r in rows_), sorted(r.near_next for r in rows_)
    assert edited[len(edited) // 20] > 0.5 and sum(x < 0.5 for x in after) > 0.95 * len(after)


@pytest.mark.parametrize("radius", [0, 1, 3, 6])
def test_search_against_all_pairs(spark, radius):
    rng = random.Random(radius)
    prints = []
    for _ in range(40):
        base = rng.getrandbits(128)
        for _ in range(8):
            x = base
            for k in rng.sample(range(128), rng.randint(0, radius + 1)):
                x ^= 1 << k
            prints.append(x)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(x >> 64), signed(x & (1 << 64) - 1)) for x in prints], "hi long, lo long")
    whole = lambda hi, lo: (hi % (1 << 64)) << 64 | lo % (1 << 64)
    got = Counter((whole(r.hi, r.lo), whole(r.other_hi, r.other_lo), r.bits) for r in P.within(df, df, radius).collect())
    each = set(prints)
    assert got == Counter((a, b, (a ^ b).bit_count()) for a in each for b in each if a != b and (a ^ b).bit_count() <= radius)


def test_no_python_in_the_plan(spark):
    plan = P.votes(table(spark).select("doc_id", "text"), "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "HashAggregate" in plan


def test_texts_travel_once(spark):
    from textloom.llm.common import Scratch

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with Scratch(spark) as scratch:
            texts, _ = P.with_edits(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), scratch)
            texts.collect()
            plan = texts._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.split("Initial Plan")[0].count("ReusedExchange") == 1
