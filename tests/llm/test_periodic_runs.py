"""Operator 13 against runs found by trying every stretch."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import pytest

from textloom.llm import periodic_runs as P

from .data import as_rows, rows, table, words

COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def plain_runs(w: list) -> list[tuple[int, int, int]]:
    """For each period, maximal stretches of equality; the smallest period of a stretch counts."""
    n, least = len(w), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            k = i
            while k + p < n and w[k] == w[k + p]:
                k += 1
            if k + p - i >= max(6, 4 * p):
                least.setdefault((i, k + p - i), p)
            i = k
    return sorted(((s, m, p) for (s, m), p in least.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text: str | None) -> tuple:
    w = words(text)
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_words(seed):
    """Small alphabets, powers of powers, and runs that overlap or touch."""
    rng = random.Random(seed)
    texts = []
    for _ in range(150):
        w: list[bytes] = []
        for _ in range(rng.randint(0, 8)):
            block = [rng.choice([b"a", b"b", b"c", b"d", b"e"][: rng.randint(1, 5)]) for _ in range(rng.randint(1, 9))]
            block = block * rng.randint(1, 3) + [rng.choice([b"a", b"x"])] * rng.randint(0, 2)
            w += (block * rng.randint(1, 9))[: rng.randint(1, 90)]
        texts.append(w)
    assert P.runs_by_text(texts) == [plain_runs(w) for w in texts]


def test_texts_beyond_one_array(monkeypatch):
    monkeypatch.setattr(P, "WORDS", 40)
    monkeypatch.setattr(P, "CHUNK", 1)
    monkeypatch.setattr(P, "MOST_CHUNK", 4)
    rng = random.Random(3)
    texts = [[rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, 60))] for _ in range(60)]
    assert P.runs_by_text(texts) == [plain_runs(w) for w in texts]


def test_one_word_many_times():
    """Grids within the run of period 1 are skipped: as slow as the square otherwise."""
    assert P.runs_by_text([[b"x"] * 300_000]) == [[(0, 300_000, 1)]]
    assert P.collapse([b"x"] * 9 + [b"y"], [(0, 9, 1)]) == [b"x", b"y"]


def test_rows_against_plain_search(spark):
    given = rows() + [(1000 + i, "la " * i + "le lu " * (i % 7), "en", "a", 1, "") for i in range(60)]
    got = as_rows(P.digest(P.periodic_runs(P.repeat_tails(table(spark, given)))), *COLUMNS)
    assert got == Counter(plain_row(r[0], r[1]) for r in given)


def test_texts_and_empty_tables(spark):
    docs = table(spark, [(1, "go a b a b a b a b stop", "en", "a", 1, ""), (2, None, None, None, None, None)])
    got = {r.doc_id: r for r in P.periodic_runs(docs).collect()}
    assert got[1].collapsed == "go a b stop" and [tuple(r) for r in got[1].runs] == [(1, 8, 2)] and got[1].n_words == 10
    assert got[2].collapsed == "" and got[2].runs == []
    assert P.digest(P.periodic_runs(P.repeat_tails(table(spark, [])))).count() == 0
