"""The near-copy stage against Jaccard similarities of all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from textloom.llm import near_copies

from .data import as_rows, rows, table, words


def plain_set(text: str | None) -> frozenset:
    w = [x.encode().lower() for x in words(text)]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def plain_kept(given: list[tuple]) -> list[int]:
    """Indexes of the rows that stay."""
    sets = [plain_set(t) for _, t in given]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b)):
                parent[find(i)] = find(j)
    groups: dict = {}
    for i in range(len(sets)):
        groups.setdefault(find(i), []).append(i)
    return [min(g, key=lambda i: (given[i][0] is None, given[i][0] or 0)) for g in groups.values()]


@pytest.mark.parametrize("frequent", [4, 1])
def test_against_all_pairs(spark, monkeypatch, frequent):
    monkeypatch.setattr(near_copies, "FREQUENT", frequent)
    given = [r for r in rows(5, 120) if r[0] is not None]
    want = {given[i][0] for i in plain_kept([(r[0], r[1]) for r in given])}
    assert len(want) < len({r[1] for r in given})  # near copies go, not only copies
    got = near_copies.one_of_each(table(spark, given))
    assert sorted(r.doc_id for r in got.collect()) == sorted(want) and got.columns == table(spark, given).columns
    assert near_copies.one_of_each(table(spark, [])).count() == 0


def test_against_all_pairs_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    given = [(r.doc_id, r.text) for r in docs.collect()]
    want = {given[i][0] for i in plain_kept(given)}
    assert sorted(r[0] for r in as_rows(near_copies.one_of_each(docs), "doc_id").elements()) == sorted(want)


def test_repeated_and_null_ids(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(30)) for c in "xy")
    given = [(7, one), (7, two), (7, two), (None, one), (None, None), (None, "only here"), (9, two)]
    docs = table(spark, [(d, t, "en", "a", 1, "") for d, t in given])
    got = as_rows(near_copies.one_of_each(docs), "doc_id", "text")
    assert got == {(7, one): 1, (7, two): 1, (None, None): 1, (None, "only here"): 1}


def test_crowded_groups_and_clashing_columns(spark):
    """One large group whose members are near a base, not all near each other; names of the operator's own columns."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(60)}" for _ in range(220)]
    given = []
    for i in range(90):
        text = list(base)
        for _ in range(rng.randrange(1, 9)):
            text[rng.randrange(len(text))] = f"v{rng.randrange(400)}"
        given.append((i, " ".join(text)))
    given += [(200 + i, " ".join(f"u{rng.randrange(300)}" for _ in range(90))) for i in range(20)]
    docs = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in given], "doc_id long, text string, row int, textloom_row string, kept int").repartition(3)
    got = near_copies.one_of_each(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == sorted(given[i][0] for i in plain_kept(given))


def test_maps_discard_no_near_pair():
    """Pairs at 4/5 pass maps of any size; maps of sets that share little don't."""
    rng = np.random.default_rng(9)
    for _ in range(400):
        n = int(rng.integers(5, 900))
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[rng.random(n) < rng.uniform(0.3, 1)], rng.integers(0, 2**63, int(rng.integers(0, n // 3 + 1)), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        for bits in (64, near_copies.FOLDED, near_copies.BITS):
            x, y = (np.frombuffer(near_copies.bit_map(s, bits), dtype=np.uint64)[None] for s in (a, b))
            allowed = bool(near_copies.can_be_near(x, y, np.array([len(a)]), np.array([len(b)]))[0])
            assert allowed or 5 * both < 4 * (len(a) + len(b) - both)
            if bits == near_copies.BITS and 100 < n < 500 and 2 * both < len(a):
                assert not allowed


@pytest.mark.parametrize("crowd", [3, 1000])
def test_pairs_of_components(monkeypatch, crowd):
    """Pairs of different components against all pairs; the nearest are one for each node at most, and name every node that has a pair."""
    monkeypatch.setattr(near_copies, "CROWD", crowd)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(300) < 0.93], rng.integers(0, 2**63, 12, dtype=np.uint64)])) for _ in range(60)]
    key = np.repeat([4, 9, 9, 9], 15)
    n = np.array([len(x) for x in sets])
    order = np.lexsort((n, key))
    key, n, sets = key[order], n[order], [sets[i] for i in order]
    node, root, place = np.arange(60) + 100, np.where(np.arange(60) % 5 > 1, -7, np.arange(60) // 2), n << 32
    maps = np.stack([np.frombuffer(near_copies.bit_map(x, near_copies.FOLDED), dtype=np.uint64) for x in sets])
    want = set()
    for i in range(60):
        for j in range(i):
            if key[i] == key[j] and root[i] != root[j] and near_copies.can_be_near(maps[i][None], maps[j][None], n[i : i + 1], n[j : j + 1])[0]:
                want.add((j + 100, i + 100))
    got = [(a, b) for part in near_copies._pairs(key, place, node, root, maps) for a, b in zip(*(c.to_pylist() for c in part.columns), strict=True)]
    assert len(want) > 100 and sorted(got) == sorted(want)
    near = [(a, b) for part in near_copies._nearest(key, place, node, root, maps) for a, b in zip(*(c.to_pylist() for c in part.columns), strict=True)]
    assert set(near) <= want and len(near) <= 60 and {x for p in near for x in p} == {x for p in want for x in p}
