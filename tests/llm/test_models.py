"""Operators 3, 6 and 10."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import quality_model, token_counts, toxicity

from .data import as_rows, rows, table, words


def auc(y: np.ndarray, s: np.ndarray) -> float:
    order = np.argsort(np.argsort(s, kind="stable"), kind="stable") + 1
    good = int(y.sum())
    return (order[y == 1].sum() - good * (good + 1) / 2) / (good * (len(y) - good))


def held_out(spark, out, label: str, folds: int, fold: int):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = out.join(labels, "doc_id").filter("held_out").select("doc_id", F.col(label).alias("y"), "score", "predicted").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % folds == fold for r in got)
    return np.array([r.y for r in got]), np.array([r.score for r in got]), np.array([r.predicted for r in got])


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality_model.quality_classifier(docs, labels)
    y, s, p = held_out(spark, out, "quality", 5, 0)
    assert auc(y, s) > 0.95 and (p == y).mean() > 0.9


def test_ranking_against_pairwise_loss(monkeypatch):
    """The weights are where the loss over the same pairs, summed pair by pair, has no slope."""
    monkeypatch.setattr(quality_model, "PAIRS", 60)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(40, 3))
    y = (x[:, 0] + 0.5 * rng.normal(size=40) > 0).astype(int)
    model = quality_model.fit(x, y)
    z = (x - x.mean(0)) / (x.std(0) + 1e-9)
    again = np.random.default_rng(quality_model.SEED)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    pairs = list(zip(again.choice(good, 60).tolist(), again.choice(bad, 60).tolist(), strict=True))

    def loss(w) -> float:
        return sum(np.log1p(np.exp(-(z[a] - z[b]) @ w)) for a, b in pairs) / len(pairs) + quality_model.RIDGE / 2 * (w @ w)

    for i in range(3):
        step = np.eye(3)[i] * 1e-3
        assert loss(model["w"] + step) > loss(model["w"]) < loss(model["w"] - step)
    strength = sorted(float(sum(a * b for a, b in zip(row, model["w"], strict=True))) for row in z)
    assert model["threshold"] == pytest.approx(np.quantile(strength, 1 - y.mean()))
    got = quality_model.score(model, x)
    assert ((got >= 0.3) == (z @ model["w"] >= model["threshold"])).all()


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    out = toxicity.classify(docs, model).filter("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    got = out.select("doc_id", "lang", F.col("toxic").alias("y"), "predicted").collect()
    assert got and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)
    for lang in ("en", "de", "es", "fr"):
        toxic, clean = ([r.predicted for r in got if r.lang == lang and r.y == y] for y in (1, 0))
        assert np.mean(toxic) >= 0.9 and 1 - np.mean(clean) >= 0.98, lang
    cases = table(spark, [(1, "you are a pathetic moron and a stupid clown", "en", "a", 1, ""), (2, "the and of to in plain words only here", "en", "a", 1, "")])
    assert {r.doc_id: r.predicted for r in toxicity.classify(cases, model).collect()} == {1: 1, 2: 0}


def plain_em(v: np.ndarray, y: np.ndarray, prior: float) -> list[float]:
    """The label model without a tree, vote by vote."""
    post = [toxicity.TRUST if a else 1 - toxicity.TRUST for a in y]
    n = len(y)
    for _ in range(toxicity.EM_STEPS):
        mass = [sum(1 - p for p in post), sum(post)]
        on = [[(sum(w for w, row in zip(ws, v, strict=True) if row[j]) + 0.5) / (mass[c] + 1) for j in range(v.shape[1])] for c, ws in enumerate(([1 - p for p in post], post))]
        agree = [sum(w for w, a in zip(ws, y, strict=True) if a == c) for c, ws in enumerate(([1 - p for p in post], post))]
        right = [(agree[c] + toxicity.TRUST * n) / (mass[c] + n) for c in range(2)]
        for i, (row, a) in enumerate(zip(v, y, strict=True)):
            like = [1 - prior, prior]
            for c in range(2):
                for j, x in enumerate(row):
                    like[c] *= on[c][j] if x else 1 - on[c][j]
                like[c] *= right[c] if a == c else 1 - right[c]
            post[i] = like[1] / sum(like)
    return post


def test_label_model_against_plain_em(monkeypatch):
    monkeypatch.setattr(toxicity, "LEAST_INFORMATION", np.inf)
    rng = np.random.default_rng(1)
    for _ in range(5):
        y = (rng.random(80) < 0.3).astype(int)
        v = np.stack([np.where(rng.random(80) < a, y, rng.random(80) < 0.2) for a in (0.9, 0.6, 0.3)], 1).astype(float)
        assert np.allclose(toxicity.label_model(v, y, 0.3), plain_em(v, y, 0.3))


def test_label_model_counts_copies_of_a_voter_once():
    rng = np.random.default_rng(2)
    y = (rng.random(3000) < 0.3).astype(int)
    v = np.stack([np.where(rng.random(3000) < a, y, rng.random(3000) < 0.3) for a in (0.7, 0.5)], 1).astype(float)
    once, copied = (toxicity.label_model(x, y, 0.3) for x in (v, v[:, [0, 1, 1, 1, 1]]))
    assert np.abs(once - copied).max() < 0.05
    joint = np.empty((2, 2, 2, 5, 5))
    x = v[:, [0, 1, 1, 1, 1]]
    for c in range(2):
        for a in range(2):
            for b in range(2):
                joint[c, a, b] = ((x == a)[y == c].T.astype(float)) @ (x == b)[y == c]
    parent = toxicity._tree(joint, np.array([(y == 0).sum(), (y == 1).sum()], dtype=float))
    assert sum(p in (1, 2, 3, 4) for p in parent[1:]) == 3


def test_mined_starts(spark):
    toxic = [(i, f"zorblax zorblaxes and the other words {i}", 1) for i in range(20)]
    clean = [(100 + i, f"some plain words of the other kind {i}", 0) for i in range(80)]
    got = toxicity.mine(spark.createDataFrame([*toxic, *clean, (500, "", 0)], "doc_id long, text string, label int"))
    assert {b"zorb", b"zorbl", b"zorbla"} <= set(got) and b"word" not in got
    few = spark.createDataFrame([*toxic, (500, "", 1)], "doc_id long, text string, label int")
    assert toxicity.mine(few) == [] and toxicity.mine(few.filter("false")) == []


def test_models_take_awkward_tables(spark):
    docs = table(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0), (None, 1, 1), (3, None, None), (5, 0, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    none = labels.filter("false")
    for f in (quality_model.quality_classifier, toxicity.toxicity):
        for lab in (labels, none, labels.filter("quality = 1")):
            out = f(docs, lab)
            assert out.columns == ["doc_id", "held_out", "score", "predicted"]
            got = out.collect()
            assert len(got) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out is not None for r in got)
        assert f(table(spark, []), labels).count() == 0


def test_scores_are_the_same_each_time(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    for f in (quality_model.quality_classifier, toxicity.toxicity):
        a, b = (as_rows(f(docs.repartition(k), labels), "doc_id", "score") for k in (1, 5))
        assert a == b


def greedy(vocabulary: set[tuple], longest: int, word: bytes) -> int:
    symbols, at, n = (*word, token_counts.END), 0, 0
    while at < len(symbols):
        size = next(k for k in range(min(longest, len(symbols) - at), 0, -1) if symbols[at : at + k] in vocabulary or k == 1)
        at, n = at + size, n + 1
    return n


def test_token_counts(spark):
    pieces = token_counts.read_vocabulary(token_counts.VOCABULARY)
    known, longest = set(pieces), max(map(len, pieces))
    cache: dict[bytes, int] = {}
    want = {}
    for r in rows():
        w = [x.lower() if x.isascii() else bytes(x.encode()).lower().decode() for x in words(r[1])]
        for x in w:
            cache.setdefault(x.encode(), greedy(known, longest, x.encode()))
        want[r[0]] = (len(w), sum(cache[x.encode()] for x in w))
    got = token_counts.token_counts(table(spark)).collect()
    assert len(got) == len(rows())
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.n_tokens) == want[r.doc_id]
    assert token_counts.token_counts(table(spark, [])).count() == 0


def test_automaton_on_small_vocabularies():
    rng = np.random.default_rng(3)
    for _ in range(30):
        pieces = {tuple(int(x) for x in rng.integers(97, 100, rng.integers(1, 6))) for _ in range(12)}
        pieces |= {(*p, token_counts.END) for p in list(pieces)[:4]}
        machine = token_counts.Automaton(list(pieces))
        for _ in range(60):
            word = bytes(int(x) for x in rng.integers(97, 101, rng.integers(1, 14)))
            assert machine.count(word) == greedy(pieces, 8, word)
