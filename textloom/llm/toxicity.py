"""Operator 6, toxicity: weak supervision with a generative label model, then a linear classifier.

Voters: words of a fixed lexicon; word starts mined from the training folds (``MINED`` at most, those
whose use tells toxic texts most, by a likelihood ratio); patterns (several insults, density of
insults or mined starts, an insult after a pronoun, shouting, a vote for clean without any sign); and
the labels themselves, as an annotator who may err. The label model has a hidden class; given it,
voters form a tree: every voter depends on the class and on the voter that it goes with most
(greatest conditional mutual information), so voters that say the same thing count once.
Expectation-maximisation estimates accuracies and correlations together. A logistic classifier on
votes and counts, without the annotator, is fitted to the posterior labels and scores every document.

The fit uses at most ``SAMPLE`` rows of the training folds; scoring covers every row. Defined
results: a null or empty text has no votes for toxic; a null id is never held out; without training
rows of both labels the classifier is the prior with the lexicon's weight; repeated rows each get a row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .labelled import fold, training_sample

SAMPLE, EM_STEPS, TREE_STEPS, RIDGE, STEPS = 20_000, 20, 3, 1e-3, 20
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: Bytes of a mined word start; a text uses one if so many words have it, or at least every DENSE-th word.
STARTS, TWICE, DENSE = (4, 5, 6), 2, 200
#: Most starts that are mined, their least likelihood ratio, the least ratio of the rates, and the least toxic texts that use them.
MINED, LEAST_RATIO, LIFT, LEAST_TEXTS = 300, 20.0, 4.0, 3
#: Nats of conditional mutual information below which voters count as independent given the class.
LEAST_INFORMATION = 1e-3
#: The annotator is thought to be right this often, with the weight of so many votes for each row.
TRUST, TRUST_WEIGHT = 0.99, 1.0

# Insults of four languages, lower case, each a voter.
LEXICON = (
    "idiot idiots idiotic moron morons moronic stupid stupidity pathetic worthless loser losers clown clowns trash scum scumbag disgusting"
    " dumb dumbass imbecile fool foolish jerk filth filthy vermin garbage bastard bitch asshole bullshit crap shit fuck fucking fucker"
    " retard retarded lunatic psycho creep freak subhuman degenerate parasite liar coward ugly braindead brainless cretin dimwit halfwit"
    " ignorant sucker twat wanker prick slut whore piss"
    " idiote idiots imbécile crétin connard connasse salaud salope ordure débile abruti minable pourriture"
    " idioten dummkopf trottel arschloch abschaum schwachkopf vollidiot dreckig widerlich erbärmlich schlampe hurensohn"
    " idiota idiotas imbécil estúpido estúpida tonto basura escoria asqueroso patético inútil cabrón gilipollas payaso"
).split()
_WORDS = [w.encode() for w in dict.fromkeys(LEXICON)]
_INDEX = {w: i for i, w in enumerate(_WORDS)}
PATTERNS = ("two_insults", "dense_insults", "aimed_insult", "shouting", "two_starts", "dense_starts", "very_dense_starts", "clean")
_AIMED = {b"you", b"your", b"youre", b"he", b"she", b"they", b"tu", b"vous", b"du", b"sie", b"ihr", b"usted", b"eres"}
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Numbers after the votes: insults, and insults and mined starts per 100 words.
_NUMBERS = 3


class Voters:
    """All voters but the annotator; ``starts`` are the mined word starts."""

    def __init__(self, starts: list[bytes]):
        self.starts = starts
        self.place = {s: len(_WORDS) + i for i, s in enumerate(starts)}
        self.heads = {s[: STARTS[0]] for s in starts}
        self.n = len(_WORDS) + len(starts) + len(PATTERNS)

    def features(self, text: bytes) -> list[float]:
        """0 or 1 of every voter, then the numbers. Words are runs of letters in lower case."""
        words = text.translate(_LETTERS).split()
        seen, n = Counter(words), max(len(words), 1)
        out = [0.0] * (self.n + _NUMBERS)
        insults = 0
        for w in seen.keys() & _INDEX.keys():
            out[_INDEX[w]] = 1.0
            insults += seen[w]
        uses: dict[int, int] = {}
        started, heads, place = 0, self.heads, self.place
        for w, k in seen.items():
            if w[: STARTS[0]] in heads:
                found = [at for size in STARTS if len(w) >= size and (at := place.get(w[:size])) is not None]
                for at in found:
                    uses[at] = uses.get(at, 0) + k
                started += k if found else 0
        for at, k in uses.items():
            out[at] = float(k >= TWICE or DENSE * k >= n)
        at = len(_WORDS) + len(self.starts)
        out[at], out[at + 1] = float(insults >= 2), float(100 * insults >= n)
        out[at + 2] = float(insults > 0 and any(b in _INDEX and a in _AIMED for a, b in zip(words, words[1:], strict=False)))
        out[at + 3] = float(text.count(b"!!") >= 3)
        out[at + 4], out[at + 5], out[at + 6] = float(started >= 2), float(100 * started >= n), float(100 * started >= 2 * n)
        out[at + 7] = float(not insults and not started)
        out[self.n :] = float(min(insults, 20)), min(100 * insults / n, 10.0), min(100 * started / n, 10.0)
        return out


def used_starts(text: bytes) -> list[bytes]:
    """Word starts that a text uses."""
    words = text.translate(_LETTERS).split()
    uses: Counter = Counter()
    for w, k in Counter(words).items():
        for size in STARTS:
            if len(w) >= size:
                uses[w[:size]] += k
    return [s for s, k in uses.items() if k >= TWICE or DENSE * k >= len(words)]


def _ratio(a: Column, b: Column, n1: int, n0: int) -> Column:
    """Likelihood ratio (G) of a of n1 toxic and b of n0 clean texts against one rate for both; 0 if the rates differ by less than ``LIFT``."""
    rates = (a + 0.5) / (n1 + 1), (b + 0.5) / (n0 + 1), (a + b + 0.5) / (n1 + n0 + 1)
    part = lambda k, n, p: k * F.log(p) + (n - k) * F.log(1 - p)
    return F.when(rates[0] > LIFT * rates[1], 2 * (part(a, n1, rates[0]) + part(b, n0, rates[1]) - part(a + b, n1 + n0, rates[2]))).otherwise(0.0)


def mine(sample: DataFrame) -> list[bytes]:
    """The word starts whose use tells toxic rows of the sample (text, label) most, best first."""
    schema = pa.schema([("label", pa.int32()), ("starts", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.arrow_steps(batches):
            found = [used_starts(t or b"") for t in part.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("label").cast(pa.int32()), pa.array(found, type=schema.field(1).type)], schema=schema)

    n1, n0 = (int(n or 0) for n in sample.agg(F.sum("label"), F.sum(1 - F.col("label"))).first())
    if not n1 or not n0:
        return []
    each = sample.select("text", "label").mapInArrow(run, C.spark_schema(schema)).select("label", F.explode("starts").alias("start"))
    counts = each.groupBy("start").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")).filter(F.col("a") >= LEAST_TEXTS)
    rated = counts.select("start", _ratio(F.col("a"), F.col("b"), n1, n0).alias("g")).filter(F.col("g") >= LEAST_RATIO)
    return [bytes(r.start) for r in rated.orderBy(F.desc(F.round("g", 6)), "start").limit(MINED).collect()]


def _tree(joint: np.ndarray, total: np.ndarray) -> list[int]:
    """Parent of each voter or -1: a maximum spanning forest by mutual information given the class.

    ``joint[c, a, b]`` is the matrix of how often voter i says a and voter j says b in class c.
    """
    m = joint.shape[-1]
    info = np.zeros((m, m))
    for c in range(2):
        own = [joint[c, a, a].diagonal() for a in range(2)]
        for a in range(2):
            for b in range(2):
                p, q = joint[c, a, b] / total[c], np.outer(own[a], own[b]) / total[c] ** 2
                info += total[c] / total.sum() * np.where(p > 1e-12, p * np.log(np.maximum(p, 1e-12) / np.maximum(q, 1e-12)), 0)
    np.fill_diagonal(info, 0)
    parent, best, gain, left = [-1] * m, np.full(m, -1), np.full(m, LEAST_INFORMATION), np.ones(m, dtype=bool)
    while left.any():
        at = int(np.argmax(np.where(left, gain, -1)))
        parent[at], left[at] = int(best[at]), False
        closer = left & (info[at] > gain)
        best[closer], gain[closer] = at, info[at][closer]
    return parent


def label_model(v: np.ndarray, y: np.ndarray, prior: float) -> np.ndarray:
    """Posterior of toxic for each row of votes (0 or 1) and label y, which is the annotator's vote."""
    n, m = v.shape
    post = np.where(y > 0, TRUST, 1 - TRUST)
    parent: list[int] = [-1] * m
    for step in range(EM_STEPS):
        mass = np.stack([1 - post, post])
        total = mass.sum(1) + 1
        both = np.stack([(v * w[:, None]).T @ v for w in mass])
        one = np.stack([w @ v for w in mass])
        joint = np.empty((2, 2, 2, m, m))
        for c in range(2):
            joint[c, 1, 1] = both[c]
            joint[c, 1, 0], joint[c, 0, 1] = one[c][:, None] - both[c], one[c][None, :] - both[c]
            joint[c, 0, 0] = mass[c].sum() - one[c][:, None] - one[c][None, :] + both[c]
        joint = np.maximum(joint, 0)
        if step < TREE_STEPS:
            parent = _tree(joint, total)
        odds = np.full(n, np.log(prior / (1 - prior)))
        for j, up in enumerate(parent):
            if up < 0:
                on = [(one[c][j] + 0.5) / total[c] for c in range(2)]
                odds += np.where(v[:, j] > 0, np.log(on[1] / on[0]), np.log((1 - on[1]) / (1 - on[0])))
                continue
            table = np.empty((2, 2))  # of the parent's and the own vote
            for a in range(2):
                on = [(joint[c, a, 1, up, j] + 0.5 * total[c] / total.sum()) / (joint[c, a, :, up, j].sum() + total[c] / total.sum()) for c in range(2)]
                table[a] = np.log((1 - on[1]) / (1 - on[0])), np.log(on[1] / on[0])
            odds += table[v[:, up].astype(int), v[:, j].astype(int)]
        right = [(mass[c] @ (y == c) + TRUST * TRUST_WEIGHT * n) / (mass[c].sum() + TRUST_WEIGHT * n) for c in range(2)]
        odds += np.where(y > 0, np.log(right[1] / (1 - right[0])), np.log((1 - right[1]) / right[0]))
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post


def fit(x: np.ndarray, y: np.ndarray, starts: list[bytes]) -> dict:
    """Logistic weights on the posterior labels."""
    voters = Voters(starts)
    if len(y) == 0 or y.min() == y.max():
        w = np.zeros(voters.n + _NUMBERS)
        w[voters.n] = 3.0
        return {"w": w, "b": -3.0, "starts": starts}
    prior = float(np.clip(y.mean(), 0.01, 0.5))
    votes = x[:, : voters.n]
    votes = votes[:, votes.any(0) & ~votes.all(0)]  # a voter that never changes says nothing
    post = label_model(votes, y, prior)
    z = np.hstack([x, np.ones((len(x), 1))])
    w, pull = np.zeros(z.shape[1]), np.full(z.shape[1], RIDGE)
    # Lexicon words that never fire here lean on the common count.
    pull[-1] = 1e-6
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - post) / len(z) + pull * w
        hess = (z * (p * (1 - p))[:, None]).T @ z / len(z) + np.diag(pull)
        w -= np.linalg.solve(hess, grad)
    return {"w": w[:-1], "b": float(w[-1]), "starts": starts}


def score(model: dict, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ model["w"] + model["b"], -30, 30)))


def _mapped(df: DataFrame, starts: list[bytes], made, out: pa.Schema, keep: tuple[str, ...]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(starts)
        for part in C.arrow_steps(batches):
            texts = part.column("text").cast(pa.binary()).to_pylist()
            x = np.array([voters.features(t or b"") for t in texts]).reshape(-1, voters.n + _NUMBERS)
            yield pa.RecordBatch.from_arrays([*(part.column(c).cast(out.field(c).type) for c in keep), made(x)], schema=out)

    return df.mapInArrow(run, C.spark_schema(out))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> dict:
    with C.Scratch(docs.sparkSession) as scratch:
        few = training_sample(docs, labels, label, FOLDS, HELD_OUT, SAMPLE, id_col, text_col).select("doc_id", "text", "label")
        few = scratch.save(few, "sample")
        starts = mine(few)
        out = C.arrow_schema(C.id_type(few, "doc_id"), label=pa.int32(), x=pa.list_(pa.float64()))
        each = _mapped(few, starts, lambda x: pa.array(x.tolist(), type=pa.list_(pa.float64())), out, ("doc_id", "label"))
        # One row for each id and label, however many documents share the id: what is collected is bounded.
        rows = sorted(each.groupBy("doc_id", "label").agg(F.min("x").alias("x")).collect(), key=lambda r: (r.doc_id, r.label))
    return fit(np.array([r.x for r in rows]).reshape(-1, Voters(starts).n + _NUMBERS), np.array([r.label for r in rows]), starts)


def classify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    out = C.arrow_schema(C.id_type(docs, id_col), score=pa.float64())
    scored = _mapped(C.id_and_text(docs, id_col, text_col), model["starts"], lambda x: pa.array(score(model, x)), out, ("doc_id",))
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, train(docs, labels))
