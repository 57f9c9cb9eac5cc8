"""Operator 3, quality classifier: Bradley-Terry ranking of documents from preference pairs.

In each pair a document labelled good is preferred to one labelled bad. The strength of a document
is linear in its features; logistic loss on feature differences fits the weights (Newton steps with
a ridge). The threshold is the quantile of the sample's strengths at the share of bad labels, and
the score is ``sigmoid(strength - threshold + logit(0.3))``, so that 0.3 is the threshold.

Features come from whole texts only. The fit uses at most ``SAMPLE`` labelled rows of the training
folds; scoring covers every row. Defined results: a null or empty text is scored as an empty text;
a null id is never held out; without labels of both kinds every score is the share of good labels
(0.5 without any); repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .labelled import fold, training_sample
from .textstats import CHAR_CLASSES, COMMON, COMMON_WORDS, profile

SAMPLE, PAIRS, RIDGE, STEPS, SEED = 20_000, 200_000, 1e-3, 12, 3
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
_BY_LANG = np.array([[w.decode() in words for w in COMMON] for words in COMMON_WORDS.values()], dtype=float)


def features(text: bytes) -> list[float]:
    """Rates of one text; all zero for the empty text, but for the constant signs of emptiness."""
    p = profile(text)
    n, chars = max(p["n_words"], 1), p["chars"]
    rates = chars / max(int(chars.sum()), 1)
    common = _BY_LANG @ np.array(p["common"], dtype=float) / max(p["n_plain"], 1)
    dup, rep = p["n_dup_lines"] / max(p["n_lines"], 1), p["n_repeat_words"] / n
    own = [
        np.log1p(p["n_words"]), p["n_words"] < 20, p["n_words"] < 8, p["word_chars"] / n, p["n_symbols"] / n, dup, rep, rep > 0.3, rep > 0,
        p["n_distinct"] / max(p["n_plain"], 1), p["n_plain"] / n, common.max(), np.log1p(p["n_lines"]) - np.log1p(p["n_words"]),
    ]
    return [float(x) for x in (*own, *rates, *np.sqrt(rates))]


N_FEATURES = 13 + 2 * len(CHAR_CLASSES)


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Weights for standardised features, and the strength that stands for the threshold."""
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return {"constant": share}
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = (x - mean) / spread
    rng = np.random.default_rng(SEED)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = z[rng.choice(good, PAIRS)] - z[rng.choice(bad, PAIRS)]
    w = np.zeros(z.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        grad = d.T @ (p - 1) / len(d) + RIDGE * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + RIDGE * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    return {"mean": mean, "spread": spread, "w": w, "threshold": float(np.quantile(z @ w, 1 - y.mean()))}


def score(model: dict, x: np.ndarray) -> np.ndarray:
    if "constant" in model:
        return np.full(len(x), model["constant"])
    strength = ((x - model["mean"]) / model["spread"]) @ model["w"]
    return 1 / (1 + np.exp(-np.clip(strength - model["threshold"] + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


def _mapped(df: DataFrame, made, out: pa.Schema, keep: tuple[str, ...]) -> DataFrame:
    """Keeps columns and adds what ``made`` gives for the feature matrix of a step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.arrow_steps(batches):
            texts = part.column("text").cast(pa.binary()).to_pylist()
            x = np.array([features(t or b"") for t in texts]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([*(part.column(c).cast(out.field(c).type) for c in keep), made(x)], schema=out)

    return df.mapInArrow(run, C.spark_schema(out))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> dict:
    few = training_sample(docs, labels, label, FOLDS, HELD_OUT, SAMPLE, id_col, text_col).select("doc_id", "text", "label")
    out = C.arrow_schema(C.id_type(few, "doc_id"), label=pa.int32(), x=pa.list_(pa.float64()))
    each = _mapped(few, lambda x: pa.array(x.tolist(), type=pa.list_(pa.float64())), out, ("doc_id", "label"))
    # One row for each id and label, however many documents share the id: what is collected is bounded.
    rows = sorted(each.groupBy("doc_id", "label").agg(F.min("x").alias("x")).collect(), key=lambda r: (r.doc_id, r.label))
    return fit(np.array([r.x for r in rows]).reshape(-1, N_FEATURES), np.array([r.label for r in rows]))


def classify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    out = C.arrow_schema(C.id_type(docs, id_col), score=pa.float64())
    scored = _mapped(C.id_and_text(docs, id_col, text_col), lambda x: pa.array(score(model, x)), out, ("doc_id",))
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, train(docs, labels))
