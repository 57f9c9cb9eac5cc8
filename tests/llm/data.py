"""Small tables with awkward rows, and plain versions of the contracts' base results."""

from __future__ import annotations

import random
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    """Documents in syllables, with copies, near copies, shared passages, nulls, empty and long texts, and repeated rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "er", "th", "on", "ing", "é", "ß", "st"]) for _ in range(rng.randint(1, 3)))
    prose = lambda k: " ".join(word() for _ in range(k)).capitalize() + "."
    passage = prose(70)
    texts: list[str | None] = []
    for i in range(n):
        kind = i % 10
        if kind == 3 and texts:
            texts.append(rng.choice(texts))
        elif kind == 4 and texts and texts[0]:
            w = texts[0].split(" ")
            w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
        elif kind == 5:
            texts.append(f"{prose(rng.randint(0, 60))}\n{passage}\t{prose(20)}")
        elif kind == 6:
            texts.append("\n".join([prose(9)] * rng.randint(2, 6)))
        else:
            texts.append(prose(rng.randint(30, 220)))
    texts += [None, "", " \n\t ", "one", "one two", "x " * 3000, "# $ % & | < >" * 8, "İ K ſ é 😀 word\x0bword\x1fword", passage, prose(4000)]
    out = [(i, t, rng.choice(["en", "fr", None, "xx"]), rng.choice(["a", "a", "b", None, "é"]), len(t) if t is not None else None, "e") for i, t in enumerate(texts)]
    out.append(out[0])  # a repeated row
    out.append((None, texts[1], "en", "a", 1, None))
    out.append((None, None, None, None, None, None))
    rng.shuffle(out)
    return out


def table(spark: SparkSession, given: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(rows() if given is None else given, SCHEMA).repartition(3)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def as_rows(df: DataFrame, *columns: str) -> Counter:
    return Counter(tuple(r) for r in df.select(*columns).collect())
