"""Operator 13, periodic runs of words by harmonic grid probing.

A run is a stretch of words with smallest period q, at least ``POWER`` periods and ``LEAST`` words long, that no
neighbouring word extends. For each period p, in ascending order, words at grid points jp and (j+1)p are
compared; a run of four periods holds three such pairs in a row, so only points that start three equal pairs
survive. A survivor is extended both ways by comparing chunks of the array with itself p places on.
Grid pairs within a run already found, of a period that divides p, are skipped: what they would
find has that shorter period. All grids together have about n ln n points.

Texts of an Arrow batch are laid end to end in arrays of up to ``WORDS`` words, longest first, a number of its own
between any two, so one comparison probes a period in all of them; only texts of four periods take part.

:func:`repeat_tails` makes the texts that the query looks at: the tail of every tenth text becomes repeats of
its own start. Defined results: a null or empty text has no words and no run; a row with a null id keeps its words
as they are; ids of any type count by their text; repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

POWER, LEAST = 4, 6
#: Words of several texts that are searched together; a longer text is searched alone.
WORDS, CHUNK, MOST_CHUNK = 1 << 20, 16, 1 << 16


def _ahead(a: np.ndarray, x: int, p: int) -> int:
    """The first y >= x whose word isn't the one p places on."""
    size, last = CHUNK, len(a) - p
    while x < last:
        end = min(x + size, last)
        differ = np.flatnonzero(a[x:end] != a[x + p : end + p])
        if len(differ):
            return x + int(differ[0])
        x, size = end, min(2 * size, MOST_CHUNK)
    return last


def _behind(a: np.ndarray, x: int, p: int) -> int:
    """The least y <= x from which all words up to x are those p places on."""
    size = CHUNK
    while x > 0:
        end = max(x - size, 0)
        differ = np.flatnonzero(a[end:x] != a[end + p : x + p])
        if len(differ):
            return end + int(differ[-1]) + 1
        x, size = end, min(2 * size, MOST_CHUNK)
    return 0


def find_runs(a: np.ndarray, sizes: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in texts of the given sizes, in descending order, laid end to end.

    A value that occurs nowhere else follows each text, so no run crosses into the next.
    """
    ends = np.cumsum(np.array(sizes, dtype=np.int64) + 1)
    found: list[tuple[int, int, int]] = []
    active: list[tuple[int, int, int]] = []  # runs longer than the period at hand
    texts = len(sizes)
    for p in range(1, max(sizes, default=0) // POWER + 1):
        while sizes[texts - 1] < max(LEAST, POWER * p):
            texts -= 1
            if not texts:
                return found
        b = a[: ends[texts - 1]]
        grid = b[::p]
        same = grid[1:] == grid[:-1]
        active = [r for r in active if r[1] > p]
        for start, length, q in active:
            if p % q == 0:
                same[-(-start // p) : (start + length - 1) // p] = False
        done = -1
        for j in np.flatnonzero(same[:-2] & same[1:-1] & same[2:]).tolist():
            x = j * p
            if x < done:
                continue
            start, done = _behind(b, x, p), _ahead(b, x, p)
            length = done + p - start
            if length >= max(LEAST, POWER * p):
                found.append((start, length, p))
                active.append((start, length, p))
    return found


def runs_by_text(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Runs of each list of words, by start and then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    order = sorted((i for i, w in enumerate(texts) if len(w) >= LEAST), key=lambda i: -len(texts[i]))
    at = 0
    while at < len(order):
        group, total = [], 0
        while at < len(order) and (not group or total + len(texts[order[at]]) <= WORDS):
            group.append(order[at])
            total += len(texts[order[at]])
            at += 1
        numbers, fresh, parts = {}, count(), []
        for k, i in enumerate(group):
            parts += [np.fromiter(map(numbers.setdefault, texts[i], fresh), dtype=np.int64, count=len(texts[i])), [-1 - k]]
        sizes = [len(texts[i]) for i in group]
        starts = np.cumsum([0, *(n + 1 for n in sizes)])
        for start, length, period in find_runs(np.concatenate(parts), sizes):
            k = int(np.searchsorted(starts, start, side="right")) - 1
            out[group[k]].append((start - int(starts[k]), length, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (array of start, length and period by start, then period) and collapsed, the text without repeats of a period."""
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = C.arrow_schema(C.id_type(docs, id_col), n_words=pa.int64(), runs=pa.list_(run), collapsed=pa.string())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("start", "length", "period")
        for part in C.arrow_steps(batches):
            texts = [(t or b"").split() for t in part.column("text").cast(pa.binary()).to_pylist()]
            found = runs_by_text(texts)
            columns = [
                pa.array([len(w) for w in texts], type=pa.int64()), pa.array([[dict(zip(names, r, strict=True)) for r in runs] for runs in found], type=schema.field("runs").type),
                pa.array([b" ".join(collapse(w, r)) for w, r in zip(texts, found, strict=True)], type=pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(schema.field(0).type), *columns], schema=schema)

    return C.id_and_text(docs, id_col, text_col).mapInArrow(search, C.spark_schema(schema))


def repeat_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text; where the CRC-32 h of the id is divisible by 10, words from a on become repeats of the first p of them.

    With g = h div 10 and n words, a = g mod n and p = 1 + (n - a) div (3 + g mod 8). Such a text is its words joined by blanks; others stay.
    """
    plain = C.id_and_text(docs, id_col, text_col)

    def repeated(s: Column) -> Column:
        w, g = s["w"], s["g"]
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = F.lit(1).cast("long") + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
        tail = F.sequence(F.lit(0).cast("long"), n - a - 1)
        picked = F.transform(F.array(F.struct(w.alias("w"), a.alias("a"), p.alias("p"))), lambda b: F.concat(
            F.slice(b["w"], F.lit(1), b["a"].cast("int")), F.transform(tail, lambda i: F.get(b["w"], (b["a"] + F.pmod(i, b["p"])).cast("int")))))
        return F.when(n > 0, F.array_join(F.get(picked, 0), " "))

    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(C.WORD), F.lit(0))
    made = F.get(F.transform(F.array(F.struct(words.alias("w"), F.floor(h / 10).alias("g"))), repeated), 0)
    return plain.select("doc_id", F.when(h % 10 == 0, F.coalesce(made, "text")).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The number of runs, the run of most periods, and checksums of all runs and of the collapsed text."""
    none = F.struct(*(F.lit(None).cast("long").alias(c) for c in ("start", "length", "period")))
    # Runs come by start and period, so the first of equal ones stays.
    more = lambda best, r: best["start"].isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate("runs", none, lambda b, r: F.when(more(b, r), r).otherwise(b))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
