"""Operator 11 against a merge of one row at a time."""

from __future__ import annotations

import zlib
from collections import Counter

from pyspark.sql import functions as F

from textloom.llm import branch_merge as B

from .data import as_rows, rows, table

COLUMNS = ("doc_id", "lang", "source", "text", "n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert")


def code(branch: str, doc_id, name) -> int:
    return zlib.crc32(f"{branch}:{'' if doc_id is None else doc_id}:{name}".encode()) % 17


def branch_of(branch: str, doc_id, text: str, lang: str, source: str) -> dict:
    """Changes of one branch by unit: a value, or None for a drop."""
    if code(branch, doc_id, "row") == 0:
        return {"row": None}
    out = {}
    for name, value in (("lang", lang), ("source", source)):
        new = {0: "", 1: value + "!", 2: value + "?"}.get(code(branch, doc_id, name), value)
        if new != value:
            out[name] = new
    for i, line in enumerate(text.split("\n")):
        c = code(branch, doc_id, i)
        if c <= 2:
            out["line", i] = (None, line + "!", line + "?")[c]
        elif c <= 4:
            out["gap", i] = "!?"[c - 3]
    return out


def plain_merge(given: list[tuple]) -> Counter:
    out, added = Counter(), {}
    for doc_id, text, lang, source, *_ in given:
        text, lang, source = text or "", lang or "", source or ""
        left, right = (branch_of(b, doc_id, text, lang, source) for b in "LR")
        for branch, shift in (("L", 1), ("R", 5)):
            if doc_id is not None and code(branch, doc_id, "row") in (3, 4):
                row = (lang, source, "!?"[code(branch, doc_id, "row") - 3])
                kept = added.setdefault(-shift - doc_id, {})
                kept[branch] = min(kept.get(branch, row), row)
        if "row" in left or "row" in right:
            fought = bool(left) and bool(right) and left != right
            counts = (0, 0, 1, 0) if fought else (1, 0, 0, 0)
            state = left if fought and "row" not in left else None
        else:
            counts, state = [0, 0, 0, 0], {**right, **left}
            for unit in state:
                if unit not in left or unit not in right or left[unit] == right[unit]:
                    counts[0] += 1
                elif unit[0] == "gap":
                    counts[3] += 1
                else:
                    counts[2 if unit[0] == "line" and None in (left[unit], right[unit]) else 1] += 1
        if state is None:
            out[(doc_id, None, None, None, *counts)] += 1
            continue
        lines = []
        for i, line in enumerate(text.split("\n")):
            lines += [state.get(("line", i), line), state.get(("gap", i))]
        out[(doc_id, state.get("lang", lang), state.get("source", source), "\n".join(x for x in lines if x is not None), *counts)] += 1
    for doc_id, by in added.items():
        both = len(set(by.values())) == 2
        out[(doc_id, *by.get("L", by.get("R")), int(not both), 0, 0, int(both))] += 1
    return out


def many(n: int = 900) -> list[tuple]:
    """Enough ids that both branches drop one row, fight over rows, and add rows under one id."""
    langs, sources = ["en", "fr", "", None], ["a", "b", None]
    texts = ["one\ntwo\n\nfour", "", None, "x", "\n\n", "a\nb\nc\nd\ne\nf\ng\nh", " \t\nz\r\n"]
    return [(i, texts[i % 7], langs[i % 4], sources[i % 3], 0, None) for i in range(n)]


def test_merge_row_by_row(spark):
    given = many() + [r for r in rows() if r[0] is None or r[0] > 900] + [(7, "again\nand again", "xx", "q", 0, None)] * 3
    want = plain_merge(given)
    assert as_rows(B.merge_branches(table(spark, given)), *COLUMNS) == want
    kinds = Counter()
    for key in want:
        kinds.update({"clean": key[4] > 0, "edits": key[5] > 0, "fights": key[6] > 0, "inserts": key[7] > 0, "gone": key[3] is None, "added": (key[0] or 0) < 0})
    assert all(kinds[k] > 1 for k in ("clean", "edits", "fights", "inserts", "gone", "added"))


def test_awkward_rows(spark):
    given = rows()
    assert as_rows(B.merge_branches(table(spark, given)), *COLUMNS) == plain_merge(given)
    assert B.digest(B.merge_branches(table(spark, []))).count() == 0


def test_long_texts_and_digest(spark):
    given = [(3, "\n".join(f"line {i}" for i in range(60_000)), "en", "a", 0, None)]
    assert as_rows(B.merge_branches(table(spark, given)), *COLUMNS) == plain_merge(given)
    found = B.merge_branches(table(spark, many(40)))
    assert B.digest(found).filter(F.col("text_sha256").isNull() != F.col("lang").isNull()).count() == 0


def test_ids_of_text_add_no_row(spark):
    docs = table(spark, many(200)).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    assert B.merge_branches(docs).count() == 200
    numbers = table(spark, many(200)).withColumn("doc_id", F.col("doc_id").cast("string"))
    assert B.merge_branches(numbers).count() > 200


def test_no_python_and_two_shuffles(spark):
    plan = B.digest(B.merge_branches(table(spark)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Broadcast" not in plan and "SinglePartition" not in plan
