"""Byte-level BPE against merging without a queue, and against the library that reads such files."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import bpe
from textloom.plans.encoding import TOKENIZER

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer file")

TEXTS = [
    "", " ", "  \n\n  x", "It's we'll they'RE don't", "a  b\t\tc \n d", "naïve café — 東京 42 3.14159 ½ ²", "😀😀 👩‍👩‍👧 é", "x" * 3000, "ab" * 500, "<|endoftext|>mid<|endoftext|> end", "\x00\x1f\x85  nbsp here",
]


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges.read(TOKENIZER)


def plain_merge(ids: list[int], pairs: dict) -> list[int]:
    """The pair of least rank, its leftmost place, again and again."""
    while True:
        found = [(pairs[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in pairs]
        if not found:
            return ids
        _, i = min(found)
        ids = [*ids[:i], pairs[ids[i], ids[i + 1]][1], *ids[i + 2 :]]


def test_queue_against_plain_merging(merges):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeinrst hé") for _ in range(rng.randint(1, 40))) for _ in range(400)] + ["aaaaaaaaaaa", "eeeeeee", "ininininin"]
    for w in words:
        assert merges.merged(w.encode()) == plain_merge([merges.byte_ids[b] for b in w.encode()], merges.pairs)


def test_odd_ranks():
    """Merges that come up by another merge before their turn, in a made-up file."""
    ids = list(range(256))
    pairs = {(97, 98): (5, 300), (300, 99): (0, 301), (99, 97): (2, 302), (301, 301): (1, 303), (97, 97): (7, 304), (304, 97): (3, 305)}
    made = bpe.Merges(pairs, ids)
    rng = random.Random(6)
    for _ in range(500):
        w = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14)))
        assert made.merged(w) == plain_merge(list(w), pairs)


def test_encoding_against_the_library(spark, merges, sf):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(TOKENIZER)
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    encode = merges.encoder()
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encode(t) == e.ids


def test_signs_and_prefix_space(merges, tmp_path):
    """Files with both kinds of post-processing and a leading blank."""
    tokenizers = pytest.importorskip("tokenizers")
    with open(TOKENIZER, encoding="utf-8") as f:
        whole = json.load(f)
    whole["pre_tokenizer"]["add_prefix_space"] = True
    forms = [
        {"type": "RobertaProcessing", "sep": ["!", 0], "cls": ["\"", 1], "trim_offsets": True, "add_prefix_space": False},
        {"type": "TemplateProcessing", "single": [{"SpecialToken": {"id": "!", "type_id": 0}}, {"Sequence": {"id": "A", "type_id": 0}}, {"SpecialToken": {"id": "#", "type_id": 0}}],
         "pair": [{"Sequence": {"id": "A", "type_id": 0}}, {"Sequence": {"id": "B", "type_id": 0}}], "special_tokens": {c: {"id": c, "ids": [i], "tokens": [c]} for c, i in (("!", 0), ("#", 2))}},
    ]
    for i, form in enumerate(forms):
        path = tmp_path / f"{i}.json"
        path.write_text(json.dumps(whole | {"post_processor": form}), encoding="utf-8")
        made = bpe.Merges.read(str(path))
        library = tokenizers.Tokenizer.from_file(str(path))
        encode = made.encoder()
        for t in TEXTS[1:]:
            assert [*made.start, *encode(t), *made.end] == library.encode(t).ids
        library.enable_truncation(8)
        assert [*made.start, *encode("a long text of many words that is cut")[:6], *made.end] == library.encode("a long text of many words that is cut").ids


def test_columns(spark, merges):
    df = spark.createDataFrame([(1, "hello world " * 600), (2, None), (3, "hi")], "id int, text string").repartition(2)
    ids = bpe.byte_pair_ids(spark, merges)
    got = {r.id: r for r in df.select("id", ids(F.col("text")).alias("ids")).select("id", "ids", bpe.model_ids(F.col("ids"), (7,), (8, 9)).alias("x")).collect()}
    assert len(got[1].ids) == 1201 and len(got[1].x) == 512 and got[1].x[0] == 7 and got[1].x[-2:] == [8, 9]
    assert got[2].ids == [] and got[2].x == [7, 8, 9] and got[3].x == [7, *merges.encoder()("hi"), 8, 9]


def test_refused_files(tmp_path):
    with open(TOKENIZER, encoding="utf-8") as f:
        whole = json.load(f)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}):
        path = tmp_path / "t.json"
        path.write_text(json.dumps(whole | change), encoding="utf-8")
        with pytest.raises(ValueError, match="byte-level"):
            bpe.Merges.read(str(path))


@pytest.mark.parametrize("most", [0, 1, 5, 511])
def test_first_ids_are_those_of_the_whole_text(merges, most):
    """A reader that cuts the text needs no more ids, and the rest isn't encoded; all ids of a batch were held as lists before."""
    for given in ("", "a", "Ünïcode words, 1234 of them. " * 60, "<|endoftext|>ab<|endoftext|>" * 9):
        assert merges.encoder(most)(given) == merges.encoder()(given)[:most]
