"""Byte-level BPE: texts to token ids by the ranks of a tokenizer file, in Arrow batches.

A text is cut into words by a fixed pattern; a word starts as the tokens of its UTF-8 bytes, and of all neighbours
that the file can merge those of least rank, the leftmost first, become one token until none is left. Candidates wait in
a priority queue, so a word of n bytes takes about n log n steps however long it is.

The file is read on the driver and its merges are broadcast (at most ``MAX_MERGES``), so executors need no copy of it.
Words come again and again: each worker keeps the ids of up to ``MEMO`` short ones; results don't depend on that.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .tokens import MAX_LENGTH

MAX_MERGES, MEMO, MEMO_BYTES = 1_000_000, 50_000, 48
# Fixed value: what byte-level BPE takes for a word.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The letter by which such files write each byte: printable Latin-1 by itself, the others by U+0100 and on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


@dataclass
class Merges:
    """What encoding needs of a tokenizer file. ``pairs`` maps (left, right) to (rank, merged id)."""

    pairs: dict[tuple[int, int], tuple[int, int]]
    byte_ids: list[int]
    specials: dict[str, int] = field(default_factory=dict)
    prefix_space: bool = False
    start: tuple[int, ...] = ()
    end: tuple[int, ...] = ()

    @classmethod
    def read(cls, path: str) -> Merges:
        """From the fast tokenizer's JSON file; refused unless it is byte-level BPE without a normalizer."""
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, pre = whole["model"], whole["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
        if model.get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or whole["normalizer"] or odd:
            raise ValueError(f"not plain byte-level BPE: {path}")
        if len(model["merges"]) > MAX_MERGES:
            raise ValueError(f"{len(model['merges'])} merges; at most {MAX_MERGES} are broadcast")
        vocabulary, pairs = model["vocab"], {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pairs[vocabulary[left], vocabulary[right]] = rank, vocabulary[left + right]
        start, end = _around(whole["post_processor"] or {})
        specials = {t["content"]: t["id"] for t in whole["added_tokens"]}
        return cls(pairs, [vocabulary[c] for c in byte_letters()], specials, pre.get("add_prefix_space", False), start, end)

    def merged(self, word: bytes) -> list[int]:
        """Token ids of one word."""
        ids = [self.byte_ids[b] for b in word]
        pairs, n = self.pairs, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(*found, i, ids[i], ids[i + 1]) for i in range(n - 1) if (found := pairs.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, new, i, left, right = heapq.heappop(queue)
            j = after[i]
            # A place may have changed since it was queued: -1 is a token that was merged into another.
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := pairs.get((new, ids[k])):
                    heapq.heappush(queue, (*found, i, new, ids[k]))
            h = before[i]
            if h >= 0 and (found := pairs.get((ids[h], new))):
                heapq.heappush(queue, (*found, h, ids[h], new))
        return [t for t in ids if t >= 0]

    def encoder(self, most: int | None = None) -> Callable[[str], list[int]]:
        """Encodes whole texts, or their first ``most`` ids; special tokens written in a text count as such."""
        memo: dict[str, list[int]] = {}
        words = regex.compile(WORD)
        cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None

        def plain(text: str, out: list[int]) -> None:
            if self.prefix_space and text and not text.startswith(" "):
                text = " " + text
            for found in words.finditer(text):
                if most is not None and len(out) >= most:
                    return
                w = found.group()
                ids = memo.get(w)
                if ids is None:
                    ids = self.merged(w.encode())
                    if len(w) <= MEMO_BYTES:
                        if len(memo) >= MEMO:
                            memo.clear()
                        memo[w] = ids
                out += ids

        def encode(text: str) -> list[int]:
            out: list[int] = []
            for k, piece in enumerate(cut.split(text) if cut else [text]):
                if k % 2:
                    out.append(self.specials[piece])
                else:
                    plain(piece, out)
                if most is not None and len(out) >= most:
                    return out[:most]
            return out

        return encode


def _around(processor: dict) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Ids that the file puts before and after a text."""
    if processor.get("type") in ("RobertaProcessing", "BertProcessing"):
        return (processor["cls"][1],), (processor["sep"][1],)
    if processor.get("type") == "TemplateProcessing":
        parts, ids = processor["single"], processor["special_tokens"]
        at = next(i for i, p in enumerate(parts) if "Sequence" in p)
        of = lambda some: tuple(t for p in some for t in ids[p["SpecialToken"]["id"]]["ids"])
        return of(parts[:at]), of(parts[at + 1 :])
    return (), ()


def byte_pair_ids(spark: SparkSession, merges: Merges, most: int | None = None) -> Callable[[Column], Column]:
    """A function of a text column that gives its token ids, array<int>, without start and end; null has none.

    All ids, or with ``most`` the first ones, for readers that cut the text there: the rest of it isn't encoded. A batch is held as four bytes an id.
    """
    shared = spark.sparkContext.broadcast(merges)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = shared.value.encoder(most)
        for texts in batches:
            flat, ends = array("i"), array("i", [0])
            for t in texts:
                flat.extend(encode(t.as_py() or ""))
                ends.append(len(flat))
            yield pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), len(ends), [None, pa.py_buffer(ends)]), pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)]))

    return ids


def model_ids(ids: Column, start: tuple[int, ...] = (), end: tuple[int, ...] = (), length: int = MAX_LENGTH) -> Column:
    """At most ``length`` ids with start and end around them; what doesn't fit is cut off the text, not off the end sign."""
    constant = lambda some: F.array(*map(F.lit, some)).cast("array<int>")
    return F.concat(constant(start), F.slice(ids, 1, length - len(start) - len(end)), constant(end))
