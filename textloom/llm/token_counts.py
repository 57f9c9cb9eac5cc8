"""Operator 10, token counts: greedy longest-match pieces counted by a linear automaton.

The vocabulary becomes a trie over bytes whose nodes carry a failure link and the number of pieces
popped on the way along it, so one scan of a word counts its pieces without building them. Words
are cut as everywhere in this subpackage, A-Z in lower case, and end with an end-of-word sign that
pieces may include. A byte that starts no piece is one token of its own. Counts of recent words
are kept in a bounded table; the result doesn't depend on it.

The vocabulary is read on the driver from the path given and broadcast; it is refused beyond
``MAX_PIECES`` pieces. Defined results: a null or empty text has zero words and tokens; repeated
rows each get a row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
MAX_PIECES, MEMO = 1_000_000, 200_000
END = 256  # the end-of-word sign, a symbol beside the bytes
WIDTH = 257
_END_TEXT = "</w>"


def byte_letters() -> dict[str, int]:
    """The letters by which such vocabularies write bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> list[tuple[int, ...]]:
    """Pieces as symbols: bytes, and ``END`` last where the piece closes a word."""
    with open(path, encoding="utf-8") as f:
        names = json.load(f)["model"]["vocab"]
    if len(names) > MAX_PIECES:
        raise ValueError(f"{len(names)} pieces; at most {MAX_PIECES} are broadcast")
    letters, out = byte_letters(), []
    for name in names:
        closes = name.endswith(_END_TEXT)
        body = name[: -len(_END_TEXT)] if closes else name
        if all(c in letters for c in body) and (body or closes):
            out.append((*(letters[c] for c in body), *([END] if closes else [])))
    return out


class Automaton:
    """Trie with failure links. ``step`` maps node * WIDTH + symbol to a node; ``fail`` and ``popped`` are by node.

    For node u that spells s: if s is a piece, failing pops it whole and goes to the root; else
    failing pops the longest pieces that start s and goes to the node of what is left, or to -1
    where s starts with no piece.
    """

    def __init__(self, pieces: list[tuple[int, ...]]):
        self.step: dict[int, int] = {}
        depth, final, parent, symbol = [0], [False], [0], [0]
        for piece in {*pieces, *((b,) for b in range(WIDTH))}:
            u = 0
            for s in piece:
                v = self.step.get(u * WIDTH + s)
                if v is None:
                    v = self.step[u * WIDTH + s] = len(depth)
                    depth.append(depth[u] + 1)
                    final.append(False)
                    parent.append(u)
                    symbol.append(s)
                u = v
            final[u] = True
        self.fail, self.popped = [-1] * len(depth), [0] * len(depth)
        for v in sorted(range(1, len(depth)), key=depth.__getitem__):
            if final[v]:
                self.fail[v], self.popped[v] = 0, 1
                continue
            z, n = self.fail[parent[v]], self.popped[parent[v]]
            while z >= 0 and z * WIDTH + symbol[v] not in self.step:
                z, n = self.fail[z], n + self.popped[z]
            if z >= 0:
                self.fail[v], self.popped[v] = self.step[z * WIDTH + symbol[v]], n

    def count(self, word: bytes) -> int:
        """Pieces of a word followed by the end sign. Every single symbol is a piece, so each failure pops one."""
        step, fail, popped = self.step, self.fail, self.popped
        u = n = 0
        for s in (*word, END):
            while (v := step.get(u * WIDTH + s)) is None:
                n += popped[u]
                u = fail[u]
            u = v
        while u:
            n += popped[u]
            u = fail[u]
        return n


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words and n_tokens of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(read_vocabulary(vocabulary)))
    schema = C.arrow_schema(C.id_type(docs, id_col), n_words=pa.int64(), n_tokens=pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, memo = shared.value.count, {}

        def row(text: bytes) -> tuple:
            words = text.lower().split()
            total = 0
            for w in words:
                n = memo.get(w)
                if n is None:
                    n = count(w)
                    if len(memo) >= MEMO:
                        memo.clear()
                    if len(w) <= 64:
                        memo[w] = n
                total += n
            return len(words), total

        yield from C.map_rows(row, schema, (), as_bytes=True)(batches)

    return C.id_and_text(docs, id_col, text_col).mapInArrow(run, C.spark_schema(schema))
