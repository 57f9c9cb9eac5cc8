"""Operator 2, secret scans: keyword prefilter, anchored patterns near hits, checksum validation.

One Aho-Corasick pass over the lower-cased text finds the keywords of every kind; a kind's pattern
is tried only at its hits, leftmost first and without overlaps. Runs of hexadecimal digits have no
keyword: their pattern, a plain run of one character class, is its own linear prefilter. Tokens
that embed a check value (CRC-32 in base 62) or a decodable header count only if it holds.

Defined results: a null or empty text has no spans; positions are code points, end exclusive;
repeated rows each get a row.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_base62(body: str) -> str:
    """CRC-32 of the body in base 62, six characters wide: the check value at the end of such tokens."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, digit = divmod(n, 62)
        out = BASE62[digit] + out
    return out.rjust(6, "0")


def _crc_holds(m: re.Match) -> bool:
    return crc_base62(m[1][:-6]) == m[1][-6:]


def _jwt_header(m: re.Match) -> bool:
    head = m[0].partition(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except ValueError:
        return False


# Kinds in report order; keywords (lower case), pattern anchored at a keyword, test of a match.
# The first two and hex are the base kinds; the others are public formats of issued credentials.
KINDS = {
    "assign": (
        ("password", "passwd", "secret", "token", "api_key", "apikey"),
        re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
        lambda m: len(m[2]) >= 12,
    ),
    "access": (("akia",), re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    "hex": ((), re.compile(r"[0-9a-f]{16,}"), lambda m: True),
    "forge": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), _crc_holds),
    "registry": (("npm_",), re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), _crc_holds),
    "jwt": (("eyj",), re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), _jwt_header),
    "chat": (("xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"), re.compile(r"xox[bpars]-[0-9A-Za-z-]{20,}"), lambda m: True),
    "maps": (("aiza",), re.compile(r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"), lambda m: True),
    "pay": (("sk_live_", "rk_live_"), re.compile(r"[sr]k_live_[0-9A-Za-z]{16,}"), lambda m: True),
    "pem": (("-----begin ",), re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[^-]*-----END [A-Z ]{0,30}PRIVATE KEY-----)?"), lambda m: True),
}
BASE = ("assign", "access", "hex")
_ORDER = {kind: i for i, kind in enumerate(KINDS)}
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Where a kind's pattern fails at a hit, it fails at every later hit in the same run of these.
_FAILS_IN = {"jwt": re.compile(r"[A-Za-z0-9_-]+")}


@cache
def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, (keywords, _, _) in KINDS.items():
        for k in keywords:
            out.add_word(k, (kind, len(k)))
    out.make_automaton()
    return out


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind in report order."""
    low = text.lower()
    if len(low) != len(text):  # a letter that grows in lower case would shift positions
        low = text.translate(_LOWER)
    hits: dict[str, list[int]] = {}
    for end, (kind, size) in _automaton().iter(low):
        hits.setdefault(kind, []).append(end - size + 1)
    found = [(*m.span(), "hex") for m in KINDS["hex"][1].finditer(text)]
    for kind, starts in hits.items():
        _, pattern, holds = KINDS[kind]
        last = 0
        for at in sorted(starts):
            if at < last:
                continue
            if m := pattern.match(text, at):
                last = m.end()
                if holds(m):
                    found.append((*m.span(), kind))
            elif kind in _FAILS_IN:
                last = _FAILS_IN[kind].match(text, at).end()
    return sorted(found, key=lambda s: (s[0], _ORDER[s[2]]))


def spelled(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans, array<struct<kind, start, end, value>>: all secrets of each row."""
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])
    schema = C.arrow_schema(C.id_type(docs, id_col), spans=pa.list_(item))

    def row(text: str) -> tuple:
        return ([{"kind": k, "start": s, "end": e, "value": text[s:e]} for s, e, k in find_spans(text)],)

    return C.id_and_text(docs, id_col, text_col).mapInArrow(C.map_rows(row, schema, (), as_bytes=False), C.spark_schema(schema))


def digest(spans: DataFrame) -> DataFrame:
    """The contract's columns from the operator's spans."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def text(of: Column) -> Column:
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return spans.select("doc_id", *map(count, BASE), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with every secret replaced; overlapping spans become one mark."""
    out, last = [], 0
    for start, end, _ in find_spans(text):
        if start >= last:
            out += [text[last:start], mark]
        last = max(last, end)
    return "".join([*out, text[last:]])


def redact_documents(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """All rows and columns, with secrets in the text replaced; null stays null. The length column, if there is one, follows the text."""
    spans = F.pandas_udf(lambda s: s.map(lambda t: redact(t) if t is not None else None), "string")
    out = docs.withColumn(text_col, spans(docs[text_col]))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out
