"""Counts of one text that the quality operators share: characters by class, words, repeats."""

from __future__ import annotations

from collections import Counter

import numpy as np

# Frequent function words of four languages.
COMMON_WORDS = {
    "en": "the of and to in is that it for was on are with as at be by this from or an have not".split(),
    "fr": "de la le et les des en un du que est pour qui dans par au une sur pas plus avec se".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como así".split(),
}
COMMON = [w.encode() for w in dict.fromkeys(w for words in COMMON_WORDS.values() for w in words)]

# The classes of bytes whose histogram is compared. A non-ASCII character counts at its first byte.
CHAR_CLASSES = ("lower", "upper", "digit", "blank", "line", "stop", "comma", "quote", "symbol", "other_ascii", "latin", "other")
SYMBOLS = b"#*$%&|<>"

WINDOW = 8

_CLASS = np.full(256, CHAR_CLASSES.index("other_ascii"))
for _name, _members in (
    ("lower", b"abcdefghijklmnopqrstuvwxyz"), ("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", b"0123456789"),
    ("blank", b" \t\x0b\x0c"), ("line", b"\n\r"), ("stop", b".!?"), ("comma", b",;:"), ("quote", b"\"'()-"), ("symbol", SYMBOLS + b"@^~_=+/\\{}[]`"),
):
    _CLASS[list(_members)] = CHAR_CLASSES.index(_name)
_CLASS[0xC2:0xC4] = CHAR_CLASSES.index("latin")
_CLASS[0xC4:] = CHAR_CLASSES.index("other")
_CLASS[0x80:0xC2] = len(CHAR_CLASSES)  # later bytes of a character
_SPACES = [0x20, *range(0x09, 0x0E)]
_SYMBOLS = list(SYMBOLS)
#: Lower case for A-Z, a blank for every other ASCII character that isn't a letter.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MIX = np.random.default_rng(8).integers(1, 2**63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words covered by windows of ``width`` words that occur twice or more in the list.

    Hashes of windows find the candidates; windows are then compared word by word.
    """
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    rolled = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        rolled += ids[j : j + n] * _MIX[j]
    order = np.argsort(rolled, kind="stable")
    same = rolled[order[1:]] == rolled[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n, dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    at = np.flatnonzero(hit).tolist()
    found = [tuple(words[i : i + width]) for i in at]
    times = Counter(found)
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    for i, w in zip(at, found, strict=True):
        if times[w] > 1:
            covered[i] += 1
            covered[i + width] -= 1
    return int(np.count_nonzero(np.cumsum(covered)))


def profile(text: bytes) -> dict:
    """All counts of one UTF-8 text in one pass of each kind; the empty text has zeros."""
    words = text.split()
    seen = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    chars = np.bincount(_CLASS, weights=seen, minlength=len(CHAR_CLASSES) + 1)[: len(CHAR_CLASSES)].astype(np.int64)
    lines = [x for x in text.split(b"\n") if x.strip()]
    plain = Counter(text.translate(_LETTERS).split())
    return {
        "n_words": len(words),
        "word_chars": int(chars.sum() - seen[_SPACES].sum()),
        "n_symbols": int(seen[_SYMBOLS].sum()),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(words),
        "chars": chars,
        "common": [plain.get(w, 0) for w in COMMON],
        "n_plain": plain.total(),
        "n_distinct": len(plain),
        "n_lines": len(lines),
    }
