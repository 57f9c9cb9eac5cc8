"""White space, cleaning and counting of text, as columns that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space, and those that don't.
_BLANKS = r"\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
WS = f"[{_BLANKS}]"
NOT_WS = f"[^{_BLANKS}]"

#: A run of it; the look ahead ends most attempts by one comparison.
GAP = f"(?![!-~]){WS}++"
#: The same characters one by one, for trimming.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

MIN_BLOCK_WORDS = 8


def strip(c: Column) -> Column:
    """Without white space at both ends; reads no pattern over the text between."""
    return F.btrim(c, F.lit(SPACES))


def normalize_newlines(c: Column) -> Column:
    """CRLF and CR become LF."""
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def collapse_spaces(c: Column) -> Column:
    """Runs of blanks and tabs become one blank; other spaces stay. A single blank, the usual case, is no match."""
    return F.regexp_replace(c, r"[ \t]{2,}|\t", " ")


def collapse_blank_lines(c: Column) -> Column:
    """Three or more LF in a row become two."""
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def clean_text(c: Column) -> Column:
    return strip(collapse_blank_lines(collapse_spaces(normalize_newlines(c))))


def words(c: Column) -> Column:
    """array<string> of the words. Splitting at white space takes a seventh of the time of extracting words."""
    return F.array_remove(F.split(c, GAP, -1), "")


def word_count(c: Column) -> Column:
    return F.when(c.isNotNull(), F.size(words(c)))


def enough_words(c: Column, least: int = MIN_BLOCK_WORDS) -> Column:
    """Whether there are so many words; reads no further than the last of them."""
    return c.rlike(rf"\A{WS}*+(?:{NOT_WS}++{WS}++){{{least - 1}}}{NOT_WS}") if least > 0 else c.isNotNull()


def lines(c: Column) -> Column:
    """Stripped lines of text that is already normalised."""
    return F.transform(F.split(c, "\n", -1), strip)


def ordered_distinct(blocks: Column) -> Column:
    """First occurrences, in order."""
    return F.array_distinct(blocks)


def join_blocks(blocks: Column) -> Column:
    return F.array_join(blocks, "\n\n")


def csv_items(c: Column) -> Column:
    """Stripped items of a comma-separated setting, without blank ones."""
    return F.filter(F.transform(F.split(c, ",", -1), strip), lambda x: x != "")
