"""URL tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NOT_WS, WS, strip

_AUTHORITY = r"(?i)^https?://([^/?#]+)"
#: The start of such a text before it is stripped and joined: white space in the authority counts only if the text goes on.
_GAP = r"[\t\r\n]*+"
_START = rf"(?i)\A{WS}*+{_GAP.join('http')}{_GAP}(?:s{_GAP})?:{_GAP}/{_GAP}/{_GAP}(?:(?![/?#]){NOT_WS}|{WS}++{NOT_WS})"


def _joined(c: Column) -> Column:
    """Stripped, and without the line ends and tabs that a URL parser deletes."""
    return F.regexp_replace(strip(c), r"[\t\r\n]", "")


def looks_like_url(c: Column) -> Column:
    """Scheme http or https and an authority; text after it doesn't matter and isn't copied."""
    return c.rlike(_START)


def malformed_authority(c: Column) -> Column:
    """A URL whose authority has only one of a pair of brackets: parsing it is an error."""
    host = F.regexp_extract(_joined(c), _AUTHORITY, 1)
    return looks_like_url(c) & (F.contains(host, F.lit("[")) != F.contains(host, F.lit("]")))


def base_url(configured: Column, host: Column) -> Column:
    """API address: the configured one without one trailing slash, else port 8000 for a local page, else ``/api``."""
    own = strip(F.coalesce(configured, F.lit("")))
    return (
        F.when(own != "", F.regexp_replace(own, r"/\z", ""))
        .when(host.isin("localhost", "127.0.0.1"), F.lit("http://localhost:8000"))
        .otherwise(F.lit("/api"))
    )
