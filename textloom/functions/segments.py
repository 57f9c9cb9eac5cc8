"""Segmentation of clean text into articles, sentences or paragraphs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, clean_text, strip

MODES = ("article", "sentence", "paragraph")

# Where sentences and paragraphs end.
#: White space after a stop and before a capital or digit, with or without an opening quote.
SENTENCE_BREAK = rf"(?<=[.!?]){WS}++(?=[\"'“”‘’]?[A-Z0-9])"
#: An empty line, or one line end before a capital, digit or straight quote.
PARAGRAPH_BREAK = rf"\n{WS}*\n|\n(?=[A-Z0-9\"'])"
#: Abbreviations by language that the aware form, an extension, doesn't end a sentence at.
ABBREVIATIONS = {
    "de": ("Abs", "Bd", "Dipl", "Dr", "Fr", "Hr", "Nr", "bzw", "ca"),
    "en": ("Capt", "Col", "Dr", "Gen", "Hon", "Lt", "Mr", "Mrs", "No", "Rev", "Sgt"),
    "es": ("Av", "Dr", "Dra", "Lic", "Sra", "Srta", "pág"),
    "fr": ("Cie", "Dr", "Mlle", "Mme", "apr", "av", "env"),
}

def _parts(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern, -1), strip), lambda x: x != "")


def article_of(clean: Column) -> Column:
    return F.filter(F.array(clean), lambda x: x != "")


def sentences_of(clean: Column, abbreviation_aware: bool = False) -> Column:
    """Sentences. By default abbreviations do end one; the aware form is an extension."""
    if not abbreviation_aware:
        return _parts(clean, SENTENCE_BREAK)
    guards = "".join(rf"(?<!\b{a}\.)" for a in sorted({a for some in ABBREVIATIONS.values() for a in some}))
    return _parts(clean, guards + SENTENCE_BREAK)


def paragraphs_of(clean: Column) -> Column:
    return _parts(clean, PARAGRAPH_BREAK)


def segments_of_clean(clean: Column, mode: Column) -> Column:
    """array<string> by mode, null for other modes; rows of different modes share one plan."""
    return (
        F.when(mode == "article", article_of(clean))
        .when(mode == "sentence", sentences_of(clean))
        .when(mode == "paragraph", paragraphs_of(clean))
    )


def segment_text(text: Column, mode: Column) -> Column:
    return segments_of_clean(clean_text(text), mode)
