from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import segments, text, urls

# (input, cleaned or None for the same, sentences or None for one, paragraphs or None for one)
CASES = [
    ("Dr. Smith spoke. He left.", None, ["Dr.", "Smith spoke.", "He left."], None),
    ('He said "no." Then left.', None, None, None),
    ("He asked. “Why?” she said.", None, ["He asked.", "“Why?” she said."], None),
    ("Rates rose 3.5 pct. 2 banks fell.", None, ["Rates rose 3.5 pct.", "2 banks fell."], None),
    ("It works. écoutez. Élan fort. Ok.", None, ["It works. écoutez. Élan fort.", "Ok."], None),
    ("Head line\nBody starts here. more", None, None, ["Head line", "Body starts here. more"]),
    ("a\r\nB\rC\td  e", "a\nB\nC d e", None, ["a", "B", "C d e"]),
    ("one\n\n\n\ntwo", "one\n\ntwo", None, ["one", "two"]),
    ("one\n \n \ntwo", None, None, ["one", "two"]),
    ("x\n Indented", None, None, None),
    ("x\nlower\nUpper\n\"Quote\n“Curly", None, None, ["x\nlower", "Upper", "\"Quote\n“Curly"]),
    ("   \t\n ", "", [], []),
    ("Wait... And go?! Yes.", None, ["Wait...", "And go?!", "Yes."], None),
    ("A.\xa0B", None, ["A.", "B"], None),
    ("End.\n\nNext para. Same", None, ["End.", "Next para.", "Same"], ["End.", "Next para. Same"]),
    ("a. (B) c. B", None, ["a. (B) c.", "B"], None),
]


def test_fixture_cases(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string")
    got = df.select("i", text.clean_text(F.col("t")).alias("c"), *(segments.segment_text(F.col("t"), F.lit(m)).alias(m) for m in segments.MODES)).collect()
    for r in got:
        raw, clean, sentences, paragraphs = CASES[r.i]
        clean = raw if clean is None else clean
        assert r.c == clean
        assert r.article == ([clean] if clean else [])
        assert r.sentence == ([clean] if sentences is None else sentences)
        assert r.paragraph == ([clean] if paragraphs is None else paragraphs)


def test_unknown_mode_and_nulls(spark):
    r = spark.range(1).select(
        segments.segment_text(F.lit("a"), F.lit("word")).alias("a"), segments.segment_text(F.lit(None).cast("string"), F.lit("sentence")).alias("b")
    ).first()
    assert r.a is None and not r.b


def test_abbreviation_aware_extension(spark):
    r = spark.range(1).select(segments.sentences_of(F.lit("Dr. Smith spoke. He left."), abbreviation_aware=True).alias("s")).first()
    assert r.s == ["Dr. Smith spoke.", "He left."]
    r = spark.range(1).select(segments.sentences_of(F.lit("Frau Dra. Ruiz kam. Nr. 5 kam. XDr. Y ging."), abbreviation_aware=True).alias("s")).first()
    assert r.s == ["Frau Dra. Ruiz kam.", "Nr. 5 kam.", "XDr.", "Y ging."]


PIECES = st.lists(st.sampled_from(["a", "B", "É", "9", ".", "!", "?", '"', "'", "“", "’", " ", "  ", "\t", "\n", "\r\n", "\r", "\xa0", " ", "\x1c", "\x0b"]), max_size=30).map("".join)


def plain_clean(t: str) -> str:
    """Character by character."""
    out: list[str] = []
    for i, c in enumerate(t):
        if c == "\r":
            c = "\n"
        elif c == "\n" and i and t[i - 1] == "\r":
            continue
        if c in " \t":
            c = " "
            if out and out[-1] == " ":
                continue
        if c == "\n" and out[-2:] == ["\n", "\n"]:
            continue
        out.append(c)
    return "".join(out).strip()


def plain_sentences(t: str) -> list[str]:
    """A break is white space after a stop, if a capital or digit follows, perhaps behind one quote."""
    out, start, i = [], 0, 0
    while i < len(t):
        if not t[i].isspace():
            i += 1
            continue
        end = i
        while end < len(t) and t[end].isspace():
            end += 1
        opens = end + 1 if t[end : end + 1] in ("\"", "'", "“", "”", "‘", "’") else end
        if i and t[i - 1] in ".!?" and any(t[k : k + 1].isascii() and (t[k : k + 1].isupper() or t[k : k + 1].isdigit()) for k in (end, opens)):
            out.append(t[start:i])
            start = end
        i = end
    return [x.strip() for x in [*out, t[start:]] if x.strip()]


def plain_paragraphs(t: str) -> list[str]:
    """A break is a line end before an empty line, up to the last line end of the white space, or before a capital, digit or straight quote."""
    out, start, i = [], 0, 0
    while i < len(t):
        if t[i] != "\n":
            i += 1
            continue
        end = i + 1
        while end < len(t) and t[end].isspace():
            end += 1
        last = t.rfind("\n", i + 1, end)
        follows = t[i + 1 : i + 2]
        stop = last + 1 if last > 0 else i + 1 if follows and follows.isascii() and (follows.isupper() or follows.isdigit() or follows in "\"'") else 0
        if stop:
            out.append(t[start:i])
            start = stop
        i = stop or i + 1
    return [x.strip() for x in [*out, t[start:]] if x.strip()]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(PIECES, min_size=60, max_size=60))
def test_against_plain_version(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    c = text.clean_text(F.col("t"))
    for r in df.select("i", c.alias("c"), text.clean_text(c).alias("cc"), segments.sentences_of(c).alias("s"), segments.paragraphs_of(c).alias("p"), text.word_count(F.col("t")).alias("n")).collect():
        clean = plain_clean(texts[r.i])
        assert r.c == clean and r.cc == clean
        assert r.n == len(texts[r.i].split())
        assert r.s == plain_sentences(clean)
        assert r.p == plain_paragraphs(clean)


@pytest.mark.parametrize(("raw", "items"), [("a, b ,,c", ["a", "b", "c"]), ("  ", []), (",", []), ("x", ["x"])])
def test_csv_items(spark, raw, items):
    assert spark.range(1).select(text.csv_items(F.lit(raw)).alias("x")).first().x == items


def test_blocks(spark):
    r = spark.range(1).select(
        text.ordered_distinct(F.array(*map(F.lit, "babcb"))).alias("d"), text.join_blocks(F.array(F.lit("x"), F.lit("y"))).alias("j"), text.enough_words(F.lit("1 2 3 4 5 6 7\xa08")).alias("e")
    ).first()
    assert (r.d, r.j, r.e) == (["b", "a", "c"], "x\n\ny", True)


def test_plain_texts_pass_few_patterns(spark):
    """Trimming, line ends and the URL test, on the usual texts, run no pattern that copies the whole text; they did five times."""
    df = spark.range(1).select(F.concat(F.lit(" a b "), F.col("id").cast("string")).alias("t"))
    plan = df.select(text.clean_text(F.col("t")).alias("a"), urls.looks_like_url(F.col("t")).alias("b"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(") == 2


def test_fast_forms_give_what_the_patterns_gave(spark):
    rng = random.Random(3)
    letters = [" ", "\t", "\r", "\n", "\xa0", "\u2003", "\x1c", "\x85", "\u200b", "/", "?", "#", "a", "\u00e9", "\U0001f600", "\0"]
    some = lambda n: "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
    made = [some(9) for _ in range(1500)] + [some(2) + rng.choice(["http", "HTTPS", "ht\ntp", "http\ts"]) + rng.choice(["://", ":/\n/", ":/"]) + some(4) for _ in range(3000)]
    c, ws = F.col("t"), text.WS
    strip = lambda x: F.regexp_replace(x, rf"^{ws}++|(?<!{ws}){ws}++\z", "")
    pairs = [
        (text.strip(c), strip(c)), (text.normalize_newlines(c), F.regexp_replace(c, r"\r\n?", "\n")), (text.collapse_spaces(c), F.regexp_replace(c, r"[ \t]+", " ")),
        (F.size(text.words(c)), F.size(F.array_remove(F.split(c, f"{ws}++", -1), ""))), (urls.looks_like_url(c), F.regexp_replace(strip(c), r"[\t\r\n]", "").rlike(r"(?i)^https?://[^/?#]+")),
    ]
    df = spark.createDataFrame([(x,) for x in made], "t string")
    assert [r for r in df.select("t", *(~a.eqNullSafe(b) for a, b in pairs)).collect() if any(r[1:])] == []
