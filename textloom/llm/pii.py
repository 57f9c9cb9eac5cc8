"""Operator 4, personal data by weak-supervision aggregation, in DataFrame functions only.

Candidates are pattern matches of several kinds, with their positions. Labelers vote on each: the
form (number ranges, check digits), gazetteers (top-level domains, calling codes, card issuers,
bank countries, reserved networks), words before the match that speak for it or against it, and its
edges. A run of digits looks like many things, so of runs that are no cards those that fail as one (an issuer's digits, a card's
length, no check digit) have a form against them, as have runs without any word that says what they are. Votes are -1, 0 or 1. Expectation-maximisation over the counts of all vote patterns estimates
how reliable each labeler is; a logistic span classifier, one weight for each vote and one bias for
each kind, is then trained on the posteriors. The patterns are few (kinds times 3 to the number of
labelers), so both run on the driver over counts, and the classifier is applied as a column.

Base kinds stay whatever the classifier says; spans of the other kinds stay at ``KEEP`` or more. Of these,
bank accounts and social security numbers must pass their own check first; runs of digits that are no
cards, national phone numbers and hardware addresses are the classifier's alone.

The table of candidates between the two passes holds places and votes, no values: no personal data is written.

Positions come from splitting the text at the matches: a match starts after all pieces and matches
before it. Prefix sums work in blocks, so texts with very many matches stay near linear.
Patterns are possessive where that changes nothing, so that long runs need no backtracking.

Defined results: a null or empty text has no spans; positions are code points, end exclusive;
repeated rows each get a row; tables without any candidate give rows without spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: What is thought of a labeler before any vote, as so many votes of each class: one for rather goes with the class, one against doesn't.
PRIOR_VOTES, LEAN = 20, ({-1: 0.1, 1: 0.9}, {-1: 0.9, 1: 0.1})
KEEP, EM_STEPS, FIT_STEPS, RATE, BLOCK, CONTEXT = 0.5, 40, 400, 0.5, 256, 30

# Kinds in report order with pattern and a cheap test that a text can hold one.
# A leading (?:\G|(?<!...)) starts a match only where an earlier start isn't possible.
_DIGIT_RUN = r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"
BASE = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", None),
    "card": (_DIGIT_RUN, None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
MORE = {
    "account": (_DIGIT_RUN, None),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", None),
    "ssn": (r"(?<![A-Za-z0-9+-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])", None),
    "mac": (r"(?<![A-Za-z0-9:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![A-Za-z0-9:])", ":"),
    "local_phone": (r"(?<![0-9]|\+[0-9]{1,3}[\x20.-])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", None),
}
KINDS = BASE | MORE
#: Kinds whose form is sure: a match that fails it is none.
DECIDED = (*BASE, "iban", "ssn")
#: Digits of a run that may be the number of an account or document; a run that is a card is none.
ACCOUNT_DIGITS = (11, 19)
#: Kinds that any run of their characters could be: a passed form says nothing, and no word for them speaks against.
UNFORMED = ("account",)
_ORDER = {kind: i for i, kind in enumerate(KINDS)}
LABELERS = ("form", "gazetteer", "context", "doubt", "edges")

# Gazetteers and context words, lower case.
DOMAINS = "com org net edu gov mil int info biz io co us uk de fr es it nl be ch at pt pl se no dk fi ie eu ca au nz jp cn in br mx ar ru".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 420 971 972".split()
BANK_COUNTRIES = "AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IL IS IT LI LT LU LV MC MT NL NO PL PT RO SA SE SI SK SM TR UA".split()
CUES = {
    "email": "mail contact write courriel correo kontakt", "ip": "ip address host server login adresse", "card": "card visa mastercard amex payment karte carte tarjeta",
    "phone": "phone tel call mobile fax telefon appel llama", "iban": "iban account bank konto compte cuenta", "ssn": "ssn social security taxpayer",
    "mac": "mac address ethernet device", "local_phone": "phone tel call mobile fax", "account": "account card customer id konto karte compte cuenta",
}
DOUBTS = "version isbn order section figure part serial invoice revision release".split()


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once: lambdas compute what they capture for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def _located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value, before, after>> of the pattern's matches."""
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def place(s: Column) -> Column:
        pieces, hits, sizes, upto = s["pieces"], s["hits"], s["sizes"], s["upto"]

        def one(i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            start = F.get(upto, block) + total(F.slice(sizes, block * BLOCK + 1, i - block * BLOCK)) + F.length(F.get(pieces, i))
            return F.struct(
                start.alias("start"), (start + F.length(F.get(hits, i))).alias("end"), F.get(hits, i).alias("value"),
                F.substring(F.get(pieces, i), -CONTEXT, CONTEXT).alias("before"), F.substring(F.get(pieces, i + 1), 1, 1).alias("after"),
            )

        return F.transform(F.sequence(F.lit(0), F.size(hits) - 1), one)

    def summed(s: Column) -> Column:
        """Adds sizes, and sums of all blocks before each."""
        sizes = F.zip_with(F.slice(s["pieces"], 1, F.size(s["hits"])), s["hits"], lambda p, h: F.length(p) + F.length(h))
        return _bound(sizes, lambda z: _bound(
            F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(z, b * BLOCK + 1, F.lit(BLOCK)))),
            lambda sums: place_with(s, z, F.transform(F.sequence(F.lit(0), F.size(sums) - 1), lambda b: total(F.slice(sums, F.lit(1), b)))),
        ))

    def place_with(s: Column, sizes: Column, upto: Column) -> Column:
        return _bound(F.struct(s["pieces"].alias("pieces"), s["hits"].alias("hits"), sizes.alias("sizes"), upto.alias("upto")), place)

    both = F.struct(pieces.alias("pieces"), hits.alias("hits"))
    return _bound(both, lambda s: F.when(F.size(s["hits"]) > 0, summed(s)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _bank_check(value: Column) -> Column:
    """Remainder by 97 with the first four characters last and letters as 10 to 35."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        n = F.ascii(c)
        return F.when(n <= 57, (acc * 10 + n - 48) % 97).otherwise((acc * 100 + n - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c))) == 1


def _form(kind: str, value: Column) -> Column:
    """The test of a match; for the kinds in ``DECIDED`` it decides whether there is a span at all."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: _bound(F.regexp_replace(p, "^0+(?=.)", ""), lambda x: F.when(F.length(x) <= 3, x.cast("int") <= 255).otherwise(F.lit(False)))
        return F.forall(F.split(value, r"\."), part)
    if kind == "card":
        return _bound(_digits(value), lambda d: F.when(F.length(d).between(14, 19), F.call_function("luhn_check", d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    if kind == "iban":
        return _bank_check(value)
    if kind == "ssn":
        return ~value.rlike("^(?:000|666|9)") & ~value.rlike("-00-|-0000$")
    if kind == "account":
        return ~_bound(_digits(value), lambda d: F.length(d).between(14, 19) & d.rlike("^[3-6]"))  # else a card that fails
    if kind == "mac":
        return ~value.rlike("^(?:00:){5}00$|^(?:[fF]{2}:){5}[fF]{2}$")
    return _digits(value).rlike("^[2-9]")


def _listed(kind: str, value: Column) -> Column:
    """Gazetteer vote."""
    vote = lambda yes: F.when(yes, 1).otherwise(-1)
    if kind == "email":
        return vote(F.lower(F.element_at(F.split(value, r"\."), -1)).isin(DOMAINS))
    if kind == "ip":
        return vote(~value.rlike(r"^(?:0|127|255)\."))
    if kind == "card":
        return vote(value.rlike("^[3-6]"))
    if kind == "phone":
        return vote(_bound(_digits(value), lambda d: F.array_contains(F.array(*map(F.lit, CALLING_CODES)), F.substring(d, 1, 1)) | F.substring(d, 1, 2).isin(CALLING_CODES) | F.substring(d, 1, 3).isin(CALLING_CODES)))
    if kind == "iban":
        return vote(F.substring(value, 1, 2).isin(BANK_COUNTRIES))
    if kind == "local_phone":
        return F.when(_digits(value).rlike("^[0-9]{3}55501"), -1).otherwise(0)
    return F.lit(0)


def _possible(kind: str, s: Column) -> Column:
    """Whether a match is a candidate at all."""
    if kind in DECIDED:
        return s["form"] > 0
    if kind == "account":
        return _bound(_digits(s["value"]), lambda d: F.length(d).between(*ACCOUNT_DIGITS) & ~(F.length(d).between(14, 19) & F.call_function("luhn_check", d)))
    return F.lit(True)


def _told(kind: str, located: Column) -> Column:
    """array<struct<start, rank, end, kind, votes...>> of a kind from located matches."""

    def told(s: Column) -> Column:
        before = F.lower(s["before"])
        form = _form(kind, s["value"])
        edges = ~F.coalesce(F.substring(s["before"], -1, 1), F.lit("")).rlike("[A-Za-z0-9]") & ~F.coalesce(s["after"], F.lit("")).rlike("[A-Za-z0-9]")
        return F.struct(
            s["start"].cast("long").alias("start"), F.lit(_ORDER[kind]).alias("rank"), s["end"].cast("long").alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value"),
            F.when(form, 0 if kind in UNFORMED else 1).otherwise(-1).alias("form"), _listed(kind, s["value"]).cast("int").alias("gazetteer"),
            F.when(before.rlike(rf"\b(?:{'|'.join(CUES[kind].split())})"), 1).otherwise(-1 if kind in UNFORMED else 0).alias("context"),
            F.when(before.rlike(rf"\b(?:{'|'.join(DOUBTS)})\b"), -1).otherwise(0).alias("doubt"),
            F.when(edges, 1).otherwise(-1).alias("edges"),
        )

    found = F.filter(F.transform(located, told), lambda s: _possible(kind, s))
    # The value is personal data and isn't kept: start and end tell where it is.
    return F.transform(found, lambda s: F.struct(*(s[c].alias(c) for c in ("start", "rank", "end", "kind", *LABELERS)))).cast(_SPAN)


_SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string," + ",".join(f"{x}:int" for x in LABELERS) + ">>"


def _candidates(text: Column) -> list[Column]:
    """One array of candidates for each pattern; kinds with the same pattern share its matches."""
    none = F.array().cast(_SPAN)
    out = []
    for pattern in dict.fromkeys(p for p, _ in KINDS.values()):
        kinds = [k for k, (p, _) in KINDS.items() if p == pattern]
        needs = KINDS[kinds[0]][1]
        found = _bound(_located(text, pattern), lambda at: F.concat(*(F.coalesce(_told(k, at), none) for k in kinds)))  # noqa: B023 - used at once
        out.append(F.coalesce(F.when(F.contains(text, F.lit(needs)), found) if needs else found, none))
    return out


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and found, the candidates of all kinds in order, one row per input row."""
    text = F.coalesce("text", F.lit(""))
    # Every kind needs a digit, an at sign or a colon (mac addresses can be letters only).
    found = F.when(text.rlike("[0-9@:]"), F.array_sort(F.flatten(F.array(*_candidates(F.col("text"))))))
    return C.id_and_text(docs, id_col, text_col).select("doc_id", F.coalesce(found, F.array().cast(_SPAN)).alias("found"))


def reliabilities(counts: list[tuple[str, tuple[int, ...], int]]) -> list[float]:
    """Posterior of each vote pattern: EM for two classes, votes independent given the class, a prior for each kind.

    A labeler that abstains (0) says nothing.
    """
    kinds = sorted({k for k, _, _ in counts})
    post = [1 / (1 + math.exp(-1.5 * sum(v))) for _, v, _ in counts]
    for _ in range(EM_STEPS):
        seen = [[dict.fromkeys((-1, 0, 1), 0.0) for _ in LABELERS] for _ in range(2)]
        prior = {k: [1.0, 1.0] for k in kinds}
        for (k, v, n), p in zip(counts, post, strict=True):
            for c, w in enumerate((n * p, n * (1 - p))):
                prior[k][c] += w
                for j, x in enumerate(v):
                    seen[c][j][x] += w
        rate = [[{x: (s[x] + PRIOR_VOTES * LEAN[c][x]) / (s[-1] + s[1] + PRIOR_VOTES) for x in (-1, 1)} for s in seen[c]] for c in range(2)]
        for i, (k, v, _) in enumerate(counts):
            odds = math.log(prior[k][0] / prior[k][1]) + sum(math.log(rate[0][j][x] / rate[1][j][x]) for j, x in enumerate(v) if x)
            post[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post


def span_classifier(counts: list[tuple[str, tuple[int, ...], int]]) -> tuple[dict[str, float], list[float]]:
    """Bias of each kind and weight of each vote: logistic regression on the posteriors of all candidates."""
    bias, weight = {k: 0.0 for k in KINDS}, [1.0] * len(LABELERS)
    if not counts:
        return bias, weight
    post = reliabilities(counts)
    share = [n for _, _, n in counts]
    total = sum(share)
    for _ in range(FIT_STEPS):
        to_bias, to_weight = {k: 0.0 for k in KINDS}, [0.0] * len(LABELERS)
        for (k, v, _), p, n in zip(counts, post, share, strict=True):
            miss = n / total * (p - 1 / (1 + math.exp(-(bias[k] + sum(w * x for w, x in zip(weight, v, strict=True))))))
            to_bias[k] += miss
            for j, x in enumerate(v):
                to_weight[j] += miss * x
        bias = {k: b + RATE * to_bias[k] for k, b in bias.items()}
        weight = [w + RATE * (g - 1e-3 * w) for w, g in zip(weight, to_weight, strict=True)]
    return bias, weight


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans, array<struct<start, end, kind, score>> by start, then kind in report order."""
    found = C.Scratch(docs.sparkSession).keep(candidates(docs, id_col, text_col), "candidates")
    each = found.select(F.explode("found").alias("s")).groupBy("s.kind", *(f"s.{x}" for x in LABELERS)).agg(F.count(F.lit(1)).alias("n"))
    counts = sorted((r.kind, tuple(r[x] for x in LABELERS), r.n) for r in each.collect())
    bias, weight = span_classifier(counts)

    def scored(s: Column) -> Column:
        z = F.element_at(F.create_map(*(F.lit(x) for kv in bias.items() for x in kv)), s["kind"])
        for w, x in zip(weight, LABELERS, strict=True):
            z = z + w * s[x]
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), (1 / (1 + F.exp(-z))).alias("score"))

    spans = F.filter(F.transform("found", scored), lambda s: s["kind"].isin(*BASE) | (s["score"] >= KEEP))
    return found.select("doc_id", spans.alias("spans"))


def digest(spans: DataFrame) -> DataFrame:
    """The contract's columns from the operator's spans."""

    def text(of: Column) -> Column:
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return spans.select("doc_id", *map(count, BASE), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
