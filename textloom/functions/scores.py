"""Scores of three classes: softmax, rounding, argmax, labels and percentages, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels by id, and the order in which they are displayed.
LABELS = ("LEFT", "RIGHT", "CENTER")
DISPLAY_ORDER = ("LEFT", "CENTER", "RIGHT")
DEFAULT_LABEL = "CENTER"


def softmax(logits: list[Column]) -> list[Column]:
    """Probabilities, with the greatest logit subtracted first."""
    top = F.greatest(*logits)
    powers = [F.exp(z - top) for z in logits]
    total = sum(powers[1:], powers[0])
    return [p / total for p in powers]


def rounded(p: Column) -> Column:
    return F.round(p, 6)


def argmax(scores: list[Column]) -> Column:
    """Index of the greatest score; of equal ones the first."""
    return (F.array_position(F.array(*scores), F.greatest(*scores)) - 1).cast("int")


def label_of(label_id: Column) -> Column:
    """The name of an id; null for an unknown one."""
    return F.try_element_at(F.array(*map(F.lit, LABELS)), label_id + 1)


def percent(p: Column) -> Column:
    """Whole percent, halves up."""
    return F.floor(p * 100 + F.lit(0.5)).cast("int")


def probability_map(columns: list[Column]) -> Column:
    """label -> probability in the order of ids."""
    pairs = (x for name, c in zip(LABELS, columns, strict=True) for x in (F.lit(name), c))
    return F.create_map(*pairs)
