"""Fixed-length token ids: truncation, padding and attention mask."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the model's input.
MAX_LENGTH, PAD_ID = 512, 1


def code_points(text: Column) -> Column:
    """Stand-in tokenizer: the code points of the whole text; :func:`truncate` cuts them."""
    return F.transform(F.array_remove(F.split(text, "", -1), ""), lambda c: F.ascii(c))


def truncate(ids: Column, length: int = MAX_LENGTH) -> Column:
    return F.slice(ids, 1, length)


def pad(ids: Column, length: int = MAX_LENGTH, pad_id: int = PAD_ID) -> Column:
    """Padded on the right to ``length``; ids must not be longer."""
    return F.concat(ids, F.array_repeat(F.lit(pad_id), F.lit(length) - F.size(ids)))


def attention_mask(ids: Column, length: int = MAX_LENGTH) -> Column:
    """1 for each id, 0 for each place that padding fills."""
    n = F.least(F.size(ids), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(length) - n))
