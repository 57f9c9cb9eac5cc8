"""Operator 5, benchmark decontamination: size-partitioned MinHash containment search.

Items and documents are sets of five-word shingles in lower case (of any script). Items fall into partitions by
size, a power of two each, and every partition has an index of its own:

* Its signatures are the least shingle hashes of its items (bottom-k MinHash). k follows from the
  partition's upper size and ``THRESHOLD``: of n shingles at most n - ceil(0.8 n) are missing, so an item that lies in a
  document has a signature hash there for certain.
* Its bound is the greatest hash of its signatures. The sketch of a document for this partition is the set of
  its shingle hashes up to the bound (MinHash with a fixed bound in place of a fixed size), so it grows with the
  document, and a short item isn't lost in a long one.

A document is a candidate of a partition if its sketch holds a signature hash, and is then compared with the
items of that partition by exact containment: distinct shingles of the item found in the document, word by
word, over all its distinct shingles.

Only DataFrame operations run here. The signatures are broadcast if there are at most
``BROADCAST_ROWS`` of them, else joined by a shuffle; likewise the candidates' ids.

Defined results: null and empty texts, and items under five words, have no shingles and never
match; null ids are left out; rows that share an id count as one document or item; items
without any match don't appear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SHINGLE, THRESHOLD = 5, 0.8
BROADCAST_ROWS = 1_000_000


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once: an array of one element, transformed."""
    return F.get(F.transform(F.array(value), use), 0)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")


def _places(words: Column) -> Column:
    return F.sequence(F.lit(0), F.size(words) - SHINGLE)


def _hashes(text: Column) -> Column:
    """array<long>: hashes of the distinct shingles, from the hashes of the words; null under five words."""

    def of(h: Column) -> Column:
        one = lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(SHINGLE)))
        return F.when(F.size(h) >= SHINGLE, F.array_distinct(F.transform(_places(h), one)))

    return _bound(F.transform(_words(text), lambda w: F.xxhash64(w)), of)


def _shingles(text: Column) -> Column:
    """array<string>: the distinct shingles, words joined by a blank; null under five words."""

    def of(words: Column) -> Column:
        one = lambda i: F.array_join(F.slice(words, i + 1, F.lit(SHINGLE)), " ")
        return F.when(F.size(words) >= SHINGLE, F.array_distinct(F.transform(_places(words), one)))

    return _bound(_words(text), of)


def _hash_of(shingle: Column) -> Column:
    """The hash that :func:`_hashes` gives a shingle."""
    return _bound(F.split(shingle, " "), lambda w: F.xxhash64(*(F.xxhash64(F.get(w, j)) for j in range(SHINGLE))))


def _least_shared(n: Column) -> Column:
    """Shingles that an item of n must share, in whole numbers: ceil(0.8 n)."""
    return F.floor((4 * n + 4) / 5)


def item_index(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, g, h, n (shingles of the item), upper (of its size partition) and signature (true for those searched)."""
    sets = items.select(items[id_col].alias("item_id"), F.explode(_shingles(items[text_col].cast("string"))).alias("g"))
    rows = sets.filter(F.col("item_id").isNotNull()).distinct().select("item_id", "g", _hash_of(F.col("g")).alias("h"))
    by_item = Window.partitionBy("item_id")
    sized = rows.withColumn("n", F.count(F.lit(1)).over(by_item)).withColumn("rank", F.row_number().over(by_item.orderBy("h", "g")))
    sized = sized.withColumn("upper", F.pow(F.lit(2), F.ceil(F.log2("n"))).cast("long"))
    return sized.select("item_id", "g", "h", "n", "upper", (F.col("rank") <= F.col("upper") - _least_shared(F.col("upper")) + 1).alias("signature"))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_item, n_shared and containment of every pair at the threshold or above."""
    with C.Scratch(docs.sparkSession) as scratch:
        index = scratch.keep(item_index(items), "items")
        near = F.broadcast if index.count() <= BROADCAST_ROWS else lambda df: df
        probes = index.filter("signature").select(F.col("h").alias("probe"), "upper").distinct()
        # One bound for each partition, so at most as many as a long has bits.
        bounds = index.filter("signature").groupBy("upper").agg(F.max("h").alias("bound")).collect()
        most = max((r.bound for r in bounds), default=-(2**63))
        texts = C.id_and_text(docs, id_col, text_col).filter(F.col("doc_id").isNotNull())
        # Sketches up to the greatest bound hold those up to each: a partition's signatures are all within its own.
        sketch = F.filter(_hashes(F.col("text")), lambda h: h <= F.lit(most))
        # explode() would add a filter that computes the shingles once more; nulls of the outer form don't join.
        hits = texts.select("doc_id", F.explode_outer(sketch).alias("h")).join(near(probes), F.col("h") == F.col("probe"))
        found = scratch.keep(hits.select(F.col("doc_id").alias("candidate"), "upper").distinct(), "candidates")
        few = F.broadcast if found.count() <= BROADCAST_ROWS else lambda df: df
        held = texts.join(few(found), F.col("doc_id") == F.col("candidate")).select("doc_id", F.col("upper").alias("probed"), F.explode_outer(_shingles(F.col("text"))).alias("own"))
        wanted = near(index.select("item_id", "g", "n", "upper"))
        rows = held.join(wanted, (F.col("own") == F.col("g")) & (F.col("probed") == F.col("upper")))
        pairs = rows.groupBy("doc_id", "item_id").agg(F.first("n").alias("n_item"), F.countDistinct("own").alias("n_shared"))
        out = pairs.filter(F.col("n_shared") >= _least_shared(F.col("n_item")))
        return out.select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of the documents that hold no item; rows with a null id stay."""
    held = contaminated(docs, items, id_col, text_col).select(F.col("doc_id").alias("held")).distinct()
    held = C.Scratch(docs.sparkSession).keep(held, "held")
    few = F.broadcast if held.count() <= BROADCAST_ROWS else lambda df: df
    # The row is held in a struct, so that none of the table's own names can clash.
    rows = docs.select(F.struct("*").alias("textloom_row"), docs[id_col].alias("textloom_of"))
    return rows.join(few(held.select(F.struct("held").alias("textloom_held"))), F.col("textloom_of") == F.col("textloom_held.held"), "left_anti").select("textloom_row.*")
