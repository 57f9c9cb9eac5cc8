"""Operator 12, SimHash fingerprints of documents, in DataFrame functions only.

Terms are pairs of neighbouring words in lower case (a single word is a pair with nothing), weighted by the mean
length of the two, 1 to ``MOST_WEIGHT``: pairs of short, common words say little. Two hashes of a term give
``BITS`` signed votes; a bit of the fingerprint is one where the votes for it outweigh those against.

Votes are summed as rows: a text is exploded into its terms, and each long integer holds four sums of 16 bits, so 32 plain
sums hold all votes of up to ``CHUNK`` terms. Sums of a text's chunks are unpacked and added afterwards; only
these travel, never words.

:func:`within` finds fingerprints within a Hamming radius by permuted block tables. With radius r the bits are cut into
r + 2 blocks, of which two at least are equal in any such pair. Each pair of blocks gives a table whose
permuted fingerprints start with these two; what agrees in the start is compared bit by bit, and a pair counts in its first table only.

:func:`with_edits` gives each document a text whose last quarter is the start of the next document's, by id. The
next id comes from ranges of ids of ``RANGE`` each; texts travel once, to their id.

Defined results: a null text is empty; the empty text, or one of blanks, has fingerprint zero. Of rows with one id the one with the least
hash of its text, then the first read, stands for the id as the next document; such rows share their next document. A row with a null id has
none: its last quarter is dropped and near_next is null. A single id is its own next. Repeated rows each get a row. Rows are numbered where they are read: give
a table that is read from files, as a frame that a shuffle makes may number its rows anew when an executor is lost.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

BITS, MOST_WEIGHT = 128, 7
#: Terms whose weighted votes fit into 15 bits.
CHUNK = 4096
#: Ids in one range of the order, and the share of rows from which an id is hot; so at most 1 / HOT_SHARE ids are.
RANGE, HOT_SHARE, HOT_LEAST, SALTS = 250_000, 0.001, 10_000, 64
RADIUS = 3

_BLANKS = " \t\n\x0b\x0c\r"
_LANES = 16
_MASK = 0x0001000100010001
_HASHES = BITS // 64
_SUMS = [f"v{i}" for i in range(_HASHES * _LANES)]


def _words(text: Column) -> Column:
    return F.split(F.btrim(F.lower(text), F.lit(_BLANKS)), "[\\x20\\x09-\\x0D]+", -1)


def votes(texts: DataFrame, *keys: str) -> DataFrame:
    """keys, v0 ... v31 and total: packed sums of votes of each chunk of the column text; keys must identify a text."""
    words = texts.select(*keys, _words(F.col("text")).alias("w"))
    # The list is never empty; the plain generator would filter by its size, which splits all texts twice.
    terms = words.select(*keys, "w", F.posexplode_outer("w").alias("i", "a")).withColumn("b", F.coalesce(F.get("w", F.col("i") + 1), F.lit("")))
    # The last word starts no pair, unless it is the only one; the empty text has one empty word, which counts nothing.
    counts = (F.col("a") != "") & ((F.col("i") < F.size("w") - 1) | (F.col("i") == 0))
    weight = F.when(counts, F.greatest(F.lit(1), F.least(F.lit(MOST_WEIGHT), F.shiftright(F.length("a") + F.length("b"), 1)))).otherwise(0).cast("long")
    hashed = terms.select(*keys, F.expr(f"i div {CHUNK}").alias("chunk"), weight.alias("weight"), F.xxhash64("a", "b").alias("h0"), F.xxhash64("a", "b", F.lit(1)).alias("h1"))
    lanes = [
        F.sum(F.shiftrightunsigned(f"h{h}", k).bitwiseAND(F.lit(_MASK)) * F.col("weight")).alias(_SUMS[h * _LANES + k]) for h in range(_HASHES) for k in range(_LANES)
    ]
    return hashed.groupBy(*keys, "chunk").agg(*lanes, F.sum("weight").alias("total"))


def _bits(chunks: Column, word: int) -> Column:
    """64 bits of a fingerprint, as a long, from an array of structs with packed sums."""
    total = F.aggregate(chunks, F.lit(0).cast("long"), lambda s, c: s + c["total"])

    def bit(i: Column) -> Column:
        """Bit i lies in lane i % 16, at place i div 16."""
        place = (F.floor(i / _LANES) * _LANES).cast("int")
        votes = F.aggregate(chunks, F.lit(0).cast("long"), lambda s, c: s + F.call_function("shiftrightunsigned", F.get(c["v"], (i % _LANES + word * _LANES).cast("int")), place).bitwiseAND(F.lit(0xFFFF)))
        return F.when(votes * 2 > total, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda s, i: s.bitwiseOR(bit(i)))


def _packed() -> Column:
    return F.struct(F.array(*_SUMS).alias("v"), "total")


def hexadecimal(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, hi and lo, the halves of the fingerprint, one row per input row."""
    named = C.id_and_text(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    gathered = votes(named, "rid", "doc_id").groupBy("rid", "doc_id").agg(F.collect_list(_packed()).alias("chunks"))
    return gathered.select("doc_id", _bits(F.col("chunks"), 0).alias("hi"), _bits(F.col("chunks"), 1).alias("lo"))


def likeness(bits: Column) -> Column:
    """Cosine of the angle that so many differing bits stand for; 0 from the right angle on."""
    return F.greatest(F.lit(0.0), F.cos(bits * (math.pi / BITS)))


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def table_keys(hi: Column, lo: Column, radius: int) -> Column:
    """The start of the fingerprint in each permuted table: its two leading blocks, as text."""
    digits = hexadecimal(hi, lo)
    blocks = radius + 2
    if not 0 <= radius <= BITS // 4 - 2:
        raise ValueError("blocks are whole hexadecimal digits")
    edges = [BITS // 4 * i // blocks for i in range(blocks + 1)]
    block = [F.substring(digits, edges[i] + 1, edges[i + 1] - edges[i]) for i in range(blocks)]
    return F.array(*(F.concat(block[i], block[j]) for i, j in combinations(range(blocks), 2)))


def within(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """hi, lo, other_hi, other_lo and bits: for each distinct fingerprint of ``queries`` the distinct others of ``prints`` at most ``radius`` bits apart.

    Both have columns hi and lo. Copies are folded first; they and rows join by fingerprint.
    """

    def tabled(df: DataFrame, prefix: str) -> DataFrame:
        once = df.filter("hi IS NOT NULL AND lo IS NOT NULL").select(F.col("hi").alias(f"{prefix}hi"), F.col("lo").alias(f"{prefix}lo")).distinct()
        keys = table_keys(F.col(f"{prefix}hi"), F.col(f"{prefix}lo"), radius)
        return once.select("*", keys.alias(f"{prefix}keys")).select("*", F.posexplode(f"{prefix}keys").alias(f"{prefix}t", f"{prefix}key"))

    met = tabled(queries, "").join(tabled(prints, "other_"), (F.col("t") == F.col("other_t")) & (F.col("key") == F.col("other_key")))
    first = F.array_position(F.zip_with("keys", "other_keys", lambda a, b: a == b), True) - 1
    bits = distance((F.col("hi"), F.col("lo")), (F.col("other_hi"), F.col("other_lo")))
    return met.filter((first == F.col("t")) & bits.between(1, radius)).select("hi", "lo", "other_hi", "other_lo", bits.alias("bits"))


def next_ids(ids: DataFrame, scratch: C.Scratch) -> DataFrame:
    """Adds next_rid to distinct ids with their rows (doc_id, rid): the row of the next id, after the last the first."""
    ranges = max(1, math.ceil(ids.count() / RANGE))
    placed = scratch.save(ids.repartitionByRange(ranges, "doc_id").withColumn("part", F.spark_partition_id()), "ranges")
    # One row for each range.
    heads = placed.groupBy("part").agg(F.min(F.struct("doc_id", "rid")).alias("head"))
    order = Window.orderBy("part")
    heads = heads.select(F.col("part").alias("of"), F.coalesce(F.lead("head.rid").over(order), F.first("head.rid").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).alias("follow"))
    within_range = F.lead("rid").over(Window.partitionBy("part").orderBy("doc_id"))
    return placed.withColumn("next", within_range).join(heads, F.col("part") == F.col("of")).select("doc_id", "rid", "longest", F.coalesce("next", "follow").alias("next_rid"))


def with_edits(docs: DataFrame, scratch: C.Scratch, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows with rid, doc_id, text and edited; and the order, doc_id, rid and next_rid of each id."""
    text = F.coalesce("text", F.lit(""))
    named = C.id_and_text(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("rid"), "doc_id", text.alias("text"))
    narrow = named.filter("doc_id IS NOT NULL").select("doc_id", "rid", F.xxhash64("text").alias("h"), F.length("text").alias("n"))
    ids = narrow.groupBy("doc_id").agg(F.min(F.struct("h", "rid")).alias("least"), F.max("n").alias("longest"), F.count(F.lit(1)).alias("times"))
    ids = scratch.save(ids.select("doc_id", "least.rid", "longest", "times"), "ids")
    total = ids.agg(F.sum("times")).first()[0] or 0
    hot = [r.doc_id for r in ids.filter(F.col("times") > max(HOT_LEAST, HOT_SHARE * total)).select("doc_id").collect()]
    order = scratch.save(next_ids(ids.drop("times"), scratch), "order")

    def place(doc_id: str, rid: str) -> Column:
        """Where the texts of an id lie; those of a hot id, and of none, lie in ``SALTS`` places."""
        c = F.col(doc_id)
        spread = c.isNull() | c.isin(hot) if hot else c.isNull()
        return F.xxhash64(c, F.when(spread, F.pmod(rid, F.lit(SALTS))).otherwise(0).cast("long"))

    # Both joins read one shuffle of the texts: they are partitioned by all that they are joined by, and ask for the same columns.
    # What else must be equal is compared as a range of structs: an equality would count as a key, and plain columns would be filtered for nulls.
    placed = named.withColumn("place", place("doc_id", "rid")).repartition("place")
    owner = order.select(F.col("rid").alias("owner_rid"), F.col("doc_id").alias("owner"))
    asked = order.select(F.col("doc_id").alias("asker"), F.floor(F.col("longest") / 4).cast("int").alias("most"), "next_rid")
    wanted = asked.join(owner, F.col("next_rid") == F.col("owner_rid")).withColumn("owner_place", place("owner", "owner_rid"))
    wanted = scratch.save(wanted.select("asker", "most", "owner", "owner_place", "owner_rid"), "wanted")
    same = lambda a, b: F.struct(*a).between(F.struct(*b), F.struct(*b))
    met = placed.join(wanted, (F.col("place") == F.col("owner_place")) & same(("rid", "doc_id"), ("owner_rid", "owner")))
    starts = met.select("asker", F.substring("text", F.lit(1), F.col("most")).alias("start"))
    places = F.transform(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.xxhash64("asker", i.cast("long")))
    alone = F.array(F.xxhash64("asker", F.lit(0).cast("long")))
    starts = starts.select("asker", "start", F.explode_outer(F.when(F.col("asker").isin(hot), places).otherwise(alone) if hot else alone).alias("start_place"))
    both = placed.join(starts, (F.col("place") == F.col("start_place")) & same(("doc_id",), ("asker",)), "left")
    n = F.length("text")
    tail = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - tail), F.substring(F.coalesce("start", F.lit("")), F.lit(1), tail))
    return both.select("rid", "doc_id", "text", edited.alias("edited")), order


def near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row."""
    with C.Scratch(docs.sparkSession) as scratch:
        texts, order = with_edits(docs, scratch, id_col, text_col)
        kinds = F.array(
            F.struct(F.lit(0).alias("kind"), F.col("text").alias("text"), F.lit(None).cast("string").alias("sha")),
            F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text"), F.sha2("edited", 256).alias("sha")),
        )
        keys = ("rid", "doc_id", "n_chars", "kind", "sha")
        listed = texts.select("rid", "doc_id", F.length("text").cast("long").alias("n_chars"), F.explode(kinds).alias("k")).select("rid", "doc_id", "n_chars", "k.kind", "k.text", "k.sha")
        gathered = votes(listed, *keys).groupBy("rid", "doc_id", "n_chars").agg(
            F.collect_list(F.when(F.col("kind") == 0, _packed())).alias("own"), F.collect_list(F.when(F.col("kind") == 1, _packed())).alias("edited"), F.max("sha").alias("edited_sha256")
        )
        halves = {f"{name}_{half}": _bits(F.col(name), i) for name in ("own", "edited") for i, half in enumerate(("hi", "lo"))}
        prints = scratch.keep(gathered.select("rid", "doc_id", "n_chars", "edited_sha256", *(c.alias(n) for n, c in halves.items())), "prints")
        of_next = order.join(prints.select(F.col("rid").alias("at"), F.col("own_hi").alias("next_hi"), F.col("own_lo").alias("next_lo")), F.col("next_rid") == F.col("at"))
        of_next = scratch.keep(of_next.select(F.col("doc_id").alias("before"), "next_hi", "next_lo"), "next")
    out = prints.join(of_next, F.col("doc_id") == F.col("before"), "left")
    own, edited, after = ((F.col(f"{n}_hi"), F.col(f"{n}_lo")) for n in ("own", "edited", "next"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", hexadecimal(*own).alias("fingerprint"), hexadecimal(*edited).alias("edited_fingerprint"),
        likeness(distance(own, edited)).alias("near_edited"), F.when(F.col("next_hi").isNotNull(), likeness(distance(own, after))).alias("near_next"),
    )
