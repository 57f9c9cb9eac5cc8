"""Operator 7, mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and hash bucket. In each source the buckets below a threshold fit the
budget; only the bucket at the boundary is summed again by finer bits of the hash, down to single
hash values. Documents are then kept by comparing their hash with the threshold of their source:
nothing is sorted, and thresholds for growing budgets are nested.

Targets: sources in code point order, null last, weigh 3, 1, 2, repeating, and share 150 % of all
sizes; a target stops at twice its source's size, and the excess is shared again by weight. A
source takes whole passes over its documents as far as its target goes, and the threshold decides
which documents it takes once more; at the boundary it goes to the nearer side of the budget.

Defined results: a null or empty text has size 0; the hash is that of the id as text and of the text, so only rows
equal in both go together (nulls count as empty); a source of size 0 has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Weights by rank of the source, and the share of all sizes that the mix takes, times two.
WEIGHTS, DOUBLE_SHARE, MOST_PASSES = (3, 1, 2), 3, 2
BITS, LEVELS = 12, 4
HASH_BITS = BITS * LEVELS
#: More sources than this are joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 100_000


def _hash(id_column: Column, text: Column) -> Column:
    both = F.concat(*(F.coalesce(c.cast("string"), F.lit("")) for c in (id_column, text)))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(C.WORD)), F.lit(0)).cast("long")


def _source(docs: DataFrame, source_col: str) -> Column:
    return docs[source_col].cast("string") if source_col in docs.columns else F.lit(None).cast("string")


def _ranked(sources: DataFrame, scratch: C.Scratch) -> DataFrame:
    """Weights by rank, from a range partitioning: offsets of partitions plus places within them."""
    ordered = F.col("source").asc_nulls_last()
    placed = scratch.save(sources.repartitionByRange(ordered).withColumn("pid", F.spark_partition_id()), "sources")
    counts = {r.pid: r.n for r in placed.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, at = {}, 0
    for pid in sorted(counts):
        offsets[pid] = at
        at += counts[pid]
    offset = F.create_map(*(F.lit(x) for kv in offsets.items() for x in kv))[F.col("pid")] if offsets else F.lit(0)
    rank = offset + F.row_number().over(Window.partitionBy("pid").orderBy(ordered)) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS)).cast("int") + 1)
    return placed.select("source", "source_size", weight.cast("long").alias("weight"))


def targets(sources: DataFrame, scratch: C.Scratch) -> DataFrame:
    """source, source_size, target: integers until the last division, so the order of sums doesn't matter."""
    ranked = scratch.save(_ranked(sources, scratch), "weights")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    total = ranked.agg(F.sum(wide("source_size"))).first()[0] or 0
    capped, up, down = F.lit(False), 0, 1
    n_capped = -1
    while True:
        full, light, n = ranked.agg(F.sum(F.when(capped, wide("source_size"))), F.sum(F.when(~capped, wide("weight"))), F.sum(capped.cast("long"))).first()
        if (n or 0) == n_capped:
            break
        n_capped = n or 0
        up, down = DOUBLE_SHARE * int(total) - 2 * MOST_PASSES * int(full or 0), 2 * int(light or 0)
        if not down:
            break
        capped = F.lit(up).cast("decimal(38,0)") * wide("weight") >= F.lit(MOST_PASSES * down).cast("decimal(38,0)") * wide("source_size")
    share = (F.lit(up).cast("decimal(38,0)") * wide("weight")).cast("double") / F.lit(float(max(down, 1)))
    return ranked.select("source", "source_size", F.when(capped, (MOST_PASSES * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def thresholds(sized: DataFrame, scratch: C.Scratch) -> tuple[DataFrame, bool]:
    """of, source_size, target, passes and below of every source, and whether they are few enough to broadcast.

    ``sized`` has source, size and h of every row. Rows with a hash under ``below`` are taken once more.
    """
    sources = scratch.save(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "totals")
    few = sources.count() <= BROADCAST_SOURCES
    near = F.broadcast if few else lambda df: df
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = targets(sources, scratch).withColumn("passes", passes).withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size"))
    state = scratch.save(state.withColumn("below", F.lit(0).cast("long")).withColumn("open", F.col("passes") < MOST_PASSES), "state")
    for level in range(1, LEVELS + 1):
        shift, before = HASH_BITS - BITS * level, HASH_BITS - BITS * (level - 1)
        st = state.filter("open").select(F.col("source").alias("of"), "below", "budget")
        inside = sized.filter("size > 0").join(near(st), F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("h", before) == F.shiftright("below", before)))
        sums = inside.groupBy("of", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("n"), F.first("budget").alias("budget"))
        upto = F.sum("n").over(Window.partitionBy("of").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
        fits = F.col("upto") <= F.col("budget")
        edge = sums.withColumn("upto", upto).groupBy("of").agg(
            F.sum(F.when(fits, F.col("n"))).alias("used"), F.max(F.when(fits, F.col("b"))).alias("last"),
            F.min(F.when(~fits, F.struct("b", "n"))).alias("cut"),
        )
        joined = state.join(edge, F.col("source").eqNullSafe(F.col("of")), "left")
        left = F.col("budget") - F.coalesce("used", F.lit(0))
        has_cut = F.col("cut").isNotNull()
        cut = F.shiftleft(F.col("cut.b"), shift)
        if level == LEVELS:  # a single hash value: to the nearer side
            cut = cut + (F.col("cut.n") <= 2 * left).cast("long")
        below = F.when(has_cut, cut).when(F.col("last").isNotNull(), F.shiftleft(F.col("last") + 1, shift)).otherwise(F.col("below"))
        state = joined.select("source", "source_size", "target", "passes", left.alias("budget"), below.alias("below"), (F.col("open") & has_cut).alias("open"))
        state = scratch.keep(state, "thresholds") if level == LEVELS else scratch.save(state, "state")
    return state.select(F.col("source").alias("of"), "source_size", "target", "passes", "below"), few


def _times() -> Column:
    return F.col("passes") + ((F.col("passes") < MOST_PASSES) & (F.col("h") < F.col("below"))).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken and passes, one row per input row."""
    with C.Scratch(docs.sparkSession) as scratch:
        sized = docs.select(docs[id_col].alias("doc_id"), _source(docs, source_col).alias("source"), _size(docs[text_col]).alias("size"), _hash(docs[id_col], docs[text_col]).alias("h"))
        sized = scratch.keep(sized, "sizes")
        state, few = thresholds(sized, scratch)
    out = sized.join(F.broadcast(state) if few else state, F.col("source").eqNullSafe(F.col("of")), "left")
    return out.select("doc_id", "source", "size", "source_size", "target", (_times() * F.col("size")).alias("taken"), _times().alias("passes"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """All columns of the documents that the mix takes, with mix_passes (times taken) and mix_taken (words taken).

    Columns of these two names that the input has already are replaced.
    """
    with C.Scratch(docs.sparkSession) as scratch:
        sized = scratch.save(docs.select(_source(docs, source_col).alias("source"), _size(docs[text_col]).alias("size"), _hash(docs[id_col], docs[text_col]).alias("h")), "sizes")
        state, few = thresholds(sized, scratch)
    row, of = F.struct("*").alias("row"), _source(docs, source_col).alias("from")
    own = docs.select(row, of, _hash(docs[id_col], docs[text_col]).alias("h"), _size(docs[text_col]).alias("size"))
    out = own.join(F.broadcast(state) if few else state, F.col("from").eqNullSafe(F.col("of")), "left").filter(_times() > 0)
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("mix_passes", "mix_taken")]
    return out.select(*kept, _times().alias("mix_passes"), (_times() * F.col("size")).alias("mix_taken"))
