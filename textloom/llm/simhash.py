"""Operator 8, SimHash near-dedup with pivot distance tables.

The table of a fingerprint has its Hamming distances to ``len(PIVOTS)`` reference fingerprints: zero, and
``PER_BLOCK`` for each of four 16-bit blocks that are zero outside it. A distance to one of these less that to
zero depends on its block alone. At most two differing bits leave two or more blocks equal, and with them
their coordinates, so each of six pairs of blocks gives a bucket: the fingerprints whose table agrees in
the coordinates of both. No link is lost. In a bucket, sorted by one distance, only pairs whose distances
are within ``MAX_BITS`` meet; those that differ by more in any coordinate are discarded, and survivors are
verified bit by bit. Buckets give a spanning forest of their links.

Buckets of more than ``BUCKET`` fingerprints, where tables are all alike, go another exact way: two
fingerprints are at most two bits apart exactly if some value is at most one bit from both, so each
fingerprint is sent to the 65 values of its own ball. A value is shared by 65 fingerprints at most, so no
group grows with the data.

Copies are folded first. Links between distinct fingerprints become components by star contraction in tables.

Defined results: a null or empty text, or one of blanks, has fingerprint zero and links like any
other; a null id belongs to its component but names none, so a component of null ids only has
component null; repeated rows each get a row and share a component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import common as C
from .components import components

SHINGLE, SEED, MAX_BITS = 3, 42, 2
BLOCK, BUCKET, PER_BLOCK = 16, 1024, 12
#: More names of components than this are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_REFERENCES = np.random.default_rng(64).integers(1, 1 << BLOCK, (4, PER_BLOCK), dtype=np.uint64)
PIVOTS = np.concatenate([np.zeros(1, dtype=np.uint64), *(r << np.uint64(BLOCK * i) for i, r in enumerate(_REFERENCES))])
_PAIRS = [(i, j) for i in range(4) for j in range(i)]
_ODD = np.random.default_rng(65).integers(0, 2**62, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 1 << 16
_WEIGHTS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle, A-Z in lower case; the whole sequence if it is shorter."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    flat = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=-1))[1:]
    starts = [0, *(e + 1 for e in ends[:-1])]
    if len(words) < size:
        return np.array([xxh64_intdigest(flat, SEED)], dtype=np.uint64)
    return np.array([xxh64_intdigest(flat[a:b], SEED) for a, b in zip(starts, ends[size - 1 :], strict=False)], dtype=np.uint64)


def fingerprint(text: bytes) -> int:
    return fingerprint_of(shingle_hashes(text))


def fingerprint_of(h: np.ndarray) -> int:
    """Signed 64-bit value: a bit is set if it is set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), _STEP):
        bits = np.unpackbits(h[at : at + _STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int32)
    return int(_WEIGHTS[2 * ones > len(h)].sum(dtype=np.uint64).view(np.int64)) if len(h) else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    schema = C.arrow_schema(C.id_type(docs, id_col), fp=pa.int64())
    return C.id_and_text(docs, id_col, text_col).mapInArrow(C.map_rows(lambda t: (fingerprint(t),), schema, (), as_bytes=True), C.spark_schema(schema))


def _forest(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Links of a spanning forest."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x], x = root, up
        return root

    out = []
    for x, y in zip(a, b, strict=True):
        rx, ry = find(x), find(y)
        if rx != ry:
            parent[rx] = ry
            out.append((x, y))
    return out


def distance_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to all pivots."""
    return np.bitwise_count(fps.view(np.uint64)[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def bucket_keys(table: np.ndarray) -> np.ndarray:
    """Six keys of each row of the table, equal for rows that agree in the coordinates of a pair of blocks.

    The coordinates of a block, each from -16 to 16, make one whole number; a key mixes two of them.
    """
    own = (table[:, 1:].astype(np.int64) - table[:, :1] + BLOCK).reshape(-1, 4, PER_BLOCK)
    codes = (own * (2 * BLOCK + 1) ** np.arange(PER_BLOCK)).sum(2).astype(np.uint64)
    out = np.empty((len(table), len(_PAIRS)), dtype=np.uint64)
    for n, (i, j) in enumerate(_PAIRS):
        h = codes[:, i] * _ODD[0] + codes[:, j] * _ODD[1] + np.uint64(n) * _ODD[2]
        h = (h ^ (h >> np.uint64(32))) * _ODD[0]
        out[:, n] = h ^ (h >> np.uint64(29))
    return out.view(np.int64)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64())])
    for part in batches:
        fps = part.column("fp").to_numpy(zero_copy_only=False)
        keys = bucket_keys(distance_table(np.ascontiguousarray(fps)))
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(fps, keys.shape[1]))], schema=schema)


def links_of(keys: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
    """Verified links between fingerprints of equal keys."""
    table = distance_table(fps)
    order = np.lexsort((fps, table[:, 0], keys))
    keys, fps, table = keys[order], fps[order], table[order]
    found_a, found_b = [], []
    at, lag = np.arange(len(keys)), 0
    while True:
        lag += 1
        at = at[: np.searchsorted(at, len(keys) - lag)]
        # The first distance ascends in a bucket: once it is out of range, all after it are.
        at = at[(keys[at] == keys[at + lag]) & (table[at + lag, 0] - table[at, 0] <= MAX_BITS)]
        if not len(at):
            break
        near = at[np.abs(table[at] - table[at + lag]).max(1) <= MAX_BITS]
        near = near[np.bitwise_count(fps[near].view(np.uint64) ^ fps[near + lag].view(np.uint64)) <= MAX_BITS]
        found_a.append(fps[near])
        found_b.append(fps[near + lag])
    if not found_a:
        return []
    return _forest(np.concatenate(found_a).tolist(), np.concatenate(found_b).tolist())


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key; the last run of a batch waits for the next, so a bucket is seen whole."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    keys, fps = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def out(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        pairs = links_of(k, f)
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], type=pa.int64()) for i in (0, 1)], schema=schema)

    for part in batches:
        keys = np.concatenate([keys, part.column("key").to_numpy(zero_copy_only=False)])
        fps = np.concatenate([fps, part.column("fp").to_numpy(zero_copy_only=False)])
        cut = np.searchsorted(keys, keys[-1]) if len(keys) else 0
        if cut:
            yield out(keys[:cut], fps[:cut])
            keys, fps = keys[cut:], fps[cut:]
    if len(keys):
        yield out(keys, fps)


def links(distinct: DataFrame, scratch: C.Scratch) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that connect all pairs at most ``MAX_BITS`` apart."""
    keyed = distinct.select("fp").mapInArrow(_keyed, "key long, fp long")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("key").alias("of"), "n")
    met = scratch.save(keyed.join(sizes, F.col("key") == F.col("of")).select("key", "fp", "n"), "buckets")
    cold = met.filter(F.col("n") <= BUCKET).select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
    found = cold.mapInArrow(_bucket_links, "a long, b long")
    hot = met.filter(F.col("n") > BUCKET).select("fp").distinct()
    ball = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    shared = hot.select("fp", F.explode(ball).alias("z")).groupBy("z").agg(F.collect_set("fp").alias("near")).filter(F.size("near") > 1)
    stars = shared.select(F.array_min("near").alias("a"), F.explode("near").alias("b")).filter("a <> b").distinct()
    return found.unionAll(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, one row per input row."""
    with C.Scratch(docs.sparkSession) as scratch:
        prints = scratch.keep(fingerprints(docs, id_col, text_col), "fingerprints")
        distinct = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
        roots = components(links(distinct.select("fp"), scratch), scratch)
        # A fingerprint without links is its own component; the others take the least id of their component.
        placed = scratch.save(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", "root"), "placed")
        named = placed.filter("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("component_id")).select(F.col("root").alias("of"), "component_id")
        linked = placed.filter("root IS NOT NULL").join(named, F.col("root") == F.col("of")).select(F.col("fp").alias("print"), "component_id")
        # Rows that nothing is like need no name: they are most, so names are few and copies of one text don't meet in a task.
        alone = placed.filter("root IS NULL AND n > 1").select(F.col("fp").alias("print"), F.col("least").alias("component_id"))
        names = scratch.keep(linked.unionAll(alone).withColumn("named", F.lit(True)), "components")
    near = F.broadcast if names.count() <= BROADCAST_ROWS else lambda df: df
    out = prints.join(near(names), F.col("fp") == F.col("print"), "left")
    component = F.when(F.col("named"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))
