"""Operator 8 as a stage: SimHash near-dedup that keeps one row of each group of near copies.

Near copies are rows whose sets of five-word shingles have a Jaccard similarity of 4/5 or more; a
group is all rows joined by a chain of such pairs. Rows with the same set are one node. Three sources
propose pairs of nodes, and every pair is verified on whole sets:

1. SimHash fingerprints of the shingles, linked by pivot distance tables (:func:`textloom.llm.simhash.links`).
2. Stars at shared prefix shingles. A set of n shingles has a prefix: its first n - ceil(0.8 n) + 1 shingles
   in one order that all sets share. Two sets at 0.8 or more share a shingle of both prefixes. At each such
   shingle the first node in each of ``ORDERS`` orders is a hub; of ``HUBS`` hubs of a node the ``BEST`` that may be
   nearest are compared with it. Sizes and positions discard pairs that can't reach 0.8.
3. After links of 1 and 2 have become components, each node with the nearest one, by maps, of another component at
   each shared prefix shingle; and after these have joined components, all pairs at shared prefix shingles whose nodes
   are still in different ones. So no link between components is lost, and a large group of near copies, which
   is joined by then, isn't verified pair by pair. Nodes that maps allow no pair at first have none later and drop out.

Before whole sets travel, maps of ``BITS`` bits, one set for each shingle's hash, bound what two sets share: a bit of
one that the other lacks is a shingle that the other lacks. Pairs whose bound is under 4/5 are discarded, which
loses none; pairs of 3 pass maps of ``FOLDED`` bits before they are written. Then each pair sends its map, and
if that passes its set, to the other, the hub; a hub with many pairs takes them in several tasks.

Fingerprints two bits apart alone would miss most pairs at 0.8 (they are 3 to 18 bits apart), hence 2 and 3.
The order of shingles is by hash, with those that a sample shows in many sets last: any sample gives the same
groups, it only keeps license lines and the like out of the prefixes.

Defined results: A-Z count as lower case; a text under five words is one shingle, a null or empty
one or one of blanks is the empty set, equal only to its like; null ids are ordinary rows that come last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components
from .simhash import fingerprint_of, links as fingerprint_links, shingle_hashes

SHINGLE = 5
#: Documents of the sample at least, and of how many one is in it; the sets of it that make a shingle a frequent one; at most so many are kept.
SAMPLE, ONE_OF, FREQUENT, MOST = 10_000, 6, 3, 500_000
#: More rows, or pairs, than this are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Bits of the maps, pairs of a hub that one task takes; hubs of a shingle, and of a node by map and by set, before components are known.
BITS, FOLDED, PAIRS_OF_HUB, ORDERS, HUBS, BEST = 2048, 1024, 256, 4, 4, 2
#: Pairs whose maps are compared at a time; rows of a shingle beyond which those of its largest component aren't paired with each other.
STEP, CROWD = 1 << 16, 64


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes."""
    return np.unique(shingle_hashes(text, SHINGLE))


def node_of(found: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix(found: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The first n - ceil(4n/5) + 1 hashes, those of ``last`` (sorted) behind all others."""
    n = len(found)
    if not n:
        return found
    if len(last):
        at = np.minimum(np.searchsorted(last, found), len(last) - 1)
        late = last[at] == found
        found = np.concatenate([found[~late], found[late]])
    return found[: n - (4 * n + 4) // 5 + 1]


def _frequent(texts: DataFrame) -> np.ndarray:
    """Hashes in many sets of a sample that is taken by the hash of the row and grows with the table.

    They come last in prefixes, so these hold the shingles by which members of a large group differ.
    """
    few = texts.filter(F.pmod("row", F.lit(max(1, min(ONE_OF, texts.count() // SAMPLE)))) == 0).select(F.col("row").alias("doc_id"), "text")
    schema = pa.schema([("doc_id", pa.int64()), ("hashes", pa.list_(pa.int64()))])
    sets = few.mapInArrow(C.map_rows(lambda t: (shingle_set(t).view(np.int64),), schema, (), as_bytes=True), C.spark_schema(schema))
    often = sets.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FREQUENT)
    got = often.orderBy(F.desc("n"), "h").limit(MOST).select("h").toArrow().column("h").to_numpy()
    return np.sort(got.astype(np.int64).view(np.uint64))


def bit_map(found: np.ndarray, bits: int) -> bytes:
    """A bit for each shingle, by its hash."""
    out = np.zeros(bits, dtype=bool)
    out[(found % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


def most_shared(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What sets of n and m shingles with these maps (rows of 64-bit words) share at most."""
    lacking = lambda p, q: np.bitwise_count(p & ~q).sum(1, dtype=np.int64)
    return np.minimum(n - lacking(x, y), m - lacking(y, x))


def can_be_near(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether they may share the 4/9 (n + m) that make 4/5."""
    return 9 * most_shared(x, y, n, m) >= 4 * (n + m)


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _column(c: pa.Array) -> np.ndarray:
    """Numbers, or maps as rows of 64-bit words."""
    if pa.types.is_binary(c.type):
        return np.frombuffer(b"".join(c.to_pylist()), dtype=np.uint64).reshape(len(c), -1)
    return c.to_numpy(zero_copy_only=False)


def _by_key(find):
    """Applies ``find`` to whole runs of equal keys, rows sorted by key; the last run of a batch waits for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for part in batches:
            now = [_column(c) for c in part.columns]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            cut = np.searchsorted(held[0], held[0][-1]) if len(held[0]) else 0
            if cut:
                yield from find(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield from find(*held)

    return run


def _met(key, place, node) -> Iterator[pa.RecordBatch]:
    """Rows of keys that several nodes have."""
    same = key[1:] == key[:-1]
    many = np.append(False, same) | np.append(same, False)
    yield pa.RecordBatch.from_arrays([pa.array(x[many]) for x in (key, place, node)], names=["key", "place", "node"])


def _reachable(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sets that share a shingle at these places (size and position in the prefix, 32 bits each) can have 4/5."""
    n, m = x >> 32, y >> 32
    most = np.minimum(n - (x & 0xFFFFFFFF), m - (y & 0xFFFFFFFF))
    return (5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (9 * most >= 4 * (n + m))


def _pair_rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=_PAIR)


def _stars(key, place, node) -> Iterator[pa.RecordBatch]:
    """hub, node: each node with the first of its key in every order."""
    run = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1
    for i in range(ORDERS):
        mixed = (node.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * i * 0x632BE59BD9B4E019 & 2**64 - 1)) >> np.uint64(16)
        order = np.lexsort((mixed, run))
        lead = order[np.flatnonzero(np.append(True, run[order][1:] != run[order][:-1]))][run]
        ok = (node != node[lead]) & _reachable(place, place[lead])
        yield pa.RecordBatch.from_arrays([pa.array(node[lead][ok]), pa.array(node[ok])], names=["hub", "node"])


def _allowed(key, place, root, maps) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places x, y of all pairs of different components that their maps allow, each pair once for its key, and the share that both
    may have in common; places, and so sizes, ascend for a key."""

    def told(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        ok = (root[x] != root[y]) & _reachable(place[x], place[y])
        x, y = x[ok], y[ok]
        for at in range(0, len(x), STEP):
            a, b = x[at : at + STEP], y[at : at + STEP]
            most, size = most_shared(maps[a], maps[b], place[a] >> 32, place[b] >> 32), (place[a] >> 32) + (place[b] >> 32)
            near = 9 * most >= 4 * size
            if near.any():
                yield a[near], b[near], 2 * most[near] / np.maximum(size[near], 1)

    runs = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    ends = np.append(runs[1:], len(key))
    start, lag = np.flatnonzero(np.repeat(ends - runs <= CROWD, ends - runs)), 0
    while True:
        lag += 1
        start = start[: np.searchsorted(start, len(key) - lag)]
        # Once a set is too large, all after it are.
        start = start[(key[start] == key[start + lag]) & (5 * (place[start] >> 32) >= 4 * (place[start + lag] >> 32))]
        if not len(start):
            break
        yield from told(start, start + lag)
    for low, high in zip(runs, ends, strict=True):
        if high - low > CROWD:
            found, n = np.unique(root[low:high], return_counts=True)
            large = root[low:high] == found[n.argmax()]
            size = place[low:high] >> 32
            for i in np.flatnonzero(~large):
                y = np.arange(np.searchsorted(5 * size, 4 * size[i]), np.searchsorted(4 * size, 5 * size[i], "right"))
                y = low + y[large[y] | (y > i)]
                yield from told(np.full(len(y), low + i), y)


def _pairs(key, place, node, root, maps) -> Iterator[pa.RecordBatch]:
    """All pairs of nodes in different components that their maps allow."""
    found: list[np.ndarray] = []

    def once() -> pa.RecordBatch:
        """Pairs that met at several keys here are given once."""
        both = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
        return _pair_rows(both[:, 0], both[:, 1])

    for x, y, _ in _allowed(key, place, root, maps):
        found.append(np.stack([node[x], node[y]], 1))
        if sum(map(len, found)) >= STEP:
            found = [np.unique(np.sort(np.concatenate(found), axis=1), axis=0)]
            if len(found[0]) >= STEP // 2:
                yield once()
                found = []
    if found:
        yield once()


def _nearest(key, place, node, root, maps) -> Iterator[pa.RecordBatch]:
    """Each node that has such a pair with the one whose map agrees most."""
    best, other = np.full(len(key), -1.0), np.zeros(len(key), dtype=np.int64)
    for x, y, share in _allowed(key, place, root, maps):
        order = np.argsort(share, kind="stable")
        for p, q in ((x[order], y[order]), (y[order], x[order])):
            more = share[order] > best[p]
            # Of a place that is written repeatedly, the last, nearest, counts.
            best[p[more]], other[p[more]] = share[order][more], node[q[more]]
    has = best >= 0
    if has.any():
        both = np.unique(np.sort(np.stack([node[has], other[has]], 1), axis=1), axis=0)
        yield _pair_rows(both[:, 0], both[:, 1])


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hub and part, the hub's own map (no member) first; gives the pairs that maps allow, and at most what share of both sets is common."""
    schema = pa.schema([*_PAIR, ("share", pa.float64())])
    own: tuple | None = None
    for part in batches:
        hub, n, maps = (_column(part.column(c)) for c in ("hub", "n", "bits"))
        member = part.column("member")
        lead = np.array(member.is_null().to_numpy(zero_copy_only=False), dtype=bool)
        at = np.maximum.accumulate(np.where(lead, np.arange(len(hub)), -1))
        if (at < 0).any():  # the hub came with the rows before
            hub, n, maps, lead = np.append(own[0], hub), np.append(own[1], n), np.concatenate([own[2], maps]), np.append(True, lead)
            member = pa.chunked_array([pa.nulls(1, pa.int64()), member]).combine_chunks()
            at = np.maximum.accumulate(np.where(lead, np.arange(len(hub)), -1))
        if len(hub):
            own = (hub[at[-1]], n[at[-1]], maps[at[-1]][None])
        rows = np.flatnonzero(~lead)
        most, size = most_shared(maps[rows], maps[at[rows]], n[rows], n[at[rows]]), n[rows] + n[at[rows]]
        ok = 9 * most >= 4 * size
        yield pa.RecordBatch.from_arrays([pa.array(hub[rows[ok]]), member.take(pa.array(rows[ok])), pa.array(2 * most[ok] / np.maximum(size[ok], 1))], schema=schema)


def _near_hub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hub and part, the hub's own set (no member) first."""
    hub, own = None, None
    for batch in C.arrow_steps(batches):
        near = []
        for h, member, found in zip(batch.column("hub").to_pylist(), batch.column("member").to_pylist(), batch.column("hashes"), strict=True):
            found = found.values.to_numpy(zero_copy_only=False)
            if member is None:
                hub, own = h, found
            elif h == hub:
                both = len(np.intersect1d(own, found, assume_unique=True))
                if 5 * both >= 4 * (len(own) + len(found) - both):
                    near.append((h, member))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in near], type=pa.int64()) for i in (0, 1)], schema=_PAIR)


def _print_links(nodes: DataFrame, scratch: C.Scratch) -> DataFrame:
    """a, b: the least node of each fingerprint with its other nodes, and with those of linked fingerprints."""
    least = scratch.save(nodes.groupBy("fp").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")), "prints")
    met = fingerprint_links(least.select("fp"), scratch)
    of = [least.select(F.col("fp").alias(f"{c}_fp"), F.col("lead").alias(f"{c}_node")) for c in ("x", "y")]
    linked = met.join(of[0], F.col("a") == F.col("x_fp")).join(of[1], F.col("b") == F.col("y_fp")).select(F.col("x_node").alias("a"), F.col("y_node").alias("b"))
    same = nodes.join(least.filter("n > 1").select(F.col("fp").alias("of_fp"), "lead"), F.col("fp") == F.col("of_fp")).select(F.col("node").alias("a"), F.col("lead").alias("b"))
    return linked.unionAll(same.filter("a <> b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _near(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _sends(pairs: DataFrame) -> tuple[DataFrame, bool]:
    """node and sends, the hubs that it goes to, hubs themselves included (no member); and whether the pairs are few."""
    hubs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS_OF_HUB).cast("int").alias("parts"))
    sent = pairs.join(hubs, "a").select(F.col("b").alias("of"), F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), F.col("b").alias("member"))
    own = hubs.select(F.col("a").alias("of"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("member"))
    return sent.unionAll(own).groupBy("of").agg(F.collect_list(F.struct("hub", "part", "member")).alias("sends")), pairs.count() <= BROADCAST_ROWS


def _at_hubs(rows: DataFrame) -> DataFrame:
    return rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "member").drop("part")


def _verify(texts: DataFrame, heads: DataFrame, pairs: DataFrame, scratch: C.Scratch, best: int | None = None) -> DataFrame:
    """The pairs at 4/5 or more; with ``best`` only so many of each b, those whose maps agree most.

    ``texts`` has row and text, ``heads`` node, n, row and bits.
    """
    sends, few = _sends(scratch.save(pairs.distinct(), "pairs"))
    near = F.broadcast if few else lambda df: df
    sent = heads.select("node", "n", "bits").join(near(sends), F.col("node") == F.col("of")).select(F.explode("sends").alias("s"), "n", "bits")
    possible = _at_hubs(sent.select("s.hub", "s.part", "s.member", "n", "bits")).mapInArrow(_possible, "a long, b long, share double")
    if best:
        nearest = F.slice(F.sort_array(F.collect_list(F.struct("share", "a")), asc=False), 1, best)
        possible = possible.groupBy("b").agg(nearest.alias("near")).select(F.explode("near.a").alias("a"), "b")
    sends, few = _sends(scratch.save(possible.select("a", "b"), "possible"))
    wanted = sends.join(heads.select("node", F.col("row").alias("of_row")), F.col("node") == F.col("of")).select("of_row", "sends")
    wanted = scratch.save(wanted, "wanted")
    near = F.broadcast if few else lambda df: df
    schema = pa.schema([("sends", pa.list_(pa.struct([("hub", pa.int64()), ("part", pa.int32()), ("member", pa.int64())]))), ("hashes", pa.list_(pa.int64()))])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a row that is repeated whole sends its set once a task
        for part in C.arrow_steps(batches):
            first = []
            for r in part.column("row").to_pylist():
                first.append(r not in seen)
                seen.add(r)
            part = part.filter(pa.array(first, type=pa.bool_()))
            found = [shingle_set(t or b"").view(np.int64) for t in part.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("sends").cast(schema.field(0).type), pa.array(found, type=schema.field(1).type)], schema=schema)

    held = texts.join(near(wanted), F.col("row") == F.col("of_row")).select("row", "text", "sends").mapInArrow(sets, C.spark_schema(schema))
    posted = held.select(F.explode("sends").alias("s"), "hashes").select("s.hub", "s.part", "s.member", "hashes")
    return scratch.save(_at_hubs(posted).mapInArrow(_near_hub, "a long, b long"), "links")


def _rooted(table: DataFrame, links: DataFrame, scratch: C.Scratch) -> DataFrame:
    """Adds root to a table with node: the component, or the node itself."""
    roots = components(links, scratch).select(F.col("node").alias("of"), F.col("root").alias("least"))
    return table.join(_near(roots), F.col("node") == F.col("of"), "left").withColumn("root", F.coalesce("least", "node")).drop("of", "least")


def groups(docs: DataFrame, id_col: str, text_col: str, scratch: C.Scratch) -> DataFrame:
    """doc_id, row (a hash of id and text), node and root: rows of one group share the root."""
    # The hash of id and text stands for the row: ids may repeat or be null.
    row_hash = F.xxhash64(docs[id_col], docs[text_col])
    texts = docs.select(row_hash.alias("row"), docs[text_col].cast("string").alias("text"))
    last = _frequent(texts)
    schema = C.arrow_schema(
        C.id_type(docs, id_col), row=pa.int64(), node=pa.int64(), n=pa.int64(), prefix=pa.list_(pa.int64()), fp=pa.int64(), bits=pa.binary(), folded=pa.binary()
    )
    narrow = docs.select(docs[id_col].alias("doc_id"), row_hash.alias("row"), docs[text_col].cast("string").alias("text"))

    def of(row: int, text: bytes) -> tuple:
        hashes = shingle_hashes(text, SHINGLE)
        found = np.unique(hashes)
        return row, node_of(found), len(found), prefix(found, last).view(np.int64), fingerprint_of(hashes), bit_map(found, BITS), bit_map(found, FOLDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.arrow_steps(batches):
            made = [of(r, t or b"") for r, t in zip(part.column("row").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True)]
            columns = [pa.array([m[i] for m in made], type=schema.field(i + 1).type) for i in range(7)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(schema.field(0).type), *columns], schema=schema)

    rows = scratch.save(narrow.mapInArrow(run, C.spark_schema(schema)), "rows")
    # One row for each node; only rows of sets that occur more than once are looked up.
    copied = rows.groupBy("node").agg(F.min("row").alias("lead"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select(F.col("node").alias("of"), "lead")
    told = rows.join(_near(scratch.save(copied, "copied")), F.col("node") == F.col("of"), "left")
    columns = ["node", "n", "prefix", "row", "fp", "bits", "folded"]
    nodes = told.filter("lead IS NULL").select(*columns).unionAll(told.filter("row = lead").select(*columns).dropDuplicates(["node"]))
    heads = scratch.save(nodes.drop("prefix"), "heads")
    place = F.shiftleft(F.col("n"), 32) + F.col("at")
    posted = nodes.select("node", "n", F.posexplode("prefix").alias("at", "key")).select("key", place.alias("place"), "node")
    by_key = lambda df: df.repartition("key").sortWithinPartitions("key", "place", "node")
    met = scratch.save(by_key(posted).mapInArrow(_by_key(_met), "key long, place long, node long"), "met")
    stars = by_key(met).mapInArrow(_by_key(_stars), "hub long, node long").groupBy("node").agg(F.slice(F.array_sort(F.collect_set("hub")), 1, HUBS).alias("hubs"))
    stars = stars.select(F.explode("hubs").alias("a"), F.col("node").alias("b"))
    near = _verify(texts, heads, _print_links(heads, scratch).unionAll(stars), scratch, BEST)
    maps = heads.select("node", "folded")

    def apart(undecided: DataFrame, links: DataFrame, find) -> DataFrame:
        """Pairs of undecided nodes in different components, distinct."""
        mapped = met.join(_rooted(undecided, links, scratch).withColumnRenamed("node", "of"), F.col("node") == F.col("of"))
        found = by_key(mapped.select("key", "place", "node", "root", "folded")).mapInArrow(_by_key(find), "a long, b long")
        return scratch.save(found.distinct(), "apart")

    nearest = apart(maps, near, _nearest)
    either = _near(nearest.select("a").unionAll(nearest.select("b")).distinct())
    undecided = scratch.save(maps.join(either, F.col("node") == F.col("a"), "left_semi"), "undecided")
    links = near.unionAll(_verify(texts, heads, nearest, scratch))
    links = links.unionAll(_verify(texts, heads, apart(undecided, links, _pairs), scratch))
    return _rooted(rows.select("doc_id", "row", "node"), links, scratch)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of one row of each group: that with the least id, then the least hash of id and text.

    Null ids come last; of rows that agree in id and text, that with the least hash of all its columns stays.
    """
    with C.Scratch(docs.sparkSession) as scratch:
        placed = scratch.save(groups(docs, id_col, text_col, scratch), "placed")
        least = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least"))
        kept = least.select(F.col("least.row").alias("kept")).distinct()
        # Few rows go and fewer are repeated whole, so these travel, not the others.
        each = placed.groupBy("row").agg(F.count(F.lit(1)).alias("n"))
        fate = each.join(kept, F.col("row") == F.col("kept"), "left").filter("kept IS NULL OR n > 1")
        fate = scratch.keep(fate.select(F.struct(F.col("row"), F.col("kept").isNotNull().alias("once")).alias("textloom_fate")), "fates")
    near = F.broadcast if fate.count() <= BROADCAST_ROWS else lambda df: df
    # Columns are held in structs, so that none of the table's own names can clash.
    held = docs.select(F.struct("*").alias("textloom_row"), F.xxhash64(docs[id_col], docs[text_col]).alias("textloom_of"))
    told = held.join(near(fate), F.col("textloom_of") == F.col("textloom_fate.row"), "left")
    plain = told.filter(F.col("textloom_fate").isNull()).select("textloom_row.*")
    once = told.filter(F.col("textloom_fate.once")).groupBy("textloom_of").agg(F.min_by("textloom_row", F.xxhash64("textloom_row")).alias("textloom_row")).select("textloom_row.*")
    return plain.unionAll(once)
