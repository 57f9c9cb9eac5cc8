"""Operator 9, substring dedup with prefix-partitioned suffix trees.

The suffixes of interest start a window of ``WINDOW`` words. Each is filed under a prefix of variable length:

1. The prefix of a window is the run of ``PREFIX`` words that has the least hash in it (the first of
   equal ones), so equal windows have equal prefixes, at equal places. Prefixes of one text lead to a
   leaf and end here. The texts under each of the others are counted; a prefix of more than ``GROUP`` texts is
   lengthened to the whole window, which splits its group as far as it can be split. Which prefixes are long travels with
   the texts that have them, so nothing is broadcast and no bound depends on how many there are.
2. Suffixes under prefixes that several texts share go to the group of their prefix, with the words
   that the group's tree needs. Windows that follow each other under one prefix share their words.
3. The tree of a group is built in memory, as a suffix array: ranks of suffixes by their first 1, 2, 4
   words and so on to ``WINDOW``, compared word by word. Suffixes of equal rank hang below one internal node of
   that depth, a repeat; its least document keeps the words, all others lose them. Touching nodes
   of a document are one maximal repeat. A group whose prefix is a whole window is a single node; its windows come with
   their words and are compared by them too.

Prefixes and texts are known by hashes of 64 to 128 bits, everything below a prefix by its words.

Each task first builds the tree of what it has itself (``BUFFER`` words at a time), settles all but the
least document of each node, and sends on that document's suffixes only. So a passage that very
many documents share sends a few rows a task. Copies of a whole text are one leaf: the least document stands
for them, and the others, all of whose windows start in it too, lose every word. Tasks read their
rows in a fixed order, so that a task that runs again after a loss settles the same rows.

Texts travel only if more than ``BROADCAST_ROWS`` of them share a prefix, and then once: both joins
use the same partitioning by the text's hash.

Defined results: a null or empty text has no words; texts under ``WINDOW`` words keep all; ids can be of
any type that has an order; a null id has no smaller one and is none, so its row stays whole; rows that
share an id don't remove each other's words, whatever their texts; repeats within one document stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from . import common as C

WINDOW, PREFIX = 50, 25
#: Words that a tree in memory is built from, at least; texts that share a prefix before it is lengthened.
BUFFER, GROUP = 400_000, 2_000
#: Texts with shared prefixes, or with words to cut, and hashes or runs of them, that are broadcast at most.
BROADCAST_ROWS, BROADCAST_ITEMS = 200_000, 2_000_000
ALL = 2**31 - 1
_ODD = np.random.default_rng(9).integers(0, 2**63, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_INVERSE = [np.uint64(pow(int(b), -1, 1 << 64)) for b in _ODD]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of a base and of its inverse modulo 2**64; tables over 2**20 aren't kept."""
    have = _powers.get(which)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 14)
        both = []
        for base in (_ODD[which], _INVERSE[which]):
            ones = np.full(size, base, dtype=np.uint64)
            ones[0] = 1
            both.append(np.multiply.accumulate(ones))
        have = (both[0], both[1])
        if size <= 1 << 20:
            _powers[which] = have
    return have


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def rolling(ids: np.ndarray, width: int, which: int) -> np.ndarray:
    """Polynomial hash, modulo 2**64 and mixed, of every run of ``width`` ids."""
    n = len(ids)
    if n < width:
        return np.zeros(0, dtype=np.uint64)
    up, down = _power_table(which, n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(ids * down[:n], out=sums[1:])
    return _mixed((sums[width:] - sums[:-width]) * up[width - 1 : n])


def word_ids(words: list[bytes]) -> np.ndarray:
    return np.array([xxh64_intdigest(w) for w in words], dtype=np.uint64)


def picked(h: np.ndarray) -> np.ndarray:
    """For each window the place of its prefix: the first of the least of ``WINDOW - PREFIX + 1`` hashes."""
    run = WINDOW - PREFIX + 1
    n = len(h) - run + 1
    if n < 1:
        return np.zeros(0, dtype=np.int64)
    first = lambda a, b: np.where(h[b] < h[a], b, a)
    best, size = np.arange(len(h)), 1
    while 2 * size <= run:
        best = first(best[:-size], best[size:])
        size *= 2
    return first(best[:n], best[run - size :][:n])


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Index of the first row of the run that each row of sorted keys belongs to."""
    n = len(keys[0])
    new = np.ones(n, dtype=bool)
    if n:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.maximum.accumulate(np.where(new, np.arange(n), 0))


def _leads(*keys: np.ndarray) -> np.ndarray:
    """Whether a row of sorted keys is the first of its run."""
    return _runs(*keys) == np.arange(len(keys[0]))


def _spans(leads: np.ndarray) -> list[tuple[int, int]]:
    at = np.flatnonzero(leads).tolist()
    return list(zip(at, [*at[1:], len(leads)], strict=False))


def ranks(words: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Suffixes of a sequence of word numbers get equal ranks exactly if their first ``depth`` words are equal.

    Ranks by 1, 2, 4 ... words each come from two ranks by half as many; suffixes shorter than ``depth`` have no meaningful rank.
    """
    rank, size = words.astype(np.int64), 1
    while size < depth:
        step = min(size, depth - size)
        if len(rank) <= step:
            return np.zeros(0, dtype=np.int64)
        pair = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        size += step
    return rank


class _Lexicon(dict):
    """Numbers of words, in the order that they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _numbered(texts: list[list[bytes]]) -> np.ndarray:
    known = _Lexicon()
    return np.fromiter((known[w] for words in texts for w in words), dtype=np.int64, count=sum(map(len, texts)))


def _merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same words in runs that don't touch, by document: maximal repeats from their windows."""
    if not len(doc):
        return doc, start, stop
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    apart = np.cumsum(np.append(False, doc[1:] != doc[:-1])) << 33
    reach = np.maximum.accumulate(stop + apart)
    at = np.flatnonzero(np.append(True, (start + apart)[1:] > reach[:-1]))
    return doc[at], start[at], np.maximum.reduceat(stop, at)


def _texts(part: pa.RecordBatch) -> list[bytes | None]:
    return part.column("text").cast(pa.binary()).to_pylist()


_PREFIXES = pa.schema([("k", pa.int64()), ("h", pa.int64()), ("key", pa.int64()), ("known", pa.bool_())])


def _prefix_rows(buffer: int):
    """Step 1 in a task: the prefixes of each text. ``known`` marks those that two texts of this task share.

    Of these only one row travels by its hash, for the other tasks; the rest is dealt by text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def settle() -> pa.RecordBatch:
            h, key = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((key, h))
            h, key = h[order].view(np.int64), key[order]
            once = np.ones(len(h), dtype=bool)  # copies of a text say the same
            once[1:] = (h[1:] != h[:-1]) | (key[1:] != key[:-1])
            h, key = h[once], key[once]
            leads = _leads(h)
            size_of = np.diff(np.append(np.flatnonzero(leads), len(h)))
            known = np.repeat(size_of > 1, size_of)
            aside = known & ~leads
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.where(aside, key, h), h, key, known)], schema=_PREFIXES)

        for batch in C.arrow_steps(batches):
            for key, text in zip(batch.column("key").to_pylist(), _texts(batch), strict=True):
                words = (text or b"").split()
                if len(words) < WINDOW:
                    continue
                h = rolling(word_ids(words), PREFIX, 0)
                h = np.unique(h[picked(h)])
                held.append((h, np.full(len(h), key, dtype=np.int64)))
                size += len(h)
                if size >= buffer:
                    yield settle()
                    held, size = [], 0
        if held:
            yield settle()

    return run


def _shared_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1 over all tasks: rows sorted by hash and text; gives key and h of prefixes in two texts.

    A run waits as long as it has one text, so what waits is from one text.
    """
    out = pa.schema([("key", pa.int64()), ("h", pa.int64())])
    wait = [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)]
    open_hash = None  # of a run that goes on and is known to be shared
    for part in batches:
        h, key, known = (part.column(c).to_numpy(zero_copy_only=False) for c in ("h", "key", "known"))
        h, key = (np.concatenate(x) for x in zip(wait, (h, key), strict=True))
        known = np.concatenate([np.zeros(len(h) - len(known), dtype=bool), known])
        if not len(h):
            continue
        starts = np.flatnonzero(_leads(h))
        ends = np.append(starts[1:], len(h)) - 1
        shared = (key[starts] != key[ends]) | np.logical_or.reduceat(known, starts)
        if open_hash is not None and h[0] == open_hash:
            shared[0] = True
        keep = np.repeat(shared, ends - starts + 1)
        open_hash = h[-1] if shared[-1] else None
        rest = slice(len(h) if shared[-1] else starts[-1], len(h))
        wait = [h[rest], key[rest]]
        yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(h[keep])], schema=out)


TREE, NODE, SETTLED = 0, 1, 2
#: k deals the row out; doc is the number of the document; words are those of n windows from start on. places are
#: runs of words, as pairs of int32, for all windows of a document below one node; none if it is the window itself.
_SUFFIXES = pa.schema(
    [("k", pa.int64()), ("k2", pa.int64()), ("kind", pa.int8()), ("doc", pa.int64()), ("key", pa.int64()), ("more", pa.int64())]
    + [("start", pa.int32()), ("n", pa.int32()), ("words", pa.binary()), ("places", pa.binary())]
)


def _packed(starts: np.ndarray, stops: np.ndarray) -> bytes:
    return np.stack([starts, stops], 1).astype(np.int32).tobytes()


def _settled(rank: np.ndarray, doc: np.ndarray, text: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes by node, document, text and place, and in that order whether a node has a lesser document."""
    order = np.lexsort((start, text, doc, rank))
    by_doc = doc[order]
    return order, by_doc > by_doc[_runs(rank[order])]


class _Buffer:
    """Texts of a task, about ``BUFFER`` words of theirs that lie in windows under shared prefixes."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.names: list[tuple[int, int, int]] = []  # doc, key, more
        self.seen: set[tuple[int, int]] = set()
        self.words: list[list[bytes]] = []
        self.ids: list[np.ndarray] = []
        self.windows: list[tuple[np.ndarray, ...]] = []  # text, start, place among the held words, prefix hash, place of the prefix, whether it is long
        self.size = 0

    def add(self, name: tuple[int, int, int], text: bytes, shared: list[int], long: list[int]) -> None:
        words = text.split()
        if len(words) < WINDOW or name[1:] in self.seen:
            return
        ids = word_ids(words)
        h = rolling(ids, PREFIX, 0)
        at = picked(h)
        start = np.flatnonzero(np.isin(h[at].view(np.int64), np.array(shared, dtype=np.int64)))
        if not len(start):
            return
        cover = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + WINDOW, -1)
        cover = np.cumsum(cover[:-1]) > 0
        place = (np.cumsum(cover) - 1)[start]
        held = np.flatnonzero(cover).tolist()
        prefix = h[at[start]].view(np.int64)
        self.seen.add(name[1:])
        self.windows.append((np.full(len(start), len(self.names)), start, place + self.size, prefix, at[start], np.isin(prefix, np.array(long, dtype=np.int64))))
        self.names.append(name)
        self.words.append([words[i] for i in held])
        self.ids.append(ids[cover])
        self.size += len(held)

    def rows(self) -> pa.RecordBatch:
        """The suffixes that go on, and runs of words that are settled."""
        text, start, place, prefix, at, long = (np.concatenate(x) for x in zip(*self.windows, strict=True))
        names = np.array(self.names, dtype=np.int64)
        rank = ranks(_numbered(self.words))[place]
        order, later = _settled(rank, names[text, 0], text, start)
        out: dict[str, list] = {f.name: [] for f in _SUFFIXES}

        def put(k, k2, kind, t, start, n, words, places) -> None:
            for name, value in zip(out, (k, k2, kind, *self.names[t], start, n, words, places), strict=True):
                out[name].append(value)

        cut = order[later]
        cut_text, cut_start, cut_stop = _merged(text[cut], start[cut], start[cut] + WINDOW)
        for a, b in _spans(_leads(cut_text)):
            t = int(cut_text[a])
            put(self.names[t][1], 0, SETTLED, t, 0, 0, None, _packed(cut_start[a:b], cut_stop[a:b]))

        # Of the windows of a text below one node the first stands for all.
        kept = order[~later]
        first = np.flatnonzero(_leads(rank[kept], text[kept]))
        count = np.diff(np.append(first, len(kept)))
        rep = kept[first]
        places: dict[int, bytes] = {}
        for i in np.flatnonzero(count > 1).tolist():
            all_of = kept[first[i] : first[i] + count[i]]
            _, a, b = _merged(np.zeros(len(all_of), dtype=np.int64), start[all_of], start[all_of] + WINDOW)
            places[int(rep[i])] = _packed(a, b)

        hot = long[rep]
        offsets = np.cumsum([0, *map(len, self.words)])
        whole: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w in rep[hot].tolist():
            t = int(text[w])
            if t not in whole:
                whole[t] = (rolling(self.ids[t], WINDOW, 1).view(np.int64), rolling(self.ids[t], WINDOW, 2).view(np.int64))
            i = int(place[w] - offsets[t])
            put(whole[t][0][i], whole[t][1][i], NODE, t, start[w], 1, b" ".join(self.words[t][i : i + WINDOW]), places.get(w))

        cold = np.sort(rep[~hot])  # by text and start
        single = np.isin(cold, list(places)) if places else np.zeros(len(cold), dtype=bool)
        new = np.ones(len(cold), dtype=bool)
        new[1:] = (text[cold][1:] != text[cold][:-1]) | (start[cold][1:] != start[cold][:-1] + 1) | (at[cold][1:] != at[cold][:-1]) | single[1:] | single[:-1]
        for a, b in _spans(new):
            w, t = int(cold[a]), int(text[cold[a]])
            i = int(place[w] - offsets[t])
            put(prefix[w], 0, TREE, t, start[w], b - a, b" ".join(self.words[t][i : i + b - a + WINDOW - 1]), places.get(w))
        return pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in _SUFFIXES], schema=_SUFFIXES)


def _suffix_rows(buffer: int):
    """Step 2 in a task; the column long has the prefixes of a text that are lengthened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Buffer()
        for batch in C.arrow_steps(batches):
            columns = [batch.column(c).to_pylist() for c in ("doc", "key", "more", "shared", "long")]
            for doc, key, more, shared, long, text in zip(*columns, _texts(batch), strict=True):
                held.add((doc, key, more), text or b"", shared, long)
                if held.size >= buffer:
                    yield held.rows()
                    held.clear()
        if held.names:
            yield held.rows()

    return run


_CUTS = pa.schema([("key", pa.int64()), ("more", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])


def _cut_rows(key: np.ndarray, more: np.ndarray, text: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    """``text`` indexes key and more."""
    text, start, stop = _merged(text, start.astype(np.int64), stop.astype(np.int64))
    columns = (key[text], more[text], start.astype(np.int32), stop.astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_CUTS)


def _unpacked(places: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the entry, start and stop of every run."""
    runs = [np.frombuffer(p, dtype=np.int32).reshape(-1, 2) for p in places]
    flat = np.concatenate([*runs, np.zeros((0, 2), dtype=np.int32)])
    return np.repeat(np.arange(len(runs)), [len(r) for r in runs]), flat[:, 0], flat[:, 1]


def _tree_cuts(rows: dict[str, list]) -> pa.RecordBatch:
    """Step 3: cuts of whole groups, from rows of kind ``TREE``."""
    n = np.array(rows["n"], dtype=np.int64)
    words = [w.split() for w in rows["words"]]
    offset = np.cumsum([0, *map(len, words)])[:-1]
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    rank = ranks(_numbered(words))[offset[row] + step]
    doc, start = np.array(rows["doc"], dtype=np.int64), np.array(rows["start"], dtype=np.int64)
    order, later = _settled(rank, doc[row], row, step)
    cut = order[later]
    has = np.array([p is not None for p in rows["places"]], dtype=bool)
    plain, listed = cut[~has[row[cut]]], row[cut[has[row[cut]]]]
    index, a, b = _unpacked([rows["places"][i] for i in listed.tolist()])
    begin = start[row[plain]] + step[plain]
    text = np.concatenate([row[plain], listed[index]])
    return _cut_rows(np.array(rows["key"], dtype=np.int64), np.array(rows["more"], dtype=np.int64), text, np.concatenate([begin, a]), np.concatenate([begin + WINDOW, b]))


def _cuts(buffer: int):
    """Step 3 over all tasks: rows sorted by group, node and document; gives runs of words to cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("k", "doc", "key", "more", "start", "n", "words", "places")
        held: dict[str, list] = {c: [] for c in names}
        size = 0
        node, least = None, {}  # the window that a run of rows shares by hash, and the least document by words
        for part in batches:
            kind = part.column("kind").to_numpy(zero_copy_only=False)
            done = part.filter(pa.array(kind == SETTLED))
            if done.num_rows:
                index, a, b = _unpacked(done.column("places").to_pylist())
                key, more = (done.column(c).to_numpy(zero_copy_only=False) for c in ("key", "more"))
                yield _cut_rows(key, more, index, a, b)
            single = part.filter(pa.array(kind == NODE))
            if single.num_rows:
                k, k2, doc, key, more, start = (single.column(c).to_numpy(zero_copy_only=False) for c in ("k", "k2", "doc", "key", "more", "start"))
                cut = []
                for i, (own, d, words) in enumerate(zip(zip(k.tolist(), k2.tolist(), strict=True), doc.tolist(), single.column("words").to_pylist(), strict=True)):
                    if own != node:
                        node, least = own, {}
                    if d > least.setdefault(words, d):
                        cut.append(i)
                cut = np.array(cut, dtype=np.int64)
                places = [p if p is not None else _packed(start[i : i + 1], start[i : i + 1] + WINDOW) for i, p in zip(cut.tolist(), single.column("places").take(pa.array(cut)).to_pylist(), strict=True)]
                index, a, b = _unpacked(places)
                yield _cut_rows(key, more, cut[index], a, b)
            tree = part.filter(pa.array(kind == TREE))
            if not tree.num_rows:
                continue
            more_rows = {c: tree.column(c).to_pylist() for c in names}
            if size >= buffer and more_rows["k"][0] != held["k"][-1]:
                yield _tree_cuts(held)
                held, size = {c: [] for c in names}, 0
            # Groups are whole up to the last change of k; what is after it waits for the next rows.
            for c in names:
                held[c] += more_rows[c]
            size += sum(more_rows["n"]) + (WINDOW - 1) * tree.num_rows
            if size >= buffer and held["k"][0] != (last := held["k"][-1]):
                at = next(i for i in range(len(held["k"]) - 1, -1, -1) if held["k"][i] != last) + 1
                yield _tree_cuts({c: v[:at] for c, v in held.items()})
                held = {c: v[at:] for c, v in held.items()}
                size = sum(held["n"]) + (WINDOW - 1) * len(held["n"])
        if held["k"]:
            yield _tree_cuts(held)

    return run


def _numbers(least: DataFrame) -> DataFrame:
    """Adds doc, a whole number in the order of the ids: the id itself, or its place among all ids by a range sort."""
    if isinstance(least.schema["least"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return least.withColumn("doc", F.col("least").cast("long"))
    order = least.select(F.col("least").alias("of_id")).distinct().orderBy("of_id").withColumn("doc", F.monotonically_increasing_id())
    return least.join(order, F.col("least") == F.col("of_id")).drop("of_id")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, and key and more, which stand for the text."""
    text = F.col("text")
    return C.id_and_text(docs, id_col, text_col).select("doc_id", "text", F.xxhash64(text).alias("key"), F.xxhash64(F.lit(9), text).alias("more"))


def _joined(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and at, the runs of words to cut (null: none; they may overlap, the run to ``ALL`` stands for a whole copy)."""
    scratch = C.Scratch(docs.sparkSession)
    texts = _keyed(docs, id_col, text_col)
    known = texts.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    prefixes = known.select("text", "key").mapInArrow(_prefix_rows(BUFFER), C.spark_schema(_PREFIXES))
    prefixes = prefixes.repartition("k").sortWithinPartitions("h", "key").select("h", "key", "known")
    shared = scratch.keep(prefixes.mapInArrow(_shared_prefixes, "key long, h long"), "prefixes")
    long = scratch.keep(shared.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUP).select(F.col("h").alias("long")), "long")

    least = known.groupBy("key", "more").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    by_text = shared.join(long, F.col("h") == F.col("long"), "left").groupBy("key").agg(F.collect_set("h").alias("shared"), F.collect_set("long").alias("long"))
    wanted = _numbers(least.drop("most").join(by_text, "key")).select(F.col("key").alias("of_key"), F.col("more").alias("of_more"), "least", "doc", "shared", "long")
    wanted = scratch.keep(wanted, "wanted")
    few = _is_small(wanted, "shared")

    def on_text(left: DataFrame, right: DataFrame, near: bool, how: str, *also) -> DataFrame:
        same = (F.col("key") == F.col("of_key")) & (F.col("more") == F.col("of_more"))
        for c in also:
            same = same & c
        return left.join(F.broadcast(right) if near else right.hint("merge"), same, how)

    found = on_text(texts, wanted, few, "inner", F.col("doc_id").eqNullSafe(F.col("least"))).select("doc", "key", "more", "text", "shared", "long")
    found = found if few else found.sortWithinPartitions("key", "more")
    rows = found.mapInArrow(_suffix_rows(BUFFER), C.spark_schema(_SUFFIXES))
    rows = rows.repartition("k").sortWithinPartitions("k", "kind", "k2", "doc", "key", "start")
    cuts = rows.mapInArrow(_cuts(BUFFER), C.spark_schema(_CUTS)).groupBy("key", "more").agg(F.collect_list(F.struct("start", "stop")).alias("at"))
    info = least.join(cuts, ["key", "more"], "left").filter(F.col("at").isNotNull() | (F.col("most") > F.col("least")))
    info = info.select(F.col("key").alias("of_key"), F.col("more").alias("of_more"), "least", "at")
    if few:
        info = scratch.keep(info, "cuts")
        few = _is_small(info, "at")
    out = on_text(texts, info, few, "left")
    copy = F.array(F.struct(F.lit(0).alias("start"), F.lit(ALL).alias("stop")))
    return out.select("doc_id", "text", F.when(F.col("doc_id") > F.col("least"), copy).when(F.col("doc_id") == F.col("least"), F.col("at")).alias("at"))


def _is_small(table: DataFrame, items: str) -> bool:
    n, of = table.agg(F.count(F.lit(1)), F.sum(F.size(F.coalesce(items, F.array())))).first()
    return n <= BROADCAST_ROWS and (of or 0) <= BROADCAST_ITEMS


def kept_words(words: list[bytes], at: list[dict] | None) -> list[bytes]:
    if not at:
        return words
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for run in at:
        if run["stop"] == ALL and len(words) >= WINDOW:
            return []
        if run["stop"] <= len(words):
            gone[run["start"]] += 1
            gone[run["stop"]] -= 1
    return [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text of every row, with the repeated words gone and the others joined by one space."""
    schema = C.arrow_schema(C.id_type(docs, id_col), text=pa.string())
    row = lambda t, at: (b" ".join(kept_words(t.split(), at)).decode(),)
    return _joined(docs, id_col, text_col).mapInArrow(C.map_rows(row, schema, ("at",), as_bytes=True), C.spark_schema(schema))


def substring_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns: doc_id, n_words, n_removed and kept_sha256 of every row."""
    schema = C.arrow_schema(C.id_type(docs, id_col), n_words=pa.int64(), n_removed=pa.int64(), kept_sha256=pa.string())

    def row(text: bytes, at: list[dict] | None) -> tuple:
        words = text.split()
        kept = kept_words(words, at)
        return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    return _joined(docs, id_col, text_col).mapInArrow(C.map_rows(row, schema, ("at",), as_bytes=True), C.spark_schema(schema))
