"""Exact n-gram Jaccard self-join of texts, as linked components.

A text's set is its distinct word n-gram hashes. Two sets link when
100 * |A & B| >= percent * |A | B|.

1. One pass measures every text: set size, set id (a hash of the whole set: equal
   sets are one node from here on), a parity bitmap of the set, and a bounded
   summary of frequent n-grams of each task (a mergeable heavy-hitter summary
   over all texts). The most frequent ones come last in the global order;
   the order changes speed, never results.
2. A second pass emits each distinct set's prefix: two sets that link share an
   n-gram of their prefixes. Index lists are shuffled by n-gram; singletons end there.
3. Set relations. In each list a set is paired with the list's leader of similar size
   and with its neighbour only (linear). Each set tests the pair that met in most lists, then
   in a few rounds each class tests its most promising pair to another class;
   verified links make larger classes of highly similar sets.
4. Between classes, lists are scanned by block: a block of entries is skipped
   when its sizes or positions rule out enough overlap. In long lists a set's answers
   are derived from its class pivot's: the pivot's bitmap distances, corrected by
   the set's own distance from the pivot, exclude most entries without comparing them.
   Pairs inside a class are never formed.
5. Candidates are thinned by the parity bitmaps (|A ^ B| is at least the number of
   differing bits: exact exclusion). Where several sets of a class are to be compared with the same other
   set, the class pivot's answer is computed first: its overlap with the other set, corrected by what each member lacks of the
   pivot or has besides it, decides most members without their sets. What stays open is verified on the full sets. Connected
   components of all links are the result.

No candidate is dropped by a cap. Full sets are moved only for pairs
that the bitmaps leave open.

Edge cases: a null or empty text has an empty set and is linked with nothing. A
text with fewer words than n has its whole sequence as its one n-gram. Rows that repeat a key
are separate members; rows with a null key take part, and a component of
such rows only has a null component_id. Empty tables give empty results.
Other columns are not looked at. Set ids are 64-bit hashes of the sorted set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import connected_components
from tessera.llm.shared import BROADCAST_KEYS, Scratch, join_hot, semi_by_key
from tessera.llm.textkernel import column_bytes, distinct_sorted, mix64, shingles, slices, tidied, word_hashes, words

#: Entries of a task's heavy-hitter summary while it runs, and rows it hands on.
SUMMARY = 200_000
SUMMARY_OUT = 20_000
#: Most n-grams in the "last in order" table: 512 KB.
FREQUENT = 65_536
#: Document frequency from which an n-gram counts as frequent.
FREQUENT_FROM = 30
#: Lists from this length on are scanned by block with bitmaps.
LONG_LIST = 64
BLOCK = 64
#: Pivots of one list whose answers are held at a time.
ANSWERS = 256
#: From so many members on, a class is compared with another set by its pivot's answer.
DERIVE_FROM = 3
#: Rounds of growing classes of similar sets before classes are compared in full.
ROUNDS = 3
#: Bits of a parity bitmap per n-gram, rounded up to a power of two.
BITS_PER_GRAM = 4


def text_sets(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes (ascending) of each text, and where each set begins."""
    starts, ends, first = words(data, offsets)
    grams, begin = shingles(word_hashes(data, starts, ends, lower=True), first, n)
    return distinct_sorted(grams, begin)


def set_ids(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """One 64-bit id of each set (order-free: a mixed sum and the size)."""
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(values ^ np.uint64(0x5851F42D4C957F2D)))])
    size = np.diff(begin).astype(np.uint64)
    return mix64(run[begin[1:]] - run[begin[:-1]] + size * np.uint64(0x2545F4914F6CDD1D)).view(np.int64)


def parity_bitmap(values: np.ndarray) -> bytes:
    """Bit i is the parity of the n-grams that hash to i; a power of two of bits, at least 64."""
    bits = 64
    while bits < BITS_PER_GRAM * len(values):
        bits *= 2
    counts = np.bincount((values >> np.uint64(17)).astype(np.int64) & (bits - 1), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(bitmap: np.ndarray, size: int) -> np.ndarray:
    """The bitmap (uint64 words, last axis) as one of ``size`` words."""
    while bitmap.shape[-1] > size:
        half = bitmap.shape[-1] // 2
        bitmap = bitmap[..., :half] ^ bitmap[..., half:]
    return bitmap


class Frequent:
    """A mergeable summary of frequent values (Misra-Gries): bounded, lower-bound counts."""

    def __init__(self) -> None:
        self.values, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, values: np.ndarray) -> None:
        self.held.append(values)
        self.size += len(values)
        if self.size > 1_000_000:
            self.merge()

    def merge(self) -> None:
        if not self.held:
            return
        v, c = np.unique(np.concatenate(self.held), return_counts=True)
        self.held, self.size = [], 0
        both = np.concatenate([self.values, v])
        values, back = np.unique(both, return_inverse=True)
        counts = np.bincount(back, np.concatenate([self.counts, c]), minlength=len(values)).astype(np.int64)
        if len(values) > SUMMARY:
            counts -= np.partition(counts, len(counts) - SUMMARY)[len(counts) - SUMMARY]
            values, counts = values[counts > 0], counts[counts > 0]
        self.values, self.counts = values, counts

    def top(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        at = np.flatnonzero(self.counts >= 2)
        at = at[np.argsort(-self.counts[at], kind="stable")[:SUMMARY_OUT]]
        return self.values[at], self.counts[at]


def _batches(batch: pa.RecordBatch, column: int, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = column_bytes(batch.column(column))
    for lo, hi in slices(offsets):
        o = offsets[lo : hi + 1]
        yield lo, hi, *text_sets(data[o[0] : o[-1]], o - o[0], n)


def measure(docs: DataFrame, n: int) -> DataFrame:
    """Rows of three kinds. 0: key, n, sid of each text. 1: sid, n, bitmap of each set (once a task). 2: frequent n-grams of a task."""
    kind = docs.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, seen, key_type = Frequent(), set(), None
        names = ["kind", "key", "n", "sid", "bitmap", "gram", "c"]
        for batch in batches:
            key_type = batch.schema.field(0).type
            for lo, hi, values, begin in _batches(batch, 0 + 1, n):
                sizes, ids, m = np.diff(begin), set_ids(values, begin), hi - lo
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(m, np.int32)), batch.column(0).slice(lo, m), pa.array(sizes.astype(np.int32)), pa.array(ids, mask=sizes == 0), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], names
                )
                fresh = []
                for i in np.flatnonzero(sizes):
                    if ids[i] not in seen:
                        seen.add(ids[i])
                        fresh.append(i)
                if len(seen) > 500_000:
                    seen.clear()
                m = len(fresh)
                if m:
                    frequent.add(np.concatenate([values[begin[i] : begin[i + 1]] for i in fresh]))
                    maps = pa.array([parity_bitmap(values[begin[i] : begin[i + 1]]) for i in fresh], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.nulls(m, key_type), pa.array(sizes[fresh].astype(np.int32)), pa.array(ids[fresh]), maps, pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], names)
        grams, counts = frequent.top()
        if len(grams):
            m = len(grams)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, 2, np.int32)), pa.nulls(m, key_type), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(grams.view(np.int64)), pa.array(counts)], names)

    return docs.mapInArrow(tidied(run), f"kind int, key {kind.simpleString()}, n int, sid bigint, bitmap binary, gram bigint, c bigint")


def prefixes(docs: DataFrame, n: int, percent: int, last: np.ndarray) -> DataFrame:
    """gram, sid, n, pos of the prefix entries of each distinct set (once a task). ``last``: sorted frequent n-grams."""
    order = docs.sparkSession.sparkContext.broadcast(last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, seen = order.value, set()
        for batch in batches:
            for _, _, values, begin in _batches(batch, 0, n):
                sizes, ids = np.diff(begin), set_ids(values, begin)
                keep = np.zeros(len(sizes), dtype=bool)
                for i in np.flatnonzero(sizes):
                    if ids[i] not in seen:
                        seen.add(ids[i])
                        keep[i] = True
                if len(seen) > 500_000:
                    seen.clear()
                owner = np.repeat(np.arange(len(sizes)), sizes)
                use = keep[owner]
                v, o = values[use], owner[use]
                if not len(v):
                    continue
                frequent = np.zeros(len(v), dtype=bool)
                if len(late):
                    at = np.minimum(np.searchsorted(late, v), len(late) - 1)
                    frequent = late[at] == v
                by = np.lexsort((frequent, o))  # stable: hashes stay ascending
                v, o = v[by], o[by]
                pos = np.arange(len(v)) - np.searchsorted(o, np.arange(len(sizes)))[o]
                length = sizes - -(-sizes * percent // 100) + 1
                front = pos < length[o]
                v, o, pos = v[front], o[front], pos[front]
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(ids[o]), pa.array(sizes[o].astype(np.int32)), pa.array(pos.astype(np.int32))], ["gram", "sid", "n", "pos"])

    return docs.select("text").mapInArrow(tidied(run), "gram bigint, sid bigint, n int, pos int")


def _need(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of linked sets of these sizes."""
    return -(-percent * (a + b) // (100 + percent))


def _open(n1, p1, n2, p2, percent: int):
    """Whether sets that share their first common n-gram at these positions may link."""
    return (1 + np.minimum(n1 - p1, n2 - p2) - 1 >= _need(n1, n2, percent)) & (np.minimum(n1, n2) * 100 >= percent * np.maximum(n1, n2))


def _table(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got).combine_chunks() if got else None


def _pair_batch(a: list[np.ndarray], b: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if a:
        x, y = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
        for at in range(0, len(pairs), 100_000):
            p = pairs[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], ["a", "b"])


def index_lists(rows: DataFrame, percent: int) -> DataFrame:
    """Two kinds of rows from one shuffle by n-gram.

    0: gram, sid, n, pos, size: entries of lists with at least two sets, one per (n-gram, set).
    1: sid, other, c: how many lists of the task pair the set with ``other``, its list's leader of
    similar size or its neighbour there; linear in the entries.
    """
    names = ["kind", "gram", "sid", "n", "pos", "size", "other", "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _table(batches)
        if t is None:
            return
        gram, sid, n, pos = (t[c].to_numpy() for c in ("gram", "sid", "n", "pos"))
        order = np.lexsort((sid, n, gram))
        gram, sid, n, pos = gram[order], sid[order], n[order], pos[order]
        keep = np.ones(len(gram), dtype=bool)
        keep[1:] = (gram[1:] != gram[:-1]) | (sid[1:] != sid[:-1])
        gram, sid, n, pos = gram[keep], sid[keep], n[keep], pos[keep]
        edge = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        length = np.diff(np.append(edge, len(gram)))
        size = np.repeat(length, length)
        at = np.flatnonzero(size >= 2)
        gram, sid, n, pos, size = gram[at], sid[at], n[at], pos[at], size[at]
        for lo in range(0, len(at), 100_000):
            i = slice(lo, lo + 100_000)
            m = len(gram[i])
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), pa.array(gram[i]), pa.array(sid[i]), pa.array(n[i]), pa.array(pos[i]), pa.array(size[i].astype(np.int32)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32())], names)
        if not len(at):
            return
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        step = np.floor(np.log(n) / np.log(100 / percent)).astype(np.int64)
        new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (step[1:] != step[:-1])])
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        me = np.arange(len(gram))
        pairs = []
        for other, ok in ((lead, lead != me), (np.maximum(me - 1, 0), np.concatenate([[False], gram[1:] == gram[:-1]]))):
            i = np.flatnonzero(ok)
            i = i[_open(n[i], pos[i], n[other[i]], pos[other[i]], percent)]
            pairs.append(np.stack([sid[i], sid[other[i]]], axis=1))
        both, count = np.unique(np.concatenate(pairs), axis=0, return_counts=True)
        for lo in range(0, len(both), 100_000):
            p, c = both[lo : lo + 100_000], count[lo : lo + 100_000]
            m = len(p)
            none = [pa.nulls(m, k) for k in (pa.int32(), pa.int32(), pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.nulls(m, pa.int64()), pa.array(p[:, 0].copy()), *none, pa.array(p[:, 1].copy()), pa.array(c.astype(np.int32))], names)

    return rows.repartition("gram").mapInArrow(tidied(run), "kind int, gram bigint, sid bigint, n int, pos int, size int, other bigint, c int")


def paired(counted: DataFrame) -> DataFrame:
    """a, b, c: in how many lists a set met another as its leader or neighbour; linear in the entries."""
    ends = counted.select(F.least("sid", "other").alias("a"), F.greatest("sid", "other").alias("b"), "c")
    return ends.groupBy("a", "b").agg(F.sum("c").alias("c"))


def leader_pairs(pairs: DataFrame) -> DataFrame:
    """a, b: for each set the pair that met in most lists, and the one with the smallest id (a hub that many sets choose)."""
    both = pairs.select(F.col("a").alias("sid"), F.col("b").alias("o"), "c").unionByName(pairs.select(F.col("b").alias("sid"), F.col("a").alias("o"), "c"))
    best = both.groupBy("sid").agg(F.max_by("o", F.struct("c", "o")).alias("o1"), F.min("o").alias("o2"))
    ends = best.select("sid", F.explode(F.array("o1", "o2")).alias("o"))
    return ends.select(F.least("sid", "o").alias("a"), F.greatest("sid", "o").alias("b")).distinct()


def in_classes(entries: DataFrame, classes: DataFrame, few: bool) -> DataFrame:
    """entries with comp, the set's class. Few classes are broadcast and the lists stay where they were written; else lists are shuffled anew."""
    out = entries.join(F.broadcast(classes) if few else classes, "sid", "left").withColumn("comp", F.coalesce("component", "sid")).drop("component")
    return out if few else out.repartition("gram")


def _long_list(n, pos, comp, maps: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(entry, open partners of other classes, how far each is inside the bound) in one long list, sorted by size. Scans block by block."""
    m = len(n)
    words_of = np.array([len(x) for x in maps])
    heads = np.arange(0, m, BLOCK)
    least_n = n[heads]
    most_rest = np.array([(n[h : h + BLOCK] - pos[h : h + BLOCK]).max() for h in heads])
    _, pivot = np.unique(comp, return_index=True)
    pivot_of = dict(zip(comp[pivot].tolist(), pivot.tolist()))
    folded: dict[int, np.ndarray] = {}

    def at_size(w: int) -> np.ndarray:
        if w not in folded:
            out = np.zeros((m, w), np.uint64)
            for i in np.flatnonzero(words_of >= w):
                out[i] = fold(maps[i], w)
            folded[w] = out
        return folded[w]

    answers: dict[tuple[int, int], np.ndarray] = {}
    for i in range(m - 1):
        reach = int(np.searchsorted(n, n[i] * 100 / percent, side="right"))
        blocks = np.flatnonzero((heads < reach) & (heads + BLOCK > i + 1) & (np.minimum(n[i] - pos[i], most_rest) >= _need(n[i], least_n, percent)))
        if not len(blocks):
            continue
        j = (heads[blocks][:, None] + np.arange(BLOCK)).ravel()
        j = j[(j > i) & (j < reach)]
        j = j[(comp[j] != comp[i]) & _open(n[i], pos[i], n[j], pos[j], percent)]
        if not len(j):
            continue
        w = int(words_of[i])  # sizes ascend, so the others' bitmaps are as wide or wider
        table = at_size(w)
        allowed = (100 - percent) * (n[i] + n[j]) // (100 + percent)
        p = pivot_of[int(comp[i])]
        if p != i and words_of[p] >= w:
            if (p, w) not in answers:
                if len(answers) >= ANSWERS:
                    answers.clear()
                answers[p, w] = np.bitwise_count(table ^ table[p]).sum(1).astype(np.int64)
            far = answers[p, w]
            keep = far[j] - far[i] <= allowed  # triangle inequality on differing bits
            j, allowed = j[keep], allowed[keep]
        if len(j):
            margin = allowed - np.bitwise_count(table[j] ^ table[i]).sum(1)
            keep = margin >= 0
            if keep.any():
                yield i, j[keep], margin[keep]


def _sorted(t: pa.Table) -> tuple[np.ndarray, ...]:
    gram, sid, n, pos, comp = (t[c].to_numpy() for c in ("gram", "sid", "n", "pos", "comp"))
    order = np.lexsort((sid, n, gram))
    return order, gram[order], sid[order], n[order].astype(np.int64), pos[order].astype(np.int64), comp[order]


def short_list_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Open pairs between different classes in lists below ``LONG_LIST``: all lists of a task at once, one shift at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _table(batches)
        if t is None:
            return
        _, gram, sid, n, pos, comp = _sorted(t)
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        i = np.arange(len(gram))
        for shift in range(1, LONG_LIST):
            i = i[i + shift < len(gram)]
            i = i[(gram[i + shift] == gram[i]) & (n[i + shift] * percent <= n[i] * 100)]
            if not len(i):
                break
            j = i + shift
            k = np.flatnonzero((comp[i] != comp[j]) & _open(n[i], pos[i], n[j], pos[j], percent))
            a.append(sid[i[k]])
            b.append(sid[j[k]])
        yield from _pair_batch(a, b)

    return entries.mapInArrow(tidied(run), "a bigint, b bigint").distinct()


def _each_long_list(t: pa.Table, percent: int):
    """(set ids, classes, entry, partners, margins) over the long lists of a task."""
    order, gram, sid, n, pos, comp = _sorted(t)
    maps = t["bitmap"].combine_chunks()
    cuts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1], [True]]))
    for lo, hi in zip(cuts, cuts[1:]):
        c = comp[lo:hi]
        if (c == c[0]).all():
            continue
        bits = [np.frombuffer(maps[int(x)].as_py(), "<u8") for x in order[lo:hi]]
        for i, j, margin in _long_list(n[lo:hi], pos[lo:hi], c, bits, percent):
            yield sid[lo:hi], c, i, j, margin


def long_list_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Open pairs between different classes in long lists (entries carry bitmaps)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _table(batches)
        if t is None:
            return
        a, b = [], []
        for sid, _, i, j, _ in _each_long_list(t, percent):
            a.append(np.full(len(j), sid[i]))
            b.append(sid[j])
        yield from _pair_batch(a, b)

    return entries.mapInArrow(tidied(run), "a bigint, b bigint").distinct()


def best_class_pairs(entries: DataFrame, percent: int, tested: DataFrame) -> DataFrame:
    """a, b: for each class its most promising open pair to another class in long lists. One row per class and task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _table(batches)
        if t is None:
            return
        best: dict[int, tuple[int, int, int]] = {}
        for sid, comp, i, j, margin in _each_long_list(t, percent):
            for k in (int(margin.argmax()), 0):
                a, b = int(sid[i]), int(sid[j[k]])
                found = (int(margin[k]), min(a, b), max(a, b))
                for c in (int(comp[i]), int(comp[j[k]])):
                    if c not in best or found > best[c]:
                        best[c] = found
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), *[pa.array([x[k] for x in best.values()], pa.int64()) for k in range(3)]], ["cls", "margin", "a", "b"])

    found = entries.mapInArrow(tidied(run), "cls bigint, margin bigint, a bigint, b bigint").join(tested, ["a", "b"], "left_anti")
    best = found.groupBy("cls").agg(F.max_by(F.struct("a", "b"), F.struct("margin", "a", "b")).alias("e"))
    return best.select("e.a", "e.b").distinct()


def thin(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that the parity bitmaps leave open. The smaller set's side is joined first."""
    one = lambda s: sets.select(F.col("sid").alias(s), F.col("n").alias(f"n_{s}"), F.col("bitmap").alias(f"bm_{s}"))
    rows = pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "n_a", "n_b", "bm_a", "bm_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5))):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                w = min(len(x), len(y))
                if int(np.bitwise_count(fold(x, w) ^ fold(y, w)).sum()) * (100 + percent) <= (100 - percent) * (int(n_a[i]) + int(n_b[i])):
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64())).select(["a", "b"])

    return rows.mapInArrow(tidied(run), "a bigint, b bigint")


def overlaps(pairs: DataFrame, docs: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """a, b, both, n_a, n_b: the overlap and the sizes of the full sets. ``keys``: sid, key of a row that holds the set."""
    ids = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    wanted = keys.join(ids, "sid").select("key").distinct()
    count = wanted.count()
    named = semi_by_key(docs, wanted.filter("key is not null"), "key", count)
    rows = named.unionByName(docs.filter("key is null"))

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, values, begin in _batches(batch, 1, n):
                sizes = np.diff(begin)
                at = np.flatnonzero(sizes)
                ids = set_ids(values, begin)[at]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([values[begin[i] : begin[i + 1]].tobytes() for i in at], pa.binary())], ["sid", "grams"])

    sets = rows.mapInArrow(tidied(full), "sid bigint, grams binary").join(ids.hint("shuffle_hash"), "sid", "left_semi").dropDuplicates(["sid"])
    side = lambda s: sets.select(F.col("sid").alias(s), F.col("grams").alias(f"g_{s}"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, last, x = [], None, None
            for a, g, h in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if a != last:
                    last, x = a, np.frombuffer(g.as_py(), np.uint64)
                y = np.frombuffer(h.as_py(), np.uint64)
                out.append((len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
            numbers = np.array(out, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(numbers[:, i].copy()) for i in range(3)]], ["a", "b", "both", "n_a", "n_b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "g_a", "g_b").mapInArrow(tidied(check), "a bigint, b bigint, both bigint, n_a bigint, n_b bigint")


def _linked(percent: int) -> Column:
    return F.col("both") * 100 >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))


def verify(pairs: DataFrame, docs: DataFrame, keys: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs whose full sets link."""
    return overlaps(pairs, docs, keys, n).filter(_linked(percent)).select("a", "b")


def verify_by_pivots(pairs: DataFrame, classes: DataFrame, docs: DataFrame, keys: DataFrame, n: int, percent: int, scratch: Scratch) -> DataFrame:
    """The same for pairs between classes (sid, component: the class's pivot), where a pivot's answers decide what they can.

    For a member S of pivot P and another set X, |S & X| lies between |P & X| - |P - S| and |P & X| + |S - P|.
    """
    pivot = lambda s: classes.filter("sid <> component").select(F.col("sid").alias(s), F.col("component").alias(f"p_{s}"))
    rows = pairs.join(pivot("a"), "a", "left").join(pivot("b"), "b", "left")
    turned = F.col("p_a").isNull()
    rows = rows.select("a", "b", F.when(turned, F.col("b")).otherwise(F.col("a")).alias("s"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("x"), F.coalesce("p_a", "p_b").alias("p"))
    many = rows.filter("p is not null").groupBy("p", "x").count().filter(F.col("count") >= DERIVE_FROM).select("p", "x")
    derived = scratch.save(rows.join(many, ["p", "x"]), "derived")
    plain_ = scratch.save(pairs.join(derived.select("a", "b"), ["a", "b"], "left_anti"), "plain")
    if not derived.take(1):
        return verify(plain_, docs, keys, n, percent)
    ordered = lambda u, v: (F.least(u, v).alias("a"), F.greatest(u, v).alias("b"))
    asked = derived.select(*ordered("p", "x")).unionByName(derived.select(*ordered("s", "p"))).unionByName(plain_).distinct()
    known = scratch.save(overlaps(asked, docs, keys, n), "known")
    answer = known.select(F.col("a").alias("p"), F.col("b").alias("x"), F.col("both").alias("p_x"), F.col("n_a").alias("n_p"), F.col("n_b").alias("n_x"))
    answer = answer.unionByName(known.select(F.col("b").alias("p"), F.col("a").alias("x"), F.col("both").alias("p_x"), F.col("n_b").alias("n_p"), F.col("n_a").alias("n_x")))
    own = answer.select(F.col("p").alias("s"), F.col("x").alias("p"), F.col("p_x").alias("s_p"), F.col("n_p").alias("n_s"))
    bounds = derived.join(answer, ["p", "x"]).join(own, ["s", "p"])
    low, high = F.col("p_x") - (F.col("n_p") - F.col("s_p")), F.col("p_x") + (F.col("n_s") - F.col("s_p"))
    links = lambda both: both * 100 >= percent * (F.col("n_s") + F.col("n_x") - both)
    decided = scratch.save(bounds.select("a", "b", F.when(links(low), True).when(~links(high), False).alias("linked")), "decided")
    rest = verify(scratch.save(decided.filter("linked is null").select("a", "b"), "rest"), docs, keys, n, percent)
    return known.join(plain_, ["a", "b"], "left_semi").filter(_linked(percent)).select("a", "b").unionByName(decided.filter("linked").select("a", "b")).unionByName(rest)


def with_set_ids(docs: DataFrame, n: int = 5, text: str = "text") -> DataFrame:
    """``docs`` with set_id, as ``jaccard_components`` names the sets; null without words."""
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [pa.array(set_ids(values, begin), mask=np.diff(begin) == 0) for _, _, values, begin in _batches(batch, at, n)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.concat_arrays(ids) if ids else pa.array([], pa.int64())], [*names, "set_id"])

    return docs.mapInArrow(tidied(run), ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], "set_id bigint"]))


def jaccard_components(docs: DataFrame, percent: int = 75, n: int = 5, key: str = "doc_id", text: str = "text", with_sets: bool = False) -> DataFrame:
    """``key``, n_shingles and component_id (smallest key of the row's component) of every row, and with ``with_sets`` its set_id."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    measured = scratch.save(measure(docs, n), "measured")
    rows = measured.filter("kind = 0").select("key", "n", "sid")
    sets = scratch.save(measured.filter("kind = 1").groupBy("sid").agg(F.first("n").alias("n"), F.first("bitmap").alias("bitmap")), "sets")
    holders = scratch.save(rows.filter("n > 0").groupBy("sid").agg(F.min("key").alias("key")), "holders")
    top = measured.filter("kind = 2").groupBy("gram").agg(F.sum("c").alias("c")).filter(F.col("c") >= FREQUENT_FROM).orderBy(F.desc("c"), "gram").limit(FREQUENT).select("gram").toArrow()
    last = np.sort(top["gram"].to_numpy().view(np.uint64)) if top.num_rows else np.zeros(0, np.uint64)
    indexed = scratch.save(index_lists(prefixes(docs, n, percent, last), percent), "indexed", whole_files=True)
    lists = indexed.filter("kind = 0").select("gram", "sid", "n", "pos", "size")
    short = lists.filter(F.col("size") < LONG_LIST)
    # lists are written once with their bitmaps; later rounds read them in place
    longer = scratch.save(lists.filter(F.col("size") >= LONG_LIST).join(sets.select("sid", "bitmap"), "sid").repartition("gram"), "long", whole_files=True)
    links = classes = tested = None
    for r in range(ROUNDS):
        few = classes is None or classes.count() <= BROADCAST_KEYS
        chosen = leader_pairs(paired(indexed.filter("kind = 1"))) if classes is None else best_class_pairs(in_classes(longer, classes, few), percent, tested)
        chosen = scratch.save(chosen, f"chosen-{r}")
        new = scratch.save(verify(scratch.save(thin(chosen, sets, percent), f"near-{r}"), docs, holders, n, percent), f"links-{r}")
        links = new if links is None else links.unionByName(new)
        tested = chosen if tested is None else tested.unionByName(chosen)
        if r and not new.take(1):
            break
        classes = scratch.save(connected_components(links, scratch, f"classes-{r}").select(F.col("node").alias("sid"), "component"), f"class-{r}")
    few = classes.count() <= BROADCAST_KEYS
    open_pairs = short_list_pairs(in_classes(short, classes, few), percent).unionByName(long_list_pairs(in_classes(longer, classes, few), percent)).distinct()
    open_pairs = scratch.save(thin(open_pairs.join(tested, ["a", "b"], "left_anti"), sets, percent), "open")
    more = scratch.save(verify_by_pivots(open_pairs, classes, docs, holders, n, percent, scratch), "links-more")
    nodes = scratch.save(connected_components(links.unionByName(more), scratch, "all").select(F.col("node").alias("sid"), "component"), "nodes")
    scratch.drop("indexed", "long", "open")
    # a component's smallest key is found among its sets, and given to rows by set: a component or set may hold a third of all rows
    least = nodes.join(holders, "sid").groupBy("component").agg(F.min("key").alias("least"))
    of_set = join_hot(nodes, least, "component", scratch, "hot-components").select("sid", "least")
    facts = holders.join(of_set, "sid", "left").select("sid", F.coalesce("least", "key").alias("least"))
    out = join_hot(rows, facts, "sid", scratch, "hot-sets")
    return out.select(F.col("key").alias(key), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("key")).alias("component_id"), *([F.col("sid").alias("set_id")] if with_sets else []))
