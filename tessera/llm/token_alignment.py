"""Alignment of two tokenizers over the same bytes.

Both tokenizers cut the text (with a space before it) into byte ranges. Tokens are the nodes of a bipartite graph, and an A
token is joined to each B token whose range overlaps its own. Union-find over those edges gives connected
components, which are exactly the smallest groups that begin and end together in both. A group's members expand to
links: all pairs of one A and one B occurrence in it.

1. One pass over the texts encodes, groups and expands. It writes a row for each text (its distinct linked id pairs with the
   times each occurs) and, already added up within the task, in how many texts each pair is linked.
2. Pair counts are summed by a shuffle of those partial counts, and an A id's highest count by another one.
3. The ``TABLE`` most frequent pairs are broadcast as sorted arrays (at most 17 MB); the written rows look their pairs
   up. Pairs beyond the table are joined by a shuffle and added to their rows; frequent pairs, which
   would be hot keys, are never among those. The table decides where a count is looked up, not what it is.

No text and no group of texts is ever in one task's hands but its own; a pass holds one slice of texts at a time.

Edge cases: a null or empty text, and one whose joined A or B bytes are not a space and the text (a tokenizer that normalises it),
has no tokens: zeros and an empty digest. Special strings in a text are plain text. Rows that repeat a key, or have none, are
texts of their own and are counted each. Empty tables give empty results. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.encoders import ByteBpe, Pieces, kept
from tessera.llm.shared import Scratch
from tessera.llm.textkernel import column_bytes, slices, tidied

#: Most pairs in the broadcast table: 17 bytes each.
TABLE = 1 << 20
#: Distinct pairs that a task adds up before it hands them on.
HELD = 1 << 21
#: Texts are encoded in slices of about so many bytes.
SLICE = 1 << 19
_SHIFT = np.int64(32)


def components(n_a: int, n_b: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over edges a[i] - b[i]: the smallest node (A tokens first) of the component of each A and of each B token.

    All edges are united at once: roots are found by pointer jumping, and the larger root of an edge is hung below the smaller one, until no edge joins two trees.
    """
    parent = np.arange(n_a + n_b)
    x, y = a, b + n_a
    while len(x):
        u, v = parent[x], parent[y]
        apart = np.flatnonzero(u != v)
        if not len(apart):
            break
        x, y, u, v = x[apart], y[apart], u[apart], v[apart]
        np.minimum.at(parent, np.maximum(u, v), np.minimum(u, v))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent[:n_a], parent[n_a:]


@dataclass
class Aligned:
    """Texts of one slice: token ids of each side, the text and the group (numbered from 0 over the slice) of each token, and the group's text."""

    a: np.ndarray
    b: np.ndarray
    text_a: np.ndarray
    text_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    group_text: np.ndarray
    end_a: np.ndarray
    end_b: np.ndarray


class Aligner:
    """Two tokenizers; kept for the life of a worker."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = kept(ByteBpe, path_a), kept(Pieces, path_b)
        self.size_a, self.size_b = (np.array([len(t) for t in e.table], np.int64) for e in (self.a, self.b))
        name = lambda n, last: [f"{i}," for i in range(n)] + [f"{i}{last}" for i in range(n)]
        self.names = np.array(name(len(self.size_a), "|") + name(len(self.size_b), ";"), object)

    def align(self, texts: list[str]) -> Aligned:
        ids_a = self.a.encode([f" {t}" if t else "" for t in texts])
        ids_b = self.b.encode(texts)
        table_a, table_b = self.a.table, self.b.table
        for i, t in enumerate(texts):
            raw = f" {t}".encode() if t else b""
            if not t or b"".join([table_a[x] for x in ids_a[i]]) != raw or b"".join([table_b[x] for x in ids_b[i]]) != raw:
                ids_a[i] = ids_b[i] = []
        n_a, n_b = np.array([len(x) for x in ids_a], np.int64), np.array([len(x) for x in ids_b], np.int64)
        a, b = (np.fromiter((i for ids in all_ids for i in ids), np.int64, n.sum()) for all_ids, n in ((ids_a, n_a), (ids_b, n_b)))
        text_a, text_b = np.repeat(np.arange(len(texts)), n_a), np.repeat(np.arange(len(texts)), n_b)
        # one byte axis for all texts: each text's tokens cover its part of it on both sides
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        cuts = np.union1d(end_a, end_b)  # between two cuts one A and one B token overlap
        root_a, root_b = components(len(a), len(b), np.searchsorted(end_a, cuts), np.searchsorted(end_b, cuts))
        roots, group_a = np.unique(root_a, return_inverse=True)
        return Aligned(a, b, text_a, text_b, group_a, np.searchsorted(roots, root_b), text_a[roots], end_a, end_b)

    def digests(self, got: Aligned, n: int) -> list[str]:
        """SHA-256 of each text's groups as ``a1,a2|b1;...``; empty without tokens."""
        last_a = np.append(got.group_a[1:] != got.group_a[:-1], True) if len(got.a) else np.zeros(0, bool)
        last_b = np.append(got.group_b[1:] != got.group_b[:-1], True) if len(got.b) else np.zeros(0, bool)
        va, vb = len(self.size_a), len(self.size_b)
        name = np.concatenate([got.a + va * last_a, 2 * va + got.b + vb * last_b])
        order = np.lexsort((np.repeat([0, 1], [len(got.a), len(got.b)]), np.concatenate([got.group_a, got.group_b])))  # stable
        words = self.names[name[order]]
        edge = np.concatenate([[0], np.cumsum(np.bincount(got.text_a, minlength=n) + np.bincount(got.text_b, minlength=n))])
        out = []
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            out.append(hashlib.sha256("".join(words[lo:hi].tolist())[:-1].encode()).hexdigest() if hi > lo else "")
        return out


def links(got: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pair, times) of the distinct linked id pairs of each text, in order. A pair is a << 32 | b.

    Equal ids of a group are counted first, so a group of many equal tokens (long runs of one character) doesn't expand to all its occurrences.
    """
    def distinct(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, n = np.unique(group << _SHIFT | ids, return_counts=True)
        return key >> _SHIFT, key & np.int64(0xFFFFFFFF), n

    (ga, a, na), (gb, b, nb) = distinct(got.group_a, got.a), distinct(got.group_b, got.b)
    begin, end = np.searchsorted(gb, ga), np.searchsorted(gb, ga, side="right")
    width = end - begin
    left = np.repeat(np.arange(len(ga)), width)
    right = np.arange(len(left)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(begin, width)
    text, pair, times = got.group_text[ga[left]], a[left] << _SHIFT | b[right], na[left] * nb[right]
    order = np.lexsort((pair, text))
    text, pair, times = text[order], pair[order], times[order]
    if not len(text):
        return text, pair, times
    new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (pair[1:] != pair[:-1])]))
    return text[new], pair[new], np.add.reduceat(times, new)


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def aligned_groups(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, first_byte, end_byte (of space and text), a_ids, b_ids of every group of every text."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _aligner(path_a, path_b)
        for batch in batches:
            _, offsets = column_bytes(batch.column(1))
            for lo, hi in slices(offsets, SLICE):
                got = both.align([t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()])
                n = len(got.group_text)
                lists = lambda ids, group: pa.ListArray.from_arrays(pa.array(np.searchsorted(group, np.arange(n + 1)).astype(np.int32)), pa.array(ids.astype(np.int32)))  # noqa: E731, B023
                last = np.searchsorted(got.group_a, np.arange(n), side="right") - 1
                end = got.end_a[last] if n else np.zeros(0, np.int64)
                first = np.concatenate([[0], end[:-1]]) if n else end
                base = first[np.searchsorted(got.group_text, got.group_text)] if n else end  # where the group's text begins
                keys = batch.column(0).take(pa.array(got.group_text + lo))
                yield pa.RecordBatch.from_arrays([keys, pa.array(first - base), pa.array(end - base), lists(got.a, got.group_a), lists(got.b, got.group_b)], [key, "first_byte", "end_byte", "a_ids", "b_ids"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(tidied(run), f"`{key}` {kind}, first_byte bigint, end_byte bigint, a_ids array<int>, b_ids array<int>")


def measure(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of two kinds. 0: a text (key, row, n_a, n_b, n_groups, n_links, digest, its pairs a, b and how often each occurs). 1: partial counts (a, b, n) of a task."""
    kind = docs.schema["key"].dataType
    names = ["kind", "key", "row", "n_a", "n_b", "n_groups", "n_links", "digest", "a", "b", "times"]
    whole = [pa.int64()] * 5

    def partial(pairs: np.ndarray, counts: np.ndarray, key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(pairs), 1 << 18):
            p, c = pairs[lo : lo + (1 << 18)], counts[lo : lo + (1 << 18)]
            one = pa.array(np.arange(len(p) + 1, dtype=np.int32))
            lists = [pa.ListArray.from_arrays(one, pa.array(x.astype(np.int32))) for x in (p >> _SHIFT, p & np.int64(0xFFFFFFFF))]
            counted = pa.ListArray.from_arrays(one, pa.array(c))
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(p), np.int32)), pa.nulls(len(p), key_type), *[pa.nulls(len(p), t) for t in whole], pa.nulls(len(p), pa.string()), *lists, counted], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, key_type = _aligner(path_a, path_b), None
        held, counts, fresh, fresh_n = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        at = TaskContext.get().partitionId() << 33

        def merge() -> None:
            nonlocal held, counts, fresh, fresh_n
            every, back = np.unique(np.concatenate([held, *fresh]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, np.ones(fresh_n)]), minlength=len(every)).astype(np.int64)
            held, fresh, fresh_n = every, [], 0

        for batch in batches:
            key_type = batch.schema.field(0).type
            _, offsets = column_bytes(batch.column(1))
            for lo, hi in slices(offsets, SLICE):
                n = hi - lo
                got = both.align([t or "" for t in batch.column(1).slice(lo, n).to_pylist()])
                text, pair, times = links(got)
                edge = pa.array(np.searchsorted(text, np.arange(n + 1)).astype(np.int32))
                per = lambda owner, weight=None: pa.array(np.bincount(owner, weight, minlength=n).astype(np.int64))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.zeros(n, np.int32)), batch.column(0).slice(lo, n), pa.array(at + np.arange(n)), per(got.text_a), per(got.text_b), per(got.group_text), per(text, times),
                        pa.array(both.digests(got, n), pa.string()), *[pa.ListArray.from_arrays(edge, pa.array(x.astype(np.int32))) for x in (pair >> _SHIFT, pair & np.int64(0xFFFFFFFF))], pa.ListArray.from_arrays(edge, pa.array(times)),
                    ],
                    names,
                )
                at += n
                fresh.append(pair)
                fresh_n += len(pair)
                if fresh_n > HELD:
                    merge()
                    if len(held) > HELD:
                        yield from partial(held, counts, key_type)
                        held, counts = held[:0], counts[:0]
        if fresh_n:
            merge()
        if len(held):
            yield from partial(held, counts, key_type)

    schema = f"kind int, key {kind.simpleString()}, row bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, digest string, a array<int>, b array<int>, times array<bigint>"
    return docs.mapInArrow(tidied(run), schema)


def pair_counts(measured: DataFrame) -> DataFrame:
    """a, b, n (texts in which the pair is linked), best (no pair of the A id has more)."""
    one = measured.filter("kind = 1").select(F.col("a")[0].alias("a"), F.col("b")[0].alias("b"), F.col("times")[0].alias("n")).groupBy("a", "b").agg(F.sum("n").alias("n"))
    top = one.groupBy("a").agg(F.max("n").alias("most"))  # at most a row for each id of a vocabulary
    return one.join(top, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def align_tokens(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", table: int = TABLE) -> DataFrame:
    """``key``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every text, as the module says."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "alignment")
    measured = scratch.save(measure(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), path_a, path_b), "measured", by="kind")
    counts = scratch.save(pair_counts(measured), "counts")
    # a frequent pair is one of the first so many; the order of equal counts is fixed
    top = counts.orderBy(F.desc("n"), "a", "b").limit(table).toArrow()
    pairs = top["a"].to_numpy().astype(np.int64) << _SHIFT | top["b"].to_numpy()
    order = np.argsort(pairs)
    known = spark.sparkContext.broadcast((pairs[order], top["n"].to_numpy()[order], top["best"].to_numpy(zero_copy_only=False)[order]))
    rare = counts.count() > table
    kind = docs.schema[key].dataType.simpleString()

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, count, best = known.value
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            size = np.diff(cols["a"].offsets.to_numpy())
            pair = cols["a"].flatten().to_numpy().astype(np.int64) << _SHIFT | cols["b"].flatten().to_numpy()
            times, owner = cols["times"].flatten().to_numpy(), np.repeat(np.arange(len(size)), size)
            at = np.minimum(np.searchsorted(frequent, pair), max(0, len(frequent) - 1))
            hit = frequent[at] == pair if len(frequent) else np.zeros(len(pair), bool)
            at, to, m = at[hit], owner[hit], times[hit]
            sums, bests = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            np.add.at(sums, to, count[at] * m)
            np.add.at(bests, to, np.where(best[at], m, 0))
            missed = np.flatnonzero(~hit)
            edge = pa.array(np.searchsorted(owner[missed], np.arange(len(size) + 1)).astype(np.int32))
            left = [pa.ListArray.from_arrays(edge, pa.array(x[missed])) for x in (pair, times)]
            yield pa.RecordBatch.from_arrays([*[cols[c] for c in ("key", "row", "n_a", "n_b", "n_groups", "n_links", "digest")], pa.array(bests), pa.array(sums), *left], ["key", "row", "n_a", "n_b", "n_groups", "n_links", "digest", "n_best", "count_sum", "pairs", "times"])

    rows = measured.filter("kind = 0").select("key", "row", "n_a", "n_b", "n_groups", "n_links", "digest", "a", "b", "times")
    rows = rows.mapInArrow(tidied(look_up), f"key {kind}, row bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, digest string, n_best bigint, count_sum bigint, pairs array<bigint>, times array<bigint>")
    if rare:
        rows = scratch.save(rows, "rows")
        seen = spark.createDataFrame([], "pair bigint") if not len(pairs) else counts.orderBy(F.desc("n"), "a", "b").limit(table).select(F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long")).alias("pair"))
        facts = counts.select(F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long")).alias("pair"), "n", "best").join(F.broadcast(seen), "pair", "left_anti")
        open_ = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("e")).select("row", F.col("e.pairs").alias("pair"), F.col("e.times").alias("m"))
        more = open_.join(facts, "pair").groupBy("row").agg(F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("k"))
        rows = rows.join(more, "row", "left").withColumn("n_best", F.col("n_best") + F.coalesce("k", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("s", F.lit(0)))
    return rows.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("digest").alias("groups_sha256"))
