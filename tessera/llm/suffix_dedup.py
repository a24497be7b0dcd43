"""Removal of long byte strings that occur more than once, anywhere in a corpus.

A byte goes if a string of ``SPAN`` bytes that covers it also starts at another place, in the same text or in another one.

1. Routing. Every window of ``SPAN`` bytes is known by its anchor, the smallest hash of the ``GRAM``-byte strings in it, so equal windows have
   equal anchors. Windows that follow each other and share an anchor are one segment (a long run of one character, or of
   a short period, is one too), cut into pieces of ``PIECE`` windows. Anchors that occur once can't repeat anything and go first.
2. Segments are summed up by their digest (128 bits of SHA-256). What occurs at least twice as a whole is covered as a whole. Anchors
   with several different segments, or with one that holds the anchor's string several times, are open: each different segment's bytes are fetched once.
3. The open segments of an anchor meet in one task, which holds at most ``INDEX_BYTES`` at a time: it sorts their suffixes by
   their first ``SPAN`` bytes, and expands intervals on the Burrows-Wheeler transform breadth first up to that length (``bwt``). What then
   has no common prefix yet shares at least ``SPAN`` bytes with its neighbour.
4. An anchor whose different segments are above ``HOT_BYTES`` together (a template with a number in it, in very many texts) is never brought
   together: its windows are counted one by one, by 128-bit hashes, in a shuffle that is summed up task by task.
5. Covered runs go back to the texts that hold the segments; each text is cut once.

Hashes route, and digests of 128 bits stand for equal segments and for windows of hot anchors; other windows are compared as bytes.

Edge cases: a null text has no bytes. Rows that repeat a key, or have none, are texts of their own, so a row that occurs twice
loses every byte of its long strings. Texts of fewer than ``SPAN`` bytes lose nothing. What is left of a text may cut a character in two, so it
is binary. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bwt import long_repeats
from tessera.llm.shared import Scratch, join_hot
from tessera.llm.textkernel import column_bytes, mix64, slices, tidied

SPAN = 400
GRAM = 32
#: Windows of a piece.
PIECE = 4_096
#: Bytes that one index holds, unless a single anchor has more; and most bytes of an anchor's segments that meet in a task.
INDEX_BYTES = 2 << 20
HOT_BYTES = 2 << 20
#: Anchors that are sent to all workers (8 bytes each); beyond that every segment is summed up instead.
BROADCAST_ANCHORS = 4_000_000
_U = np.uint64


def _eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; zeros past the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), "<u8", padded, strides=(1,))


def _running_min(x: np.ndarray, k: int) -> np.ndarray:
    """The smallest of each ``k`` numbers in a row."""
    size = 1
    while size * 2 <= k:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (k - size)], x[k - size :]) if k > size else x


def segments(data: np.ndarray, offsets: np.ndarray, span: int, gram: int, piece: int = PIECE) -> tuple[np.ndarray, ...]:
    """(text, first byte in it, windows, anchor, whether the anchor's string is in it several times) of every segment; ``gram``: a multiple of 8."""
    none = np.zeros(0, np.int64)
    if len(data) < span:
        return none, none, none, none, none.astype(bool)
    eight = _eight(data)
    m = len(data) - gram + 1
    h = np.full(m, _U(gram))
    for i in range(0, gram, 8):
        h = mix64((h ^ eight[i : m + i]) * _U(0x9E3779B97F4A7C15))
    k = span - gram + 1
    low = _running_min(h, k)
    # strings that are the smallest of some window: the largest of the minima over them is their own hash
    around = ~_running_min(~np.concatenate([np.zeros(k - 1, _U), low, np.zeros(k - 1, _U)]), k)
    chosen = np.flatnonzero(around == h)
    value = h[chosen].view(np.int64)
    low = low.view(np.int64)
    # windows that lie in one text
    edge = np.zeros(len(data) + 1, np.int8)
    inside = np.diff(offsets) >= span
    np.add.at(edge, offsets[:-1][inside], 1)
    np.add.at(edge, offsets[1:][inside] - span + 1, -1)
    good = np.cumsum(edge[: len(low)]).astype(bool)
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | ~good[:-1]
    starts = offsets[:-1][inside]
    new[starts] = True
    first = np.flatnonzero(new & good)
    last = np.flatnonzero(good & np.append(new[1:] | ~good[1:], True))
    windows = last - first + 1
    n = -(-windows // piece)
    part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = np.repeat(first, n) + part * piece
    size = np.minimum(np.repeat(windows, n) - part * piece, piece)
    owner = np.searchsorted(offsets, begin, side="right") - 1
    anchor = low[begin]
    lo, hi = np.searchsorted(chosen, begin), np.searchsorted(chosen, begin + size + k - 1)
    width = hi - lo
    mine = np.repeat(np.arange(len(begin)), width)
    at = np.arange(len(mine)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(lo, width)
    times = np.bincount(mine[value[at] == anchor[mine]], minlength=len(begin))
    return owner, begin - offsets[owner], size, anchor, times > 1


def window_hashes(data: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every window of ``span`` (at least 8) bytes, from those of its halves: lengths double, and the last step overlaps."""
    out = []
    for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        h, size = mix64(_eight(data)[: len(data) - 7] ^ _U(seed)), 8
        while size * 2 <= span:
            h = mix64(mix64(h[:-size] ^ _U(seed)) + h[size:])
            size *= 2
        if size < span:
            h = mix64(mix64(h[: len(h) - (span - size)] ^ _U(seed + size)) + h[span - size :])
        out.append(h.view(np.int64))
    return out[0], out[1]


def _walk(batch: pa.RecordBatch, column: int, span: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, tuple[np.ndarray, ...]]]:
    """(first row, bytes, offsets, segments) of slices of a batch."""
    data, offsets = column_bytes(batch.column(column))
    for lo, hi in slices(offsets):
        o = offsets[lo : hi + 1]
        part, o = data[o[0] : o[-1]], o - o[0]
        yield lo, part, o, segments(part, o, span, gram)


def repeated_anchors(texts: DataFrame, span: int, gram: int) -> DataFrame:
    """anchor of every anchor that at least two segments have, or one segment several times. A task hands on each of its anchors once, with the number of its segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            anchors, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(n)], ["anchor", "n"])

        for batch in batches:
            for _, _, _, (_, _, _, anchor, several) in _walk(batch, 0, span, gram):
                held += [anchor, anchor[several]]
                size += len(anchor)
                if size > 1 << 20:
                    yield out()
                    size = 0
        if held:
            yield out()

    return texts.select("text").mapInArrow(tidied(run), "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor")


def _segment_rows(base: DataFrame, span: int, gram: int, wanted: np.ndarray | None) -> DataFrame:
    """rid, start, size, anchor, several (the anchor is in it more than once), digest of the segments with a wanted (sorted) anchor; of all segments if None."""
    known = None if wanted is None else base.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, data, offsets, (owner, start, size, anchor, several) in _walk(batch, 1, span, gram):
                if known is not None:
                    table = known.value
                    at = np.minimum(np.searchsorted(table, anchor), max(0, len(table) - 1))
                    keep = np.flatnonzero(table[at] == anchor) if len(table) else np.zeros(0, np.int64)
                    owner, start, size, anchor, several = owner[keep], start[keep], size[keep], anchor[keep], several[keep]
                if not len(owner):
                    continue
                raw = data.tobytes()
                begin = offsets[owner] + start
                digest = [hashlib.sha256(raw[a:b]).digest()[:16] for a, b in zip(begin.tolist(), (begin + size + span - 1).tolist())]
                rid = batch.column(0).take(pa.array(owner + lo)).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([rid, pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(anchor), pa.array(several), pa.array(digest, pa.binary())], ["rid", "start", "size", "anchor", "several", "digest"])

    return base.select("rid", "text").mapInArrow(tidied(run), "rid binary, start int, size int, anchor bigint, several boolean, digest binary")


def _fetch(base: DataFrame, open_: DataFrame, span: int) -> DataFrame:
    """anchor, digest, n, hot and the bytes of every open segment, from one text that holds it (rows that are equal give it again)."""
    wanted = open_.groupBy("rid").agg(F.collect_list(F.struct("start", "size", "anchor", "digest", "n", "hot")).alias("parts"))  # at most a text's own segments

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(1)
            flat, owner = parts.flatten(), np.repeat(np.arange(len(parts)), np.diff(parts.offsets.to_numpy()))
            start, size = flat.field("start").to_numpy(), flat.field("size").to_numpy()
            data, offsets = column_bytes(batch.column(0))
            begin = offsets[owner] + start
            for at in range(0, len(owner), 4096):
                b, e = begin[at : at + 4096].tolist(), (begin + size)[at : at + 4096].tolist()
                body = pa.array([data[i : j + span - 1].tobytes() for i, j in zip(b, e)], pa.binary())
                yield pa.RecordBatch.from_arrays([*[flat.field(c).slice(at, 4096) for c in ("anchor", "digest", "n", "hot")], body], ["anchor", "digest", "n", "hot", "body"])

    return base.select("rid", "text").join(wanted.hint("shuffle_hash"), "rid").select("text", "parts").mapInArrow(tidied(run), "anchor bigint, digest binary, n bigint, hot boolean, body binary")


_RUNS = "digest binary, runs array<struct<a:int,b:int>>"


def _runs(digests: list[bytes], begin: np.ndarray, flags: np.ndarray) -> pa.RecordBatch:
    """Runs of true flags of each piece (``begin``: where each piece's flags begin)."""
    edge = np.zeros(len(flags) + 1, bool)
    edge[begin[:-1]] = True
    first = np.flatnonzero(flags & np.concatenate([[True], ~flags[:-1] | edge[1:-1]]))
    last = np.flatnonzero(flags & np.append(~flags[1:] | edge[1:-1], True))
    owner = np.searchsorted(begin, first, side="right") - 1
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(digests) + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array((first - begin[owner]).astype(np.int32)), pa.array((last + 1 - begin[owner]).astype(np.int32))], ["a", "b"]))
    some = np.flatnonzero(np.diff(np.searchsorted(owner, np.arange(len(digests) + 1))))
    return pa.RecordBatch.from_arrays([pa.array([digests[i] for i in some], pa.binary()), lists.take(pa.array(some))], ["digest", "runs"])


def _expand(parts: DataFrame, span: int, limit: int) -> DataFrame:
    """digest, runs (window starts) of segments that occur once as a whole: what another segment of the anchor, or another place of the same, also holds."""

    def search(found: dict[bytes, tuple[int, bytes]]) -> pa.RecordBatch:
        digests = list(found)
        bodies = [found[d][1] for d in digests]
        size = np.array([len(b) for b in bodies], np.int64)
        begin = np.concatenate([[0], np.cumsum(size + 1)])
        symbols = np.zeros(begin[-1], np.int16)
        solid = np.ones(len(symbols), bool)
        solid[begin[1:] - 1] = False
        symbols[solid] = np.frombuffer(b"".join(bodies), np.uint8).astype(np.int16) + 1
        hit = long_repeats(symbols, span)
        once = np.array([found[d][0] == 1 for d in digests])
        hit &= np.repeat(once, size + 1)  # what occurs twice as a whole is known already
        return _runs(digests, begin, hit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, tuple[int, bytes]] = {}
        held, last = 0, None
        for batch in batches:  # in order of anchors
            for anchor, digest, n, body in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if anchor != last and held >= limit:
                    yield search(found)
                    found, held = {}, 0
                last = anchor
                if digest not in found:
                    found[digest] = (n, body)
                    held += len(body)
        if found:
            yield search(found)

    return parts.select("anchor", "digest", "n", "body").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(tidied(run), _RUNS)


def _count_windows(parts: DataFrame, span: int, scratch: Scratch) -> DataFrame:
    """The same for hot anchors: windows counted by their hashes, wherever they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, n, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                h, k = window_hashes(np.frombuffer(body, np.uint8), span)
                w = np.stack([h, k], axis=1)
                size = len(w)
                name = pa.Array.from_buffers(pa.binary(), size, [None, pa.py_buffer((np.arange(size + 1, dtype=np.int32) * 16).tobytes()), pa.py_buffer(w.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array([digest] * size, pa.binary()), pa.array(np.full(size, n)), pa.array(np.arange(size, dtype=np.int32)), name], ["digest", "n", "at", "w"])

    one = parts.groupBy("digest").agg(F.first("n").alias("n"), F.first("body").alias("body")).select("digest", "n", "body")
    windows = scratch.save(one.mapInArrow(tidied(run), "digest binary, n bigint, at int, w binary"), "hot-windows")
    again = scratch.save(windows.groupBy("w").agg(F.sum("n").alias("c")).filter("c > 1").select("w", F.lit(True).alias("again")), "hot-again")
    hits = join_hot(windows.filter("n = 1"), again, "w", scratch, "hot-hot").filter("again")
    return hits.groupBy("digest").agg(F.collect_list(F.struct(F.col("at").alias("a"), (F.col("at") + 1).alias("b"))).alias("runs"))  # at most PIECE windows


def repeated_spans(base: DataFrame, scratch: Scratch, span: int = SPAN, gram: int = GRAM, index_bytes: int = INDEX_BYTES, hot_bytes: int = HOT_BYTES, broadcast_anchors: int = BROADCAST_ANCHORS) -> DataFrame:
    """rid, spans (first byte, end byte) of what repeats in each text of ``base`` (rid, text); spans may touch and overlap."""
    anchors = scratch.save(repeated_anchors(base, span, gram), "anchors")
    wanted = np.sort(anchors.toArrow().column("anchor").to_numpy()) if anchors.count() <= broadcast_anchors else None
    rows = scratch.save(_segment_rows(base, span, gram, wanted), "segments")
    kinds = scratch.save(rows.groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.max("several").alias("several"), F.min(F.struct("rid", "start", "size")).alias("r")), "kinds")
    shared = kinds.groupBy("anchor").agg(F.count("*").alias("v"), F.sum(F.col("r.size") + (span - 1)).alias("bytes"), F.max("several").alias("several")).filter("v > 1 or several").select("anchor", (F.col("bytes") > hot_bytes).alias("hot"))
    shared = scratch.save(shared, "shared")
    opened = join_hot(kinds, shared, "anchor", scratch, "hot-anchors").filter("hot is not null")  # an anchor may have very many different segments
    open_ = scratch.save(opened.select("anchor", "digest", "n", "r.*", "hot"), "open")
    parts = scratch.save(_fetch(base, open_, span), "parts", by="hot")
    runs = _expand(parts.filter("not hot"), span, index_bytes)
    if open_.filter("hot").take(1):
        runs = runs.unionByName(_count_windows(parts.filter("hot"), span, scratch))
    whole = kinds.filter("n > 1").select("digest", F.array(F.struct(F.lit(0).alias("a"), F.col("r.size").alias("b"))).alias("runs"))
    facts = scratch.save(whole.unionByName(runs), "facts")
    scratch.drop("parts", "open", "anchors")
    held = join_hot(rows.select("rid", "start", "digest"), facts, "digest", scratch, "hot-digests").filter("runs is not null")
    shifted = F.transform("runs", lambda r: F.struct((F.col("start") + r["a"]).alias("a"), (F.col("start") + r["b"] + (span - 1)).alias("b")))
    return held.groupBy("rid").agg(F.flatten(F.collect_set(shifted)).alias("spans"))  # at most a text's own segments


def dedup_bytes(docs: DataFrame, span: int = SPAN, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), digest_only: bool = False, **limits: int) -> DataFrame:
    """``key``, the columns in ``keep``, n_bytes, n_removed, n_spans (maximal removed runs), and the bytes that are left: kept (binary), or with
    ``digest_only`` its kept_sha256. ``limits``: those of ``repeated_spans``."""
    body = F.coalesce(F.col(text), F.lit(""))
    # rows with equal key and text have equal spans, so they may share an id
    rid = F.substring(F.unhex(F.sha2(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), body), 256)), 1, 16)
    base = docs.select(rid.alias("rid"), body.alias("text"), F.col(key).alias("own_key"), *[F.col(f"`{c}`").alias(f"keep_{i}") for i, c in enumerate(keep)])
    spans = repeated_spans(base.select("rid", "text"), Scratch(docs.sparkSession, "bytes"), span, **limits)
    joined = base.join(spans.hint("shuffle_hash"), "rid", "left").drop("rid")
    n_keep = len(keep)
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (key, *keep)]
    out = "kept_sha256 string" if digest_only else "kept binary"

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(0))
            total, gone, runs, left = np.diff(offsets), [], [], []
            for i, spans in enumerate(batch.column(2 + n_keep)):
                raw = data[offsets[i] : offsets[i + 1]]
                keep_, n = [], 0
                at = 0
                for a, b in _merged(spans):
                    keep_.append(raw[at:a])
                    at, n = b, n + 1
                keep_.append(raw[at:])
                rest = np.concatenate(keep_).tobytes()
                gone.append(len(raw) - len(rest))
                runs.append(n)
                left.append(hashlib.sha256(rest).hexdigest() if digest_only else rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), *batch.columns[2 : 2 + n_keep], pa.array(total), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(left, pa.string() if digest_only else pa.binary())], [key, *keep, "n_bytes", "n_removed", "n_spans", out.split()[0]]
            )

    return joined.select("text", "own_key", *[f"keep_{i}" for i in range(n_keep)], "spans").mapInArrow(tidied(assemble), ", ".join([*kinds, "n_bytes bigint", "n_removed bigint", "n_spans bigint", out]))


def _merged(spans: pa.Scalar) -> list[tuple[int, int]]:
    """Maximal runs of a list of spans; touching ones are one run."""
    if not spans.is_valid:
        return []
    flat = spans.values
    a, b = flat.field("a").to_numpy(), flat.field("b").to_numpy()
    if not len(a):
        return []
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
    return list(zip(a[new].tolist(), b[np.append(new[1:], len(a)) - 1].tolist()))
