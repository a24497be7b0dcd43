"""Removal of repeated word windows with compressed FM-indexes.

A window is ``span`` consecutive words of one text. A word goes if a window that
covers it also starts in a text with a smaller key.

Sharding. Searching every document in every shard would cost documents times
shards. Instead text is cut by minimizers: of the ``anchor``-word sequences inside a
window, the one with the smallest hash is the window's anchor. Equal windows
have equal anchors, so all occurrences of a window are in the shard that owns its anchor,
and each stretch of windows with one anchor (a segment) goes to one shard.

1. Anchors: each anchor's smallest and largest key and its count, partially aggregated before the
   shuffle. Anchors that occur under one key only are settled there.
2. Segments: texts are streamed again; only segments whose anchor is shared are
   sent, to the shard of their anchor, as words. The set of shared anchors is broadcast
   up to ``BROADCAST_ANCHORS`` (checked), and beyond that joined to the texts. Of equal segments
   met together only those of the smallest key are sent; the others repeat it, whatever else is found. A
   hot anchor (more than ``HOT`` texts) sends its windows one by one to the shards of their hashes, so no
   shard holds all of them, and each task remembers the hot windows it has sent. What repeats others and follows on each other in a text is one row.
3. Shard: segments of one anchor are ranked by key. For every bit of the rank, the
   segments with a 0 there are put into an FM-index and the ones with a 1 are streamed through it by
   backward search; only ranks that agree above that bit can match (the index's letters are pairs of that group and a word).
   So the indexed and the streamed texts are always different ones, every pair of keys meets
   exactly once, the indexed key is the smaller one, and a matching statistic of ``span`` words or more
   is a repeated window. Bits share an index up to its size; segments that are found whole are not looked at for later ones.
4. Intervals meet their texts by (key, SHA-256 of the text), and the kept words are joined.

A shard's partition is cut into indexes of at most ``INDEX_WORDS`` words (or one anchor's
distinct segments), so memory follows the shuffle partition size. Hashes only decide where segments go: in
a shard words are compared as words.

Edge cases: a null text has no words. Rows with a null key remove nothing and lose nothing; a key that is no whole number is an error. Rows that repeat a
key don't count as smaller than each other. Texts shorter than ``span`` words
keep all. Empty tables give empty results. Other columns are carried through
``keep`` only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.fm_index import FMIndex
from tessera.llm.shared import Scratch, arrow_rows
from tessera.llm.textkernel import column_bytes, mix64, shingles, slices, tidied, word_hashes, words

SPAN = 13
ANCHOR = 5
#: Shared anchors (9 bytes each) that may be broadcast.
BROADCAST_ANCHORS = 4_000_000
#: Words of one FM-index.
INDEX_WORDS = 400_000
#: Windows of one segment, and of the pieces that a segment is streamed in.
RUN = 256
PIECE = 12
#: Texts from which an anchor is hot.
HOT = 1_000
#: Bytes of text that are cut into words at a time (or one longer text), and rows of an Arrow batch.
SLICE_BYTES = 1 << 18
BATCH_ROWS = 1_000
#: Hot windows that a task remembers; forgotten together when there are more.
REMEMBERED = 200_000


def window_anchors(data: np.ndarray, offsets: np.ndarray, span: int, anchor: int):
    """(starts and ends of words, word hashes, first word of each text, text of each window, first word of each window, anchor hash of each window)."""
    starts, ends, first = words(data, offsets)
    h = word_hashes(data, starts, ends)
    n = np.diff(first)
    count = np.maximum(n - span + 1, 0)
    owner = np.repeat(np.arange(len(n)), count)
    begin = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(begin[-1]) - begin[owner] + first[owner]
    if not len(at):
        return starts, ends, h, first, owner, at, np.zeros(0, np.uint64)
    grams = shingles(h, np.array([0, len(h)]), anchor)[0]
    best = grams[at].copy()
    for j in range(1, span - anchor + 1):
        np.minimum(best, grams[at + j], out=best)
    return starts, ends, h, first, owner, at, best


def _segments(owner: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first window, number of windows) of each run of windows with one anchor, at most ``RUN``: a text that repeats one
    word has one long segment, not one for each window."""
    if not len(best):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate([[True], (best[1:] != best[:-1]) | (owner[1:] != owner[:-1])])
    inside = np.arange(len(best)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    edge = np.flatnonzero(inside % RUN == 0)
    return edge, np.diff(np.append(edge, len(best)))


def shared_anchors(docs: DataFrame, span: int, anchor: int) -> DataFrame:
    """anchor, hot: anchors that occur under at least two keys."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            key = batch.column(0).to_numpy()
            for lo, hi in slices(offsets, SLICE_BYTES):
                o = offsets[lo : hi + 1]
                *_, owner, _, best = window_anchors(data[o[0] : o[-1]], o - o[0], span, anchor)
                edge, _ = _segments(owner, best)
                a, k = best[edge], key[owner[edge] + lo]
                order = np.lexsort((k, a))
                a, k = a[order], k[order]
                new = np.concatenate([[True], (a[1:] != a[:-1]) | (k[1:] != k[:-1])]) if len(a) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(a[new].view(np.int64)), pa.array(k[new])], ["anchor", "key"])

    rows = docs.select("key", "text").mapInArrow(tidied(emit), "anchor bigint, key bigint")
    found = rows.groupBy("anchor").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n")).filter("lo < hi")
    return found.select("anchor", (F.col("n") > HOT).alias("hot"))


def own_anchors(docs: DataFrame, anchors: DataFrame, span: int, anchor: int) -> DataFrame:
    """The texts with a column ``anchors``: their own shared anchors with the hot flag. For sets of anchors that are too many to send around."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(2))
            for lo, hi in slices(offsets, SLICE_BYTES):
                o = offsets[lo : hi + 1]
                *_, owner, _, best = window_anchors(data[o[0] : o[-1]], o - o[0], span, anchor)
                pairs = np.unique(np.stack([owner, best.view(np.int64)], axis=1), axis=0)
                at = pa.array(pairs[:, 0] + lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(pairs[:, 1].copy())], ["key", "tid", "anchor"])

    rows = docs.select("key", "tid", "text").mapInArrow(tidied(emit), "key bigint, tid binary, anchor bigint")
    own = rows.join(anchors, "anchor").groupBy("key", "tid").agg(F.collect_set(F.struct("anchor", "hot")).alias("anchors"))  # at most a text's own anchors
    return docs.join(own, ["key", "tid"]).select("key", "tid", "text", "anchors")


_PARTS = pa.schema([("shard", pa.int64()), ("key", pa.int64()), ("tid", pa.binary()), ("start", pa.int32()), ("words", pa.binary()), ("end", pa.int32()), ("source", pa.int64())])
_HITS = pa.schema([("key", pa.int64()), ("tid", pa.binary()), ("a", pa.int32()), ("b", pa.int32()), ("source", pa.int64())])
_SQL = {pa.int64(): "bigint", pa.int32(): "int", pa.binary(): "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_SQL[f.type]}" for f in schema)


def _one_spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All words with one space after each, and where each begins (with the total at the end)."""
    size = ends - starts
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(int(begin[-1]), 0x20, np.uint8)
    inside = np.ones(len(out), bool)
    inside[begin[1:] - 1] = False
    solid = np.zeros(len(data) + 1, np.int8)
    np.add.at(solid, starts, 1)
    np.add.at(solid, ends, -1)
    out[inside] = data[np.cumsum(solid[:-1]).astype(bool)]
    return out.tobytes(), begin


def _joined(which: np.ndarray, owner: np.ndarray, at: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of windows, ascending by their first one, that follow on each other in one text: the first of each chain, and the window after its last."""
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (at[1:] != (at + run)[:-1])])[: len(which)]
    last = np.append(np.flatnonzero(new)[1:], len(which))[: new.sum()] - 1
    return which[new], (at + run)[last]


def segments(docs: DataFrame, span: int, anchor: int, allowed: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """Segments with a shared anchor (words; ``allowed``: sorted anchors and their hot flags, or the row's own column ``anchors``), and
    runs that are known to repeat a smaller key (end, source)."""
    known = None if allowed is None else docs.sparkSession.sparkContext.broadcast(allowed)

    def wanted(batch: pa.RecordBatch, lo: int, hi: int, owner: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shared, hot) of each segment."""
        a = best.view(np.int64)
        if known is not None:
            table, hot = known.value
            if not len(table):
                return np.zeros(len(a), bool), np.zeros(len(a), bool)
            at = np.minimum(np.searchsorted(table, a), len(table) - 1)
            keep = table[at] == a
            return keep, keep & hot[at]
        keep, is_hot, cut = np.zeros(len(a), bool), np.zeros(len(a), bool), np.searchsorted(owner, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            own = batch.column(3)[lo + i].as_py() or []
            part = slice(cut[i], cut[i + 1])
            keep[part] = np.isin(a[part], np.array([x["anchor"] for x in own], np.int64))
            is_hot[part] = np.isin(a[part], np.array([x["anchor"] for x in own if x["hot"]], np.int64))
        return keep, is_hot

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[bytes, int] = {}  # hot windows and the smallest key they were sent with
        for batch in batches:
            data, offsets = column_bytes(batch.column(2))
            key_of = batch.column(0).to_numpy()
            for lo, hi in slices(offsets, SLICE_BYTES):
                o = offsets[lo : hi + 1]
                part = data[o[0] : o[-1]]
                starts, ends, h, first, owner, at, best = window_anchors(part, o - o[0], span, anchor)
                edge, run = _segments(owner, best)
                keep, hot = wanted(batch, lo, hi, owner[edge], best[edge])
                if not keep.any():
                    continue
                one = edge[keep & hot]  # windows of hot anchors, each for itself
                alone = np.arange(run[keep & hot].sum()) + np.repeat(one - (np.cumsum(run[keep & hot]) - run[keep & hot]), run[keep & hot])
                edge, run = np.concatenate([edge[keep & ~hot], alone]), np.concatenate([run[keep & ~hot], np.ones(len(alone), np.int64)])
                shard = best[edge].copy()
                cold = len(edge) - len(alone)
                if len(alone):
                    shard[cold:] = mix64(shard[cold:] ^ shingles(h, np.array([0, len(h)]), span)[0][at[alone]])
                blob, begin = _one_spaced(part, starts, ends)
                u, v = begin[at[edge]], begin[at[edge] + run + span - 1] - 1
                body = [blob[a:b] for a, b in zip(u.tolist(), v.tolist())]
                key, start = key_of[owner[edge] + lo], at[edge] - first[owner[edge]]
                same = pa.array(body, pa.binary()).dictionary_encode().indices.to_numpy()
                least = np.full(len(body), np.iinfo(np.int64).max)
                np.minimum.at(least, same, key)
                least = least[same]
                for i in range(cold, len(edge)):  # what this task has sent before
                    k = sent.get(body[i])
                    if k is None or k > least[i]:
                        sent[body[i]] = int(least[i])
                    else:
                        least[i] = k
                if len(sent) > REMEMBERED:
                    sent.clear()
                again = key > least
                tid = batch.column(1).take(pa.array(owner[edge] + lo)).cast(pa.binary())
                go = np.flatnonzero(~again)
                none = pa.nulls(len(go), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(shard[go].view(np.int64)), pa.array(key[go]), tid.take(pa.array(go)), pa.array(start[go].astype(np.int32)), pa.array([body[i] for i in go.tolist()], pa.binary()), none, pa.nulls(len(go), pa.int64())], schema=_PARTS)
                go = np.flatnonzero(again)
                go = go[np.argsort(at[edge[go]], kind="stable")]
                go, end = _joined(go, owner[edge[go]], at[edge[go]], run[go])
                end = (end - first[owner[edge[go]]] + span - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(mix64(key[go]).view(np.int64)), pa.array(key[go]), tid.take(pa.array(go)), pa.array(start[go].astype(np.int32)), pa.nulls(len(go), pa.binary()), pa.array(end), pa.array(least[go])], schema=_PARTS)

    return docs.mapInArrow(tidied(emit), _ddl(_PARTS))


def _array(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)
    return column


def search_shard(ids: np.ndarray, begin: np.ndarray, shard: np.ndarray, key: np.ndarray, span: int, sources: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For each word position of the distinct segments: whether the window that starts there is in a segment of the same shard with a smaller
    key, and with ``sources`` the key of one that holds it. ``ids``: exact word numbers."""
    size, n = np.diff(begin), len(shard)
    found, source = np.zeros(len(ids), bool), np.full(len(ids), np.iinfo(np.int64).max)
    windows = np.maximum(size - span + 1, 0)
    order = np.lexsort((key, shard))
    new_shard = np.concatenate([[True], shard[order][1:] != shard[order][:-1]]) if n else np.zeros(0, bool)
    step = new_shard | np.concatenate([[True], key[order][1:] != key[order][:-1]]) if n else new_shard
    dense = np.cumsum(step)
    rank, group = np.zeros(n, np.int64), np.zeros(n, np.int64)
    rank[order] = dense - dense[np.flatnonzero(new_shard)][np.cumsum(new_shard) - 1]
    group[order] = np.cumsum(new_shard)
    owner = np.repeat(np.arange(n), size)
    alphabet = int(ids.max(initial=0)) + 1
    is_window = np.arange(len(ids)) - begin[owner] < windows[owner]
    held: list[tuple[np.ndarray, ...]] = []  # letters and segments of an index; letters, places and piece sizes of what is streamed
    words_held, base = 0, 0

    def search() -> None:
        nonlocal words_held, base
        letters, numbers = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        index, size_ = np.concatenate([h[1] for h in held]), np.concatenate([size[h[1]] for h in held])
        starts = np.cumsum(size_) - size_ + np.arange(len(index))  # one separator after each segment
        sequence = np.zeros(len(numbers) + len(index), np.int64)
        sequence[np.arange(len(numbers)) + np.repeat(np.arange(len(index)), size_)] = numbers + 1
        fm = FMIndex(sequence, len(letters) + 1)
        wanted, at = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])
        seek = np.minimum(np.searchsorted(letters, wanted), len(letters) - 1)
        seek = np.where(letters[seek] == wanted, seek + 1, 0)
        edges = np.concatenate([[0], np.cumsum(np.concatenate([h[4] for h in held]))])
        length, row = fm.matching_statistics(seek, edges, span)
        hit = np.flatnonzero(length >= span)
        found[at[hit]] = True
        if sources and len(hit):
            position = fm.locate(row[hit])
            np.minimum.at(source, at[hit], key[index[np.searchsorted(starts, position, side="right") - 1]])
        held.clear()
        words_held, base = 0, 0

    for bit in range(int(rank.max(initial=0)).bit_length() - 1, -1, -1):
        left = np.bincount(owner[is_window & ~found], minlength=n) > 0  # what is found whole is also held by a smaller key
        together = group << 32 | rank >> (bit + 1)
        upper = (rank >> bit & 1).astype(bool)
        both = np.intersect1d(together[left & ~upper], together[left & upper])
        inside = left & np.isin(together, both)
        index, stream = np.flatnonzero(inside & ~upper), np.flatnonzero(inside & upper)
        if not len(stream):
            continue
        letter = (base + np.searchsorted(both, together[owner])) * alphabet + ids  # of words in ``inside`` segments
        at = _words_of(begin, index)
        places, sizes = _pieces(begin, stream, span)
        held.append((letter[at], index, letter[places], places, sizes))
        base += len(both)
        words_held += len(at)
        if words_held > INDEX_WORDS:
            search()
    if held:
        search()
    return found, source


def _pieces(begin: np.ndarray, which: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions of pieces of at most ``PIECE`` windows of these segments, and the pieces' sizes."""
    size = begin[which + 1] - begin[which]
    n = np.maximum(1, -(-(size - span + 1) // PIECE))
    first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(begin[which], n) + first * PIECE
    length = np.minimum(np.repeat(size, n) - first * PIECE, PIECE + span - 1)
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length), length


def _words_of(begin: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Positions of all words of these segments."""
    size = begin[which + 1] - begin[which]
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[which] - (ends - size), size)


def covered(parts: DataFrame, span: int, sources: bool = False) -> DataFrame:
    """key, tid, first word, end word of runs of covered words, and with ``sources`` the key of a text that holds the run's first window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for b in batches:
            known = b.filter(b.column(5).is_valid())
            if known.num_rows:
                yield pa.RecordBatch.from_arrays([known.column(1), known.column(2), known.column(3), known.column(5), known.column(6)], schema=_HITS)
            b = b.filter(b.column(5).is_null())
            if b.num_rows:
                got.append(b)
        if not got:
            return
        t = pa.Table.from_batches(got).select(["shard", "key", "tid", "start", "words"]).combine_chunks()
        shard = t["shard"].to_numpy()
        order = np.argsort(shard, kind="stable")
        sizes = np.diff(column_bytes(t["words"])[1])[order] // 6 + 1  # words, roughly
        edge = np.flatnonzero(np.concatenate([[True], shard[order][1:] != shard[order][:-1]]))
        ends = np.append(edge[1:], len(order))
        total = np.concatenate([[0], np.cumsum(sizes)])
        lo = 0
        while lo < len(edge):  # whole shards, up to INDEX_WORDS
            hi = max(lo + 1, int(np.searchsorted(total[ends], total[edge[lo]] + INDEX_WORDS, side="right")))
            yield from one(t.take(pa.array(order[edge[lo] : ends[hi - 1]])))
            lo = hi

    def one(t: pa.Table) -> Iterator[pa.RecordBatch]:
        shard, key, start = (t[c].to_numpy() for c in ("shard", "key", "start"))
        encoded = _array(t["words"]).dictionary_encode()
        text_no = encoded.indices.to_numpy().astype(np.int64)
        pair, first, which = np.unique(np.stack([shard, text_no], axis=1), axis=0, return_index=True, return_inverse=True)
        which = which.ravel()
        least = np.full(len(pair), np.iinfo(np.int64).max)
        np.minimum.at(least, which, key)
        data, offsets = column_bytes(encoded.dictionary.take(pa.array(pair[:, 1].copy())))
        s, e, begin = words(data, offsets)
        flat = pa.Array.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(e - s)]).astype(np.int64).tobytes()), pa.py_buffer(data[data != 0x20].tobytes())])
        ids = flat.dictionary_encode().indices.to_numpy().astype(np.int64)  # words are compared as words
        found, source = search_shard(ids, begin, pair[:, 0], least, span, sources)
        windows = np.diff(begin) - span + 1
        count = windows[which]
        offset = np.concatenate([[0], np.cumsum(count)])
        row = np.repeat(np.arange(len(which)), count)
        j = np.arange(offset[-1]) - offset[row]
        place = begin[which[row]] + j
        whole = key > least[which]
        bad = whole[row] | found[place]
        row, place, at = row[bad], place[bad], (start[row] + j)[bad]
        if not len(row):
            return
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)]))
        last = np.append(new[1:], len(row)) - 1
        from_ = np.where(whole[row[new]], least[which[row[new]]], source[place[new]])
        held = pa.array(from_) if sources else pa.nulls(len(new), pa.int64())
        tid = _array(t["tid"]).take(pa.array(row[new]))
        yield pa.RecordBatch.from_arrays([pa.array(key[row[new]]), tid, pa.array(at[new].astype(np.int32)), pa.array((at[last] + span).astype(np.int32)), held], schema=_HITS)

    return parts.repartition("shard").mapInArrow(tidied(run), _ddl(_HITS))


def _cut(text: bytes, runs: list[tuple[int, int]]) -> tuple[list[bytes], int]:
    """(kept words, number of words)."""
    all_words = text.split()  # ASCII white space of bytes: 0x20, 0x09-0x0D
    if not runs:
        return all_words, len(all_words)
    keep, at = [], 0
    for a, b in sorted(runs):
        if a > at:
            keep += all_words[at:a]
        at = max(at, b)
    return keep + all_words[at:], len(all_words)


def _numbered(docs: DataFrame, key: str, text: str, *more) -> DataFrame:
    """key, text, and tid, by which rows that repeat a key are told apart."""
    whole = F.col(key).try_cast("long")
    whole = F.when(whole.isNull() & F.col(key).isNotNull(), F.raise_error(F.lit(f"{key}: keys must be whole numbers, since the smaller one keeps a passage"))).otherwise(whole)
    return docs.select(whole.alias("key"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("tid"), F.coalesce(F.col(text), F.lit("")).alias("text"), *more)


def _hits(base: DataFrame, scratch: Scratch, span: int, anchor: int, broadcast_anchors: int, sources: bool) -> DataFrame:
    usable = base.filter("key is not null").select("key", "tid", "text")
    with arrow_rows(base.sparkSession, BATCH_ROWS):
        anchors = scratch.save(shared_anchors(usable, span, anchor), "anchors")
        if anchors.count() <= broadcast_anchors:
            got = anchors.toArrow()
            a = got["anchor"].to_numpy() if got.num_rows else np.zeros(0, np.int64)
            hot = got["hot"].to_numpy(zero_copy_only=False) if got.num_rows else np.zeros(0, bool)
            order = np.argsort(a)
            parts = segments(usable, span, anchor, (a[order], hot[order]))
        else:
            parts = segments(own_anchors(usable, anchors, span, anchor), span, anchor, None)
        hits = scratch.save(covered(parts, span, sources), "hits")
    scratch.drop("anchors")
    return hits


def repeated_passages(docs: DataFrame, span: int = SPAN, anchor: int = ANCHOR, key: str = "doc_id", text: str = "text", broadcast_anchors: int = BROADCAST_ANCHORS) -> DataFrame:
    """``key``, first_word, end_word, source: intervals of words whose windows repeat a text with a smaller key, and the key of one
    text that holds the interval's first window. Intervals of different shards may overlap."""
    base = _numbered(docs, key, text)
    hits = _hits(base, Scratch(docs.sparkSession, "passages"), span, anchor, broadcast_anchors, True)
    return hits.select(F.col("key").alias(key), F.col("a").alias("first_word"), F.col("b").alias("end_word"), "source")


def dedup_substrings(docs: DataFrame, span: int = SPAN, anchor: int = ANCHOR, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), broadcast_anchors: int = BROADCAST_ANCHORS, digest_only: bool = False) -> DataFrame:
    """``key``, the columns in ``keep``, n_words, n_removed, and the kept words joined by one space: kept_text, or with ``digest_only`` its kept_sha256."""
    base = _numbered(docs, key, text, F.col(key).alias("own_key"), *[F.col(f"`{c}`").alias(f"keep_{i}") for i, c in enumerate(keep)])
    hits = _hits(base, Scratch(docs.sparkSession, "substrings"), span, anchor, broadcast_anchors, False)
    runs = hits.groupBy("key", "tid").agg(F.collect_set(F.struct("a", "b")).alias("runs"))  # at most a text's own windows
    joined = base.join(runs.hint("shuffle_hash"), ["key", "tid"], "left").drop("key", "tid")
    n_keep = len(keep)
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (key, *keep)]
    out = "kept_sha256 string" if digest_only else "kept_text string"

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, gone, kept = [], [], []
            for t, r in zip(batch.column(1), batch.column(2 + n_keep)):
                left, n = _cut(t.as_py().encode(), [] if not r.is_valid else [(x["a"], x["b"]) for x in r.as_py()])
                whole = b" ".join(left)
                n_words.append(n)
                gone.append(n - len(left))
                kept.append(hashlib.sha256(whole).hexdigest() if digest_only else whole.decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[2 : 2 + n_keep], pa.array(n_words, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], [key, *keep, "n_words", "n_removed", out.split()[0]]
            )

    return joined.select("own_key", "text", *[f"keep_{i}" for i in range(n_keep)], "runs").mapInArrow(tidied(assemble), ", ".join([*kinds, "n_words bigint", "n_removed bigint", out]))
