"""Subword encoding with seeded merge dropout, and lossless decoding.

The model is a merge-type (BPE) sentencepiece model with byte fallback. Merges
run from an agenda, best score first and leftmost on ties. When a candidate
comes up it is skipped with probability ``dropout``: a keyed hash of (seed, key of the text,
number of the chunk, position, merged piece) decides, so a run can be repeated exactly. A skipped candidate
is gone unless a neighbouring merge makes a new pair. Without dropout the result is the
model's own segmentation.

No piece has a space mark after another character (checked when the model is
loaded), so texts are cut into chunks at word starts and chunks are encoded on their
own. Every occurrence of a chunk draws for itself. What is cached does not limit that: a
trace is a chunk, the candidates skipped so far, the candidates that come up after them if
none of those is skipped, and the pieces that this gives. An occurrence starts at its
chunk's plain trace; the first candidate that its own hashes skip leads to another trace,
until none is skipped. Traces are kept in a bounded cache per worker. Missing ones are
merged together in numpy, one agenda step of all of them at a time; very long chunks use
a heap for each occurrence.

Decoding concatenates the pieces' bytes. A space mark that is literally in the
text is written in bytes, so every text comes back unchanged.

Edge cases: a null or empty text has no pieces and decodes to the empty text.
Repeated rows give equal results. Texts of any length are encoded whole; an empty table
gives an empty result. A model of another kind is refused with an error.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textkernel import mix64, tidied

MARK = "▁"
DROPOUT = 0.1
SEED = 17
#: Traces that a worker keeps; emptied when there are more.
CACHE_SIZE = 400_000
#: Occurrences that are walked at a time.
SLICE = 100_000
#: Longest chunk (in characters) that is merged in the batch; also the longest that is cached.
BATCH_CHARS = 40
_M = (1 << 64) - 1
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_AT, _PIECE = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_NEVER = np.iinfo(np.int64).max


def _mix(x: int) -> int:
    x &= _M
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & _M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & _M
    return x ^ x >> 31


class _Column:
    """An array that grows at its end."""

    def __init__(self, dtype: type) -> None:
        self.room, self.n = np.zeros(1024, dtype), 0

    def add(self, values: np.ndarray) -> None:
        n = self.n + len(values)
        if n > len(self.room):
            self.room = np.concatenate([self.room[: self.n], np.zeros(max(n, 2 * self.n) - self.n, self.room.dtype)])
        self.room[self.n : n] = values
        self.n = n


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every (start, size), in one array."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


class MergeDropout:
    """Encoder and decoder; kept for the life of a Python worker."""

    def __init__(self, path: str, seed: int = SEED, dropout: float = DROPOUT) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.seed = seed
        self.bar = int(min(max(dropout, 0.0), 1.0) * 2**53)
        n = model.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_id = [-1] * 256
        score: dict[str, float] = {}
        self.id_of: dict[str, int] = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
                score[piece], self.id_of[piece] = model.get_score(i), i
        if -1 in self.byte_id or any(MARK in p.lstrip(MARK) for p in score):
            raise ValueError("needs byte fallback, and no piece with a space mark after another character")
        self.chars = dict(self.id_of)  # single characters that only occur inside pieces get ids above the vocabulary
        for p in score:
            for c in p:
                self.chars.setdefault(c, n + len(self.chars) - len(self.id_of))
        ranks = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for p, s in score.items():
            for cut in range(1, len(p)):
                a, b = self.chars.get(p[:cut]), self.chars.get(p[cut:])
                if a is not None and b is not None:
                    self.pairs[a, b] = (ranks[s], self.id_of[p])
        keys = np.array([(a << 32) | b for a, b in self.pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_key = keys[order]
        values = np.array(list(self.pairs.values()), dtype=np.int64).reshape(-1, 2)[order]
        self.pair_rank, self.pair_id = values[:, 0], values[:, 1]
        size = 1 << 20
        self.slot_mask = size - 1
        slot = (mix64(self.pair_key.view(np.uint64)) & np.uint64(self.slot_mask)).astype(np.int64)
        self.bucket = np.full(size, -1, np.int32)
        self.bucket[slot] = np.arange(len(slot))  # a pair whose slot another one has is found by binary search
        self.shared = np.zeros(size, bool)
        self.shared[np.flatnonzero(np.bincount(slot, minlength=size) > 1)] = True
        self.other = n + len(self.chars)  # stands for a character that no piece has
        self.symbol_of = np.full(0x30000, self.other, np.int64)
        for c, i in self.chars.items():
            if len(c) == 1 and ord(c) < len(self.symbol_of) - 1:
                self.symbol_of[ord(c)] = i
        if any(len(c) == 1 and ord(c) >= len(self.symbol_of) - 1 for c in self.chars):
            raise ValueError("a piece has a character beyond the symbol table")
        self.blob = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.size = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.forget()

    def _skip(self, key: int, at: int, piece: int) -> bool:
        return _mix(key + at * _AT + piece * _PIECE) >> 11 < self.bar

    def _ids(self, pieces: list[tuple[int, str]]) -> bytes:
        out: list[int] = []
        for i, text in pieces:
            out += [i] if 0 <= i < len(self.bytes_of) else [self.byte_id[b] for b in text.encode()]
        return np.array(out, dtype="<i4").tobytes()

    def encode_one(self, chunk: str, key: int) -> bytes:
        """One occurrence by a heap: for long chunks, and what the batch is tested against."""
        sym = [self.chars.get(c, self.other) for c in chunk]
        n = len(sym)
        end, left, right, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        agenda: list[tuple[int, int, int, int, int]] = []

        def push(a: int, b: int) -> None:
            got = self.pairs.get((sym[a], sym[b])) if a >= 0 and b < n else None
            if got:
                heapq.heappush(agenda, (got[0], a, b, end[b], got[1]))

        for i in range(n - 1):
            push(i, i + 1)
        while agenda:
            _, a, b, stop, piece = heapq.heappop(agenda)
            if not (alive[a] and b < n and alive[b]) or right[a] != b or end[b] != stop or self.pairs.get((sym[a], sym[b]), (0, -1))[1] != piece:
                continue
            if self.bar and self._skip(key, a, piece):
                continue
            sym[a], end[a], right[a], alive[b] = piece, stop, right[b], False
            if right[b] < n:
                left[right[b]] = a
            push(left[a], a)
            push(a, right[a])
        return self._ids([(sym[i], chunk[i : end[i]]) for i in range(n) if alive[i]])

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of symbol pairs; rank _NEVER for none."""
        key = (a << 32) | b
        slot = (mix64(key.view(np.uint64)) & np.uint64(self.slot_mask)).astype(np.int64)
        at = self.bucket[slot].astype(np.int64)
        clash = self.shared[slot]
        if clash.any():
            k = key[clash]
            at[clash] = np.minimum(np.searchsorted(self.pair_key, k), len(self.pair_key) - 1)
        ok = (at >= 0) & (self.pair_key[at] == key)
        return np.where(ok, self.pair_rank[at], _NEVER), np.where(ok, self.pair_id[at], -1)

    def encode_batch(self, items: list[tuple[str, int]]) -> list[bytes]:
        """Short chunks, each with the key of its occurrence."""
        return self._merge([c for c, _ in items], np.array([k for _, k in items], dtype=np.uint64), np.full(len(items), _NEVER))[0]

    def _merge(self, chunks: list[str], keys: np.ndarray, last: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Pieces of many short chunks whose keys decide up to agenda step ``last``, after which nothing is skipped; how many
        candidates each has after that step, and their parts of the hash."""
        out: list[bytes] = [b""] * len(chunks)
        owner, parts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        by_size = np.argsort([len(c) for c in chunks], kind="stable")
        for lo in range(0, len(by_size), 10_000):
            part = by_size[lo : lo + 10_000]
            for rows, more in self._merge_rows([chunks[i] for i in part], keys[part], last[part], part.tolist(), out):
                owner.append(part[rows])
                parts.append(more)
        owned = np.concatenate(owner)
        return out, np.bincount(owned, minlength=len(chunks)), np.concatenate(parts)[np.argsort(owned, kind="stable")]

    def _merge_rows(self, chunks: list[str], key: np.ndarray, last: np.ndarray, part: list[int], out: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """One agenda step of every chunk at a time. Symbols of a chunk are a linked list in its row."""
        m, sizes = len(chunks), np.array([len(c) for c in chunks])
        width = int(sizes.max())
        points = np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4").astype(np.int64)
        inside = np.arange(width) < sizes[:, None]
        sym = np.full((m, width), -1, np.int64)
        sym[inside] = self.symbol_of[np.minimum(points, len(self.symbol_of) - 1)]
        nxt = np.tile(np.arange(1, width + 1), (m, 1))
        nxt[np.arange(1, width + 1) >= sizes[:, None]] = width  # width: none
        prev = np.tile(np.arange(-1, width - 1), (m, 1))
        alive = inside.copy()
        rank, piece = np.full((m, width), _NEVER), np.full((m, width), -1, np.int64)
        both = inside[:, 1:]
        if both.any():
            r, q = self._lookup(sym[:, :-1][both], sym[:, 1:][both])
            rank[:, :-1][both], piece[:, :-1][both] = r, q
        rows, step, seen = np.arange(m), -1, []
        while len(rows):
            best = rank[rows].argmin(axis=1)
            live = rank[rows, best] != _NEVER
            rows, best = rows[live], best[live]
            merged = piece[rows, best]
            i, c = rows, best
            step += 1
            if self.bar:
                part_of_hash = c.astype(np.uint64) * np.uint64(_AT) + merged.astype(np.uint64) * np.uint64(_PIECE)
                free = step > last[i]
                seen.append((i[free], part_of_hash[free]))
                drop = self._skips(key[i] + part_of_hash) & ~free
                rank[i[drop], c[drop]] = _NEVER
                i, c, merged = i[~drop], c[~drop], merged[~drop]
            if not len(i):
                continue
            gone = nxt[i, c]
            after = nxt[i, gone]
            sym[i, c], nxt[i, c] = merged, after
            alive[i, gone], rank[i, gone] = False, _NEVER
            has = after < width
            prev[i[has], after[has]] = c[has]
            rank[i, c] = _NEVER
            rank[i[has], c[has]], piece[i[has], c[has]] = self._lookup(merged[has], sym[i[has], after[has]])
            before = prev[i, c]
            has = before >= 0
            x, y = i[has], before[has]
            rank[x, y], piece[x, y] = self._lookup(sym[x, y], merged[has])
        plain = ((sym < len(self.bytes_of)) | ~alive).all(axis=1)
        counts = alive.sum(axis=1)
        whole = sym[alive].astype("<i4").tobytes()
        ends = (np.cumsum(counts) * 4).tolist()
        at = 0
        for j, e, ok in zip(part, ends, plain.tolist()):
            out[j] = whole[at:e] if ok else b""
            at = e
        for x in np.flatnonzero(~plain):
            places = np.flatnonzero(alive[x]).tolist()
            cuts = [*places, len(chunks[x])]
            out[part[x]] = self._ids([(int(sym[x, y]), chunks[x][y:z]) for y, z in zip(places, cuts[1:])])
        return seen

    def _skips(self, h: np.ndarray) -> np.ndarray:
        return (mix64(h) >> np.uint64(11)) < np.uint64(self.bar)

    def _add(self, pieces: list[bytes], counts: np.ndarray, parts: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Numbers of new traces; ``step``: the agenda step of the first of a trace's candidates."""
        size = np.array([len(p) // 4 for p in pieces], dtype=np.int64)
        first = self.step.n
        for column, values in (
            (self.ids_start, self.ids.n + np.cumsum(size) - size), (self.ids_size, size), (self.ids, np.frombuffer(b"".join(pieces), "<i4")),
            (self.cand_start, self.cand.n + np.cumsum(counts) - counts), (self.cand_size, counts), (self.cand, parts), (self.child, np.full(len(parts), -1)), (self.step, step),
        ):
            column.add(values)
        return np.arange(first, self.step.n)

    def _walk(self, chunks: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all occurrences in one array, and how many each has."""
        if self.step.n > CACHE_SIZE:
            self.forget()
        trace = np.array([self.roots.get(c, -1) for c in chunks], dtype=np.int64)
        missing = np.flatnonzero(trace < 0).tolist()
        if missing:
            fresh = list(dict.fromkeys(chunks[i] for i in missing if len(chunks[i]) <= BATCH_CHARS))
            none = np.zeros(len(fresh), np.int64)
            self.roots.update(zip(fresh, self._add(*self._merge(fresh, none.view(np.uint64), none - 1), none).tolist()))
            long = [i for i in missing if len(chunks[i]) > BATCH_CHARS]
            none = np.zeros(len(long), np.int64)
            trace[missing] = [self.roots.get(chunks[i], -1) for i in missing]
            trace[long] = self._add([self.encode_one(chunks[i], int(keys[i])) for i in long], none, np.zeros(0, np.uint64), none)
        at = np.arange(len(chunks)) if self.bar else np.zeros(0, np.int64)
        while len(at):
            size = self.cand_size.room[trace[at]]
            index = _spread(self.cand_start.room[trace[at]], size)
            owner = np.repeat(np.arange(len(at)), size)
            hit = np.flatnonzero(self._skips(keys[at][owner] + self.cand.room[index]))
            hit = hit[np.diff(owner[hit], prepend=-1) > 0]  # the first of each occurrence
            at, index = at[owner[hit]], index[hit]
            lost = self.child.room[index] < 0
            if lost.any():
                new, one = np.unique(index[lost], return_index=True)
                one = at[lost][one]  # an occurrence that comes here: its key gives the skips so far
                step = self.step.room[trace[one]] + new - self.cand_start.room[trace[one]]
                self.child.room[new] = self._add(*self._merge([chunks[i] for i in one], keys[one], step), step + 1)
            trace[at] = self.child.room[index]
        size = self.ids_size.room[trace]
        return self.ids.room[_spread(self.ids_start.room[trace], size)], size

    def encode(self, texts: list[str], keys: np.ndarray) -> list[bytes]:
        """Piece ids (int32, little-endian) of each text; ``keys``: uint64 of each text."""
        chunks: list[str] = []
        ends: list[int] = []
        for t in texts:
            if t:
                if MARK in t:
                    first = True
                    for part in re.split(f"({MARK})", t):
                        if part == MARK:
                            chunks += [MARK] * first + [""]  # the dummy space, then the literal mark
                        elif part or first:
                            chunks += _CHUNK.findall((MARK if first else "") + part.replace(" ", MARK))
                        first = False
                else:
                    chunks += _CHUNK.findall(MARK + t.replace(" ", MARK))
            ends.append(len(chunks))
        ends_a = np.array(ends, dtype=np.int64)
        number = np.arange(len(chunks), dtype=np.int64)
        owner = np.searchsorted(ends_a, number, side="right")
        begin = np.concatenate([[0], ends_a])[:-1] if len(ends_a) else np.zeros(0, np.int64)
        base = mix64(keys ^ np.uint64(self.seed * 0x9E3779B97F4A7C15 & _M)) if len(keys) else keys
        own = mix64(base[owner] + (number - begin[owner]).astype(np.uint64)) if len(keys) else keys
        got = [self._walk(chunks[lo : lo + SLICE], own[lo : lo + SLICE]) for lo in range(0, len(chunks), SLICE)]
        ids = np.concatenate([np.zeros(0, "<i4"), *[g for g, _ in got]])
        cuts = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate([np.zeros(0, np.int64), *[n for _, n in got]]))])
        return [ids[cuts[b] : cuts[e]].tobytes() for b, e in zip(begin.tolist(), ends)]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text."""
        i = np.frombuffer(ids, "<i4").astype(np.int64)
        if not len(i):
            return b""
        size = self.size[i]
        ends = np.cumsum(size)
        index = np.arange(ends[-1]) + np.repeat(self.start[i] - (ends - size), size)
        return self.blob[index].tobytes()[1:]  # without the dummy space


    def forget(self) -> None:
        """Empty the cache; a task's end does."""
        self.roots: dict[str, int] = {}
        self.ids, self.cand = _Column(np.int32), _Column(np.uint64)
        self.ids_start, self.ids_size, self.cand_start, self.cand_size, self.child, self.step = (_Column(np.int64) for _ in range(6))
        none = np.zeros(1, np.int64)
        literal = np.array([self.byte_id[b] for b in MARK.encode()], dtype="<i4").tobytes()
        self.roots[""] = int(self._add([literal], none, np.zeros(0, np.uint64), none)[0])


_coders: dict[tuple, MergeDropout] = {}


def coder(*how) -> MergeDropout:
    """One coder per setting and worker."""
    if how not in _coders:
        _coders.clear()
        _coders[how] = MergeDropout(*how)
    return _coders[how]


def _keys(column: pa.Array) -> np.ndarray:
    return np.array([0 if v is None else (v & _M if isinstance(v, int) else int.from_bytes(hashlib.blake2b(str(v).encode(), digest_size=8).digest(), "little")) for v in column.to_pylist()], dtype=np.uint64)


def _runs(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    at, held, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t.as_py() or ""
        held.append(t)
        size += len(t)
        if size > limit:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held


def encode(docs: DataFrame, path: str, seed: int = SEED, dropout: float = DROPOUT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ids (array of piece ids) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, seed, dropout)
        for batch in batches:
            keys = _keys(batch.column(0))
            for at, texts in _runs(batch.column(1)):
                got = c.encode(texts, keys[at : at + len(texts)])
                offsets = np.concatenate([[0], np.cumsum([len(g) // 4 for g in got])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(got), "<i4")))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), ids], [key, "ids"])
        c.forget()

    return docs.select(key, text).mapInArrow(tidied(run), f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """``key`` and text of every encoded row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, SEED, 0.0)
        for batch in batches:
            texts = [c.decode(b"" if not x.is_valid else np.array(x.as_py(), "<i4").tobytes()).decode() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return encoded.select(key, "ids").mapInArrow(tidied(run), f"`{key}` {encoded.schema[key].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, seed: int = SEED, dropout: float = DROPOUT, key: str = "doc_id", text: str = "text", with_ids: bool = False, copy: str | None = None) -> DataFrame:
    """``copy`` names a column of whole numbers that tells copies of a document apart (1: the first); each draws for itself.

    ``key``, the copy, n_chars, n_pieces, with ``with_ids`` the ids, ids_sha256 (of the int32 ids), decoded_sha256, lossless: every text encoded, and decoded from its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, seed, dropout)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            keys = _keys(batch.column(0))
            if copy:
                keys = keys + (batch.column(2).to_numpy().astype(np.uint64) - np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            for at, texts in _runs(batch.column(1)):
                got = c.encode(texts, keys[at : at + len(texts)])
                back = [c.decode(g) for g in got]
                ids = []
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum([len(g) // 4 for g in got])]).astype(np.int32)
                    ids = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(got), "<i4")))]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)), *([batch.column(2).slice(at, len(texts))] if copy else []), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(g) // 4 for g in got], pa.int64()), *ids,
                        pa.array([sha(g) for g in got], pa.string()), pa.array([sha(b) for b in back], pa.string()), pa.array([b == t.encode() for b, t in zip(back, texts)], pa.bool_()),
                    ],
                    [key, *[copy] * bool(copy), "n_chars", "n_pieces", *(["ids"] * with_ids), "ids_sha256", "decoded_sha256", "lossless"],
                )
        c.forget()

    number = f" `{copy}` {docs.schema[copy].dataType.simpleString()}," if copy else ""
    return docs.select(key, text, *[copy] * bool(copy)).mapInArrow(tidied(run), f"`{key}` {docs.schema[key].dataType.simpleString()},{number} n_chars bigint, n_pieces bigint,{' ids array<int>,' * with_ids} ids_sha256 string, decoded_sha256 string, lossless boolean")
