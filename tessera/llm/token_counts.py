"""Token counts by a map-side two-tier lookup.

A tokenizer with a byte-level pre-tokenizer never merges across pre-tokens, so a
text's count is the sum of its pre-tokens' lengths. Tier one is a compact table
of frequent pre-tokens, broadcast once (at most ``TABLE_SIZE`` entries). Tier two is a
bounded cache in each Python worker, filled by encoding the misses. No
pre-token is shuffled: counting is a single narrow stage.

The table is filled from a first pass over all whole texts. Each task keeps a mergeable
summary of frequent pre-tokens (at most ``SUMMARY_SIZE`` entries, lower-bound counts) and hands on its
``HANDED_ON`` most frequent ones; only those rows meet. The table decides where a length
is looked up; counts don't depend on it.

Edge cases: a null text counts as an empty one (0 tokens). Special strings in a
text are one token each, as the tokenizer's default is. Repeated rows give
repeated results; an empty table gives an empty result. Other columns of the
input are not looked at.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.textkernel import column_bytes, tidied

#: Entries of the broadcast table; about 1 MB.
TABLE_SIZE = 65_536
#: Entries of a task's summary of frequent pre-tokens, and rows that it hands on.
SUMMARY_SIZE = 65_536
HANDED_ON = 8_192
#: Longer pre-tokens (in characters) are not kept in tables or caches.
LONGEST = 64
#: Entries of a worker's cache; it is emptied when full.
CACHE_SIZE = 400_000

_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Code points on which this pattern engine and the tokenizer's agree; other texts go to the tokenizer's own splitter.
_AGREED = regex.compile(r"[\x00-\u024f]*")


class PreTokenCounter:
    """Counts one text's tokens; kept for the life of a Python worker."""

    def __init__(self, path: str, frequent: dict[str, int]) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor has one core for this worker
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.frequent = frequent
        self.cache: dict[str, int] = {}

    def pre_tokens(self, text: str) -> list[str]:
        if _AGREED.fullmatch(text):
            return _PATTERN.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def count(self, text: str) -> int:
        if not text:
            return 0
        parts, n = [text], 0
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)
            n = len(parts) - 1
        return n + sum(self._plain(p) for p in parts if p)

    def _plain(self, text: str) -> int:
        pieces = self.pre_tokens(text)
        got = list(map(self.frequent.get, pieces))
        if None not in got:
            return sum(got)
        total, cache, missed = 0, self.cache, []
        for piece, n in zip(pieces, got):
            if n is None:
                n = cache.get(piece)
                if n is None:
                    missed.append(piece)
                    continue
            total += n
        if missed:
            new = list(dict.fromkeys(missed))
            lengths = [len(e.ids) for e in self.tokenizer.encode_batch(new, add_special_tokens=False)]
            if len(cache) + len(new) > CACHE_SIZE:
                cache.clear()
            fresh = dict(zip(new, lengths))
            cache.update((k, v) for k, v in fresh.items() if len(k) <= LONGEST)
            total += sum(fresh[p] for p in missed)
        return total


def pack_table(lengths: dict[str, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """One blob, end offsets and lengths: what is broadcast."""
    encoded = [k.encode() for k in lengths]
    return b"".join(encoded), np.cumsum([len(e) for e in encoded], dtype=np.uint32), np.fromiter(lengths.values(), np.uint16, len(lengths))


def unpack_table(packed: tuple[bytes, np.ndarray, np.ndarray]) -> dict[str, int]:
    blob, ends, lengths = packed
    out, at = {}, 0
    for e, n in zip(ends.tolist(), lengths.tolist()):
        out[blob[at:e].decode()] = n
        at = e
    return out


_kept: list = [None, None]


def kept_counter(path: str, packed: tuple[bytes, np.ndarray, np.ndarray]) -> PreTokenCounter:
    """The worker's counter for this file and table: its cache lives as long as the worker does."""
    name = (path, hash(packed[0]), len(packed[1]))
    if _kept[0] != name:
        _kept[:] = [name, PreTokenCounter(path, unpack_table(packed))]
    return _kept[1]


class FrequentPieces:
    """A mergeable summary of frequent pre-tokens: bounded, counts are lower bounds."""

    def __init__(self, counter: PreTokenCounter, size: int = SUMMARY_SIZE) -> None:
        self.counter, self.size = counter, size
        self.counts: Counter[str] = Counter()

    def add(self, texts: Iterator[str]) -> None:
        """Words are counted first, since a space begins a pre-token (but for runs of white space); then each distinct word is cut once."""
        words: Counter[str] = Counter()
        for text in texts:
            first, *rest = text.split(" ")
            words.update([first])
            words.update([f" {w}" for w in rest])
        for word, n in words.items():
            for piece in self.counter.pre_tokens(word):
                if len(piece) <= LONGEST:
                    self.counts[piece] += n
            if len(self.counts) >= 2 * self.size:
                self._thin()
        self._thin()

    def _thin(self) -> None:
        """Keep ``size`` entries: the largest count that must go is taken from all."""
        if len(self.counts) > self.size:
            cut = sorted(self.counts.values(), reverse=True)[self.size]
            self.counts = Counter({k: n - cut for k, n in self.counts.items() if n > cut})

    def top(self, n: int) -> list[tuple[str, int]]:
        return sorted(self.counts.items(), key=lambda e: (-e[1], e[0]))[:n]


def frequent_lengths(docs: DataFrame, path: str, text: str = "text") -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of all texts, by their summaries; at most ``TABLE_SIZE``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = FrequentPieces(kept_counter(path, pack_table({})))
        for batch in batches:
            summary.add(t for x in batch.column(0) if (t := x.as_py()))
        top = summary.top(HANDED_ON)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])

    summed = docs.select(text).mapInArrow(tidied(run), "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    top = summed.orderBy(F.desc("n"), "piece").limit(TABLE_SIZE).toArrow().column("piece").to_pylist()
    tokenizer = PreTokenCounter(path, {}).tokenizer
    return dict(zip(top, (len(e.ids) for e in tokenizer.encode_batch(top, add_special_tokens=False))))


def token_counts(docs: DataFrame, path: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of every text.

    ``path`` names the tokenizer file; it must exist on every executor.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key), F.col(text))
    packed = spark.sparkContext.broadcast(pack_table(frequent_lengths(docs, path, text)))
    kind = docs.schema[key].dataType
    schema = f"`{key}` {kind.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept_counter(path, packed.value)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            sizes = np.diff(column_bytes(texts)[1])
            tokens = [counter.count(x.as_py() or "") for x in texts]
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                [key, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.mapInArrow(tidied(count), schema)
