"""Threshold-scaled document sketches.

A sketch keeps every distinct five-word shingle hash below a fixed fraction of
the hash range. Unlike a fixed-size sketch it grows with the document, so
sketches of very unequal documents compare by containment, and the union of
two sketches is the sketch of the two texts' shingles together (mergeable).

Fingerprint text: ``<shingles, hex>.<64-bit sum of all shingle hashes, hex>.<base64 of the
kept hashes, ascending, 8 bytes little-endian each>``. Equal texts have equal fingerprints.

Likeness is the Jaccard estimate of two sketches. If neither sketch kept a hash
(very short texts), it is 1 when count and sum agree, else 0; so two empty
texts are alike.

Edge cases: a null text is an empty one. A text of fewer than five words has its
whole word sequence as its one shingle. An empty table gives an empty result.
Documents are ordered by (key, text), null keys first, so repeated keys have a
defined successor. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.textkernel import column_bytes, distinct_sorted, shingles, slices, tidied, word_hashes, words

_ALL = (1 << 64) - 1
#: Words of a shingle.
WORDS = 5
#: One shingle hash in so many is kept. At 4, a text of 40 words keeps about nine.
KEEP_ONE_IN = 4


def sketches(data: np.ndarray, offsets: np.ndarray, one_in: int = KEEP_ONE_IN) -> Iterator[tuple[int, int, np.ndarray]]:
    """(distinct shingles, sum of their hashes mod 2**64, kept hashes ascending) of each text."""
    bar = np.uint64(((1 << 64) - 1) // one_in)
    for lo, hi in slices(offsets):
        o = offsets[lo : hi + 1]
        part, o = data[o[0] : o[-1]], o - o[0]
        starts, ends, first = words(part, o)
        sh, begin = shingles(word_hashes(part, starts, ends), first, WORDS)
        values, begin = distinct_sorted(sh, begin)
        below = np.concatenate([[0], np.cumsum(values <= bar)])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
        for i in range(hi - lo):
            a, b = begin[i], begin[i + 1]
            yield int(b - a), (int(sums[b]) - int(sums[a])) & _ALL, values[a : a + int(below[b] - below[a])]


def to_text(sketch: tuple[int, int, np.ndarray]) -> str:
    n, total, kept = sketch
    return f"{n:x}.{total:016x}.{base64.b64encode(kept.astype('<u8').tobytes()).decode()}"


def from_text(fingerprint: str) -> tuple[int, int, np.ndarray]:
    n, total, kept = fingerprint.split(".")
    return int(n, 16), int(total, 16), np.frombuffer(base64.b64decode(kept), "<u8")


def likeness(a: tuple[int, int, np.ndarray], b: tuple[int, int, np.ndarray]) -> float:
    """Jaccard estimate in 0..1."""
    if a[:2] == b[:2]:
        return 1.0
    if not len(a[2]) and not len(b[2]):
        return 0.0
    common = len(np.intersect1d(a[2], b[2], assume_unique=True))
    return common / (len(a[2]) + len(b[2]) - common)


def containment(a: tuple[int, int, np.ndarray], b: tuple[int, int, np.ndarray]) -> float:
    """Estimated share of a's shingles that b holds; b may be far longer."""
    if not len(a[2]):
        return 1.0 if a[:2] == b[:2] or a[0] == 0 else 0.0
    return len(np.intersect1d(a[2], b[2], assume_unique=True)) / len(a[2])


def merge(*kept: np.ndarray) -> np.ndarray:
    """Kept hashes of the texts together."""
    return np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.uint64)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", one_in: int = KEEP_ONE_IN) -> DataFrame:
    """``key``, n_shingles, fingerprint; one narrow stage."""
    docs = docs.select(F.col(key), F.col(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(sketches(*column_bytes(batch.column(1)), one_in))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([to_text(g) for g in got], pa.string())], [key, "n_shingles", "fingerprint"])

    return docs.mapInArrow(tidied(run), f"`{key}` {docs.schema[key].dataType.simpleString()}, n_shingles bigint, fingerprint string")


def _range_of(key: Column, starts: list, lo: int = 0) -> Column:
    """Number of the last start that is not above the key, as a balanced tree of comparisons."""
    if len(starts) == 1:
        return F.lit(lo)
    half = len(starts) // 2
    return F.when(key >= F.lit(starts[half]), _range_of(key, starts[half:], lo + half)).otherwise(_range_of(key, starts[:half], lo))


def with_successor(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of (turn, key, text) in key order within partitions; each partition ends with the row that follows it (turn 1).

    A pass over the keys alone finds where each range starts; then the
    texts cross the network once. Only the first rows of the ranges travel twice.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = docs.select(F.col(key).alias("key"))
    ranged = keys.repartitionByRange(parts, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("start"), F.count_if(F.col("key").isNull()).alias("nulls"))
    found = ranged.collect()  # one row for each partition
    starts = sorted({r["start"] for r in found if r["start"] is not None})
    nulls = sum(r["nulls"] for r in found)
    k = F.col("key")
    if not starts:
        starts = [0]
    home = F.when(k.isNull(), F.lit(0)).otherwise(_range_of(k, starts))
    last = len(starts) - 1
    overall_first = k.isNull() if nulls else k == F.lit(starts[0])
    guests = [F.when(overall_first, F.lit(last))]
    if last:
        guests.append(F.when(k.isin(starts[1:]), F.col("home") - 1))
    rows = docs.select(k if key == "key" else F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("home", home)
    seats = F.concat(F.array(F.struct(F.col("home").alias("at"), F.lit(0).alias("turn"))), *[F.when(g.isNotNull(), F.array(F.struct(g.cast("int").alias("at"), F.lit(1).alias("turn")))).otherwise(F.array().cast("array<struct<at:int,turn:int>>")) for g in guests])
    spread = rows.withColumn("seat", F.explode(seats)).select(F.col("seat.at").alias("at"), F.col("seat.turn").alias("turn"), "key", "text")
    return spread.repartitionById(len(starts), F.col("at")).sortWithinPartitions("turn", F.col("key").asc_nulls_first(), "text").select("turn", "key", "text")


def compare_edited(docs: DataFrame, key: str = "doc_id", text: str = "text", one_in: int = KEEP_ONE_IN) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last quarter is the beginning of the next document."""
    rows = with_successor(docs, key, text)
    kind = docs.schema[key].dataType.simpleString()
    out = pa.schema([("turn", pa.int64())])  # replaced below by the key's own type

    def finish(keys: list, texts: list[str]) -> pa.RecordBatch:
        """Texts of consecutive documents; the last one is only a successor."""
        edited = [t[: len(t) - (q := len(t) // 4)] + n[:q] for t, n in zip(texts, texts[1:])]
        own = list(sketches(*column_bytes(pa.array(texts, pa.large_string())), one_in))
        new = list(sketches(*column_bytes(pa.array(edited, pa.large_string())), one_in))
        n = len(edited)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(keys[:n], out.field(0).type), pa.array([len(t) for t in texts[:n]], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array([to_text(s) for s in own[:n]], pa.string()), pa.array([to_text(s) for s in new], pa.string()),
                pa.array([likeness(a, b) for a, b in zip(own, new)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(own, own[1:])], pa.float64()),
            ],
            [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal out
        keys: list = []
        texts: list[str] = []
        size, ended = 0, False
        for batch in batches:
            out = pa.schema([batch.schema.field(1)])
            for turn, k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if ended:
                    continue
                t = t.as_py() or ""
                keys.append(k)
                texts.append(t)
                size += len(t)
                ended = turn == 1
                if (size > 4 << 20 or ended) and len(texts) > 1:
                    yield finish(keys, texts)
                    keys, texts, size = keys[-1:], texts[-1:], len(t)

    return rows.mapInArrow(tidied(run), f"`{key}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
