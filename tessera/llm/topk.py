"""Exact top-k inner-product search by norm buckets.

Vectors are grouped by length (norm) into buckets. For a query with lower bound
``t`` on its k-th best score, a bucket whose longest vector is ``m`` needs a
cosine of at least ``t / (|q| m)``: its local threshold. Above 1 the bucket is
skipped. For a high threshold each coordinate of a hit is confined to an interval
(coordinate pruning, on the query's largest coordinates); for a low one, vectors that are
too short are cut off the bucket's descending order (length pruning). What is
left is verified with exact integer products.

Buckets are met level by level, the longest first, each level ``GROWTH`` times as many as all before.
After a level the k best so far are written, and their last scores are the bounds of the
next level; inside a task bounds rise from bucket to bucket. So a level gives about
``k * GROWTH`` rows a query, whatever the number of buckets.

Vectors cross the network once, when buckets are made. Queries travel instead: they are cut
into chunks of at most ``CHUNK`` rows (bounded in bytes by ``CHUNK_BYTES``), a chunk is broadcast with its
bounds, and every task meets it with the buckets that it reads in place.

Edge cases: vectors that are null, empty, or hold null or non-finite components
take no part. Vectors of another length (dimension) than the query's are no
candidates. Ties go to the smaller id. Repeated ids are separate rows; query rows that
repeat an id are answered as one query, and a row with the query's own id is never its candidate. A null id takes no part.
Components of any finite size take part: products that doubles can't hold exactly are made with whole
numbers of any length, and a score beyond the range of a long counts as the nearest long. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import Scratch
from tessera.llm.textkernel import tidied

#: Rows of a bucket.
BLOCK = 2048
#: Queries of a chunk, and the most bytes that their vectors may have.
CHUNK = 32_768
CHUNK_BYTES = 32 << 20
#: Queries that meet a bucket in one matrix product.
TILE = 512
#: Each level has so many times the buckets of the ones before.
GROWTH = 16
#: Coordinates that a query checks in coordinate pruning.
FOCUS = 4
#: Local cosine threshold from which coordinate pruning is taken.
COORDINATE_FROM = 0.6
#: Hits that a task holds before it cuts them to the k best.
HELD = 1 << 20
#: Products below this are exact in doubles.
_EXACT = 2.0**53
_LONG = (-(2**63), 2**63 - 1)

_PACKED = "level int, dim int, ids binary, rows binary"
_HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
COUNTS = ("pairs", "skipped", "by_length", "by_coordinate", "verified")


def usable(vectors: DataFrame, scale: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, x (doubles), norm2 of the vectors that take part; norm2 is that of floor(scale * x), for the order only."""
    x = F.col("x")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.transform(F.col(vector), lambda c: c.cast("double")).alias("x"))
    rows = rows.filter(F.col("id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, finite))
    whole = lambda c: F.when(F.abs(c * scale) < 2.0**52, F.floor(c * scale).cast("double")).otherwise(c * scale)
    return rows.withColumn("norm2", F.aggregate("x", F.lit(0.0), lambda a, c: a + whole(c) * whole(c)))


def _whole(x: np.ndarray, scale: int) -> list[int]:
    """floor(scale * x) as whole numbers of any size."""
    return [math.floor(v * scale) if math.isfinite(v * scale) else int(v) * scale for v in x.tolist()]


class Vectors:
    """Ids and vectors of one dimension, as whole numbers in doubles. ``wide``: rows that doubles can't hold well."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, scale: int) -> None:
        self.ids, self.x, self.scale = ids, x, scale
        with np.errstate(over="ignore"):
            self.v = np.floor(x * scale)
            self.norm = np.sqrt((self.v * self.v).sum(axis=1))
        self.most = np.abs(self.v).max(axis=1, initial=0)

    def take(self, at: np.ndarray) -> Vectors:
        return Vectors(self.ids[at], self.x[at], self.scale)


def _clamp(n: int) -> int:
    return min(max(n, _LONG[0]), _LONG[1])


def products(rows: Vectors, queries: Vectors) -> np.ndarray:
    """Exact scores, row by query, as longs (doubles where those are exact for all pairs)."""
    dim = max(1, rows.x.shape[1])
    if float(rows.most.max(initial=0)) * float(queries.most.max(initial=0)) * dim < _EXACT:
        return rows.v @ queries.v.T
    out = np.zeros((len(rows.ids), len(queries.ids)), np.int64)
    q_all = [_whole(q, rows.scale) for q in queries.x]
    with np.errstate(over="ignore", invalid="ignore"):
        fast = (rows.most[:, None] * queries.most[None, :]) * dim < _EXACT
    if fast.any():
        r, q = np.flatnonzero(fast.any(axis=1)), np.flatnonzero(fast.any(axis=0))
        with np.errstate(over="ignore", invalid="ignore"):
            part = rows.v[r] @ queries.v[q].T
        ok = fast[np.ix_(r, q)]
        out[np.ix_(r, q)] = np.where(ok, part, 0).astype(np.int64)
    for i in np.flatnonzero(~fast.all(axis=1)):
        row = _whole(rows.x[i], rows.scale)
        for j in np.flatnonzero(~fast[i]):
            out[i, j] = _clamp(sum(a * b for a, b in zip(row, q_all[j])))
    return out


class Bucket:
    """Vectors in descending length, with sorted coordinates made when first needed."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, scale: int) -> None:
        all_ = Vectors(ids, x, scale)
        self.rows = all_.take(np.argsort(-all_.norm, kind="stable"))
        self._lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self._lists:
            norm = self.rows.norm
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.divide(self.rows.v[:, f], norm, out=np.zeros(len(norm)), where=norm > 0)
            x[~np.isfinite(norm)] = np.nan
            order = np.argsort(x, kind="stable")  # not a number: last, and always a hit
            self._lists[f] = (x[order], order)
        return self._lists[f]

    def local(self, size: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Cosine that a hit needs in this bucket; 0 where nothing can be excluded."""
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            got = np.where(bound > 0, bound / (size * self.rows.norm[0]), 0.0)
        return np.where(np.isnan(got), 0.0 if self.rows.norm[0] > 0 else np.inf, got)

    def reach(self, size: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Length pruning: how many of the longest rows may reach the bound."""
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(bound > 0, bound / size * (1 - 1e-9), 0.0)
        return np.where(bound > 0, np.searchsorted(-self.rows.norm, -np.nan_to_num(least, nan=0.0), side="right"), len(self.rows.ids))

    def near(self, q: np.ndarray, size: float, local: float, short: int) -> np.ndarray:
        """Coordinate pruning: of the ``short`` longest rows, those inside the intervals of the query's largest coordinates."""
        unit = q / size
        hits = np.zeros(len(self.rows.ids), dtype=np.int8)
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        width = np.arccos(min(local, 1.0))
        for f in focus:
            # a hit is at most ``width`` away from the query, which is ``angle`` away from this axis
            angle = np.arccos(min(1.0, max(-1.0, unit[f])))
            low = np.cos(angle + width) if angle + width < np.pi else -1.0
            high = np.cos(angle - width) if angle > width else 1.0
            x, order = self.coordinate(int(f))
            known = int(np.searchsorted(x, np.inf, side="right"))
            a, b = np.searchsorted(x[:known], low - 1e-9, side="left"), np.searchsorted(x[:known], high + 1e-9, side="right")
            hits[order[a:b]] += 1
            hits[order[known:]] += 1
        return np.flatnonzero(hits[:short] == len(focus))


def _best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best by (score descending, id ascending)."""
    order = np.lexsort((ids, ~scores, q))
    s = q[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    rank = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
    return order[rank < k]


class Search:
    """A chunk of queries against many buckets; keeps the k best of each query and lifts its bound."""

    def __init__(self, queries: Vectors, bound: np.ndarray, k: int) -> None:
        order = np.argsort(queries.ids, kind="stable")
        self.q, self.bound, self.k = queries.take(order), bound[order].copy(), k
        self.names, self.number = np.unique(self.q.ids, return_inverse=True)  # rows that repeat an id are one query
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0
        self.counts = dict.fromkeys(COUNTS, 0)

    def _add(self, rows: Vectors, at: np.ndarray) -> None:
        """Exact products of some rows with some queries; hits above the bounds are held."""
        if not len(rows.ids) or not len(at):
            return
        for lo in range(0, len(at), TILE):
            part = at[lo : lo + TILE]
            s = products(rows, self.q.take(part)).T  # a query in each row
            self.counts["verified"] += s.size
            wide = s.dtype == np.int64
            lowest = _LONG[0] if wide else -np.inf
            own = rows.ids[None, :] == self.q.ids[part][:, None]
            bound = self.bound[part]
            hit = ~own & (s >= bound[:, None])
            if s.shape[1] > self.k and int(hit.sum()) > 8 * self.k * len(part):  # bounds that don't bind yet
                kth = np.partition(np.where(own, lowest, s), s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
                hit &= s >= kth[:, None]
            i, j = np.nonzero(hit)
            self.held.append((self.number[part][i], rows.ids[j], s[i, j].astype(np.int64)))
            self.size += len(i)
            if self.size > HELD:
                self.trim()

    def trim(self) -> None:
        if not self.held:
            return
        q, ids, scores = (np.concatenate(x) for x in zip(*self.held))
        at = _best(q, ids, scores, self.k)
        q, ids, scores = q[at], ids[at], scores[at]
        self.held, self.size = [(q, ids, scores)], len(q)
        full = np.bincount(q, minlength=len(self.names)) == self.k
        last = np.full(len(self.names), -np.inf)
        low = np.full(len(self.names), np.inf)
        np.minimum.at(low, q, np.nextafter(scores.astype(np.float64), -np.inf))
        last[full] = low[full]
        self.bound = np.maximum(self.bound, last[self.number])

    def meet(self, bucket: Bucket) -> None:
        rows, n = bucket.rows, len(bucket.rows.ids)
        self.counts["pairs"] += n * len(self.q.ids)
        usable_bound = np.where(np.isfinite(self.q.norm), self.bound, -np.inf)
        local = bucket.local(self.q.norm, usable_bound)
        skip = local > 1 + 1e-9
        self.counts["skipped"] += n * int(skip.sum())
        short = bucket.reach(self.q.norm, usable_bound)
        self.counts["by_length"] += int((n - short)[~skip].sum())
        sharp = ~skip & (local >= COORDINATE_FROM) & (self.q.norm > 0)
        for i in np.flatnonzero(sharp):
            near = bucket.near(self.q.v[i], float(self.q.norm[i]), float(local[i]), int(short[i]))
            self.counts["by_coordinate"] += int(short[i]) - len(near)
            self._add(rows.take(near), np.array([i]))
        rest = np.flatnonzero(~skip & ~sharp & (short > 0))
        rest = rest[np.argsort(short[rest], kind="stable")]
        for lo in range(0, len(rest), TILE):  # queries of like reach share one product
            part = rest[lo : lo + TILE]
            self._add(rows if short[part].max() == n else rows.take(np.arange(int(short[part].max()))), part)
        self.trim()

    def result(self) -> pa.RecordBatch:
        self.trim()
        q, ids, scores = self.held[0] if self.held else (np.zeros(0, np.int64),) * 3
        return pa.RecordBatch.from_arrays([pa.array(self.names[q]), pa.array(ids), pa.array(scores)], schema=_HITS)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (level, id, x) in descending length as buckets, those of one dimension together."""
    held: dict[int, list] = {}

    def bucket(dim: int, level: int, rows: list) -> pa.RecordBatch:
        ids = np.concatenate([r[0] for r in rows])
        x = np.concatenate([r[1] for r in rows])
        return pa.RecordBatch.from_arrays([pa.array([level], pa.int32()), pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["level", "dim", "ids", "rows"])

    level = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        level = int(batch.column(0)[0].as_py())
        lists = batch.column(2)
        flat, cuts = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
        dims, ids = np.diff(cuts), batch.column(1).to_numpy()
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            x = flat[(cuts[at][:, None] + np.arange(dim)).ravel()].reshape(-1, dim)
            rows = [*held.pop(dim, []), (ids[at], x)]
            all_ids, all_x = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
            done = len(all_ids) // BLOCK * BLOCK
            for lo in range(0, done, BLOCK):
                yield bucket(dim, level, [(all_ids[lo : lo + BLOCK], all_x[lo : lo + BLOCK])])
            if done < len(all_ids):
                held[dim] = [(all_ids[done:], all_x[done:])]
    for dim, rows in held.items():
        yield bucket(dim, level, rows)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Query rows (id, x) as packed chunks of one dimension."""
    held: dict[int, list] = {}

    def give(dim: int, rows: list) -> pa.RecordBatch:
        ids, x = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64).reshape(len(rows), dim)
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["dim", "ids", "rows"])

    for batch in batches:
        for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = x.values.to_numpy(zero_copy_only=False)
            rows = held.setdefault(len(x), [])
            rows.append((i, x))
            if len(rows) >= CHUNK or len(rows) * len(x) * 8 >= CHUNK_BYTES:
                yield give(len(x), held.pop(len(x)))
    for dim, rows in held.items():
        yield give(dim, rows)


def _buckets(vectors: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(level, dim, ids, rows) of all buckets, written by level; and how many levels there are."""
    n = vectors.count()
    parts = max(1, -(-n // (4 * BLOCK)))
    # without a tie-breaker a norm that many rows share would be one partition
    sorted_ = vectors.repartitionByRange(parts, F.desc("norm2"), "id").withColumn("part", F.spark_partition_id()).sortWithinPartitions(F.desc("norm2"), "id")
    last = [1]
    while last[-1] < max(parts, 1 << 20):
        last.append(last[-1] * GROWTH)
    level = F.lit(0)
    for b in last:
        level = level + (F.col("part") >= b).cast("int")
    packed = sorted_.select(level.alias("level"), "id", "x").mapInArrow(tidied(_pack), _PACKED)
    written = scratch.save(packed, "buckets", by="level")
    top = written.agg(F.max("level")).first()[0]
    return written, 0 if top is None else top + 1


def _kernel(shared, k: int, scale: int, counting: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, ids, rows, bound = shared.value
        chunk = Vectors(np.frombuffer(ids, np.int64), np.frombuffer(rows, np.float64).reshape(-1, dim), scale)
        search = Search(chunk, bound, k)
        for batch in batches:
            for d, i, x in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if d == dim:
                    search.meet(Bucket(np.frombuffer(i.as_py(), np.int64), np.frombuffer(x.as_py(), np.float64).reshape(-1, d), scale))
        if counting:
            yield pa.RecordBatch.from_arrays([pa.array([search.counts[c]], pa.int64()) for c in COUNTS], list(COUNTS))
        else:
            yield search.result()

    return run


def _k_best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame | None = None, k: int = 20, scale: int = 64, every: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of each query's ``k`` best rows other than its own id.

    ``queries``: a table like ``vectors``; default: the rows whose id is divisible by ``every``.
    """
    return _run(vectors, queries, k, scale, every, key, vector)[0]


def pruning(vectors: DataFrame, queries: DataFrame | None = None, k: int = 20, scale: int = 64, every: int = 20, key: str = "vec_id", vector: str = "embedding") -> dict[str, int]:
    """What the search excludes: pairs of a query and a row, those skipped with their bucket, cut off by length, by coordinates, and verified."""
    return _run(vectors, queries, k, scale, every, key, vector, True)[1]


def _run(vectors: DataFrame, queries: DataFrame | None, k: int, scale: int, every: int, key: str, vector: str, counting: bool = False) -> tuple[DataFrame, dict[str, int]]:
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    rows = usable(vectors, scale, key, vector)
    asked = rows.filter(F.pmod("id", F.lit(every)) == 0) if queries is None else usable(queries, scale, key, vector)
    buckets, levels = _buckets(rows, scratch)
    packed = scratch.save(asked.select("id", "x").repartition(max(1, -(-asked.count() // CHUNK))).mapInArrow(tidied(_chunks), "dim int, ids binary, rows binary").withColumn("chunk", F.monotonically_increasing_id()), "queries")
    counts = dict.fromkeys(COUNTS, 0)
    done: DataFrame | None = None
    for c, dim in sorted((r["chunk"], r["dim"]) for r in packed.select("chunk", "dim").collect()):  # two numbers for each chunk
        one = packed.filter(F.col("chunk") == c).first()
        ids = np.frombuffer(one["ids"], np.int64)
        best: DataFrame | None = None
        bound = np.full(len(ids), -np.inf)
        for level in range(levels):
            shared = spark.sparkContext.broadcast((dim, bytes(one["ids"]), bytes(one["rows"]), bound))
            inside = buckets.filter(F.col("level") == level).select("dim", "ids", "rows")
            if counting:
                got = inside.mapInArrow(tidied(_kernel(shared, k, scale, True)), ", ".join(f"{n} bigint" for n in COUNTS)).agg(*[F.sum(n).alias(n) for n in COUNTS]).first()
                counts = {n: counts[n] + (got[n] or 0) for n in COUNTS}
            found = inside.mapInArrow(tidied(_kernel(shared, k, scale, False)), "query_id long, vec_id long, score long")
            found = found if best is None else found.unionByName(best.select("query_id", "vec_id", "score"))
            last_level = level + 1 == levels
            best = scratch.save(_k_best(found, k), f"result/{c}" if last_level else f"best-{c}-{level}")
            shared.unpersist()
            if level:
                scratch.drop(f"best-{c}-{level - 1}")
            if not last_level:
                last = best.filter(F.col("rank") == k).select("query_id", "score").toArrow()  # one row for each query of the chunk
                names, scores = last["query_id"].to_numpy(), last["score"].to_numpy()
                order = np.argsort(names)
                names, scores = names[order], scores[order]
                at = np.minimum(np.searchsorted(names, ids), max(0, len(names) - 1))
                known = names[at] == ids if len(names) else np.zeros(len(ids), bool)
                bound = np.full(len(ids), -np.inf)
                if len(names):
                    bound[known] = np.nextafter(scores[at[known]].astype(np.float64), -np.inf)
        done = best if done is None else done
    if done is None:
        done = spark.createDataFrame([], "query_id long, vec_id long, score long, rank int")
    else:  # the results of all chunks
        done = spark.read.schema(done.schema).option("recursiveFileLookup", "true").parquet(f"{scratch.path}/result")
    return done.select("query_id", "rank", "vec_id", "score"), counts
