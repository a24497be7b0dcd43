"""Document quality by a factorisation machine.

Inputs of a score: hashed words (a bucket's share of the text), structure
statistics (binned), and optional metadata columns (numbers are binned, other values are hashed). Each
input i has a weight w_i and a short vector v_i; pairs interact by <v_i, v_j>.
The pairwise sum is scored in time linear in the number of inputs:

    sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]

Fitting uses a bounded sample of the labelled rows: at most ``SAMPLE_PER_CLASS``
of each class, the smallest by hash of the key; of rows that repeat a key the smallest text, and no text above ``FITTED_BYTES``. Both classes weigh the same in the loss. Only
that sample is broadcast and only its features come to the driver. Scoring is one
narrow stage over all texts; the model (about 3 MB) is sent to the workers.

Edge cases: a null text is an empty one and gets a score. A null metadata value
has a bin of its own. Labelled keys that are repeated count once; with
conflicting labels, or a null label, not at all. With no usable label (or only one class) every score is
the share of label 1 (0.5 without labels). Empty tables give empty results. Other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tessera.llm.textkernel import column_bytes, release, shingles, slices, tidied, word_hashes, words

SAMPLE_PER_CLASS = 4_000
#: Longer texts (in bytes) are scored but not fitted on, which bounds what the driver takes: samples times this.
FITTED_BYTES = 1 << 20
BUCKETS = 1 << 16
BINS = 16
RANK = 8
EPOCHS = 6
BATCH = 256
RATE = 0.08
PENALTY = 1e-5
SEED = 7

_CLASS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "stop": (33, 44, 46, 58, 59, 63), "bang": (33,), "line": (10,), "wide": range(128, 256)}
_MARK = [b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:?!'\"-()"]
_TABLES = {k: np.isin(np.arange(256), list(v)).astype(np.int32) for k, v in {**_CLASS, "mark": _MARK}.items()}
_LETTER = np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]).astype(np.int32)
STATISTICS = (
    "log_chars", "word_length", "distinct_words", "top_word", "same_as_before", "distinct_pairs", "distinct_fives", "upper",
    "digit", "stop", "bang", "line", "wide", "mark", "bare_words", "marked_words",
)


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    run = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=run[1:])
    return run[offsets[1:]] - run[offsets[:-1]]


def _repeats(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the largest count of one value, of each text (texts below 2**16 in number, 48 bits of each value)."""
    n = len(begin) - 1
    owner = np.repeat(np.arange(n, dtype=np.uint64), np.diff(begin))
    key = np.sort((owner << np.uint64(48)) | (values >> np.uint64(16)))
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    counts = np.diff(np.append(edge, len(key)))
    owners = (key[edge] >> np.uint64(48)).astype(np.int64)
    most = np.zeros(n, dtype=np.int64)
    np.maximum.at(most, owners, counts)
    return np.bincount(owners, minlength=n), most


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(statistics [texts x len(STATISTICS)], owner, bucket, value) of one slice of texts; values have length 1 per text."""
    n = len(offsets) - 1
    starts, ends, first = words(data, offsets)
    h = word_hashes(data, starts, ends)
    n_words = np.diff(first)
    with np.errstate(divide="ignore", invalid="ignore"):
        chars = _sums(((data & 0xC0) != 0x80).astype(np.int32), offsets)
        count = {k: _sums(t[data], offsets) for k, t in _TABLES.items()}
        letters = count["upper"] + count["lower"]
        distinct, most = _repeats(h, first)
        same = np.zeros(len(h), dtype=np.int32)
        same[1:] = h[1:] == h[:-1]
        if len(h):
            same[first[:-1][n_words > 0]] = 0
        pairs, pairs_at = shingles(h, first, 2)
        fives, fives_at = shingles(h, first, 5)
        run = np.concatenate([[0], np.cumsum(_LETTER[data])])
        marks = np.concatenate([[0], np.cumsum(_TABLES["mark"][data])])
        bare = (run[ends] - run[starts] == 0).astype(np.int32)
        marked = (marks[ends] - marks[starts] > 0).astype(np.int32)
        columns = [
            np.log1p(chars), _sums((ends - starts).astype(np.int64), first) / n_words, distinct / n_words, most / n_words, _sums(same, first) / n_words,
            _repeats(pairs, pairs_at)[0] / np.diff(pairs_at), _repeats(fives, fives_at)[0] / np.diff(fives_at), count["upper"] / letters,
            *[count[k] / chars for k in ("digit", "stop", "bang", "line", "wide", "mark")], _sums(bare, first) / n_words, _sums(marked, first) / n_words,
        ]
    stats = np.stack(columns, axis=1)
    owner = np.repeat(np.arange(n), n_words)
    key, counts = np.unique(owner * buckets + (h & np.uint64(buckets - 1)).astype(np.int64), return_counts=True)
    owner, bucket = key // buckets, key % buckets
    value = counts / np.sqrt(np.maximum(np.bincount(owner, counts.astype(float) ** 2, minlength=n), 1e-12))[owner]
    return stats, owner, bucket, value


@dataclass
class Model:
    """w0, weights and vectors over [word buckets | statistic bins | metadata bins or buckets]."""

    edges: list[np.ndarray] = field(default_factory=list)
    w0: float = 0.0
    w: np.ndarray = field(default_factory=lambda: np.zeros(0))
    v: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    constant: float | None = None

    def inputs(self, stats: np.ndarray, owner: np.ndarray, bucket: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All inputs as (owner, index, value), sorted by owner."""
        n, m = stats.shape
        bins = np.empty((n, m), dtype=np.int64)
        for j, e in enumerate(self.edges):
            bins[:, j] = np.where(np.isnan(stats[:, j]), BINS - 1, np.searchsorted(e, stats[:, j], side="right"))
        index = BUCKETS + np.arange(m) * BINS + bins
        o = np.concatenate([owner, np.repeat(np.arange(n), m)])
        order = np.argsort(o, kind="stable")
        return o[order], np.concatenate([bucket, index.ravel()])[order], np.concatenate([value, np.full(n * m, 1.0)])[order]

    def margin(self, owner: np.ndarray, index: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of each text, and the sums of v_i x_i. Every text has at least its statistics, so no group is empty."""
        begin = np.searchsorted(owner, np.arange(n))
        vx = self.v[index] * x[:, None]
        total = np.add.reduceat(vx, begin, axis=0) if n else np.zeros((0, RANK))
        square = np.add.reduceat(vx * vx, begin, axis=0) if n else np.zeros((0, RANK))
        linear = np.add.reduceat(self.w[index] * x, begin) if n else np.zeros(0)
        return self.w0 + linear + 0.5 * (total**2 - square).sum(1), total

    def score(self, stats: np.ndarray, owner: np.ndarray, bucket: np.ndarray, value: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(stats), self.constant)
        out, _ = self.margin(*self.inputs(stats, owner, bucket, value), len(stats))
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit_model(stats: np.ndarray, owner: np.ndarray, bucket: np.ndarray, value: np.ndarray, label: np.ndarray) -> Model:
    """Adagrad on the class-balanced logistic loss."""
    n = len(label)
    share = float(label.mean()) if n else 0.5
    if n == 0 or share in (0.0, 1.0):
        return Model(constant=share)
    edges = []
    for j in range(stats.shape[1]):
        x = stats[:, j][~np.isnan(stats[:, j])]
        edges.append(np.unique(np.quantile(x, np.linspace(0, 1, BINS)[1:-1])) if len(x) else np.zeros(0))
    rng = np.random.default_rng(SEED)
    size = BUCKETS + stats.shape[1] * BINS
    model = Model(edges, 0.0, np.zeros(size), rng.normal(0, 0.02, (size, RANK)))
    o, i, x = model.inputs(stats, owner, bucket, value)
    begin = np.searchsorted(o, np.arange(n + 1))
    weight = np.where(label == 1, 0.5 / share, 0.5 / (1 - share))
    gw, gv, g0 = np.full(size, 1e-6), np.full((size, RANK), 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            rows = order[at : at + BATCH]
            take = np.concatenate([np.arange(begin[r], begin[r + 1]) for r in rows])
            own = np.repeat(np.arange(len(rows)), begin[rows + 1] - begin[rows])
            idx, val = i[take], x[take]
            out, total = model.margin(own, idx, val, len(rows))
            err = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - label[rows]) * weight[rows] / len(rows)
            used, back = np.unique(idx, return_inverse=True)
            dw = np.bincount(back, err[own] * val, minlength=len(used)) + PENALTY * model.w[used]
            per = (err[own] * val)[:, None] * (total[own] - model.v[idx] * val[:, None])
            dv = np.stack([np.bincount(back, per[:, f], minlength=len(used)) for f in range(RANK)], axis=1) + PENALTY * model.v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            g0 += err.sum() ** 2
            model.w[used] -= RATE * dw / np.sqrt(gw[used])
            model.v[used] -= RATE * dv / np.sqrt(gv[used])
            model.w0 -= RATE * err.sum() / np.sqrt(g0)
    model.w, model.v = model.w.astype(np.float32), model.v.astype(np.float32)
    return model


def _metadata(batch: pa.RecordBatch, at: int, names: tuple[str, ...], lo: int, hi: int, hashed: tuple[bool, ...]) -> list[np.ndarray]:
    """One column each: numbers as they are, others as bin-sized hashes; null is NaN."""
    out = []
    for j, h in enumerate(hashed):
        col = batch.column(at + j).slice(lo, hi - lo)
        if h:
            texts = col.cast(pa.string())
            data, offsets = column_bytes(texts)
            bins = (word_hashes(data, offsets[:-1], offsets[1:]) % np.uint64(BINS - 1)).astype(float)
            bins[~texts.is_valid().to_numpy(zero_copy_only=False)] = np.nan
            out.append(bins)
            continue
        raw = [None if v is None else float(v) for v in col.to_pylist()]
        out.append(np.array([np.nan if v is None else v for v in raw], dtype=float))
    return out


class QualityClassifier:
    """``fit`` on a labelled table, then ``score`` any table of texts."""

    def __init__(self, key: str = "doc_id", text: str = "text", metadata: tuple[str, ...] = (), sample_per_class: int = SAMPLE_PER_CLASS) -> None:
        self.key, self.text, self.metadata, self.sample_per_class = key, text, metadata, sample_per_class
        self.model = Model(constant=0.5)

    def _hashed(self, docs: DataFrame) -> tuple[bool, ...]:
        return tuple(not isinstance(docs.schema[m].dataType, NumericType) for m in self.metadata)

    def fit(self, docs: DataFrame, labels: DataFrame, label: str = "quality", where: Column | None = None) -> QualityClassifier:
        rows = labels.filter(where) if where is not None else labels
        clean = rows.filter(F.col(label).isin(0, 1) & F.col(self.key).isNotNull()).groupBy(F.col(self.key).alias("k")).agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("z")).filter("y = z")
        picked = [clean.filter(F.col("y") == c).select("k", "y").orderBy(F.xxhash64("k"), "k").limit(self.sample_per_class) for c in (0, 1)]
        sample = F.broadcast(picked[0].unionByName(picked[1]))
        meta = [F.col(m).alias(f"m{j}") for j, m in enumerate(self.metadata)]
        named = docs.select(F.col(self.key).alias("k"), F.col(self.text).alias("t"), *meta).filter(F.coalesce(F.octet_length("t"), F.lit(0)) <= FITTED_BYTES).join(sample, "k")
        # rows that repeat a sampled key give one row, the smallest; found task by task before the shuffle
        texts = named.groupBy("k").agg(F.min(F.struct("t", *[f"m{j}" for j in range(len(meta))], "y")).alias("r")).select("k", "r.*")
        hashed, names = self._hashed(docs), self.metadata

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = column_bytes(batch.column(1))
                for lo, hi in slices(offsets):
                    o = offsets[lo : hi + 1]
                    stats, owner, bucket, value = features(data[o[0] : o[-1]], o - o[0])
                    stats = np.column_stack([stats, *_metadata(batch, 2, names, lo, hi, hashed)]) if names else stats
                    cut = np.searchsorted(owner, np.arange(hi - lo + 1))
                    bucket, value = bucket.astype(np.int32), value.astype(np.float32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(lo, hi - lo), batch.column(batch.num_columns - 1).slice(lo, hi - lo), pa.array([s.tobytes() for s in stats], pa.binary()),
                            pa.array([bucket[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()), pa.array([value[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                        ],
                        ["k", "y", "stats", "bucket", "value"],
                    )

        kind = docs.schema[self.key].dataType.simpleString()
        got = texts.mapInArrow(tidied(run), f"k {kind}, y int, stats binary, bucket binary, value binary").toArrow()
        order = np.lexsort(([s.as_py() for s in got["stats"]], got["k"].to_numpy())) if got.num_rows else []
        got = got.take(pa.array(order, pa.int64()))
        stats = np.array([np.frombuffer(s.as_py()) for s in got["stats"]]) if got.num_rows else np.zeros((0, len(STATISTICS)))
        parts = [np.frombuffer(b.as_py(), np.int32) for b in got["bucket"]]
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts]) if parts else np.zeros(0, np.int64)
        join = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
        bucket = join(parts, np.int32)
        value = join([np.frombuffer(b.as_py(), np.float32) for b in got["value"]], np.float32)
        label_ = got["y"].to_numpy().astype(float)
        del got, parts
        self.model = fit_model(stats, owner, bucket.astype(np.int64), value.astype(float), label_)
        del owner, bucket, value
        release()  # the driver goes on with other work
        return self

    def score(self, docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """``key``, the columns in ``keep``, and score (0 to 1, higher: label 1 likelier)."""
        model = docs.sparkSession.sparkContext.broadcast(self.model)
        hashed, names = self._hashed(docs), self.metadata
        n_keep = 1 + len(keep)
        at = 1 + keep.index(self.text) if self.text in keep else n_keep  # a text that is kept crosses to Python once
        own = [] if self.text in keep else [F.col(self.text).alias("_text")]
        first_m = n_keep + len(own)
        rows = docs.select(F.col(self.key), *[F.col(f"`{c}`") for c in keep], *own, *[F.col(m).alias(f"_m{j}") for j, m in enumerate(names)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = column_bytes(batch.column(at))
                scores = [np.zeros(0)]
                for lo, hi in slices(offsets):
                    o = offsets[lo : hi + 1]
                    stats, *rest = features(data[o[0] : o[-1]], o - o[0])
                    stats = np.column_stack([stats, *_metadata(batch, first_m, names, lo, hi, hashed)]) if names else stats
                    scores.append(model.value.score(stats, *rest))
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], pa.array(np.concatenate(scores), pa.float64())], [*batch.schema.names[:n_keep], "score"])

        out = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (self.key, *keep)]
        return rows.mapInArrow(tidied(run), ", ".join([*out, "score double"]))




def held_out(key: Column) -> Column:
    """True where crc32(key as text) mod 5 is 0: those labels are never learned from. A null key is not held out (and has no label)."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))
