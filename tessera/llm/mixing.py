"""Mixing to target weights with soft domain membership.

1. A softmax classifier, fitted on a labelled table (key, domain), predicts each
   document's domain posteriors from the words and word beginnings that occur in it.
   Fitting uses at most ``SAMPLE_PER_DOMAIN`` rows of each domain, the smallest by
   hash of the key (of rows that repeat a key the smallest text, and no text above ``FITTED_BYTES``); class shares of the whole labelled table are its prior.
2. Nonnegative document rates r are fitted so that the expected tokens of each domain,
   sum_i r_i * tokens_i * p_id, match the targets: least squares, with a pull of weight ``RIDGE`` towards
   rate 1 that makes the solution unique, by projected gradient. The gradient of every document is p_i . (target - now), so
   the sum m of all steps so far is one vector, and a step projects 1 + p_i . m onto the
   nonnegative rates: r_i = max(0, 1 + p_i . m). Steps are scaled by the Gram matrix of the posteriors of documents
   whose rate is not 0, and halved until the objective falls enough; about ten passes reach the optimum. What targets
   can't be reached by soft membership is given as residual with the result. Distances between rates are weighted by tokens, so a
   rate depends on a document's posteriors, not on its length.

A pass adds up D + D^2 + 1 sums over the written (tokens, posteriors) table, in
tasks and then by Spark; rates are recomputed from m, so no rate is ever collected or rewritten. Tokens are those of a tokenizer file, a column that the caller names, or words.

Edge cases: a null text has no tokens; it gets a rate, and no weight. A target
domain that no label names is left out (the others share its weight); a domain
without tokens can't be matched and leaves a residual. Labelled keys that are null or have
several domains are not learned from. Without tokens, or with fewer than two domains, all rates
are 1. Repeated rows count as often as they occur. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.encoders import ByteBpe, kept
from tessera.llm.shared import Scratch
from tessera.llm.textkernel import column_bytes, release, slices, tidied, word_hashes, words

SAMPLE_PER_DOMAIN = 3_000
#: Domains up to which each is sampled by a query of its own.
FEW = 64
#: Buckets of whole words and of beginnings, whatever the number of domains.
BUCKETS = 1 << 17
#: Most weights of all domains together (float32): with the default buckets 128 domains. More are refused, not fitted otherwise.
WEIGHTS = 1 << 25
#: Longer texts (in bytes) are rated but not fitted on, which bounds what the driver takes.
FITTED_BYTES = 1 << 20
EPOCHS = 6
BATCH = 128
RATE = 0.1
PENALTY = 1e-4
SEED = 11
#: The fit ends when no domain's gradient is above this share of all tokens.
TOLERANCE = 1e-7
#: Weight of (rate - 1)^2 against the squared miss of the targets. More of it spares documents that only may belong to an unwanted domain.
RIDGE = 1e-4


def presence(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, owner, bucket): hashed words and hashed four-byte word beginnings that occur, once each."""
    starts, ends, first = words(data, offsets)
    n_words = np.diff(first)
    owner = np.repeat(np.arange(len(n_words)), n_words)
    whole = (word_hashes(data, starts, ends, lower=True) & np.uint64(buckets - 1)).astype(np.int64)
    front = (word_hashes(data, starts, np.minimum(ends, starts + 4), lower=True) & np.uint64(buckets - 1)).astype(np.int64) + buckets
    key = np.unique(np.concatenate([owner, owner]) * (2 * buckets) + np.concatenate([whole, front]))
    return n_words, key // (2 * buckets), key % (2 * buckets)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class DomainClassifier:
    """``fit`` on a labelled table, then ``members`` of any table of texts."""

    def __init__(self, key: str = "doc_id", text: str = "text", sample_per_domain: int = SAMPLE_PER_DOMAIN, buckets: int = BUCKETS) -> None:
        self.key, self.text, self.sample_per_domain = key, text, sample_per_domain
        self.domains: list[str] = []
        self.buckets = buckets
        self.weights, self.bias = np.zeros((2 * buckets, 0), np.float32), np.zeros(0)

    def fit(self, docs: DataFrame, labelled: DataFrame) -> DomainClassifier:
        """``labelled``: key, domain (text)."""
        rows = labelled.select(F.col(self.key).alias("k"), F.col("domain").cast("string").alias("d")).filter("k is not null and d is not null")
        clean = rows.groupBy("k").agg(F.min("d").alias("d"), F.max("d").alias("e")).filter("d = e").select("k", "d")
        counts = {r["d"]: r["n"] for r in clean.groupBy("d").agg(F.count("*").alias("n")).collect()}  # a row for each domain
        self.domains = sorted(counts)
        if not self.domains:
            return self
        if 2 * self.buckets * len(self.domains) > WEIGHTS:
            raise ValueError(f"{len(self.domains)} domains: the classifier holds at most {WEIGHTS // (2 * self.buckets)}; choose fewer buckets for more domains")
        picked = None
        if len(self.domains) <= FEW:  # each domain's smallest hashes: no task gets a whole domain
            for d in self.domains:
                one = clean.filter(F.col("d") == d).orderBy(F.xxhash64("k"), "k").limit(self.sample_per_domain)
                picked = one if picked is None else picked.unionByName(one)
        else:
            place = Window.partitionBy("d").orderBy(F.xxhash64("k"), "k")
            picked = clean.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= self.sample_per_domain).drop("_n")
        buckets = self.buckets
        named = docs.select(F.col(self.key).alias("k"), F.col(self.text).alias("t")).filter(F.coalesce(F.octet_length("t"), F.lit(0)) <= FITTED_BYTES).join(F.broadcast(picked), "k")
        texts = named.groupBy("k", "d").agg(F.min("t").alias("t")).select("k", "t", "d")  # one row a key, found task by task before the shuffle

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = column_bytes(batch.column(1))
                for lo, hi in slices(offsets):
                    o = offsets[lo : hi + 1]
                    _, owner, bucket = presence(data[o[0] : o[-1]], o - o[0], buckets)
                    cut, bucket = np.searchsorted(owner, np.arange(hi - lo + 1)), bucket.astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([bucket[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], ["k", "d", "bucket"])

        kind = docs.schema[self.key].dataType.simpleString()
        got = texts.mapInArrow(tidied(run), f"k {kind}, d string, bucket binary").toArrow()
        parts = [np.frombuffer(b.as_py(), np.int32) for b in got["bucket"]]
        number = {d: i for i, d in enumerate(self.domains)}
        y = np.array([number[d] for d in got["d"].to_pylist()], dtype=np.int64)
        order = sorted(range(len(parts)), key=lambda i: (str(got["k"][i]), parts[i].tobytes()))
        del got
        self._learn([parts[i] for i in order], y[order] if len(y) else y, np.array([counts[d] for d in self.domains], float))
        del parts
        release()  # the driver goes on with other work
        return self

    def _learn(self, parts: list[np.ndarray], y: np.ndarray, counts: np.ndarray) -> None:
        n, k = len(parts), len(self.domains)
        w, b, g = np.zeros((2 * self.buckets, k)), np.zeros(k), np.full((2 * self.buckets, k), 1e-4)
        seen = np.bincount(y, minlength=k) if n else np.zeros(k)
        weight = n / (k * np.maximum(seen, 1))
        rng = np.random.default_rng(SEED)
        for _ in range(EPOCHS if n else 0):
            order = rng.permutation(n)
            for at in range(0, n, BATCH):
                rows = order[at : at + BATCH]
                own = np.repeat(np.arange(len(rows)), [len(parts[r]) for r in rows])
                idx = np.concatenate([parts[r] for r in rows]).astype(np.int64)
                z = np.stack([np.bincount(own, w[idx, d], minlength=len(rows)) for d in range(k)], axis=1) + b
                err = _softmax(z)
                err[np.arange(len(rows)), y[rows]] -= 1
                err *= (weight[y[rows]] / len(rows))[:, None]
                used, back = np.unique(idx, return_inverse=True)
                dw = np.stack([np.bincount(back, err[own, d], minlength=len(used)) for d in range(k)], axis=1) + PENALTY * w[used]
                g[used] += dw**2
                w[used] -= RATE * dw / np.sqrt(g[used])
                b -= RATE * err.sum(0)
        self.weights = w.astype(np.float32)
        self.bias = b + np.log(np.maximum(counts, 1) / max(1.0, counts.sum()))

    def members(self, docs: DataFrame, keep: tuple[str, ...] = (), tokenizer: str | None = None) -> DataFrame:
        """``key``, the columns in ``keep``, n_words, p (posteriors in the order of ``domains``), and with ``tokenizer`` (a byte-level BPE file) n_tokens."""
        model = docs.sparkSession.sparkContext.broadcast((self.weights, self.bias))
        k, n_keep, buckets = len(self.domains), 1 + len(keep), self.buckets
        at = 1 + keep.index(self.text) if self.text in keep else n_keep
        own = [] if self.text in keep else [F.col(self.text).alias("_text")]
        rows = docs.select(F.col(self.key), *[F.col(f"`{c}`") for c in keep], *own)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, b = model.value
            for batch in batches:
                data, offsets = column_bytes(batch.column(at))
                sizes, post = [np.zeros(0, np.int64)], [np.zeros((0, k))]
                tokens = [pa.array(kept(ByteBpe, tokenizer).count([t or "" for t in batch.column(at).to_pylist()]), pa.int64())] if tokenizer else []
                for lo, hi in slices(offsets):
                    o = offsets[lo : hi + 1]
                    n_words, owner, bucket = presence(data[o[0] : o[-1]], o - o[0], buckets)
                    z = np.stack([np.bincount(owner, w[bucket, d], minlength=hi - lo) for d in range(k)], axis=1) + b if k else np.zeros((hi - lo, 0))
                    sizes.append(n_words)
                    post.append(_softmax(z) if k else z)
                p = np.concatenate(post)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * k), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], pa.array(np.concatenate(sizes)), lists, *tokens], [*batch.schema.names[:n_keep], "n_words", "p", *counted])

        counted = ["n_tokens"] if tokenizer else []
        out = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (self.key, *keep)]
        return rows.mapInArrow(tidied(run), ", ".join([*out, "n_words bigint", "p array<double>", *[f"{c} bigint" for c in counted]]))


def _rate(m: np.ndarray) -> Column:
    """The rate, from the posteriors."""
    dot = sum((F.col("p")[d] * F.lit(float(x)) for d, x in enumerate(m)), F.lit(0.0))
    return F.greatest(F.lit(0.0), 1.0 + dot)


def _sums(members: DataFrame, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(expected tokens of each domain, Gram matrix of documents whose rate is not 0, half the sum of tokens times squared rates)."""
    k = len(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, gram, square = np.zeros(k), np.zeros((k, k)), 0.0
        for batch in batches:
            n = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            r = np.maximum(0.0, 1.0 + p @ m)
            total += (n * r) @ p
            gram += (p * (n * (r > 0))[:, None]).T @ p
            square += float(n @ (r * r)) / 2
        values = np.concatenate([total, gram.ravel(), [square]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["at", "value"])

    rows = members.select("n_words", "p").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()  # D + D^2 + 1 rows
    values = np.zeros(k + k * k + 1)
    values[rows["at"].to_numpy()] = rows["value"].to_numpy()
    return values[:k], values[k:-1].reshape(k, k), float(values[-1])


def fit_rates(members: DataFrame, targets: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray]:
    """(m, expected tokens of each domain reached). ``members``: a written table with n_words and p; ``targets``: tokens of each domain."""
    k = len(targets)
    m = np.zeros(k)
    if k < 1:
        return m, m
    now, some, square = _sums(members, m)
    every = some
    cost = lambda m, square: ridge / 2 * m @ every @ m + square - targets @ m
    while True:
        gradient = ridge * every @ m + now - targets
        if np.abs(gradient).max() <= TOLERANCE * max(1.0, float(targets.sum())):
            return m, now
        step, share = -np.linalg.pinv(ridge * every + some, hermitian=True) @ gradient, 1.0
        while True:
            got = _sums(members, m + share * step)
            if cost(m + share * step, got[2]) <= cost(m, square) + 1e-4 * share * gradient @ step:
                break
            share /= 2
            if share < 1e-6:  # as near as doubles come
                return m, now
        m = m + share * step
        now, some, square = got


def target_tokens(members: DataFrame, domains: list[str], weights: dict[str, float], upsample: float | None = None) -> np.ndarray:
    """Tokens wanted of each domain. The total is the present one; with ``upsample``, so large that no wanted domain shrinks, times ``upsample``;
    domains that ``weights`` doesn't name then keep their tokens, besides that total."""
    now = _sums(members, np.zeros(len(domains)))[0] if domains else np.zeros(0)
    want = np.array([max(0.0, weights.get(d, 0.0)) for d in domains])
    if want.sum() <= 0:
        return now
    want /= want.sum()
    total = now.sum() if upsample is None else upsample * max((n / w for n, w in zip(now, want) if w > 0), default=0.0)
    return want * total if upsample is None else np.where([d in weights for d in domains], want * total, now)


def mixing_rates(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], upsample: float | None = None, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), tokens: str | None = None, ridge: float = RIDGE, tokenizer: str | None = None) -> DataFrame:
    """``key``, the columns in ``keep``, n_words, domain (likeliest), p and rate of every row, and residual: the largest share of all tokens by
    which a domain's expected tokens miss their target.

    ``tokenizer`` names a byte-level BPE file: its tokens are counted (n_tokens, also returned) in the pass that predicts. ``tokens`` names a column of counts
    instead; without both, words are counted.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    classifier = DomainClassifier(key, text).fit(docs, labelled)
    extra = (tokens,) if tokens and tokens not in keep else ()
    members = scratch.save(classifier.members(docs, keep + extra, tokenizer), "members")
    tokens, counted = ("n_tokens", ("n_tokens",)) if tokenizer else (tokens, ())
    k = len(classifier.domains)
    m, residual = np.zeros(k), 0.0
    if k >= 2:
        facts = members.select(F.coalesce(F.col(f"`{tokens}`") if tokens else F.col("n_words"), F.lit(0)).alias("n_words"), "p")
        wanted = target_tokens(facts, classifier.domains, weights, upsample)
        m, reached = fit_rates(facts, wanted, ridge)
        residual = float(np.abs(wanted - reached).max() / max(1.0, float(wanted.sum())))
    names = F.array(*[F.lit(d) for d in classifier.domains]).cast("array<string>")
    likeliest = F.element_at(names, F.array_position("p", F.array_max("p")).cast("int")) if k else F.lit(None).cast("string")
    return members.select(key, *[F.col(f"`{c}`") for c in keep], "n_words", *counted, likeliest.alias("domain"), "p", _rate(m).alias("rate"), F.lit(residual).alias("residual"))


def copies(rate: Column, key: Column) -> Column:
    """How often a row is taken: the rate, rounded up or down by a hash of the key."""
    draw = F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(1 << 30)).cast("double") / float(1 << 30)
    return F.floor(rate + draw).cast("int")
