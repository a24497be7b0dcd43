"""Sketches, likenesses and successors against plain Python over all documents; estimates against true overlaps."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import fingerprint
from tessera.llm.textkernel import column_bytes

BAR = ((1 << 64) - 1) // fingerprint.KEEP_ONE_IN


def _shingles(text):
    """Distinct five-word runs of a text, or its whole sequence where that is shorter; letters as the operator sees them."""
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {b" ".join(w)} if w else set()


class _Hashes:
    """The hash of each shingle, taken from a text that is this shingle alone."""

    def __init__(self):
        self.known = {}

    def learn(self, shingles):
        new = sorted(set(shingles) - self.known.keys())
        if new:
            got = fingerprint.sketches(*column_bytes(pa.array([s.decode() for s in new], pa.large_string())), 1)
            for s, (n, total, kept) in zip(new, got):
                assert n == 1 and kept.tolist() == [total]
                self.known[s] = total

    def sketch(self, text):
        s = _shingles(text)
        self.learn(s)
        values = sorted({self.known[x] for x in s})
        return len(values), sum(values) % (1 << 64), [v for v in values if v <= BAR]


def _likeness(a, b):
    if a[:2] == b[:2]:
        return 1.0
    both = set(a[2]) | set(b[2])
    return len(set(a[2]) & set(b[2])) / len(both) if both else 0.0


def _rows(docs):
    """What the contract says, one document after the other."""
    docs = sorted((k, t or "") for k, t in docs)
    hashes, out = _Hashes(), {}
    for i, (k, t) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q]
        own, new, nxt = (hashes.sketch(x) for x in (t, edited, following))
        text = [f"{n:x}.{s:016x}.{fingerprint.base64.b64encode(np.array(kept, '<u8').tobytes()).decode()}" for n, s, kept in (own, new)]
        out[k] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), *text, _likeness(own, new), _likeness(own, nxt))
    return out


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_all_documents(spark, sf_dir, partitions):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = {r.doc_id: tuple(r)[1:] for r in fingerprint.compare_edited(docs.repartition(5)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = _rows([(r.doc_id, r.text) for r in docs.collect()])
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k][:4] == w[:4], k
        assert np.allclose(got[k][4:], w[4:], atol=1e-12), k


def test_short_texts_nulls_and_equal_texts(spark):
    texts = [None, "", " \t\n", "one", "one", "one two three four", "one two three four five", "ä ö ü ß é 漢字 🙂", "a b c d e a b c d e a b c d e", "a b c d e a b c d e a b c d e"]
    rows = list(enumerate(texts, start=-3))
    got = {r.doc_id: tuple(r)[1:] for r in fingerprint.compare_edited(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = _rows(rows)
    assert got == want and got[-3][5] == 1.0 and got[0][5] == 1.0


def test_estimates_are_close_to_true_overlaps():
    """Means over many pairs: no bias; for a text within one forty times as long too."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    jaccard, inside = [], []
    for _ in range(120):
        a = [rng.choice(words) for _ in range(150)]
        b = a[: rng.randrange(150)] + [rng.choice(words) for _ in range(80)]
        short, long = a[:100], [rng.choice(words) for _ in range(2000)] + a[: rng.randrange(10, 100)] + [rng.choice(words) for _ in range(2000)]
        s = list(fingerprint.sketches(*column_bytes(pa.array([" ".join(x) for x in (a, b, short, long)], pa.large_string()))))
        sets = [_shingles(" ".join(x)) for x in (a, b, short, long)]
        jaccard.append(fingerprint.likeness(s[0], s[1]) - len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
        inside.append(fingerprint.containment(s[2], s[3]) - len(sets[2] & sets[3]) / len(sets[2]))
    for errors in (jaccard, inside):
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.12


def test_merged_sketches_are_those_of_all_shingles():
    texts = ["a b c d e f g h", "x y z u v w q", "a b c d e f x y z"]
    kept = [s[2] for s in fingerprint.sketches(*column_bytes(pa.array(texts, pa.large_string())), 2)]
    hashes = _Hashes()
    hashes.learn(set().union(*map(_shingles, texts)))
    assert fingerprint.merge(*kept).tolist() == sorted(v for v in hashes.known.values() if v <= ((1 << 64) - 1) // 2)
    assert fingerprint.merge().tolist() == []
