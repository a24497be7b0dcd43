"""Removal of repeated byte strings against a plain count of all windows."""

import collections
import hashlib
import random

import numpy as np
import pytest

from tessera.llm import bwt, queries, suffix_dedup
from tests.llm.test_corpus import none, odd  # noqa: F401 - fixtures


def _brute(rows, span=400):
    counts = collections.Counter()
    raws = [(t or "").encode() for _, t in rows]
    for raw in raws:
        counts.update(raw[i : i + span] for i in range(len(raw) - span + 1))
    out = []
    for (key, _), raw in zip(rows, raws):
        gone = np.zeros(len(raw) + 1, np.int64)
        for i in range(len(raw) - span + 1):
            if counts[raw[i : i + span]] > 1:
                gone[i] += 1
                gone[i + span] -= 1
        cover = np.cumsum(gone[:-1]) > 0
        kept = bytes(np.frombuffer(raw, np.uint8)[~cover])
        n = int(cover[:1].sum() + (cover[1:] & ~cover[:-1]).sum())
        out.append((key, len(raw), int(cover.sum()), n, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def _got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def _planted(r):
    words = ["w%d" % i for i in range(300)] + ["é", "中文", "x\x00y", "\n"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, period = text(200), "na " * 700
    rows = [(i, text(r.randint(1, 200))) for i in range(40)]
    rows += [(50 + i, text(30) + " " + passage[i * 7 : 900 - i] + " " + text(30)) for i in range(12)]  # passages with other borders
    rows += [(70 + i, passage[:450] + str(i) + passage[450:]) for i in range(12)]  # one character in the middle
    rows += [(90, period), (91, "q" + period[: r.randint(900, 1500)]), (92, "z" * 9000), (93, "z" * 401), (94, "z" * 399), (95, text(100) * 3)]
    rows += [(96, passage[:400]), (97, passage[:399] + "#"), (98, None), (99, ""), (None, passage), (None, None), (50, text(150)), (3, rows[3][1])]
    return rows


@pytest.mark.parametrize("limits", [{}, {"hot_bytes": 0}, {"hot_bytes": 3000, "index_bytes": 1000}, {"broadcast_anchors": 0}])
def test_bytes_as_brute_force(spark, limits):
    """In memory or by hot windows; anchors broadcast or not. Periods, repeats inside one text, rows that repeat, nulls, cut characters."""
    for seed in (1, 2):
        rows = _planted(random.Random(seed))
        docs = spark.createDataFrame([(k, t, "a", "b") for k, t in rows], "doc_id bigint, text string, rid string, anchor string").repartition(6)
        assert _got(suffix_dedup.dedup_bytes(docs, digest_only=True, **limits)) == _brute(rows)


def test_bytes_of_odd_texts(spark, odd, none):  # noqa: F811
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert _got(suffix_dedup.dedup_bytes(odd, digest_only=True)) == _brute(rows)
    assert suffix_dedup.dedup_bytes(none).count() == 0
    kept = suffix_dedup.dedup_bytes(odd, keep=("lang",))
    assert kept.columns == ["doc_id", "lang", "n_bytes", "n_removed", "n_spans", "kept"] and all(len(r.kept) == r.n_bytes - r.n_removed for r in kept.collect())


def test_bytes_of_the_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = _got(queries.op12_suffix_dedup(spark, sf_dir))
    assert got == _brute(rows) and sum(r[2] for r in got) > 0


def test_other_spans(spark):
    rows = _planted(random.Random(5))
    docs = spark.createDataFrame([(k, t) for k, t in rows], "doc_id bigint, text string")
    assert _got(suffix_dedup.dedup_bytes(docs, span=90, digest_only=True)) == _brute(rows, 90)


def test_long_repeats_as_brute_force():
    r = np.random.default_rng(1)
    for t in range(300):
        n, letters, length = int(r.integers(1, 160)), int(r.integers(2, 5)), int(r.integers(1, 12))
        s = r.integers(t % 2, letters + t % 2, n)
        if t % 3 == 0 and n > 40:
            s[20:40] = s[:20]
        if t % 7 == 0:
            s[:] = 1
        rows = s.tolist()
        counts = collections.Counter(tuple(rows[i : i + length]) for i in range(n - length + 1))
        want = [i + length <= n and 0 not in rows[i : i + length] and counts[tuple(rows[i : i + length])] > 1 for i in range(n)]
        assert bwt.long_repeats(s, length).tolist() == want


def test_common_prefixes_come_by_increasing_value(monkeypatch):
    """The expansion stops at the wanted length: no interval of a longer string is made."""
    rounds = []
    real = bwt.Branching.branches
    monkeypatch.setattr(bwt.Branching, "branches", lambda self, lo, hi: rounds.append(len(lo)) or real(self, lo, hi))
    bwt.long_repeats(np.tile(np.arange(1, 200), 5), 50)
    assert len(rounds) == 49


def test_equal_windows_have_equal_anchors_and_hashes():
    r = random.Random(2)
    common = bytes(r.randrange(1, 255) for _ in range(700))
    texts = [bytes(r.randrange(1, 255) for _ in range(r.randrange(600))) + common + b"x" * i for i in range(6)]
    seen = {}
    for t in texts:
        data = np.frombuffer(t, np.uint8)
        owner, start, size, anchor, several = suffix_dedup.segments(data, np.array([0, len(t)]), 400, 32)
        assert size.sum() == len(t) - 399
        h, k = suffix_dedup.window_hashes(data, 400)
        for s, n, a in zip(start.tolist(), size.tolist(), anchor.tolist()):
            for i in range(s, s + n):
                assert seen.setdefault(t[i : i + 400], (a, h[i], k[i])) == (a, h[i], k[i])
    assert len({v[1:] for v in seen.values()}) == len(seen)


def test_open_segments_of_an_anchor_are_joined_in_place(spark, monkeypatch):
    """An anchor with very many different segments is no join partition of its own."""
    keys = []
    join = suffix_dedup.join_hot
    monkeypatch.setattr(suffix_dedup, "join_hot", lambda rows, facts, key, *more: keys.append(key) or join(rows, facts, key, *more))
    common = "q" * 40 + "shared passage of one anchor " * 14
    rows = [(i, f"{i:04d}" * 4 + common + f"{i:04d}" * 4) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = _got(suffix_dedup.dedup_bytes(df, digest_only=True))
    assert "anchor" in keys and got == _brute(rows)
