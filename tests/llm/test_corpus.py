"""The corpus operators against SQL, brute force, libraries and round trips; edge cases of each."""

import collections
import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import encoders, fingerprint, jaccard, mixing, piece_dropout, quality, queries, substring_dedup, token_counts, topk, url_filter, warc
from tessera.operators.components import connected_components, stars
from tessera.llm.fm_index import FMIndex
from tessera.llm.shared import Scratch
from tessera.llm.textkernel import column_bytes, shingles, word_hashes, words
from tests.conftest import same_as_sql

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, key string, gram string, kind string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, other columns with clashing names."""
    r = random.Random(5)
    vocabulary = ["w%d" % i for i in range(60)] + ["é", "中文", "▁", "<|endoftext|>", "\u00a0x"]
    passage = " ".join(r.choice(vocabulary) for _ in range(40))
    texts = [None, "", " \n\t ", "one", "one two three", passage, passage, passage.upper(), passage + " tail", "x" * 3000 + " " + "y" * 10, "same " * 300]
    texts += [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 120))) + (" " + passage if i % 3 == 0 else "") for i in range(40)]
    texts += [" ".join(r.choice(vocabulary) for _ in range(30_000))]
    rows = [(i, t, "en" if i % 2 else None, "s", None if t is None else len(t), "a", "b", "c", "d") for i, t in enumerate(texts)]
    rows += [rows[5], (None, passage, None, None, None, "", "", "", "")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, duck, sf_dir, name):
    same_as_sql(spark, duck, queries.QUERIES[name], queries.oracle_sql()[name], sf_dir)


# text kernel
def test_words_and_shingles_are_those_of_the_texts():
    texts = ["a b  c", "", " \x0b x\x1cy\u2003z ", "one two three four five six", None]
    data, offsets = column_bytes(pa.array(texts))
    s, e, first = words(data, offsets)
    got = [[bytes(data[a:b]).decode() for a, b in zip(s[i:j], e[i:j])] for i, j in zip(first, first[1:])]
    assert got == [WORD.findall(t or "") for t in texts]
    _, begin = shingles(word_hashes(data, s, e), first, 5)
    assert np.diff(begin).tolist() == [1, 0, 1, 2, 0]


def test_word_hashes_do_not_depend_on_place():
    r = random.Random(1)
    vocabulary = ["".join(r.choice("abcß中") for _ in range(r.randint(1, 12))) for _ in range(3000)]
    data, offsets = column_bytes(pa.array([" ".join(vocabulary), " ".join(reversed(vocabulary))]))
    s, e, first = words(data, offsets)
    h = word_hashes(data, s, e)
    assert np.array_equal(h[: len(vocabulary)], h[len(vocabulary) :][::-1]) and len(set(h.tolist())) == len(set(vocabulary))
    upper, lower = column_bytes(pa.array(["ABCÉ"])), column_bytes(pa.array(["abcÉ"]))
    assert word_hashes(upper[0], np.array([0]), np.array([5]), True) == word_hashes(lower[0], np.array([0]), np.array([5]))


# 1 quality
def test_words_that_collide_in_a_polynomial_do_not_here(spark):
    """Words of two letters in Thue-Morse order collide under every polynomial hash modulo 2^64."""
    a = "".join("ab"[i.bit_count() & 1] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    for u, v in ((a, b), (a[:64], b[:64]), (a[:63], a[:64]), ("x" * 65, "x" * 66), ("a", "b")):
        data = np.frombuffer(f"{u} {v}".encode(), np.uint8)
        h = word_hashes(data, np.array([0, len(u) + 1]), np.array([len(u), len(data)]))
        assert h[0] != h[1]
    docs = spark.createDataFrame([(1, a), (2, b), (3, a.upper())], "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()} == {1: 1, 2: 2, 3: 1}


def test_fits_take_one_row_a_key(spark):
    """A labelled id that thousands of rows repeat gives the driver one row."""
    docs = spark.createDataFrame([(1, f"good plain words number {i}") for i in range(3000)] + [(i, "bad " * i) for i in range(2, 40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i == 1), str(i == 1)) for i in range(1, 40)], "doc_id bigint, quality int, domain string")
    fits = []
    for module, name in ((quality, "fit_model"), (mixing.DomainClassifier, "_learn")):
        real = getattr(module, name)

        def seen(*args, real=real):
            fits.append(max(len(x) for x in args if isinstance(x, (list, np.ndarray)) and len(x) <= 3100))
            return real(*args)

        setattr(module, name, seen)
        try:
            if name == "fit_model":
                quality.QualityClassifier().fit(docs, labels)
            else:
                mixing.DomainClassifier().fit(docs, labels.select("doc_id", "domain"))
        finally:
            setattr(module, name, real)
    assert fits[1] == 39 and fits[0] < 3000


def test_encoders_give_the_libraries_tokens(odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(queries.TOKENIZER)
    own, library = encoders.ByteBpe(path), Tokenizer.from_file(path)
    texts = [r.text or "" for r in odd.collect()] + ["<|endoftext|> a<|endoftext|>", "don't I'LL we've  \n\n x\u00a0y\u3000z\u2028", "\u0130\u0307 \U0001f600 \u0e01\u0e33", "\x00\x1f\x7f\x85 \r\n"]
    assert own.quick is not None
    assert own.count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    library.encode_special_tokens = True
    assert own.encode(texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert all(b"".join(own.table[i] for i in ids) == t.encode() for t, ids in zip(texts, own.encode(texts)))


def test_quality_held_out_accuracy(spark, sf_dir):
    got = queries.op1_quality(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality is not null")
    rows = got.join(labels, "doc_id").collect()
    for held in (True, False):
        part = [r for r in rows if r.held_out == held]
        assert sum(r.predicted == r.quality for r in part) >= 0.9 * len(part)
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_factorisation_machine_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    model = quality.Model(w0=0.3, w=rng.normal(size=20), v=rng.normal(size=(20, quality.RANK)))
    owner, index, x = np.array([0, 0, 0, 1, 1]), np.array([3, 7, 11, 2, 19]), rng.normal(size=5)
    out, _ = model.margin(owner, index, x, 2)
    for d in (0, 1):
        at = np.flatnonzero(owner == d)
        want = 0.3 + sum(model.w[index[i]] * x[i] for i in at) + sum(model.v[index[i]] @ model.v[index[j]] * x[i] * x[j] for i in at for j in at if i < j)
        assert out[d] == pytest.approx(want)


def test_quality_edges(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(3, 0), (None, 1), (4, None)], "doc_id bigint, quality int")
    fitted = quality.QualityClassifier(metadata=("n_chars", "lang")).fit(odd, labels)
    got = fitted.score(odd, ("text", "kind")).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    same = [r.score for r in got if r.doc_id == 5]
    assert len(set(same)) == 1
    assert fitted.score(none).count() == 0
    assert quality.QualityClassifier().fit(odd, labels.limit(0)).score(odd).first().score == 0.5
    assert quality.QualityClassifier().fit(none, labels).score(odd).first().score == 0.5


# 2 pieces
@pytest.fixture(scope="module")
def pieces():
    import public_tokenizers

    return public_tokenizers.path(queries.PIECE_MODEL)


def test_pieces_without_dropout_are_the_models(pieces, odd):
    import sentencepiece

    texts = [r.text or "" for r in odd.collect()]
    texts = [t for t in texts if "▁" not in t]
    got = piece_dropout.MergeDropout(pieces, dropout=0.0).encode(texts, np.zeros(len(texts), np.uint64))
    want = sentencepiece.SentencePieceProcessor(model_file=pieces).encode(texts)
    assert [np.frombuffer(g, "<i4").tolist() for g in got] == want


def test_batch_merging_is_the_agenda(pieces):
    r = random.Random(3)
    c = piece_dropout.MergeDropout(pieces, dropout=0.2)
    items = [("▁" * r.randint(0, 3) + "".join(r.choice("theinga中é.") for _ in range(r.randint(1, 30))), r.randrange(8)) for _ in range(800)]
    assert c.encode_batch(items) == [c.encode_one(*i) for i in items]


def test_every_occurrence_draws_for_itself(pieces):
    c = piece_dropout.MergeDropout(pieces)
    n = 4000
    keys = np.arange(n, dtype=np.uint64)
    for word in ("the", "international"):
        got = c.encode([word] * n, keys)
        free = [c.encode_one("▁" + word, random.Random(i).getrandbits(64)) for i in range(n)]
        for kind in set(free):
            assert got.count(kind) / n == pytest.approx(free.count(kind) / n, abs=0.04)
    assert len(set(got)) > 8


def test_traces_give_what_the_agenda_gives(pieces, monkeypatch):
    monkeypatch.setattr(piece_dropout, "SLICE", 700)
    monkeypatch.setattr(piece_dropout, "CACHE_SIZE", 900)
    r = random.Random(4)
    c = piece_dropout.MergeDropout(pieces, dropout=0.3)
    vocabulary = ["".join(r.choice("theinga中é.") for _ in range(r.randint(1, 45))) for _ in range(60)] + ["the", "and", ""]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 90))) for _ in range(60)]
    keys = np.array([r.getrandbits(64) for _ in texts], dtype=np.uint64)
    base = piece_dropout.mix64(keys ^ np.uint64(c.seed * 0x9E3779B97F4A7C15 & piece_dropout._M))
    want = []
    for t, b in zip(texts, base.tolist()):
        chunks = piece_dropout._CHUNK.findall("▁" + t.replace(" ", "▁")) if t else []
        want.append(b"".join(c.encode_one(x, piece_dropout._mix(b + i)) for i, x in enumerate(chunks)))
    assert c.encode(texts, keys) == want


def test_dropout_round_trip(spark, odd, none, pieces):
    encoded = piece_dropout.encode(odd, pieces, dropout=0.3)
    back = {(r.doc_id, r.text) for r in piece_dropout.decode(encoded, pieces).collect()}
    assert back == {(r.doc_id, r.text or "") for r in odd.collect()}
    trip = piece_dropout.round_trip(odd, pieces, dropout=0.3).collect()
    assert all(r.lossless for r in trip) and len(trip) == odd.count()
    assert all(r.decoded_sha256 == hashlib.sha256((t.text or "").encode()).hexdigest() for r, t in zip(sorted(trip, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_chars)), sorted(odd.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, len(r.text or "")))))
    again = {r.ids_sha256 for r in piece_dropout.round_trip(odd.repartition(3), pieces, dropout=0.3).collect()}
    assert again == {r.ids_sha256 for r in trip}
    other = {r.ids_sha256 for r in piece_dropout.round_trip(odd, pieces, seed=99, dropout=0.3).collect()}
    assert other != again
    assert piece_dropout.round_trip(none, pieces).count() == 0


# 3 fingerprints
def _set(text, lower=False):
    if lower:
        text = text.translate({i: i + 32 for i in range(65, 91)})
    w = WORD.findall(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_fingerprints_of_neighbours(spark, odd):
    got = fingerprint.compare_edited(odd.filter("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    texts = {r.doc_id: r.text or "" for r in odd.filter("doc_id is not null").collect()}
    ids = sorted(texts)
    assert sorted(r.doc_id for r in got) == ids
    prints = {}
    for r in got:
        t, n = texts[r.doc_id], texts[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        q = len(t) // 4
        edited = t[: len(t) - q] + n[:q]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        a, b = _set(t), _set(edited)
        true = len(a & b) / len(a | b) if a | b else 1.0
        assert 0 <= r.near_edited <= 1 and abs(r.near_edited - true) < 0.35 or len(a) < 40
        if len(a) > 2000:
            assert abs(r.near_edited - true) < 0.05
    assert len(set(prints.values())) == len({frozenset(_set(t)) for t in prints})


def test_fingerprint_edges(spark, odd, none):
    assert fingerprint.compare_edited(none).count() == 0
    one = odd.filter("doc_id = 5").limit(1)
    r = fingerprint.compare_edited(one).first()
    assert r.near_next == 1.0  # the only document is its own successor
    assert fingerprint.compare_edited(odd).count() == odd.count()  # null and repeated keys
    a, b = (fingerprint.from_text(x.fingerprint) for x in fingerprint.fingerprints(odd.filter("doc_id in (5, 8)")).orderBy("doc_id").collect()[::2])
    assert 0 <= fingerprint.containment(a, b) <= 1
    assert fingerprint.merge(a[2], b[2]).tolist() == sorted(set(a[2].tolist()) | set(b[2].tolist()))


# 4 search
def test_topk_is_exact(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 6)) * rng.gamma(1, 2, size=(700, 1))
    x[100:160] = x[100]
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    rows += [(2000, None), (2020, []), (2040, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2060, [float("nan")] * 6), (2080, [float("inf")] * 6), (2100, [0.0] * 6), (2120, [1.0, 2.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in topk.top_k(df, k=20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    q = {i: np.floor(64 * np.array(v)).astype(int) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    for i in [i for i in q if i % 20 == 0]:
        s = sorted(((-int(q[i] @ q[j]), j) for j in q if j != i and len(q[j]) == len(q[i])))[:20]
        assert sorted(got.get(i, [])) == [(k + 1, j, -v) for k, (v, j) in enumerate(s)]
    assert topk.top_k(df.limit(0)).count() == 0


def _exact_top(rows, k=20, every=20):
    q = [(i, [math.floor(Fraction(a) * 64) for a in v]) for i, v in rows]
    out = []
    for i in {i for i, _ in q if i % every == 0}:
        scores = [(-min(max(sum(a * b for a, b in zip(u, v)), -(2**63)), 2**63 - 1), j) for h, u in q if h == i for j, v in q if j != i and len(v) == len(u)]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def test_topk_of_large_components_and_repeated_ids(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(rng.normal(size=(60, 3)))]
    rows += [(100, [1e12, 1.0, -1.0]), (101, [-1e12, 1.0, 2.0]), (120, [1e300, 0.0, 1e-300]), (121, [1.7e308, -1.7e308, 0.0]), (140, [3e7, 2.5, 1.0]), (141, [2.0**40 + 0.5, 0.0, 1.0])]
    rows += [(20, [0.5, 0.25, -3.0]), (40, rows[40][1]), (7, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<double>, level string, part int")
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df).collect()) == _exact_top(rows)


def test_topk_over_levels_and_chunks(spark, monkeypatch):
    """Small buckets, chunks and levels give the same; lengths differ, so that each kind of pruning excludes something."""
    for name, value in (("BLOCK", 16), ("CHUNK", 7), ("TILE", 3), ("GROWTH", 3), ("HELD", 50)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(10)
    x = rng.normal(size=(12, 5))[rng.integers(0, 12, 900)] + rng.normal(size=(900, 5)) * 0.05
    x *= rng.gamma(4, 2, size=(900, 1))
    x[300:420] = x[300]
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, k=5).collect()) == _exact_top(rows, 5)
    counts = topk.pruning(df, k=5)
    assert counts["skipped"] > 0 and counts["by_length"] > 0 and counts["by_coordinate"] > 0
    assert counts["verified"] < counts["pairs"] == 900 * 45


def test_coordinate_and_length_pruning_lose_nothing():
    rng = np.random.default_rng(6)
    m = rng.integers(-60, 60, (500, 8)).astype(float)
    b = topk.Bucket(np.arange(500), m, 1)
    for q in rng.integers(-60, 60, (60, 8)).astype(float):
        size = np.sqrt((q**2).sum())
        s = m @ q
        for bound in (1.0, float(np.sort(s)[-3]), float(np.sort(s)[-40])):
            local, short = b.local(np.array([size]), np.array([bound]))[0], int(b.reach(np.array([size]), np.array([bound]))[0])
            want = set(np.flatnonzero(s >= bound).tolist())
            assert want <= set(b.rows.ids[:short].tolist()) and want <= set(b.rows.ids[b.near(q, size, local, short)].tolist())


# 5 urls
def test_url_rules_and_propagation(spark):
    rows = [
        (1, "https://www.Example.com/en/x?q#f", None), (2, "http://a.example.com/en/", ""), (3, "http://b.net", None), (4, "nothing", None), (5, None, None), (6, "x://c.net/es/1", None),
        (7, "http://good.org/", '<a href="http://blocked.net/fr/">x</a>'), (8, "http://far.org/", "<a href='//good.org/a'>"), (9, "http://blocked.net/fr/p", None), (10, "http://clean.org/", '<a href="https://x.com/">'), (10, "http://clean.org/", None),
    ]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"host": F.lit("clash"), "rule": F.lit("clash")})
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df, queries.URL_RULES).collect()}
    assert got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[2] == ("a.example.com", "/en/", "example.com/en/", "block")
    assert got[3] == ("b.net", "", None, "allow") and got[4] == got[5] == ("", "", None, "allow")
    assert got[6] == ("c.net", "/es/1", "net/es/", "block")
    assert got[7][3] == got[8][3] == "block" and got[10][3] == "allow"  # links towards blocked hosts
    assert url_filter.judge_urls(df.limit(0), queries.URL_RULES).count() == 0


def test_propagation_as_matrix_product(spark):
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 3), ("d", "a", 1)]
    rank = url_filter._propagate(spark.createDataFrame(edges, "src string, dst string, w bigint"), spark.createDataFrame([("a", 1), ("d", 3)], "host string, n bigint"), Scratch(spark, "t"), "t")
    hosts = "abcd"
    m = np.zeros((4, 4))
    for s, t, w in edges:
        m[hosts.index(t), hosts.index(s)] = w / sum(x for a, _, x in edges if a == s)
    home = np.array([0.25, 0, 0, 0.75])
    p = home.copy()
    for _ in range(url_filter.ROUNDS):
        p = 0.85 * m @ p + 0.15 * home
    got = {r.host: r.rank / url_filter.UNITS for r in rank.collect()}
    assert [got.get(h, 0) for h in hosts] == pytest.approx(p.tolist(), abs=1e-9)


def test_small_shares_of_distrust_arrive(spark):
    blocked = spark.range(1_000_000).select(F.concat(F.lit("http://many.net/fr/"), "id").alias("url"), F.lit("").alias("html"))
    one = spark.createDataFrame([("http://one.net/fr/", ""), ("http://quiet.org/", '<a href="http://one.net/">'), ("http://far.org/", '<a href="//quiet.org/">'), ("http://clean.org/", "")], "url string, html string")
    heavy = spark.range(1000).select(F.lit("http://heavy.org/").alias("url"), F.repeat(F.lit('<a href="//one.net/">'), 1000).alias("html"))
    linked = spark.range(1000).select(F.concat(F.lit("http://h"), "id", F.lit(".org/")).alias("url"), F.lit('<a href="//far.org/">').alias("html"))
    pages = blocked.unionByName(one).unionByName(heavy).unionByName(linked).withColumn("page_id", F.monotonically_increasing_id())
    got = {(r.host, r.verdict) for r in url_filter.judge_urls(pages, queries.URL_RULES).select("host", "verdict").distinct().collect()}
    assert {h for h, v in got if v == "allow"} == {"clean.org"} and len(got) == 1006


def test_sums_of_shares_in_any_order(spark):
    r = random.Random(6)
    rows = [(h, 10 ** r.uniform(-90, 12)) for h in "ab" for _ in range(500)] + [("c", 1e-100), ("c", 0.1), ("c", 0.2)]
    sums = lambda rows, n: {r.host: r.rank for r in url_filter._sum_by_host(spark.createDataFrame(rows, "host string, got double").repartition(n)).collect()}
    got = sums(rows, 2)
    assert got == sums(r.sample(rows, len(rows)), 7)
    assert got == pytest.approx({h: sum(x for k, x in rows if k == h) for h in "abc"}, rel=1e-13)


# 6 substrings
def _dedup(rows, span=13):
    first = {}
    w = {i: WORD.findall(t or "") for i, t in rows}
    for i in sorted(w):
        for j in range(len(w[i]) - span + 1):
            first.setdefault(tuple(w[i][j : j + span]), i)
    out = {}
    for i in w:
        gone = set()
        for j in range(len(w[i]) - span + 1):
            if first[tuple(w[i][j : j + span])] < i:
                gone.update(range(j, j + span))
        out[i] = (len(w[i]), len(gone), " ".join(x for k, x in enumerate(w[i]) if k not in gone))
    return out


@pytest.mark.parametrize("limit", [substring_dedup.BROADCAST_ANCHORS, 0])
def test_substrings_as_brute_force(spark, odd, none, limit):
    rows = odd.filter("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.dedup_substrings(rows, keep=("lang", "key"), broadcast_anchors=limit).collect()}
    assert got == _dedup([(r.doc_id, r.text) for r in rows.collect()])
    assert substring_dedup.dedup_substrings(odd, broadcast_anchors=limit).count() == odd.count()
    assert substring_dedup.dedup_substrings(none, broadcast_anchors=limit).count() == 0


def test_substrings_with_hot_anchors_and_other_keys(spark, monkeypatch):
    """All shared anchors hot; equal words with other white space; keys as text; rows that repeat a key with other texts."""
    monkeypatch.setattr(substring_dedup, "HOT", 0)
    r = random.Random(3)
    phrase = [r.choice("abcdefgh") * r.randint(1, 3) for _ in range(30)]
    rows = [(i, " \t"[i % 2].join(phrase[i % 5 : 20 + i % 9]) + "".join(" " + r.choice("abcdefgh") for _ in range(r.randint(0, 40)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = _dedup(rows)
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept_text) for x in substring_dedup.dedup_substrings(df).collect()} == want
    named = df.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    assert {int(x.doc_id): x.n_removed for x in substring_dedup.dedup_substrings(named).collect()} == {k: v[1] for k, v in want.items()}
    odd_keys = df.select(F.concat(F.lit("k"), "doc_id").alias("doc_id"), "text")
    with pytest.raises(Exception, match="whole numbers"):  # no order of keys, so nothing is left as it is in silence
        substring_dedup.dedup_substrings(odd_keys).count()
    twice = spark.createDataFrame([(1, " ".join(phrase)), (2, " ".join(phrase)), (2, "x " + " ".join(phrase[:20])), (2, "y")], "doc_id bigint, text string")
    assert sorted((x.doc_id, x.n_words, x.n_removed) for x in substring_dedup.dedup_substrings(twice).collect()) == [(1, 30, 0), (2, 1, 0), (2, 21, 20), (2, 30, 30)]


def test_passages_name_a_source(spark, odd):
    """Every interval repeats, window by window, a text with a smaller key; the source holds the first of them."""
    rows = {r.doc_id: WORD.findall(r.text or "") for r in odd.filter("doc_id is not null").collect()}
    got = substring_dedup.repeated_passages(odd.dropDuplicates(["doc_id"])).collect()
    assert got
    for x in got:
        assert x.source < x.doc_id and x.end_word - x.first_word >= 13
        first, held = rows[x.doc_id][x.first_word : x.first_word + 13], rows[x.source]
        assert any(held[i : i + 13] == first for i in range(len(held) - 12))


def test_indexed_and_streamed_texts_differ(monkeypatch):
    """Each segment is streamed against smaller keys of its shard only; without any, nothing is indexed. Small indexes give the same."""
    monkeypatch.setattr(substring_dedup, "INDEX_WORDS", 300)
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 3, rng.integers(13, 30)) for _ in range(80)]
    begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    shard, key = rng.integers(0, 4, 80), rng.integers(0, 25, 80)
    found, source = substring_dedup.search_shard(np.concatenate(texts), begin, shard, key, 5, True)
    for i, t in enumerate(texts):
        for j in range(len(t) - 4):
            holders = {int(key[k]) for k, u in enumerate(texts) if shard[k] == shard[i] and key[k] < key[i] and any(np.array_equal(u[m : m + 5], t[j : j + 5]) for m in range(len(u) - 4))}
            assert found[begin[i] + j] == bool(holders) and (not holders or source[begin[i] + j] in holders)
    monkeypatch.setattr(substring_dedup, "FMIndex", None)
    found, _ = substring_dedup.search_shard(np.concatenate(texts), begin, shard, shard, 5, True)
    assert not found.any()


def test_index_is_compressed():
    rng = np.random.default_rng(3)
    sequence = np.concatenate([np.append(rng.integers(1, 200, 20), 0) for _ in range(2000)])
    assert FMIndex(sequence, 200).nbytes() < 4 * len(sequence)  # the plain suffix array alone would take 8 bytes a word


def test_matching_statistics():
    rng = np.random.default_rng(8)
    for _ in range(6):
        parts = [rng.integers(1, 5, rng.integers(1, 40)) for _ in range(8)]
        parts.append(np.tile([1, 2], 60))
        seq = np.concatenate([np.append(p, 0) for p in parts])
        index = FMIndex(seq, 6)
        stream = [rng.integers(0, 6, rng.integers(1, 40)) for _ in range(5)]
        begin = np.concatenate([[0], np.cumsum([len(s) for s in stream])])
        length, row = index.matching_statistics(np.concatenate(stream), begin, 13)
        held = {tuple(p[i : i + k]) for p in parts for k in range(1, 14) for i in range(len(p) - k + 1)}
        for s, b in zip(stream, begin):
            for i in range(len(s)):
                want = max((k for k in range(1, min(13, len(s) - i) + 1) if tuple(s[i : i + k]) in held), default=0)
                assert length[b + i] == want
                if want:
                    at = int(index.locate(row[b + i : b + i + 1])[0])
                    assert np.array_equal(seq[at : at + want], s[i : i + want])


# 7 tokens
def test_token_counts_as_the_library(spark, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(queries.TOKENIZER)
    t = Tokenizer.from_file(path)
    r = random.Random(9)
    wild = ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x80, 0x250), r.randrange(0x370, 0xD7FF), r.randrange(0x1F300, 0x1F6FF), 9, 10, 13, 32, 0x85, 0x2028])) for _ in range(200)) for _ in range(60)]
    extra = spark.createDataFrame([(1000 + i, x) for i, x in enumerate(wild + ["a<|endoftext|>b<|endoftext|>", "it's  we'll\n\n  x"])], "doc_id bigint, text string")
    docs = odd.select("doc_id", "text").unionByName(extra)
    got = sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, path).collect())
    texts = [r.text or "" for r in docs.collect()]
    want = sorted((len(x.encode()), len(e.ids), len(e.ids) > 1024) for x, e in zip(texts, t.encode_batch(texts, add_special_tokens=False)))
    assert got == want
    assert token_counts.token_counts(none, path).count() == 0


def test_frequent_pre_tokens_cover_all_texts(spark, none):
    """The table is filled from every whole text, long ones and those without a key included; a small summary keeps lower bounds."""
    import public_tokenizers

    path = public_tokenizers.path(queries.TOKENIZER)
    counter = token_counts.PreTokenCounter(path, {})
    texts = ["aa bb, cc\ndd it's"] * 40 + ["Zz" + " yy" * 30_000 + " " + "x" * 500] + ["日本 語"] * 3 + ["ee"]
    want = collections.Counter(p for t in texts for p in counter.pre_tokens(t))
    summary = token_counts.FrequentPieces(counter)
    summary.add(iter(texts))
    assert dict(summary.counts) == {p: n for p, n in want.items() if len(p) <= token_counts.LONGEST}
    small = token_counts.FrequentPieces(counter, 4)
    for t in texts:
        small.add(iter([t]))
    assert len(small.counts) <= 4 and all(n <= want[p] for p, n in small.counts.items())
    assert small.counts[" yy"] >= want[" yy"] - sum(want.values()) / 5
    docs = spark.createDataFrame([(None if i % 2 else i, t) for i, t in enumerate(texts)] + [(900, None), (901, "")], "doc_id bigint, text string").repartition(3)
    got = token_counts.frequent_lengths(docs, path)
    assert set(got) == set(summary.counts)
    assert all(got[p] == len(counter.tokenizer.encode(p, add_special_tokens=False).ids) for p in got)
    assert token_counts.frequent_lengths(none, path) == {}


# 8 Jaccard
def _components(sets, percent=75):
    ids = list(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            x, y = sets[i], sets[j]
            k = len(x & y)
            if x and y and 100 * k >= percent * (len(x) + len(y) - k):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_jaccard_on_groups_of_near_copies(spark, monkeypatch):
    """Long lists, many rounds, common passages; limits are lowered so that every path runs."""
    monkeypatch.setattr(jaccard, "LONG_LIST", 6)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "FREQUENT_FROM", 2)
    r = random.Random(11)
    word = lambda: "w%d" % r.randrange(4000)
    base = [[word() for _ in range(n)] for n in (40, 90, 150)]
    passage = [word() for _ in range(60)]
    docs = []
    for b in base:
        for _ in range(25):
            c = list(b)
            for _ in range(r.randint(0, 6)):
                c[r.randrange(len(c))] = word()
            docs.append(c)
    for _ in range(30):
        docs.append([word() for _ in range(r.randint(1, 40))] + passage + [word() for _ in range(r.randint(0, 30))])
    docs += [docs[0], [x.upper() for x in docs[1]], [], ["a"], ["a"], ["A", "b"]]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(df).collect()}
    sets = {i: _set(t, True) for i, t in rows}
    want = _components(sets)
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_jaccard_edges(spark, odd, none):
    got = jaccard.jaccard_components(odd).collect()
    assert len(got) == odd.count()
    sets = {}
    for r in odd.filter("doc_id is not null").collect():
        sets[r.doc_id] = _set(r.text or "", True)
    want = _components(sets)
    assert all((r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id]) for r in got if r.doc_id is not None)
    assert next(r for r in got if r.doc_id is None).component_id == 5  # the same passage
    assert jaccard.jaccard_components(none).count() == 0


def test_components(spark, monkeypatch):
    import tessera.operators.components as module

    r = random.Random(13)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1050)] + [(5, 5), (None, 3)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    want = {x: find(x) for x in parent}
    for limit in (module.TASK_LINKS, 40):
        monkeypatch.setattr(module, "TASK_LINKS", limit)
        got = {x.node: x.component for x in connected_components(df.repartition(9), Scratch(spark, "cc"), "t").collect()}
        assert got == want
    assert connected_components(df.limit(0), Scratch(spark, "cc"), "t").count() == 0
    hi, lo = stars(np.array([3, 2, 9]), np.array([2, 1, 8]))
    assert dict(zip(hi.tolist(), lo.tolist())) == {2: 1, 3: 1, 9: 8}


# 9 WARC
def test_archives_are_valid_and_come_back(spark):
    rows = [(1, "http://a/", "same"), (2, "http://b/\r\nx", "same"), (3, None, None), (4, "http://c/", "crlf\r\n\r\nWARC/1.1\r\n\r\nin it é中"), (4, "http://c/", "other"), (None, "http://d/", "x"), (5, "http://e/", "y" * 200_000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload_bytes", F.lit("clash"))
    path = Scratch(spark, "warc-test").path
    warc.write_warc(df, f"{path}/a")
    records = warc.read_warc(spark, f"{path}/a")
    found = warc.assemble(records).collect()
    assert sorted(r.metadata.fields["page-id"] for r in found) == ["1", "2", "3", "4", "4", "5", "null"]
    captures = {r.metadata.fields["page-id"]: r for r in found}
    fours = [r for r in found if r.metadata.fields["page-id"] == "4"]
    assert {bytes(c.response.payload).decode() for c in fours} == {"other", rows[3][2]}
    assert all(c.request.target == c.metadata.target == "http://c/" and c.capture_id == c.response.record_id for c in fours)
    assert captures["1"].response.type == "revisit" and captures["1"].response.refers_to == captures["2"].response.record_id
    assert bytes(captures["2"].response.payload) == b"same" and len(captures["5"].response.payload) == 200_000
    assert captures["3"].response.payload_bytes == 0 and captures["3"].response.payload_digest == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    warc.write_warc(df.limit(0), f"{path}/none")
    assert warc.assemble(warc.read_warc(spark, f"{path}/none")).count() == 0
    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 10\r\nWARC-Type: response\r\nWARC-Record-ID: x\r\n\r\nshort"))


def test_min_bytes(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id bigint, url string, html string")
    path = Scratch(spark, "warc-min").path
    warc.write_warc(df, path, min_bytes=3)
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.page_facts(warc.assemble(warc.read_warc(spark, path, payload=False))).collect()}
    assert got == {1: ("response", None, 2), 2: ("response", None, 2), 3: ("revisit", 4, 4), 4: ("response", None, 4)}


def test_every_row_is_archived(spark, duck, tmp_path, monkeypatch):
    """Rows that repeat a page_id, are equal, or have no page_id; and pages of very different sizes. The same as the SQL."""
    monkeypatch.setattr(warc, "LONG_PAGE", 100)
    rows = [(1, "u", "aaaa"), (1, "u", "b"), (2, "u", "aaaa"), (2, "u", "aaaa"), (2, "v", "aaaa"), (None, "w", "z"), (None, "w", "z"), (None, None, None), (-3, "u", "é" * 400), (7, "u", "é" * 400), (8, "u", "q" * 150)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("page", F.lit("clash")).withColumn("tag", F.lit(1)).write.parquet(f"{tmp_path}/pages.parquet")
    cursor = duck.cursor()
    cursor.sql(f"create or replace temp view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    same_as_sql(spark, cursor, queries.op9_warc, queries.oracle_sql()["op9_warc"], str(tmp_path))


def test_a_damaged_payload_is_an_error(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([(1, "u", "abcdef")], "page_id bigint, url string, html string"), f"{tmp_path}/a", compression="none")
    for f in (tmp_path / "a").glob("part-*"):
        data = f.read_bytes()
        f.write_bytes(data.replace(b"abcdef", b"abcdeg"))
        (tmp_path / "a" / f".{f.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read_warc(spark, f"{tmp_path}/a").collect()


# 10 mixing
def test_rates_meet_the_targets(spark, sf_dir):
    out = queries.op10_mixing(spark, sf_dir).collect()
    p, w, r = np.array([x.p for x in out]), np.array([x.n_tokens for x in out]), np.array([x.rate for x in out])
    names = sorted(queries.MIX)
    got = (p * (w * r)[:, None]).sum(0)
    want = np.array([queries.MIX[n] for n in names]) * w.sum()
    assert (r >= 0).all() and np.abs(got - want).max() < 0.01 * w.sum()


@pytest.mark.parametrize("targets", [[3000.0, 200.0, 4000.0], [9000.0, 0.0, 0.0]])
def test_rates_are_the_least_squares_solution(spark, targets):
    """Against a plain projected gradient over all rates that is run to its end; the second target can't be reached by soft membership."""
    rng = np.random.default_rng(15)
    p = rng.dirichlet([0.4] * 3, 200) * 0.9 + 0.1 / 3
    w = rng.integers(1, 100, 200)
    df = Scratch(spark, "mix").save(spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(w, p)], "n_words bigint, p array<double>"), "m")
    targets, now = np.array(targets), lambda r: (w * r) @ p
    m, reached = mixing.fit_rates(df, targets)
    back = np.linalg.pinv((p * w[:, None]).T @ p)
    miss = lambda r: float((targets - now(r)) @ back @ (targets - now(r)) + mixing.RIDGE * w @ (r - 1) ** 2)
    r = before = np.ones(200)
    for i in range(20_000):
        y = r + i % 500 / (i % 500 + 3) * (r - before)
        before, r = r, np.maximum(0, y + (p @ (back @ (targets - now(y))) - mixing.RIDGE * (y - 1)) / (1 + mixing.RIDGE))
    q = np.maximum(0, 1 + p @ m)
    assert miss(q) <= miss(r) * (1 + 1e-6) and np.abs(q - r).max() < 0.01 * q.max()
    assert np.allclose(now(q), reached)
    got = sorted((x.n_words, x.r) for x in df.select("n_words", mixing._rate(m).alias("r")).collect())
    assert np.allclose(got, sorted(zip(w.tolist(), q.tolist())))


def test_many_domains_and_given_tokens(spark):
    docs = spark.createDataFrame([(i, " ".join(f"d{i % 90}w{j}" for j in range(8)), 10 * (1 + i % 2)) for i in range(900)], "doc_id bigint, text string, n bigint")
    labelled = docs.select("doc_id", F.concat(F.lit("d"), (F.col("doc_id") % 90).cast("string")).alias("domain"))
    got = mixing.mixing_rates(docs, labelled, {f"d{i}": 1.0 + (i == 3) for i in range(90)}, keep=("n",), tokens="n").collect()
    assert len(got) == 900 and len(got[0].p) == 90
    reached = sum(np.array(r.p) * r.n * r.rate for r in got)
    names = sorted(f"d{i}" for i in range(90))
    want = np.array([2.0 if n == "d3" else 1.0 for n in names]) / 91 * sum(r.n for r in got)
    assert np.abs(reached - want).max() / want.sum() == pytest.approx(got[0].residual, abs=1e-9) and got[0].residual < 1e-3


def test_unnamed_domains_keep_their_tokens(spark):
    members = spark.createDataFrame([(100, [1.0, 0.0, 0.0, 0.0]), (60, [0.0, 1.0, 0.0, 0.0]), (30, [0.0, 0.0, 1.0, 0.0]), (10, [0.0, 0.0, 0.0, 1.0])], "n_words bigint, p array<double>")
    want = mixing.target_tokens(members, ["en", "de", "it", "toxic"], {"en": 0.5, "de": 0.5, "toxic": 0.0}, 1.1)
    assert want.tolist() == pytest.approx([110, 110, 30, 0])
    steps, got = mixing.fit_rates(members, want)
    assert got.tolist() == pytest.approx([110, 110, 30, 0], abs=0.1)


def test_mixing_edges(spark, odd, none):
    labelled = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(50)] + [(3, "c"), (None, "a"), (4, None)], "doc_id bigint, domain string")
    got = mixing.mixing_rates(odd, labelled, {"a": 1.0, "b": 1.0, "absent": 3.0}, keep=("text", "kind")).collect()
    assert len(got) == odd.count() and all(r.rate >= 0 for r in got)
    assert mixing.mixing_rates(none, labelled, {"a": 1.0}).count() == 0
    assert {r.rate for r in mixing.mixing_rates(odd, labelled.limit(0), {"a": 1.0}).collect()} == {1.0}


# the pipeline
def test_pipeline_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch, inputs = Scratch(spark, "pipeline-test"), [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(scratch.save(stage(spark, inputs[-1], sf_dir), str(i)))
    text = [{r.doc_id: r.text or "" for r in d.collect()} for d in inputs[:5]]
    assert all(d.columns == list(corpus_pipeline.COLUMNS) for d in inputs[1:5])
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = [i for i, r in labels.items() if r.quality == 1 and i in text[0]]
    assert sum(i in text[1] for i in good) >= 0.97 * len(good)
    parts = _components({i: _set(t, True) for i, t in text[1].items()})
    assert set(text[2]) == {i for i, c in parts.items() if i == c}
    assert {i: t for i, t in text[3].items()} == {i: v[2] for i, v in _dedup(text[2].items()).items()}
    clean = [i for i in text[3] if i in labels and labels[i].toxic == 0]
    assert sum(i in text[4] for i in clean) >= 0.97 * len(clean)
    last = inputs[5].collect()
    assert len(last) == inputs[4].count() and all(r.lossless for r in last)
    copies, kinds = {}, {}
    for r in last:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
        kinds.setdefault(r.doc_id, set()).add(r.ids_sha256)
    long = [i for i, n in copies.items() if n > 1 and len(text[4][i]) > 300]
    assert long and all(len(kinds[i]) == copies[i] for i in long)  # every copy is segmented for itself


def test_pipeline_edges(spark, sf_dir, odd, none):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0
        got = stage(spark, odd, sf_dir)
        assert {r.doc_id for r in got.collect()} <= {r.doc_id for r in odd.collect()}
    same = spark.createDataFrame([(1, "b c d e f g", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, None, None, None, None), (2, None, None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.near_duplicates(spark, same, sf_dir).collect()
    # rows of one id with different texts are different documents; rows without words are copies of nothing
    assert sorted((r.doc_id, r.text or "") for r in kept) == [(1, "a b c d e f"), (1, "b c d e f g"), (2, ""), (2, "")]
    rows = [(3, "one two three four five six"), (5, "something quite of its own here"), (5, "one two three four five six"), (5, "something  quite of its own here"), (7, "something quite of its own here"), (None, "one two three four five six")]
    planted = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.near_duplicates(spark, planted, sf_dir).collect()
    assert sorted((r.doc_id or -1, r.text) for r in kept) == [(-1, rows[0][1]), (3, rows[0][1]), (5, "something  quite of its own here")]
