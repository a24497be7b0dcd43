"""Alignment of two tokenizers against a plain, one-token-at-a-time version."""

import collections
import hashlib

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from tessera.llm import queries, token_alignment
from tests.llm.test_corpus import none, odd  # noqa: F401 - fixtures

A, B = public_tokenizers.path(queries.TOKENIZER), public_tokenizers.path(queries.PIECE_MODEL)


def _brute(rows):
    """rows: (key, text). One dict of columns per row, in order."""
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in printable]
    letter = {**{chr(x): x for x in printable}, **{chr(256 + i): x for i, x in enumerate(rest)}}

    def piece(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if p.startswith("<0x") and p.endswith(">") and len(p) == 6 else p.replace("▁", " ").encode()

    found, counts = [], collections.Counter()
    for key, text in rows:
        groups = []
        if text:
            raw = (" " + text).encode()
            a = [(i, bytes(letter[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, piece(i)) for i in sp.encode(text)]
            if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b):
                i = j = 0
                while i < len(a):
                    ga, gb, la, lb = [a[i][0]], [b[j][0]], len(a[i][1]), len(b[j][1])
                    i, j = i + 1, j + 1
                    while la != lb:
                        if la < lb:
                            ga.append(a[i][0])
                            la += len(a[i][1])
                            i += 1
                        else:
                            gb.append(b[j][0])
                            lb += len(b[j][1])
                            j += 1
                    groups.append((ga, gb))
        linked = [(x, y) for ga, gb in groups for x in ga for y in gb]
        counts.update(set(linked))
        found.append((key, groups, linked))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for key, groups, linked in found:
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((key, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(linked), sum(counts[p] == best[p[0]] for p in linked), sum(counts[p] for p in linked), digest))
    return out, counts


def _order(rows):
    return sorted(tuple(r) for r in rows) if all(r[0] is not None for r in rows) else sorted((str(r[0]), *r[1:]) for r in rows)


@pytest.mark.parametrize("table", [token_alignment.TABLE, 50, 0])
def test_alignment_as_brute_force(spark, odd, table):  # noqa: F811
    """Whatever part of the pairs is broadcast; nulls, empty texts, repeated rows, special strings, runs, other scripts, clashing columns."""
    texts = ["aaaaaaaa" * 50, "  two  spaces\n\n", "<|endoftext|> <s> </s> <unk>", "über 中文字 🙂🙂 naïve", "tab\tand　wide   space", "\x00\x01", "İ ﬁ ½"]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    docs = odd.unionByName(more, allowMissingColumns=True).withColumn("n_a", odd["kind"])
    want, _ = _brute([(r.doc_id, r.text) for r in docs.collect()])
    got = token_alignment.align_tokens(docs, A, B, table=table)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert _order([tuple(r) for r in got.collect()]) == _order(want)
    assert any(w[1] == 0 and "▁" in t for w, t in zip(want, [r.text or "" for r in docs.collect()]))  # that sign stands for a space in the pieces


def test_alignment_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want, _ = _brute([(r.doc_id, r.text) for r in docs.collect()])
    assert _order([tuple(r) for r in queries.op11_token_alignment(spark, sf_dir).collect()]) == _order(want)


def test_alignment_of_an_empty_table(spark, none):  # noqa: F811
    assert token_alignment.align_tokens(none, A, B).count() == 0
    assert token_alignment.aligned_groups(none, A, B).count() == 0


def test_groups_tile_the_texts(spark, odd):  # noqa: F811
    rows = [(r.doc_id, r.text) for r in odd.filter("doc_id is not null").dropDuplicates(["doc_id"]).collect()]
    got = collections.defaultdict(list)
    for r in token_alignment.aligned_groups(odd.filter("doc_id is not null").dropDuplicates(["doc_id"]), A, B).collect():
        got[r.doc_id].append((r.first_byte, r.end_byte, list(r.a_ids), list(r.b_ids)))
    table = token_alignment._aligner(A, B).a.table
    assert got
    for key, text in rows:
        raw = (" " + (text or "")).encode()
        parts = sorted(got.get(key, []))
        assert not parts or (parts[0][0] == 0 and parts[-1][1] == len(raw) and all(p[1] == q[0] for p, q in zip(parts, parts[1:])))
        assert all(b"".join(table[i] for i in p[2]) == raw[p[0] : p[1]] for p in parts)


def test_components_are_those_of_the_graph():
    r = np.random.default_rng(3)
    for _ in range(20):
        n_a, n_b, m = 30, 25, int(r.integers(0, 60))
        a, b = r.integers(0, n_a, m), r.integers(0, n_b, m)
        root_a, root_b = token_alignment.components(n_a, n_b, a, b)
        label = list(range(n_a + n_b))
        for _ in range(n_a + n_b):
            for x, y in zip(a.tolist(), (b + n_a).tolist()):
                label[x] = label[y] = min(label[x], label[y])
        assert label == [*root_a.tolist(), *root_b.tolist()]
