"""The Merkle manifest against a plain tree built row by row."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle, queries
from tests.llm.test_corpus import none, odd  # noqa: F401 - fixtures

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row, text):
    values = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def _tree(nodes):
    """All levels, the leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def _brute(rows, tamper):
    groups = {}
    for r in rows:
        groups.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id, _leaf(r, r.text), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _tree([x[2] for x in sorted(groups[s], key=lambda x: (x[0], x[1] or 0, x[2]))]) for s in order}
    top = _tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (_, doc, leaf, row) in enumerate(sorted(groups[s], key=lambda x: (x[0], x[1] or 0, x[2]))):
            proof, folded = [], _leaf(row, tamper(row))
            for levels, at in ((trees[s], i), (top, k)):
                for nodes in levels[:-1]:
                    first = at - at % 3
                    run = nodes[first : first + 3]
                    proof += run[: at - first] + run[at - first + 1 :]
                    folded = _h(*run[: at - first], folded, *run[at - first + 1 :])
                    at //= 3
            out.append((doc, leaf, trees[s][-1][0], top[-1][0], _h(*proof), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def _tampered(row):
    if row.text is None or row.doc_id is None or zlib.crc32(str(row.doc_id).encode()) % 2:
        return row.text
    return row.text.replace("\n", "")


def _query(spark, docs, tmp_path):
    path = str(tmp_path / "t")
    docs.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return sorted((tuple(r) for r in queries.op13_merkle(spark, path).collect()), key=str)


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_manifest_as_brute_force(spark, odd, tmp_path, monkeypatch, levels):  # noqa: F811
    """Nulls in every column, repeated rows, ties of keys, new lines, one group with most rows; few and many rounds."""
    monkeypatch.setattr(merkle.manifest, "__defaults__", ("source", "doc_id", 3, levels))
    extra = [(200 + i, f"line {i}\nnext\n" if i % 3 else f"é{i}", "en", ["a", "b", None, "Z", "é", "", "lone"][min(i, 6) if i < 7 else i % 6], i) for i in range(60)]
    extra += [(200, "other\ntext", None, "a", None), (None, "x\ny", "de", "b", 3), (None, "x\ny", "de", "b", 3), (7, None, None, None, None)]
    docs = odd.unionByName(spark.createDataFrame(extra, "doc_id bigint, text string, lang string, source string, n_chars bigint"), allowMissingColumns=True).withColumn("leaf", F.lit("clash"))
    assert _query(spark, docs.repartition(5), tmp_path) == _brute(docs.collect(), _tampered)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_one_group_of_any_size(spark, tmp_path, n):
    docs = spark.createDataFrame([(i, f"t\n{i}", "en", "s", i) for i in range(n)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = _query(spark, docs, tmp_path)
    assert got == _brute(docs.collect(), _tampered) and {r[6] for r in got} <= {bool(zlib.crc32(str(r[0]).encode()) % 2) for r in got}


def test_manifest_of_an_empty_table(spark, none, tmp_path):  # noqa: F811
    assert _query(spark, none, tmp_path) == []


def test_proofs_can_be_folded_alone():
    leaves = [bytes([i]) * 32 for i in range(29)]
    root, proofs = merkle.collapse(leaves, None)
    assert all(merkle.fold(x, [(i, 29)], p) == root for i, (x, p) in enumerate(zip(leaves, proofs)))
    assert merkle.fold(leaves[3], [(4, 29)], proofs[4]) != root and merkle.collapse(leaves[:1], None) == (leaves[0], [b""])
