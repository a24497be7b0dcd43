"""Rows of texts that repeat a very frequent passage."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from tessera.llm import substring_dedup


def test_a_repeated_passage_of_a_hot_anchor_is_one_row_a_text():
    r = np.random.default_rng(2)
    passage = " ".join(map(str, r.integers(0, 10**9, 60)))
    texts = [" ".join(map(str, r.integers(0, 10**9, 20))) + f" {passage}" + f" {i} end" * (i % 2) for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([b"x"] * 300), pa.array(texts)], ["key", "tid", "text"])
    data, offsets = substring_dedup.column_bytes(batch.column(2))
    *_, best = substring_dedup.window_anchors(data, offsets, 13, 5)
    anchors, n = np.unique(best.view(np.int64), return_counts=True)
    shared = anchors[n >= 300]
    got = {}
    docs = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))), mapInArrow=lambda f, ddl: got.update(run=f))
    substring_dedup.segments(docs, 13, 5, (shared, np.ones(len(shared), bool)))
    rows = pa.Table.from_batches(list(got["run"](iter([batch]))))
    known = rows.filter(rows["end"].is_valid()).to_pylist()
    assert sorted(x["key"] for x in known) == list(range(1, 300)) and {x["source"] for x in known} == {0}
    assert all((x["start"], x["end"]) == (20, 80) for x in known)


def test_runs_are_not_joined_across_texts():
    which, end = substring_dedup._joined(np.arange(5), np.array([0, 0, 1, 1, 1]), np.array([4, 6, 7, 8, 20]), np.array([2, 1, 1, 3, 1]))
    assert which.tolist() == [0, 2, 4] and end.tolist() == [7, 11, 21]
    none = np.zeros(0, np.int64)
    assert [len(x) for x in substring_dedup._joined(none, none, none, none)] == [0, 0]
