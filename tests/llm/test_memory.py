"""Memory of steps that cut whole texts into words."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from tessera.llm import shared, substring_dedup


def test_arrow_batches_are_small_while_a_step_runs(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    sizes = lambda: spark.range(0, 5000, 1, 1).mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in bs), "n long").toPandas()["n"].max()
    with shared.arrow_rows(spark, 700):
        assert sizes() <= 700
    assert spark.conf.get(name) == before and sizes() > 700


def test_segments_hold_little_beside_a_batch():
    r = np.random.default_rng(1)
    texts = [" ".join(map(str, r.integers(0, 3000, 400))) for _ in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array([b"x"] * 1500), pa.array(texts)], ["key", "tid", "text"])
    got = {}
    docs = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))), mapInArrow=lambda f, ddl: got.update(run=f))
    substring_dedup.segments(docs, 13, 5, (np.zeros(1, np.int64), np.zeros(1, bool)))
    tracemalloc.start()
    list(got["run"](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16e6  # a megabyte of text at a time takes more
