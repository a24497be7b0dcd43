"""Connected components: contraction inside partitions, then alternating large-star and small-star steps.

First each task replaces the links of its partition (at most ``TASK_LINKS``) by stars with the
same components; a graph of one partition is done then. Every further step is a partial aggregation and an equi-join on node ids, so a node with
very many neighbours is pre-aggregated, and its join partition can be split by the
adaptive planner. Each round's edges are written to the shared folder: lineage
stays short and a lost executor costs a reread. The rounds end when the edges are stars, which
is tested exactly; there is no limit on their number.

Joins are merged by hint: written tables of numbers compress so well that their size on disk would have Spark
broadcast tables of millions of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.scratch import Scratch

#: Links that one task contracts (16 bytes each).
TASK_LINKS = 1_000_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of all nodes but the smallest ones, by min-label rounds with pointer jumping."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [b for b in batches if b.num_rows]
    if got:
        t = pa.Table.from_batches(got)
        hi, lo = stars(t["hi"].to_numpy(), t["lo"].to_numpy())
        for at in range(0, len(hi), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(hi[at : at + 100_000]), pa.array(lo[at : at + 100_000])], ["hi", "lo"])


def _are_stars(edges: DataFrame) -> bool:
    """Every node has one smaller neighbour at most, and that one has none."""
    if edges.groupBy("hi").count().filter("count > 1").limit(1).count():
        return False
    return not edges.join(edges.select(F.col("hi").alias("lo")).hint("merge"), "lo", "left_semi").limit(1).count()


def connected_components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """node, component (the smallest node) of every node of ``links`` (a, b: long; null ends and loops are ignored)."""
    edges = links.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    raw = scratch.save(edges, f"{name}-raw")
    parts = -(-raw.count() // TASK_LINKS)
    edges = scratch.save(raw.coalesce(max(1, parts)).mapInArrow(_contract, "hi bigint, lo bigint").distinct(), f"{name}-0")
    scratch.drop(f"{name}-raw")
    i, done = 0, parts <= 1
    while not done:
        i += 1
        both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        large = both.join(least.hint("merge"), "hi").filter("lo > hi and lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least.hint("merge"), "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.hi", "e.lo").filter("hi <> lo").distinct()
        edges = scratch.save(small, f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
        done = _are_stars(edges)
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
