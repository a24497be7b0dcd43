"""Watersheds from seeds, block by block.

A watershed of -v from seeds is the forest of best edges in which every tree holds one seed: voxels that share a face are joined by an
edge of height min(v, v'), higher edges are better, and a voxel belongs to the seed of its tree. Ties are decided by a total order
(the higher of the two values, then the smaller place, then the axis), so the forest is unique and doesn't depend on
blocks or on the order of rows.

1. Inside a block, every part without a seed joins along its best edge, as long as that edge stays inside (the halo of one
   voxel shows the edges that leave). All edges of such a part are known, so the joins are those of the whole volume.
2. What is left are parts that wait for a neighbouring block: a graph of parts, with the best edge of each pair inside a block and the edges
   across block borders (the pass table).
3. That graph is contracted in rounds: each part without a seed chooses its best edge, chosen edges are united by connected components, and
   pairs keep their best edge. A graph of at most ``TASK_EDGES`` edges is finished in one task.

No volume is whole in a task; a block and its halo are.

Edge cases: voxels at or below the level, and voxels that are not stored, are not flooded; seeds on them are dropped, as are seeds
without a positive label. Of several seeds on one voxel the smallest counts. A label may have several seeds. Voxels that no seed reaches are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import connected_components
from tessera.plans.blocks import BLOCK, Shape, map_blocks
from tessera.plans.scratch import Scratch

AXES = ("x", "y", "z")
#: Edges of parts that one task finishes (48 bytes each).
TASK_EDGES = 1_000_000
#: Coordinates are packed in 21 bits each.
_OFFSET = 1 << 20


def pack(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    return ((x.astype(np.int64) + _OFFSET) << 42) | ((y.astype(np.int64) + _OFFSET) << 21) | (z.astype(np.int64) + _OFFSET)


def _unite(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component."""
    low = np.arange(n)
    while len(a):
        u, v = low[a], low[b]
        apart = u != v
        if not apart.any():
            break
        a, b, u, v = a[apart], b[apart], u[apart], v[apart]
        np.minimum.at(low, np.maximum(u, v), np.minimum(u, v))
        while True:
            up = low[low]
            if np.array_equal(up, low):
                break
            low = up
    return low


def grow(a: np.ndarray, b: np.ndarray, rank: np.ndarray, label: np.ndarray, outer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(part, label) of every node: parts without a label join along their best (highest rank) edge, unless it leads to an ``outer`` node; then they wait."""
    n = len(label)
    part, label = np.arange(n), label.copy()
    while len(a):
        x, y = part[a], part[b]
        live = (x != y) & ~((label[x] > 0) & (label[y] > 0))
        a, b, rank, x, y = a[live], b[live], rank[live], x[live], y[live]
        best = np.full(n, -1, np.int64)
        np.maximum.at(best, x, rank)
        np.maximum.at(best, y, rank)
        asks = lambda p: (best[p] == rank) & (label[p] == 0) & ~outer[p]  # noqa: E731, B023
        chosen = (asks(x) & ~outer[y]) | (asks(y) & ~outer[x])
        if not chosen.any():
            break
        low = _unite(n, x[chosen], y[chosen])
        top = np.zeros(n, np.int64)
        np.maximum.at(top, low, np.where(part == np.arange(n), label, 0))
        part = low[part]
        label = top
    return part, label[part]


def _ranks(w: np.ndarray, u: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray, axis: np.ndarray) -> np.ndarray:
    """Place of each edge in the total order, the best one last."""
    order = np.lexsort((-axis, -z, -y, -x, u, w))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank


def _flood_block(values: np.ndarray, stored: np.ndarray, low: np.ndarray, owned: tuple[slice, slice, slice]) -> dict[str, np.ndarray]:
    v, seed = values[..., 0], values[..., 1]
    inner = np.zeros(stored.shape, bool)
    inner[owned] = stored[owned]
    number = np.full(stored.shape, -1, np.int64)
    places = np.argwhere(stored)
    number[stored] = np.arange(len(places))
    flat_v, own = v[stored], inner[stored]
    label = np.where(own, seed[stored], 0).astype(np.int64)
    starts, ends, axes = [], [], []
    for axis in range(3):
        p, q = number[tuple(slice(None, -1) if i == axis else slice(None) for i in range(3))].ravel(), number[tuple(slice(1, None) if i == axis else slice(None) for i in range(3))].ravel()
        both = (p >= 0) & (q >= 0)
        p, q = p[both], q[both]
        some = own[p] | own[q]
        starts.append(p[some])
        ends.append(q[some])
        axes.append(np.full(int(some.sum()), axis))
    a, b, axis = np.concatenate(starts), np.concatenate(ends), np.concatenate(axes)
    w, u = np.minimum(flat_v[a], flat_v[b]), np.maximum(flat_v[a], flat_v[b])
    at = places + low
    rank = _ranks(w, u, *at[a].T, axis)
    part, of = grow(a, b, rank, label, ~own)
    # a part is known by its smallest place
    code = pack(*at.T)
    name = np.full(len(code), np.iinfo(np.int64).max)
    np.minimum.at(name, part, code)
    root = name[part]
    x, y = part[a], part[b]
    inside = own[a] & own[b]
    open_ = np.flatnonzero(inside & (x != y) & ((of[a] == 0) | (of[b] == 0)))
    if len(open_):  # the best edge of each pair of parts
        lo, hi = np.minimum(x[open_], y[open_]), np.maximum(x[open_], y[open_])
        order = np.lexsort((rank[open_], hi, lo))
        last = np.append((lo[order][1:] != lo[order][:-1]) | (hi[order][1:] != hi[order][:-1]), True)
        open_ = open_[order[last]]
    across = np.flatnonzero(own[a] & ~own[b])
    e = np.concatenate([open_, across])
    vox = np.flatnonzero(own)
    p = np.concatenate([vox, a[e]])
    other = np.concatenate([np.full(len(vox), -1), np.where(inside[e], root[b[e]], -1)])
    zero = np.zeros(len(vox))
    return {
        "x": at[p, 0], "y": at[p, 1], "z": at[p, 2], "kind": np.concatenate([np.zeros(len(vox), np.int64), 1 + axis[e]]), "root": root[p], "label": of[p],
        "other": other, "w": np.concatenate([zero, w[e]]), "u": np.concatenate([zero, u[e]]),
    }


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    a, b, la, lb = (t[c].to_numpy() for c in ("a", "b", "la", "lb"))
    key = [t[c].to_numpy() for c in ("w", "u", "nx", "ny", "nz", "naxis")]
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.zeros(len(nodes), np.int64)
    np.maximum.at(label, ends, np.concatenate([la, lb]))
    order = np.lexsort(tuple(reversed(key)))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    _, found = grow(ends[: len(a)], ends[len(a) :], rank, label, np.zeros(len(nodes), bool))
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(found)], ["node", "label"])


_KEY = ("w", "u", "nx", "ny", "nz", "naxis")


def _grown(edges: DataFrame, scratch: Scratch, task_edges: int) -> DataFrame:
    """node, label of the nodes of ``edges`` (a, b, their labels la, lb with 0 for none, and the key of the order)."""
    edges = scratch.save(edges, "edges-0")
    assigned, i = None, 0
    while True:
        count = edges.count()
        if count <= task_edges:
            found = scratch.save(edges.coalesce(1).mapInArrow(_finish, "node bigint, label bigint"), "found")
            break
        i += 1
        both = edges.select("a", "b", "la", *_KEY).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("lb").alias("la"), *_KEY))
        chosen = scratch.save(both.filter("la = 0").groupBy("a").agg(F.max_by("b", F.struct(*_KEY)).alias("b")), f"chosen-{i}")
        united = scratch.save(connected_components(chosen, scratch, f"parts-{i}"), f"united-{i}")
        known = edges.select(F.col("a").alias("node"), F.col("la").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("lb").alias("label")))
        tops = scratch.save(known.join(united, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.max("label").alias("label")), f"tops-{i}")
        moved = united.join(tops, "component")
        for end in ("a", "b"):
            own = moved.select(F.col("node").alias(end), F.col("component").alias("_c"), F.col("label").alias("_l"))
            edges = edges.join(own, end, "left").withColumns({end: F.coalesce("_c", end), f"l{end}": F.coalesce("_l", f"l{end}")}).drop("_c", "_l")
        pairs = edges.filter("a <> b and (la = 0 or lb = 0)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("la")).otherwise(F.col("lb")).alias("la"), F.when(F.col("a") < F.col("b"), F.col("lb")).otherwise(F.col("la")).alias("lb"), *_KEY)
        best = pairs.groupBy("a", "b").agg(F.max(F.struct(*_KEY, "la", "lb")).alias("e")).select("a", "b", "e.*")
        edges = scratch.save(best, f"edges-{i}")
        step = united.select("node", "component")
        if assigned is None:
            assigned = step
        else:  # earlier nodes follow their part, and this round's nodes join them
            later = step.select(F.col("node").alias("component"), F.col("component").alias("_next"))
            assigned = assigned.join(later, "component", "left").select("node", F.coalesce("_next", "component").alias("component")).unionByName(step.join(assigned.select("node"), "node", "left_anti"))
        assigned = scratch.save(assigned, f"assigned-{i}")
        labels = tops.withColumnsRenamed({"component": "node"})
        done = labels if i == 1 else labels.unionByName(done.join(labels.select("node"), "node", "left_anti"))
        done = scratch.save(done, f"done-{i}")
    if assigned is None:
        return found
    top = done.join(found.withColumnRenamed("label", "_f"), "node", "full").select("node", F.greatest(F.coalesce("_f", F.lit(0)), F.coalesce("label", F.lit(0))).alias("label"))
    moved = assigned.join(top.withColumnRenamed("node", "component"), "component").select("node", "label")
    return moved.unionByName(top.join(assigned.select("node"), "node", "left_anti"))


def watershed(vox: DataFrame, seeds: DataFrame, level: float, block: Shape = BLOCK, task_edges: int = TASK_EDGES) -> DataFrame:
    """vol_id, x, y, z, label: flooding of -v from the seeds (vol_id, x, y, z, label) over voxels above the level, by faces, highest first."""
    scratch = Scratch(vox.sparkSession, "flood")
    at = ["vol_id", *AXES]
    first = seeds.filter("label > 0").groupBy("vol_id", *[F.col(a).cast("int").alias(a) for a in AXES]).agg(F.min("label").cast("long").alias("seed"))
    both = vox.filter(F.col("v") > level).select("vol_id", *[F.col(a).cast("int").alias(a) for a in AXES], F.col("v").cast("double").alias("v")).join(first, at, "left").fillna(0, ["seed"])
    got = scratch.save(map_blocks(both, _flood_block, {"kind": "bigint", "root": "bigint", "label": "bigint", "other": "bigint", "w": "double", "u": "double"}, block, (1, 1, 1), "float64", ("seed",)), "blocks")
    voxels, edges = got.filter("kind = 0").select(*at, "root", "label"), got.filter("kind > 0")
    on_face = F.lit(False)
    for a, s in zip(AXES, block):
        on_face = on_face | (F.pmod(F.col(a), F.lit(s)) == 0)
    faces = voxels.filter(on_face).select("vol_id", *[F.col(a).alias(f"q{a}") for a in AXES], F.col("root").alias("q_root"))
    q = [(F.col(a) + (F.col("kind") == i + 1).cast("int")).alias(f"q{a}") for i, a in enumerate(AXES)]
    key = [F.col("w"), F.col("u"), *[(-F.col(a)).alias(f"n{a}") for a in AXES], (-F.col("kind")).cast("int").alias("naxis")]
    inside = edges.filter("other <> -1").select("vol_id", "root", F.col("other").alias("q_root"), *key)
    across = edges.filter("other = -1").select("vol_id", "root", *q, *key).join(faces, ["vol_id", "qx", "qy", "qz"]).select("vol_id", "root", "q_root", *_KEY)
    parts = scratch.save(voxels.groupBy("vol_id", "root").agg(F.max("label").alias("label")).withColumn("node", F.monotonically_increasing_id()), "parts")
    end = lambda name, node, label: parts.select("vol_id", F.col("root").alias(name), F.col("node").alias(node), F.col("label").alias(label))
    named = inside.unionByName(across).join(end("root", "a", "la"), ["vol_id", "root"]).join(end("q_root", "b", "lb"), ["vol_id", "q_root"]).filter("la = 0 or lb = 0")
    found = _grown(named.select("a", "b", "la", "lb", *_KEY), scratch, task_edges)
    late = parts.filter("label = 0").join(found.withColumnsRenamed({"label": "_label"}), "node").filter("_label > 0").select("vol_id", "root", F.col("_label").alias("label"))
    waited = voxels.filter("label = 0").drop("label").join(late, ["vol_id", "root"])
    return voxels.filter("label > 0").select(*at, "label").unionByName(waited.select(*at, "label"))
