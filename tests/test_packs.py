"""Blocks that own nothing are neither sent nor computed, small ones are computed together, and searches run side by side, with the same results."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import connect as C
from tessera.plans import blocks as B
from tessera.plans import fixtures as fx


def test_voxels_are_sent_to_existing_blocks_only(spark, sf_dir):
    v = fx.vox(spark, sf_dir).filter("vol_id < 3")
    assert B.spread(v, (2, 2, 2), (3, 3, 3)).count() == v.count() * 8
    far = v.select(F.lit(0).cast("long").alias("vol_id"), (F.col("x") + F.col("vol_id") * 40 - 50).alias("x"), "y", "z", "v")
    sent = B.spread(far, (8, 3, 2), (9, 2, 3)).select("x", "y", "z", "bx", "by", "bz").collect()
    at = [(r.x, r.y, r.z) for r in far.select("x", "y", "z").distinct().collect()]
    size, halo = (8, 3, 2), (9, 2, 3)
    own = {tuple(c // s for c, s in zip(p, size)) for p in at}
    want = {(*p, *b) for p in at for b in own if all((c - h) // s <= k <= (c + h) // s for c, s, h, k in zip(p, size, halo, b))}
    assert len(sent) == len(want) and {tuple(r) for r in sent} == want


def test_paths_side_by_side():
    rng = np.random.default_rng(3)
    cost = rng.random((12, 3, 5, 4)) + 0.05
    cost[rng.random(cost.shape) < 0.2] = np.inf
    goal, mask = rng.random(cost.shape) < 0.1, rng.random(cost.shape) < 0.4
    start = np.stack([rng.integers(0, k, 12) for k in cost.shape[1:]], axis=1)
    parts = C.components_at(mask, start)
    for i, (path, total) in enumerate(C.cheapest_paths(cost, start, goal)):
        alone = C.cheapest_path(cost[i], tuple(start[i]), goal[i])
        assert total == alone[1] and np.array_equal(path, alone[0])
        assert np.array_equal(parts[i], C.components_at(mask[i : i + 1], start[i : i + 1])[0])


def test_packed_blocks_give_what_single_ones_give(spark, sf_dir):
    v = fx.vox(spark, sf_dir).filter("vol_id < 12 and (x + y + z + vol_id) % 7 > 0").withColumn("x", F.col("x") - 2)

    def kernel(values, stored, _, owned):
        near, there = B.gather(values, stored, B.box())
        return {"v": np.where(there, near, 0).sum(-1) * 100 + there.sum(-1), "n": np.full(values.shape, values.shape[0])}

    out = {"v": "bigint", "n": "bigint"}
    got = B.map_blocks(v, kernel, out, (3, 3, 2), pack=1).collect()
    want = B.map_blocks(v, kernel, out, (3, 3, 2)).collect()
    key = lambda rows: sorted((r.vol_id, r.x, r.y, r.z, r.v) for r in rows)
    assert key(got) == key(want) and max(r.n for r in got) > 5 >= max(r.n for r in want)
