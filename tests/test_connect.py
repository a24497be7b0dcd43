"""Connections of broken vessels against relaxation over the whole volume; corrected p-values against sorting."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import stats as T
from tessera.operators import connect as C

AT = "vol_id bigint, x int, y int, z int"
STEPS = [d for d in product((-1, 0, 1), repeat=3) if any(d)]


def _least_costs(cost, start):
    """Cheapest cost of every voxel by relaxing all of them until nothing changes."""
    d = np.full(cost.shape, np.inf)
    d[start] = 0
    while True:
        old, p = d.copy(), np.pad(d, 1, constant_values=np.inf)
        for s in STEPS:
            near = p[tuple(slice(1 + c, 1 + c + n) for c, n in zip(s, d.shape))]
            d = np.minimum(d, near + cost * np.linalg.norm(s))
        if np.array_equal(d, old):
            return d


def _component(mask, start):
    got, todo = set(), [start] if mask[start] else []
    while todo:
        p = todo.pop()
        if p in got:
            continue
        got.add(p)
        todo += [q for s in STEPS if (q := tuple(a + b for a, b in zip(p, s))) not in got and all(0 <= c < n for c, n in zip(q, mask.shape)) and mask[q]]
    return got


def _volume(spark, seed):
    r = np.random.default_rng(seed)
    shape = (7, 6, 5)
    score, mask = np.round(r.random(shape) * 2, 3), r.random(shape) < 0.08
    ends = [tuple(p) for p in np.argwhere(mask)[:4].tolist()] + [(6, 5, 4)]
    rows = [(seed, *p, float(score[p]), bool(mask[p]), bool(mask[p])) for p in np.ndindex(shape)]
    vox = spark.createDataFrame(rows + [(seed, 0, 0, 0, None, True, True), (seed, None, 0, 0, 1.0, None, None)], AT + ", score double, mask boolean, skeleton boolean")
    return score, mask, ends, vox, spark.createDataFrame([(seed, *p) for p in ends + ends[:1]], AT)


@pytest.mark.parametrize("quality", [None, 0.5])
def test_connections_are_the_cheapest(spark, quality):
    for seed in (1, 2):
        score, mask, ends, vox, table = _volume(spark, seed)
        cost = np.maximum(np.where(score > 0, 1 / (4 * np.maximum(score, 1e-9)), 1), 1 / 60)
        limit = np.inf if quality is None else quality
        cut, whole = (C.connect_ends(vox, table, 9, quality, to_skeleton=False, block=b).collect() for b in ((3, 3, 2), (64, 64, 32)))
        assert sorted(cut) == sorted(whole)
        paths = {}
        for r in sorted(whole, key=lambda r: r.step):
            paths.setdefault((r.sx, r.sy, r.sz), []).append(r)
        for e in ends:
            own, d = _component(mask, e), _least_costs(cost, e)
            others = [o for o in ends if o not in own and o != e]
            got = paths.get(e)
            if others:
                o = min(others, key=lambda o: (sum((a - b) ** 2 for a, b in zip(o, e)), o))
                if got and got[0].kind == C.TO_END:
                    assert (got[-1].x, got[-1].y, got[-1].z) == o
                    want = d[o]
                else:
                    want = min(d[p] for p in map(tuple, np.argwhere(mask).tolist()) if p not in own)
            else:
                want = min(d[p] for p in map(tuple, np.argwhere(mask).tolist()) if p not in own)
            if got is None:
                assert quality is not None
                continue
            at = [(r.x, r.y, r.z) for r in got]
            assert at[0] == e and [r.step for r in got] == list(range(len(at)))
            steps = np.diff(np.array(at), axis=0)
            assert np.abs(steps).max() == 1
            along = sum(cost[p] * np.linalg.norm(s) for p, s in zip(at[1:], steps))
            assert along == pytest.approx(want) and got[0].cost == pytest.approx(want) and got[0].cost / len(at) < limit


def test_traces_to_the_mask_and_lines_to_the_skeleton(spark):
    n = 8
    rows = [(0, x, 0, 0, 1.0, x < 2 or x > 4, x == 7) for x in range(n)]
    vox = spark.createDataFrame(rows, AT + ", score double, mask boolean, skeleton boolean")
    start = spark.createDataFrame([(0, 1, 0, 0)], AT)
    assert sorted(r.x for r in C.trace_to_mask(vox, start).collect()) == [1, 2, 3, 4, 5]
    assert sorted(r.x for r in C.connect_ends(vox, start).collect()) == [1, 2, 3, 4, 5, 6, 7]
    assert C.connect_ends(vox, start, radius=2).count() == 0
    assert C.connect_ends(vox, start.limit(0)).count() == 0 and C.connect_ends(vox.limit(0), start).count() == 0
    added = C.add_connections(vox.filter("mask"), C.trace_to_mask(vox, start), vox)
    assert sorted(r.x for r in added.collect()) == list(range(n))


def test_voxels_go_only_to_blocks_with_an_end_near_them(spark):
    rows = [(v, x, y, z, 1.0, x == 3, False) for v in range(3) for x in range(4) for y in range(4) for z in range(4)]
    rows += [(3, x, 0, 0, 1.0, False, False) for x in range(-40, 40)]
    vox = spark.createDataFrame(rows, AT + ", score double, mask boolean, skeleton boolean")
    ends = spark.createDataFrame([(0, 0, 0, 0), (1, 0, 0, 0), (3, 1, 0, 0), (None, 0, 0, 0)], AT)
    sent = [tuple(r) for r in C.near_ends(vox, ends, 3, (64, 64, 32)).select("vol_id", "bx", "by", "bz", "x").collect()]
    assert {r[:4] for r in sent} == {(0, 0, 0, 0), (1, 0, 0, 0), (3, 0, 0, 0)}
    # each voxel once, and a row for the end; of the line only what the end sees, in the block beside its own too
    assert [sum(r[0] == v for r in sent) for v in (0, 1, 3)] == [65, 65, 8]
    assert sorted({r[4] for r in sent if r[0] == 3}) == list(range(-2, 5))


def test_scores_that_are_no_number_cost_one(spark):
    vox = spark.createDataFrame([(0, x, 0, 0, float("nan") if x == 1 else 1.0, x == 3, False) for x in range(4)], AT + ", score double, mask boolean, skeleton boolean")
    got = C.trace_to_mask(vox, spark.createDataFrame([(0, 0, 0, 0)], AT)).collect()
    assert sorted(r.x for r in got) == [0, 1, 2, 3] and got[0].cost == pytest.approx(1.5)


def test_corrections_of_one_family_and_of_many(spark):
    r = np.random.default_rng(4)
    p = np.concatenate([np.round(r.random(400), 3), np.ones(300), r.random(300) * 1e-6])
    ranks = np.searchsorted(np.sort(p), p, side="right")
    order = np.argsort(-p, kind="stable")
    want = np.empty(len(p))
    want[order] = np.minimum(np.minimum.accumulate((p * len(p) / ranks)[order]), 1)
    # equal values share the smallest of their results
    want = np.array([want[p == x].min() for x in p])
    df = spark.createDataFrame([(i, 0, float(x), 9.0) for i, x in enumerate(p)] + [(-1, 0, None, 9.0)], "i bigint, g int, p double, q double")
    for got in (T.correct_p_values(df), T.correct_p_values(df, keys=["g"])):
        rows = {x.i: x.q for x in got.collect()}
        assert rows.pop(-1) is None and got.columns == df.columns
        assert np.allclose([rows[i] for i in range(len(p))], want, rtol=1e-12)
    assert {x.i: x.q for x in T.correct_p_values(df, method="Bonferroni").collect()}[999] == pytest.approx(min(p[999] * 1000, 1))
    assert T.correct_p_values(df.limit(0)).count() == 0
    assert df.filter(F.col("i") < 0).transform(T.correct_p_values).first().q is None
